"""File discovery and document tables."""
from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from faultlens.functions.text import newline_normalized
from faultlens.plans.lineage import ensure_checkpoint_dir
from faultlens.plans.ordered import running_totals

SUFFIXES = (".log", ".xml", ".sarif", ".json")
# Folders that never hold artifacts, and words that mark a structured report.
IGNORED_FOLDERS = (
    ".git", ".hg", ".svn", ".idea", ".vscode", ".venv", "venv", "env", "node_modules", "vendor", "__pycache__",
    ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".nox", ".cache", ".next", ".nuxt",
)
REPORT_HINTS = (
    "artifact", "junit", "pytest", "test-result", "test_results", "testresults", "surefire", "failsafe", "playwright",
    "cypress", "vitest", "jest", "go-test",
)


def extension(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))).otherwise("")


def list_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, size, modified) of every file; content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def without_sidecars(files: DataFrame) -> DataFrame:
    """Drop ``x.json`` when ``x.log`` lies beside it."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    logs = files.filter(extension(F.col("path")) == ".log").select(stem.alias("_stem")).distinct()
    marked = files.withColumn("_stem", F.when(extension(F.col("path")) == ".json", stem))
    return marked.join(logs, "_stem", "left_anti").drop("_stem")


def supported(files: DataFrame, root: str = "", suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Artifacts by suffix outside ignored folders; XML and JSON need a report word in their path."""
    relative = F.regexp_replace("path", "^.*?\\Q" + root.rstrip("/") + "\\E/", "") if root else F.col("path")
    folders = F.slice(F.split(relative, "/"), 1, F.greatest(F.size(F.split(relative, "/")) - 1, F.lit(0)))
    clean = files.withColumn("ext", extension(F.col("path"))).filter(
        F.col("ext").isin(*suffixes) & ~F.arrays_overlap(folders, F.array(*[F.lit(f) for f in IGNORED_FOLDERS])))
    hinted = F.lower(relative).rlike("|".join(h.replace("-", "\\-") for h in REPORT_HINTS))
    kept = clean.filter(~F.col("ext").isin(".xml", ".json") | hinted)
    # Without both kinds there are no sidecars, and the files are listed and read once.
    return without_sidecars(kept) if {".log", ".json"} <= set(suffixes) else kept


LISTED_ROWS = 10_000  # files of a batch of a listing
FOLDERS = 1000  # that a task lists, about
TASK_BYTES, FILE_BYTES = 128 << 20, 32 << 10  # content that a task reads, about; opening a file counts as so many bytes
BATCH_BYTES = 8 << 20  # content held before it is handed on, and at most one file more


def _lister():
    """Files and folders right in each folder ``path``; names that Spark's readers leave out are left out, as are files without a byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("path", pa.string()), ("size", pa.int64()), ("folder", pa.bool_())])
        for folders in batches:
            for path in folders.column("path").to_pylist():
                rows = []
                with os.scandir(path.removeprefix("file:")) as entries:
                    for entry in entries:
                        if entry.name.startswith(".") or (entry.name.startswith("_") and "=" not in entry.name) or entry.name.endswith("._COPYING_"):
                            continue
                        try:
                            folder, size = entry.is_dir(), entry.stat().st_size
                        except FileNotFoundError:  # a link to nothing
                            continue
                        if folder or size:
                            rows.append((f"{path.rstrip('/')}/{entry.name}", size, folder))
                        if len(rows) >= LISTED_ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*rows)], schema=shape)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*rows)], schema=shape)

    return run


def _reader():
    """Files ``path, ext, size`` with their content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            content, begin, held = [], 0, 0
            for end, path in enumerate(files.column("path").to_pylist(), 1):
                with open(path.removeprefix("file:"), "rb") as file:
                    content.append(file.read())
                held += len(content[-1])
                if held >= BATCH_BYTES or end == files.num_rows:
                    yield pa.RecordBatch.from_arrays([*files.slice(begin, end - begin).columns, pa.array(content, pa.binary())], ["path", "ext", "size", "content"])
                    content, begin, held = [], end, 0

    return run


def _local_folder(spark: SparkSession, folder: str) -> str | None:
    """The folder as Spark writes its path, if it lies in a file system that is mounted everywhere; None for stores, patterns and what is no folder."""
    if any(c in folder for c in "*?[{"):
        return None
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    named = system.makeQualified(path).toString()
    return named if named.startswith("file:/") and system.exists(path) and system.getFileStatus(path).isDirectory() else None


def _files_below(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of every file below a mounted folder, level by level: tasks list the folders that tasks found, and nothing is held by the driver."""
    target = f"{ensure_checkpoint_dir(spark).rstrip('/')}/faultlens-files-{uuid.uuid4().hex}"
    shape = "path string, size bigint, folder boolean"
    levels, folders, many = [], spark.createDataFrame([(root,)], "path string"), 1
    while many:
        levels.append(f"{target}/{len(levels)}")
        tasks = min(many, max(4 * spark.sparkContext.defaultParallelism, many // FOLDERS))
        folders.repartition(tasks, "path").mapInArrow(_lister(), shape).write.parquet(levels[-1])
        folders = spark.read.schema(shape).parquet(levels[-1]).where("folder").select("path")
        many = folders.count()
    return spark.read.schema(shape).parquet(*levels).where("NOT folder").select("path", "size")


def read_artifacts(spark: SparkSession, folder: str, recursive: bool = True, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """artifact(artifact_id, path, ext, size, text) of the supported files below a folder.

    Path filters run before content is loaded. Undecodable bytes become replacement characters. Below a folder that executors have mounted, tasks
    list and read the files, so their number is no matter to the driver; elsewhere Spark's reader lists them there.
    """
    root = _local_folder(spark, folder) if recursive else None
    if root is not None:
        files = supported(_files_below(spark, root), folder, suffixes).select("path", "ext", "size")
        work = files.agg(F.coalesce(F.sum(F.col("size") + FILE_BYTES), F.lit(0))).first()[0]
        tasks = max(spark.sparkContext.defaultParallelism, -(-work // TASK_BYTES))
        found = files.repartition(tasks, "path").mapInArrow(_reader(), "path string, ext string, size bigint, content binary")
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
        found = supported(files.select("path", F.col("length").alias("size"), "content"), folder, suffixes)
    text = newline_normalized(decode_text(F.col("content")))
    return found.select(F.sha2("path", 256).alias("artifact_id"), "path", "ext", "size", text.alias("text"))


BROADCAST_PIECES = 500_000  # pieces of logs whose numbers go to every task: 40 bytes each


def read_log_lines(spark: SparkSession, folder: str, pattern: str = "*.log") -> DataFrame:
    """line(artifact_id, path, line_no, line) of logs of any size below a folder, numbered from 0.

    Files are cut at line ends into pieces of ``spark.sql.files.maxPartitionBytes``, read in parallel; a line's number is its place in its piece
    plus the lines of the pieces before, which a first pass counts. Lines end at a line feed, a carriage return or both. Undecodable
    bytes become replacement characters. Empty files have no lines.
    """
    files = spark.read.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    rows = files.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_piece"), F.monotonically_increasing_id().alias("_id"), F.make_valid_utf8("value").alias("line"))
    # A piece is read by one task from its first line to its last, so its ids are consecutive, whichever columns are read.
    pieces = rows.groupBy("path", "_piece").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    before = Window.partitionBy("path").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("path", "_piece", (F.coalesce(F.sum("_lines").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    few = offsets.count() <= BROADCAST_PIECES
    return rows.join(F.broadcast(offsets) if few else offsets, ["path", "_piece"]).select(
        F.sha2("path", 256).alias("artifact_id"), "path", (F.col("_id") + F.col("_shift")).alias("line_no"), "line")


def decode_text(content: Column) -> Column:
    """UTF-8 text; invalid sequences become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def parseable(artifacts: DataFrame) -> DataFrame:
    """Structured artifacts only when their reader finds a failing record."""
    from faultlens.sources import reports, sarif

    xml = reports.junit_failures(artifacts.filter(F.col("ext") == ".xml")).select("artifact_id")
    tree = reports.test_json_failures(artifacts.filter(F.col("ext") == ".json")).select("artifact_id")
    stream = reports.go_json_failures(artifacts.filter(F.col("ext") == ".json")).select("artifact_id")
    scan = sarif.first_error(artifacts.filter(F.col("ext") == ".sarif")).select("artifact_id")
    good = xml.unionByName(tree).unionByName(stream).unionByName(scan).distinct()
    structured = F.col("ext").isin(".xml", ".json", ".sarif")
    return artifacts.filter(~structured).unionByName(artifacts.filter(structured).join(good, "artifact_id", "left_semi"))


def listing(files: DataFrame) -> DataFrame:
    """Files in case-insensitive name order."""
    return files.orderBy(F.lower(F.element_at(F.split("path", "/"), -1)), "path")


def numbered_listing(files: DataFrame) -> DataFrame:
    """Files (unique paths) with their place ``pos`` from 0 in that order, counted piece by piece of a range partitioning."""
    named = files.withColumn("_name", F.lower(F.element_at(F.split("path", "/"), -1)))
    return running_totals(named, [], ["_name", "path"], rank="pos").withColumn("pos", F.col("pos") - 1).drop("_name")


RUN_FIELDS = (
    "provider", "run_id", "run_url", "job_id", "job_name", "workflow", "step_name", "conclusion", "pr_number", "base_sha",
    "head_sha",
)
# Field names of deployment sidecars.
DEPLOYMENT_FIELDS = (
    "platform", "environment", "cluster", "target", "namespace", "release", "revision", "previous_revision", "artifact", "strategy", "started_at",
    "migration_version", "outcome", "recovery", "service", "workload", "commit", "image_digest", "finished_at", "previous_commit",
    "previous_image_digest", "customer_impact", "manifest_digest", "previous_manifest_digest", "resource_fingerprint",
    "previous_resource_fingerprint", "previous_migration_version", "runtime_version", "previous_runtime_version", "dependency_fingerprint",
    "previous_dependency_fingerprint", "feature_flag_version", "previous_feature_flag_version", "slo_target", "error_budget_remaining", "runbook_url",
)


def run_context(sidecars: DataFrame, key: str = "artifact_id", text: str = "text") -> DataFrame:
    """Run fields of sidecar JSON: from ``run`` when it is an object, else from the root."""
    at = lambda path: F.get_json_object(text, path)
    nested = F.coalesce(at("$.run").startswith("{"), F.lit(False))
    value = lambda name: F.when(nested, at(f"$.run.{name}")).otherwise(at(f"$.{name}"))
    string = lambda v: F.coalesce(v, F.lit(""))
    number = lambda v: F.when(v.try_cast("int") > 0, v.try_cast("int"))
    some = lambda v: F.nullif(v, F.lit(""))
    url = lambda v: F.when(v.rlike(r"^https?://[^\s/]+"), v).otherwise("")
    return sidecars.select(
        key, *[(url(string(value(name))) if name == "run_url" else string(value(name))).alias(name) for name in RUN_FIELDS],
        string(F.coalesce(some(value("branch")), at("$.git.branch"))).alias("branch"),
        string(F.coalesce(some(value("commit_sha")), at("$.git.head"))).alias("commit_sha"),
        number(value("attempt")).alias("attempt"), number(F.coalesce(value("duration_ms"), at("$.duration_ms"))).alias("duration_ms"))


def deployment_context(sidecars: DataFrame, key: str = "artifact_id", text: str = "text") -> DataFrame:
    """Deployment fields of sidecar JSON as strings; empty where absent."""
    field = lambda name: F.coalesce(F.get_json_object(text, f"$.deployment.{name}"), F.lit("")).alias(name)
    return sidecars.select(key, *[field(name) for name in DEPLOYMENT_FIELDS])


# ------------------------------------------------------------------ labelled cases, manifests and stored reports

_EXPECTED = (
    "struct<stage:string,kind:string,primary_event:struct<stage:string,kind:string>,failed_tests:array<string>,"
    "stack_frames:array<struct<file:string,line:int,function:string>>,severity_range:array<string>,"
    "duplicate_group:string,redactions:array<string>,is_failure:boolean>"
)
CASE_SCHEMA = f"eval_case_version string, id string, artifact string, expected {_EXPECTED}"


def evaluation_cases(documents: DataFrame, text: str = "text", version: str = "1.0") -> DataFrame:
    """Labelled cases with a ``valid`` flag; unreadable documents are invalid rows, not errors."""
    parsed = documents.withColumn("c", F.from_json(text, CASE_SCHEMA))
    ok = (
        (F.col("c.eval_case_version") == version) & (F.coalesce("c.id", F.lit("")) != "") & (F.coalesce("c.artifact", F.lit("")) != "")
        & F.col("c.expected.stage").isNotNull() & F.col("c.expected.kind").isNotNull() & (F.size("c.expected.severity_range") > 0))
    return parsed.select(*documents.columns, "c.*", F.coalesce(ok, F.lit(False)).alias("valid"))


_SPAN = "struct<start:int,end:int,label:string,verified:boolean,text:string>"
MANIFEST_SCHEMA = (
    "manifest_version string, corpus_id string, sources array<struct<id:string,license:string,metadata_url:string>>, "
    f"artifacts array<struct<case_id:string,path:string,source_id:string,license:string,split:string,raw_sha256:string,"
    f"sanitized_sha256:string,evidence_spans:array<{_SPAN}>>>"
)


def manifest_artifacts(documents: DataFrame, text: str = "text") -> DataFrame:
    manifest = documents.select(F.from_json(text, MANIFEST_SCHEMA).alias("m"))
    return manifest.select(F.col("m.corpus_id"), F.inline("m.artifacts"))


def manifest_sources(documents: DataFrame, text: str = "text") -> DataFrame:
    manifest = documents.select(F.from_json(text, MANIFEST_SCHEMA).alias("m"))
    return manifest.select(F.col("m.corpus_id"), F.inline("m.sources")).withColumnRenamed("id", "source_id")


def annotated_chunks(documents: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, pos, chunk, category, keywords) of annotated XML examples with a non-blank chunk."""
    from faultlens.functions.text import strip
    from faultlens.sources.reports import element_blocks

    blocks = documents.select(key, F.posexplode(element_blocks(F.col(text), "Example")).alias("pos", "_x"))
    parsed = blocks.select(key, "pos", F.from_xml("_x", "Chunk string, Category string, Keywords string").alias("e"))
    rows = parsed.select(
        key, "pos", F.col("e.Chunk").alias("chunk"), F.coalesce("e.Category", F.lit("")).alias("category"),
        F.coalesce("e.Keywords", F.lit("")).alias("keywords"))
    return rows.filter(strip(F.coalesce("chunk", F.lit(""))) != "")


REPORT_SCHEMA = (
    "schema_version string, meta struct<engine:string,generated_at:string,log_file:string>, "
    "failure struct<stage:string,kind:string,summary:string>, triage struct<severity:string,component:string,dedup_key:string>"
)


def stored_reports(documents: DataFrame, text: str = "text") -> DataFrame:
    """Stored reports in any order; malformed ones are skipped."""
    parsed = documents.withColumn("r", F.from_json(text, REPORT_SCHEMA)).filter(
        F.col("r.failure.kind").isNotNull() & F.col("r.meta.generated_at").isNotNull())
    return parsed.select(*[c for c in documents.columns if c != text], "r.*")


HISTORY_RECORD = (
    "struct<suite:string,test:string,status:string,attempt:int,duration_ms:int,runner:string,commit_sha:string,branch:string,"
    "environment:string,failure_signature:string,run_id:string,evidence_id:string,recorded_at:string>"
)


def history_manifest(documents: DataFrame, text: str = "text") -> DataFrame:
    """Records of exported history manifests."""
    schema = f"export_version string, schema_version int, count int, records array<{HISTORY_RECORD}>"
    return documents.select(F.inline(F.from_json(text, schema)["records"]))
