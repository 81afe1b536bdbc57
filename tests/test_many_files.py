import os

from pyspark.sql import functions as F

from faultlens.sinks.tables import write_texts
from faultlens.sources.artifacts import read_artifacts


def test_files_are_written_by_tasks_and_read_once(spark, tmp_path):
    texts = {f"{i}.txt": f"a\r\nb é {i}" + "\x00" * (i % 2) for i in range(300)} | {"none.txt": None, "empty.txt": ""}
    rows = spark.createDataFrame(list(texts.items()), "name string, text string")
    for _ in range(2):  # a repeat leaves the same files
        assert write_texts(rows, f"file:{tmp_path}/out", "name") == len(texts)
    files = [(file, open(os.path.join(folder, file), newline="").read()) for folder, _, names in os.walk(tmp_path / "out") for file in names]
    assert sorted(files) == sorted((name, text or "") for name, text in texts.items())
    read = read_artifacts(spark, f"{tmp_path}/out", suffixes=(".txt",))
    assert "Join" not in read._jdf.queryExecution().optimizedPlan().toString()  # no second listing where no sidecars can be
    got = {r.name: r.text for r in read.select(F.element_at(F.split("path", "/"), -1).alias("name"), "text").collect()}
    assert got == {name: text.replace("\r\n", "\n") for name, text in texts.items() if text}  # Spark's readers leave out files without a byte


def test_the_driver_does_not_list_the_files(spark, tmp_path):
    """Tasks list and read what Spark's reader would; no scan of the plan holds a file of the folder."""
    names = ["a.txt", "x/b.txt", "x/y/z/c.txt", "x/y/d e.txt", "k=1/f.txt", "_k=2/g.txt", "é/ü%20.txt", "other.md", "_hidden/h.txt", ".git/i.txt", "x/_j.txt", "x/.k.txt", "x/l.txt._COPYING_", "venv/m.txt"]
    for i, name in enumerate(names):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"text \xff %d\r\n" % i)
    (tmp_path / "in" / "empty.txt").touch()
    (tmp_path / "in" / "none").mkdir()
    (tmp_path / "in" / "broken.txt").symlink_to(tmp_path / "nowhere")
    for folder in (f"{tmp_path}/in", f"file://{tmp_path}/in/"):
        read = read_artifacts(spark, folder, suffixes=(".txt",))
        assert "binaryFile" not in read._jdf.queryExecution().executedPlan().toString() and not [f for f in read.inputFiles() if "/in/" in f]
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where("path LIKE '%.txt' AND path NOT LIKE '%/venv/%'")
        want = files.select(F.sha2("path", 256).alias("artifact_id"), "path", F.lit(".txt").alias("ext"), F.col("length").alias("size"), F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\r\n"), F.lit("\n")).alias("text"))
        assert sorted(map(tuple, read.collect())) == sorted(map(tuple, want.collect())) and read.count() == 7
    (tmp_path / "bare").mkdir()
    assert read_artifacts(spark, str(tmp_path / "bare")).collect() == []
    assert read_artifacts(spark, f"{tmp_path}/in/*/y", suffixes=(".txt",)).count() == 2  # a pattern, by Spark's reader
