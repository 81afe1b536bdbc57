"""Operators return everything: no first hundred of frames, tests, users or characters."""
from pyspark.sql import functions as F

from faultlens.operators import classify, evidence, extract, history, impact


def test_many_frames_tests_users_and_long_messages(spark):
    frames = [f'  File "src/m{i}.py", line {i + 1}, in f{i}' for i in range(150)]
    tests = [f"FAILED tests/test_a.py::test_{i} - assert {'x' * 700}{i}" for i in range(130)]
    users = [f"user_id=u{i} path" for i in range(30)]
    df = spark.createDataFrame([("a", "\n".join(frames + tests + users))], "artifact_id string, text string")
    assert extract.frame_table(df).count() == 150
    found = extract.failed_test_table(df).orderBy("pos").collect()
    assert [r.name for r in found] == [f"tests/test_a.py::test_{i}" for i in range(130)]
    assert all(r.assertion.endswith(str(i)) and len(r.assertion) > 700 for i, r in enumerate(found))
    assert extract.entity_context(df).first().users == [f"u{i}" for i in range(30)]
    signatures = [spark.range(1).select(history.failure_signature(F.lit("word " * 1000 + end)).alias("s")).first().s for end in ("a", "b")]
    assert signatures[0] != signatures[1]


def test_merge_enriches_by_leaf_in_first_order(spark):
    text = "\n".join(["FAILED tests/b.py::test_two - boom", "FAILED tests/a.py::test_one - late", "FAILED tests/c.py::test_two - other", "FAILED tests/a.py::test_one - later"])
    df = spark.createDataFrame([("a", text)], "artifact_id string, text string")
    got = [(r.name, r.file, r.assertion) for r in extract.failed_test_table(df).orderBy("pos").collect()]
    assert got == [("tests/b.py::test_two", "tests/b.py", "boom"), ("tests/a.py::test_one", "tests/a.py", "late"), ("tests/c.py::test_two", "tests/c.py", "other")]


def test_long_lines_keep_their_trace(spark):
    line = "job failed " + "y" * 600 + " trace_id=00000000000000aa seq=4"
    df = spark.createDataFrame([("a", "job x failed\n" + line)], "artifact_id string, text string")
    rows = {r.seq: r for r in classify.event_table(classify.extract_events(classify.classify_artifacts(df))).collect()}
    assert rows[2].trace_id == "00000000000000aa" and rows[2].sequence == 4 and rows[2].message == line


def test_all_evidence_and_related_tests(spark):
    rows = spark.range(1).select(
        F.lit("a").alias("artifact_id"), F.lit("m").alias("message"),
        F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.struct(F.concat(F.lit("t"), i.cast("string")).alias("name"), F.lit("").alias("assertion"))).alias("failed_tests"))
    assert evidence.evidence_table(evidence.evidence_items(rows)).count() == 41
    sources = spark.createDataFrame([("src/mod.py", "fn")], "file string, symbol string")
    files = spark.createDataFrame([(f"tests/test_{i:02}.py", "import mod") for i in range(30)], "path string, text string")
    assert impact.related_tests(sources, files).count() == 30 and impact.related_tests(sources, files, 10).count() == 10


def test_long_values_stay_whole(spark):
    import json

    from faultlens.operators import incidents
    from faultlens.sources import json_tree, sarif

    long = "word " * 1000 + "end"
    scan = json.dumps({"runs": [{"tool": {"driver": {"name": "t"}}, "results": [
        {"ruleId": "r", "message": {"text": long}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": long}}}]}] * 1001}]})
    found = sarif.sarif_findings(spark.createDataFrame([("a", scan)], "artifact_id string, text string"))
    assert {(r.message, r.file_path) for r in found.select("message", "file_path").distinct().collect()} == {(long, long)}
    assert sarif.top_findings(found, ["artifact_id"], ["pos"]).count() == 1001
    seen = spark.createDataFrame([("k", "timeout", long, 1)], "dedup_key string, kind string, message string, ts long")
    assert incidents.incident_state(seen, ["ts"]).first().message == long
    stored = spark.range(120).selectExpr("cast(id as string) key", "id last_seen")
    assert incidents.list_incidents(stored).count() == 120
    deep = '{"a":' * 150 + "1" + "}" * 150
    assert json_tree.json_nodes(spark.createDataFrame([("a", deep)], "artifact_id string, text string")).count() == 150
