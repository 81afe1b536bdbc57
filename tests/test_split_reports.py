import os
import random

import pytest
from pyspark.sql import functions as F

from faultlens.functions.text import newline_normalized
from faultlens.sources.reports import junit_cases, read_junit_cases


def report(rng, cases):
    out = ['<?xml version="1.0"?>\n<testsuites><testsuite name="a > b">\r\n']
    for i in range(cases):
        head = f'<testcase classname="c{i % 5}" name="t{i} é &gt;" time="0.{i % 10}"'
        out.append(rng.choice([
            head + "/>", head + "></testcase>\n", head + f'><failure message="m{i} > {i}">{"trace é " * rng.randint(0, 40)}</failure></testcase>', head + "><skipped/></testcase><system-out>a > b</system-out>",
            head + "><error>bad</error><failure message='again'/></testcase>", head + "><flakyFailure message=\"once\">x</flakyFailure></testcase>",
            f'<junit:testcase name="n{i}">\n<properties><property name="testcase" value="1"/></properties></junit:testcase>']))
    return "".join(out) + "</testsuite></testsuites>\n"


@pytest.mark.parametrize("pieces", [1, 7, 100])
def test_pieces_give_what_the_whole_report_gives(spark, tmp_path, pieces):
    rng, tmp_path = random.Random(9), tmp_path / "junit"
    tmp_path.mkdir()
    for name, cases in (("a.xml", 300), ("b.xml", 40), ("none.xml", 0)):
        (tmp_path / name).write_bytes(report(rng, cases).encode())
    (tmp_path / "typed.xml").write_text('<!DOCTYPE x [<!ENTITY a "b">]>' + report(rng, 50))
    (tmp_path / "empty.xml").write_text("")
    size = os.path.getsize(tmp_path / "a.xml")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(-(-size // pieces)))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        name = lambda path: path.rsplit("/", 1)[1]
        shown = lambda df: sorted(str((name(r.path), *[r[c] for c in df.columns if c != "path"])) for r in df.collect())
        whole = spark.read.text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_path").alias("path"), newline_normalized("value").alias("text"))
        cut = read_junit_cases(spark, str(tmp_path))
        assert shown(cut.select("path", "pos", "name", "file", "suite", "duration_ms", "notes", "rerun", "rerun_message", "skipped")) == shown(junit_cases(whole, "path"))
        assert cut.count() == 340
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_blocks_of_a_piece_give_what_the_whole_report_gives(spark, tmp_path, monkeypatch):
    from faultlens.sources import records

    monkeypatch.setattr(records, "BLOCK", 64)
    folder = tmp_path / "blocks"
    folder.mkdir()
    for name, cases in (("a.xml", 300), ("b.xml", 40), ("none.xml", 0)):
        (folder / name).write_bytes(report(random.Random(3), cases).encode())
    (folder / "typed.xml").write_text('<!DOCTYPE x [<!ENTITY a "b">]>' + report(random.Random(3), 50))
    name = lambda path: path.rsplit("/", 1)[1]
    columns = ["pos", "name", "file", "suite", "duration_ms", "notes", "rerun", "rerun_message", "skipped"]
    shown = lambda df: sorted(str((name(r.path), *[r[c] for c in columns])) for r in df.collect())
    whole = spark.read.text(str(folder), wholetext=True).select(F.col("_metadata.file_path").alias("path"), newline_normalized("value").alias("text"))
    cut = read_junit_cases(spark, str(folder))
    assert shown(cut) == shown(junit_cases(whole, "path")) and cut.count() == 340
