import os
import random

import pytest

from faultlens.operators import longlogs
from faultlens.operators.classify import classify_artifacts
from faultlens.operators.logtext import key_block_lines
from faultlens.sources.artifacts import read_artifacts, read_log_lines

TELLING = [
    ["FAILED tests/a.py::t", "panic: boom"], ["Events:", "  Normal Pulled", "", "  Warning BackOff restarting failed container"], ["npm ERR! code ELIFECYCLE", "npm ERR! errno 1", "", "npm ERR! missing script: build"],
    ["Traceback (most recent call last):", "ValueError: a", "During handling of the above exception, another exception occurred:", "KeyError: b"], ["##[error]it failed"],
    ['{"level":"error","message":"request failed"}'], ["npm ERR! code E404"], ["Events:", "nothing here"], []]


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("logs"), random.Random(6)
    texts = {}
    for i, telling in enumerate(TELLING):
        lines = [rng.choice(["step ok", "", "  ", "downloading é日本", "x" * 40]) + f" {n}" * (n % 3) for n in range(400)]
        at = rng.randrange(300)
        lines[at:at] = telling
        lines[350:350] = ["-----BEGIN PRIVATE KEY-----", *["secret"] * rng.randint(1, 60), "-----END PRIVATE KEY-----"]
        texts[f"l{i}.log"] = rng.choice(["\n", "\r\n"]).join(lines)
    texts["empty.log"], texts["blank.log"], texts["one.log"] = "", "\n\n", "no line end, it failed"
    for name, text in texts.items():
        (folder / name).write_bytes(text.encode())
    (folder / "bad.log").write_bytes(b"ok\nerror \xff here\n")
    return str(folder)


@pytest.mark.parametrize("pieces", [1, 7, 100])
def test_pieces_give_what_the_whole_log_gives(spark, logs, pieces):
    size = max(os.path.getsize(f"{logs}/{name}") for name in os.listdir(logs))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(1, -(-size // pieces))))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        whole = read_artifacts(spark, logs, suffixes=(".log",)).cache()
        lines = read_log_lines(spark, logs).cache()
        assert pieces == 1 or lines.rdd.getNumPartitions() >= pieces
        name = lambda path: path.rsplit("/", 1)[1]
        want = {}
        for row in whole.collect():
            own = row.text.split("\n")
            want[name(row.path)] = own[:-1] if own[-1] == "" else own
        got = {}
        for row in lines.collect():
            got.setdefault(name(row.path), {})[row.line_no] = row.line
        assert {n: [x[i] for i in range(len(x))] for n, x in got.items()} == {n: x for n, x in want.items() if x}
        told = {name(r.path): r.message for r in classify_artifacts(whole).collect()}
        assert {name(r.path): r.message for r in longlogs.messages(lines, key="path").collect()} == {n: m for n, m in told.items() if want[n]}
        left = key_block_lines(lines.select("path", "line_no", "line"), ["path"], "line_no")
        assert left.filter("line = 'secret'").count() == 0 and left.filter("line = '[REDACTED:private_key]'").count() == len(TELLING)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.catalog.clearCache()
