"""What the analysis of a log finds inside the log's own row equals what the operators on tables and the published patterns find."""
import random

from pyspark.sql import functions as F

from faultlens.functions.redaction import _FASTER, REDACTIONS, _may_match
from faultlens.operators import extract as X
from faultlens.operators.analysis import analyze_artifacts


def texts(seed, words, n=800, most=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(words) + rng.choice(["", "", " ", " ", "\n"]) for _ in range(rng.randint(0, most))) for _ in range(n)] + ["", None]


def test_context_in_the_row(spark):
    words = ["request_id=a", "request_id=b", "REQ_ID: 'c'", "rid=a", '"traceId":"t1"', "trace_id=t2", "sid=s", "session_id=z", "user=u1", "username:u2", "actor=u1", "method=post", "path=/x/y",
             "GET /a/b", "get\n/c", "POST /a/b", "/", "x", "_", '{"user":"u3"}', "ſid=1", "delete /q?z"]
    df = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts(3, words))], "artifact_id string, text string").repartition(4)
    got = {r.artifact_id: r for r in df.select("artifact_id", X.context_of("text").alias("c")).select("artifact_id", "c.*").collect()}
    want = {r.artifact_id: r for r in X.entity_context(df).collect()}
    assert got == want and sum(r.request_id != "" for r in got.values()) > 100 and sum(len(r.users) > 1 for r in got.values()) > 20 and sum(r.path != "" for r in got.values()) > 100


def test_an_artifact_is_redacted_once_and_stays_in_its_row(spark):
    df = spark.createDataFrame([("a", "job x failed by a@ex.com request_id=r1\nsrc/f.py:3: in run")], "artifact_id string, text string")
    rows = analyze_artifacts(df)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    row = rows.first()
    assert (row.context.request_id, row.redaction_hits, row.kind) == ("r1", 1, "ci_failure") and "@" not in row.text


def test_addresses_are_found_as_published(spark):
    words = ["a", "b.c", "x_y", "%", "+", "-", "@", "@", "ex.com", ".org", "a@b.cob@c.de", "1", ".", "d@e.fg_h@i.jk", "é", ":", "::", "::1", "fe80", "abcd:", "1:2:3:4:5:6:7:8", "py::t", " ::", "[::]", "g::", "\t", "0.0.0.0", "/"]
    df = spark.createDataFrame([(t,) for t in texts(8, words, 3000)], "text string").repartition(4)
    own = dict(REDACTIONS)
    mark = lambda pattern: F.regexp_replace("text", pattern, "<!>")
    six = F.when(_may_match("ipv6_address", F.col("text")), mark(own["ipv6_address"])).otherwise(F.col("text"))
    row = df.agg(
        F.count_if(~mark(_FASTER["email"]).eqNullSafe(mark(own["email"]))), F.count_if(~F.regexp_count("text", F.lit(_FASTER["email"])).eqNullSafe(F.regexp_count("text", F.lit(own["email"])))),
        F.count_if(~six.eqNullSafe(mark(own["ipv6_address"]))), F.count_if(mark(own["email"]) != F.col("text")), F.count_if(six != F.col("text"))).first()
    assert tuple(row)[:3] == (0, 0, 0) and min(tuple(row)[3:]) > 300
