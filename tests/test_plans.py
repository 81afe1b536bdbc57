import random

import pytest
from pyspark.sql import functions as F

from faultlens.operators import evaluate, history, impact, traces
from faultlens.plans import joins
from faultlens.plans.lineage import ensure_checkpoint_dir
from faultlens.plans.ordered import running_totals


def test_running_totals_match_a_plain_scan_with_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 5}", i, rng.randrange(100)) for i in range(600)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = {(r.k, r.o): (r.n, r.s, r.m) for r in running_totals(
        df, ["k"], ["o"], {"s": F.col("v")}, rank="n", maxes_before={"m": F.col("v")}).collect()}
    seen: dict = {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        n, s, m = seen.get(k, (0, 0, None))
        assert got[(k, o)] == (n + 1, s + v, m)
        seen[k] = (n + 1, s + v, v if m is None else max(m, v))


def test_suffix_match_against_all_pairs(spark):
    rng = random.Random(1)
    make = lambda: "/".join(rng.choice("ab") for _ in range(rng.randrange(1, 4)))
    left, right = sorted({make() for _ in range(20)}), sorted({make() for _ in range(20)})
    pairs = joins.suffix_match(
        spark.createDataFrame([(1, p) for p in left], "k int, l string"), spark.createDataFrame([(1, p) for p in right], "k int, r string"), "l", "r", ["k"])
    expected = {(a, b) for a in left for b in right if a == b or a.endswith("/" + b) or b.endswith("/" + a)}
    rows = [(r.l, r.r) for r in pairs.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected


def test_interval_join_against_between(spark):
    rng = random.Random(2)
    points = [(rng.choice("xy"), i, rng.randrange(100)) for i in range(60)]
    ranges = [(rng.choice("xy"), s, s + rng.randrange(30)) for s in (rng.randrange(100) for _ in range(40))]
    got = joins.interval_join(
        spark.createDataFrame(points, "k string, i int, p int"), spark.createDataFrame(ranges, "k string, a int, b int"), ["k"], "p", "a", "b", 7)
    assert sorted((r.i, r.a, r.b) for r in got.collect()) == sorted((i, a, b) for k, i, p in points for q, a, b in ranges if k == q and a <= p <= b)


def test_dedup_metrics_against_pairs(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.choice("xyz")) for _ in range(60)]
    got = evaluate.dedup_metrics(spark.createDataFrame(rows, "duplicate_group string, dedup_key string")).first()
    tp = fp = fn = 0
    for i, (g, k) in enumerate(rows):
        for h, m in rows[i + 1:]:
            same, predicted = g is not None and g == h, k == m
            tp, fp, fn = tp + (same and predicted), fp + (predicted and not same), fn + (same and not predicted)
    assert (got.tp, got.fp, got.fn) == (tp, fp, fn)


def _path(spans):
    by_id = {s[1]: s for s in spans}
    best, length, cyclic = [], 0, False
    for span in spans:
        chain, at = [], span
        while at is not None:
            if at in chain:
                cyclic = True
                break
            chain.append(at)
            at = by_id.get(at[2])
        starts, ends = [c[4] for c in chain if c[4] > 0], [c[5] for c in chain if c[5] > 0]
        took = max(ends) - min(starts) if starts and ends and max(ends) >= min(starts) else max((max(0, c[5] - c[4]) if c[4] and c[5] else 0) for c in chain)
        if took > length:
            best, length = chain, took
    return [c[1] for c in reversed(best)], length, cyclic


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_critical_path_against_a_walk(spark, seed):
    rng = random.Random(seed)
    spans = []
    for trace in range(6):
        size = rng.randrange(1, 14)
        for i in range(size):
            parent = str(rng.randrange(size + 1)) if rng.random() < 0.3 else (str(i - 1) if i else None)
            spans.append((f"t{trace}", str(i), parent, "svc", rng.choice([0, rng.randrange(1, 50)]), rng.choice([0, rng.randrange(1, 200)]), "1", i))
    df = spark.createDataFrame(spans, "trace_id string, span_id string, parent_span_id string, service string, start_ns long, end_ns long, version string, pos int")
    best, path = traces.critical_paths(df)
    chains: dict = {}
    for r in path.orderBy("trace_id", "position").collect():
        chains.setdefault(r.trace_id, []).append(r.span_id)
    for row in best.collect():
        want, took, cyclic = _path([s for s in spans if s[0] == row.trace_id])
        assert (row.duration_ns, row.cycle_detected) == (took, cyclic)
        assert chains.get(row.trace_id, []) == want


def test_long_chain_and_cycle_detection(spark):
    chain = [("a", str(i), str(i - 1) if i else None, i) for i in range(300)] + [("b", "x", "y", 0), ("b", "y", "x", 1), ("c", "z", "z", 0), ("d", "q", "gone", 0)]
    rows = traces.parent_cycles(spark.createDataFrame(chain, "trace_id string, span_id string, parent_span_id string, pos int")).collect()
    assert {r.trace_id: r.has_cycle for r in rows} == {"a": False, "b": True, "c": True, "d": False}


def test_related_tests_are_substrings(spark):
    sources = spark.createDataFrame([("src/cart.py", "add"), ("src/my-mod.py", "")], "file string, symbol string")
    tests = spark.createDataFrame([("tests/a.py", "shopping_cart2()"), ("tests/b.py", "xaddx"), ("lib/c.py", "cart"), ("Test/d.py", "import my-mod")], "path string, text string")
    got = {(r.file, r.path) for r in impact.related_tests(sources, tests).collect()}
    assert got == {("src/cart.py", "tests/a.py"), ("src/cart.py", "tests/b.py"), ("src/my-mod.py", "Test/d.py")}


def test_history_decisions(spark):
    day = "2024-01-{:02d} 00:00:00"
    rows = []

    def add(test, statuses, env="linux", commit="c1", start=1):
        for i, status in enumerate(statuses):
            rows.append(("s", test, f"r{start + i}", 1, status, 10, env, commit, day.format(start + i)))

    add("new", ["passed"] * 6)
    add("known", ["failed"] * 6)
    add("flaky", ["passed"] * 6 + ["failed"] * 4)
    add("suspect", ["passed"] * 24 + ["failed"])
    add("short", ["failed"] * 2)
    add("env", ["failed"] * 3, env="mac")
    add("env", ["passed"] * 4, env="linux", start=10)
    add("base", ["passed"] * 5 + ["failed"] * 2, commit="c0")
    add("base", ["passed"], commit="basis", start=20)
    past = spark.createDataFrame(rows, "suite string, test string, run_id string, attempt int, status string, duration_ms int, environment string, commit_sha string, recorded_at string")
    past = past.withColumn("recorded_at", F.to_timestamp("recorded_at"))
    run = [("now", "s", t, 1, "failed", 500, "mac") for t in ("new", "known", "flaky", "suspect", "short", "env", "base", "fresh")]
    run += [("now", "s", "retry", 1, "failed", 1, "mac"), ("now", "s", "retry", 2, "passed", 1, "mac"), ("now", "s", "new2", 1, "passed", 1, "")]
    current = spark.createDataFrame(run, "run_id string, suite string, test string, attempt int, status string, duration_ms int, environment string")
    got = {r.test: r for r in history.classify_results(history.run_candidates(current), past, baseline_commit="basis").collect()}
    assert {t: r.decision for t, r in got.items()} == {
        "new": "new_failure", "known": "known_failure", "flaky": "historically_flaky", "suspect": "flaky_suspect", "short": "insufficient_history",
        "env": "environment_specific", "base": "likely_regression", "fresh": "insufficient_history", "retry": "retry_recovered", "new2": "insufficient_history"}
    assert got["new"].duration_regression and got["new"].duration_delta_ms == 490 and got["new"].confidence == "medium"


def test_p95_rank_is_half_even(spark):
    df = spark.createDataFrame([("s", "t", i) for i in range(1, 31)], "suite string, test string, duration_ms int")
    row = history.duration_stats(df).first()
    assert (row["count"], row.median_ms, row.p95_ms) == (30, 15, 28)


def test_checkpoint_dir_is_kept_once_set(spark):
    assert ensure_checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()


def test_hot_group_limits_are_applied_before_the_shuffle(spark):
    df = spark.createDataFrame([("s", "t", 1, 1)], "suite string, test string, recorded_at int, attempt int")
    plan = history.latest_history(df, 100)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_metric_movement_reads_sums_at_window_ends(spark):
    import random

    from faultlens.operators.traces import metric_movement

    rng = random.Random(3)
    at = lambda minutes: f"2024-01-01 {10 + minutes // 60:02d}:{minutes % 60:02d}:00"
    # Nearly all samples belong to one service and metric; moments repeat, some values are null.
    samples = [("hot" if rng.random() < 0.9 else "cold", "m" if rng.random() < 0.9 else "n", rng.randrange(300), rng.choice([None, 0.1, 0.2, 7.0])) for _ in range(600)]
    deployments = [(i, rng.choice(["hot", "cold", "gone"]), rng.randrange(300), rng.choice([None, 0, 10])) for i in range(40)] + [(99, "hot", None, None)]
    metrics = spark.createDataFrame([(s, m, at(t), v) for s, m, t, v in samples], "service string, metric string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    table = spark.createDataFrame([(i, s, None if t is None else at(t), None if t is None or n is None else at(t + n)) for i, s, t, n in deployments], "deployment_id int, service string, a string, b string").select(
        "deployment_id", "service", F.to_timestamp("a").alias("started_at"), F.to_timestamp("b").alias("finished_at"))
    out = metric_movement(table, metrics, ["deployment_id"])
    mean = lambda values: round(sum(values) / len(values), 9) if values else None
    expected = []
    for i, service, t, n in deployments:
        for metric in ("m", "n"):
            own = [] if t is None else [(x, v) for s, m, x, v in samples if s == service and m == metric and t - 15 <= x <= t + (n or 0) + 15]
            if own:
                expected.append((i, metric, mean([v for x, v in own if x < t and v is not None]), mean([v for x, v in own if x > t + (n or 0) and v is not None]), len(own)))
    round_ = lambda v: None if v is None else round(v, 9)
    assert sorted((r.deployment_id, r.metric, round_(r.mean_before), round_(r.mean_after), r.samples) for r in out.collect()) == sorted(expected)


def test_listing_is_numbered_over_all_files(spark):
    from faultlens.sources.artifacts import numbered_listing

    paths = [f"/x/{'Ab' if i % 2 else 'aB'}{i % 37}/F{i * 7 % 101}.log" for i in range(400)]
    got = numbered_listing(spark.createDataFrame([(p,) for p in sorted(set(paths))], "path string").repartition(5)).collect()
    assert [r.path for r in sorted(got, key=lambda r: r.pos)] == sorted(set(paths), key=lambda p: (p.rsplit("/", 1)[1].lower(), p)) and {r.pos for r in got} == set(range(len(set(paths))))
