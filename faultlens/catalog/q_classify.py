"""Log normalization and classification queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.catalog.registry import Data, query
from faultlens.functions import text as T
from faultlens.functions.text import whole
from faultlens.operators import classify as C, ops, triage

# Label of a whole log built from the line templates. Positions compare by line; inside one line each template has
# one strongest signal. A line's stage can depend on the lines before it.
_SIGNAL_LINES = """
SELECT artifact_id, line_no, tpl, line, kind,
       CASE kind WHEN 'import_error' THEN 'build' WHEN 'compilation_error' THEN 'build' WHEN 'test_failure' THEN 'test'
                 WHEN 'crash_loop' THEN 'deploy' WHEN 'image_pull_error' THEN 'deploy' WHEN 'oom_killed' THEN 'deploy'
                 WHEN 'ci_failure' THEN 'ci'
                 WHEN 'api_rate_limited' THEN CASE WHEN deploy_before THEN 'deploy' ELSE 'ci' END
                 WHEN 'timeout' THEN CASE WHEN deploy_before THEN 'deploy' WHEN ci_before THEN 'ci'
                      WHEN test_before THEN 'test' WHEN build_before THEN 'build'
                      WHEN ci_anywhere THEN 'ci' ELSE 'unknown' END
                 ELSE CASE WHEN ci_before THEN 'ci' ELSE 'build' END END AS stage
FROM (
  SELECT *,
         max(CASE WHEN tpl IN (6, 7, 8) THEN 1 ELSE 0 END) OVER b = 1 AS deploy_before,
         max(CASE WHEN tpl = 9 THEN 1 ELSE 0 END) OVER b = 1 AS ci_before,
         max(CASE WHEN tpl = 3 THEN 1 ELSE 0 END) OVER b = 1 AS test_before,
         max(CASE WHEN tpl IN (1, 2) THEN 1 ELSE 0 END) OVER b = 1 AS build_before,
         max(CASE WHEN tpl = 9 THEN 1 ELSE 0 END) OVER (PARTITION BY artifact_id) = 1 AS ci_anywhere
  FROM {v_line}
  WINDOW b AS (PARTITION BY artifact_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
WHERE kind <> 'unknown'
"""

_LABELS = f"""
first_signal AS (
  SELECT artifact_id, arg_min(kind, line_no) AS kind, arg_min(stage, line_no) AS stage
  FROM ({_SIGNAL_LINES}) GROUP BY artifact_id
),
labelled AS (
  SELECT a.artifact_id, coalesce(f.kind, 'unknown') AS kind, coalesce(f.stage, 'unknown') AS stage
  FROM (SELECT DISTINCT artifact_id FROM {{v_line}}) a LEFT JOIN first_signal f USING (artifact_id)
),
messages AS (
  SELECT artifact_id, coalesce(
           min(CASE WHEN tpl IN (1, 2, 4) THEN line_no * 100 + tpl END),
           min(CASE WHEN tpl = 3 THEN line_no * 100 + tpl END),
           min(CASE WHEN tpl IN (6, 9) THEN line_no * 100 + tpl END),
           max(line_no * 100 + tpl)) % 100 AS tpl
  FROM {{v_line}} GROUP BY artifact_id
)
"""


def artifacts(d: Data):
    """One text per artifact; an artifact has eight lines by construction."""
    return d.gathered(d.v_line, "artifact_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n"
        ).alias("text")
    )


def classified(d: Data):
    return C.classify_artifacts(artifacts(d))


_WRAPPED = """
SELECT artifact_id, line_no,
       CASE tpl % 4 WHEN 0 THEN '##[error] ' || line WHEN 1 THEN 'ERROR: ' || line
            WHEN 2 THEN chr(27) || '[31m' || line || chr(27) || '[0m'
            ELSE '{{"level":7,"msg":"m' || CAST(tpl AS STRING) || '"}}' END AS line,
       CASE WHEN tpl % 4 = 3 THEN 'm' || CAST(tpl AS STRING) ELSE line END AS expected
FROM {v_line}"""


@query("L01_normalize_log", sql=f"SELECT artifact_id, line_no, expected AS line FROM ({_WRAPPED})")
def normalize(d: Data):
    return d.spread(d.sql(_WRAPPED)).select("artifact_id", "line_no", T.normalize_log("line").alias("line"))


@query("C01_stage_of_line", sql="SELECT artifact_id, line_no, stage FROM {v_line}")
def stage_of_line(d: Data):
    return C.classify_lines(d.spread(d.v_line.select("artifact_id", "line_no", "line"))).select("artifact_id", "line_no", "stage")


@query("C02_kind_of_line", sql="SELECT stage, kind, count(*) AS lines FROM {v_line} GROUP BY stage, kind")
def kind_of_line(d: Data):
    lines = C.classify_lines(d.spread(d.v_line.select("line")))
    return lines.groupBy("stage", "kind").agg(F.count(F.lit(1)).alias("lines"))


@query("C03_failure_signals", sql=f"""
SELECT artifact_id, kind, stage FROM (
  SELECT artifact_id, kind, stage, row_number() OVER (PARTITION BY artifact_id, kind ORDER BY line_no) AS rn
  FROM (SELECT artifact_id, line_no, kind, stage FROM ({_SIGNAL_LINES})
        UNION ALL SELECT artifact_id, line_no, 'network_failure', 'deploy' FROM {{v_line}} WHERE tpl = 1
        UNION ALL SELECT artifact_id, line_no, 'ci_failure', 'ci' FROM {{v_line}} WHERE tpl = 8)) WHERE rn = 1""")
def signals(d: Data):
    # Templates 1 and 8 carry a second, weaker signal on the same line.
    found = C.failure_signals(artifacts(d)).select("artifact_id", F.explode(whole("signals")).alias("s"))
    return found.select("artifact_id", "s.kind", "s.stage")


@query("C05_primary_classification", sql=f"WITH {_LABELS} SELECT artifact_id, stage, kind FROM labelled")
def primary(d: Data):
    return classified(d).select("artifact_id", "stage", "kind")


@query("C07_message", sql=f"""WITH {_LABELS}
SELECT m.artifact_id, t.line AS message FROM messages m JOIN {{v_template}} t ON m.tpl = t.tpl""")
def message(d: Data):
    return classified(d).select("artifact_id", "message")


@query("C08_summary", sql=f"""WITH {_LABELS}
SELECT l.kind, substr(t.line, 1, 200) AS summary, count(*) AS artifacts
FROM messages m JOIN {{v_template}} t ON m.tpl = t.tpl JOIN labelled l USING (artifact_id) GROUP BY 1, 2""")
def summary(d: Data):
    return classified(d).groupBy("kind", "summary").agg(F.count(F.lit(1)).alias("artifacts"))


@query("O10_failure_taxonomy", sql=f"""WITH {_LABELS},
placed AS (SELECT artifact_id, CASE WHEN CAST(substr(artifact_id, 2) AS BIGINT) % 3 = 0 THEN 'web' ELSE 'lib' END AS component FROM labelled)
SELECT stage, kind, CASE WHEN kind IN ('timeout', 'api_rate_limited', 'test_failure') THEN 'medium'
                         WHEN kind = 'unknown' THEN 'low' ELSE 'high' END AS severity, component, count(*) AS failures
FROM labelled JOIN placed USING (artifact_id) GROUP BY 1, 2, 3, 4""")
def taxonomy(d: Data):
    number = F.substring("artifact_id", 2, 12).cast("bigint")
    path = F.when(number % 3 == 0, "apps/web/main.py").otherwise("lib/core.py")
    rows = classified(d).withColumn("severity", triage.severity_of(F.col("kind"), F.col("message"), F.lit(False))).withColumn(
        "component", triage.assign_component(F.array(path), [("apps/web/", "web")]))
    return ops.failure_taxonomy(rows)
