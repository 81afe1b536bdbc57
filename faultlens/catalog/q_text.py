"""Redaction and log window queries; redaction runs over whole documents."""
from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.catalog.registry import Data, query
from faultlens.catalog.views import VIEWS
from faultlens.functions import redaction as R, text as T
from faultlens.operators import logtext as L


def _redaction_sql() -> str:
    """The ordered passes as CTEs for an engine without lookaround; the address form that needs it is absent there."""
    steps = ["s0 AS (SELECT doc_id, text AS t FROM {documents})"]
    carried: list[str] = []
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    for i, (kind, pattern) in enumerate(R.REDACTIONS):
        if kind == "ipv6_address":
            pattern, mark = r"$^impossible", R.marker(kind)
        elif kind == "password":
            pattern, mark = pattern.replace(r"(?<![A-Za-z0-9_])", r"(^|[^A-Za-z0-9_])"), r"\1" + R.marker(kind)
        else:
            mark = R.marker(kind)
        keep = "".join(f", h_{c}" for c in carried)
        pattern = quote(pattern).replace("{", "{{").replace("}", "}}")
        steps.append(
            f"s{i + 1} AS (SELECT doc_id, regexp_replace(t, {pattern}, {quote(mark)}, 'g') AS t{keep}, "
            f"CAST(len(regexp_extract_all(t, {pattern})) AS INT) AS h_{kind} FROM s{i})")
        carried.append(kind)
    total = " + ".join(f"h_{c}" for c in carried)
    return ",\n".join(steps) + f",\nredacted AS (SELECT *, {total} AS hits FROM s{len(R.REDACTIONS)})"


_REDACTED = _redaction_sql()
# Documents with planted shapes of every common kind, one per event.
VIEWS["v_secret_line"] = """
SELECT event_id, CASE CAST(event_id % 10 AS INT)
  WHEN 0 THEN 'Authorization: Basic ' || x || ', next' WHEN 1 THEN 'key AKIA' || lpad(n, 16, '0') || ' used' WHEN 2 THEN 'mail u' || n || '@ex.com from 10.0.0.' || CAST(user_id AS STRING)
  WHEN 3 THEN 'db_password=' || x || ' ok' WHEN 4 THEN 'peer 2001:db8::' || n || ' and 12:30:45' WHEN 5 THEN 'Bearer ' || x || x || ' sent'
  WHEN 6 THEN 'https://u:' || x || '@host/p?token=' || x || '&a=1' WHEN 7 THEN 'plain line ' || n WHEN 8 THEN 'xoxb-' || x || ' gsk_' || x || x ELSE 'postgres://h/' || x END AS line,
 CASE CAST(event_id % 10 AS INT)
  WHEN 0 THEN '[REDACTED:authorization], next' WHEN 1 THEN 'key [REDACTED:aws_key] used' WHEN 2 THEN 'mail [REDACTED:email] from [REDACTED:ip_address]'
  WHEN 3 THEN '[REDACTED:password] ok' WHEN 4 THEN 'peer [REDACTED:ipv6_address] and 12:30:45' WHEN 5 THEN '[REDACTED:bearer] sent'
  WHEN 6 THEN '[REDACTED:url_credentials]host/p[REDACTED:query_credential]&a=1' WHEN 7 THEN 'plain line ' || n WHEN 8 THEN '[REDACTED:slack_token] [REDACTED:groq_key]' ELSE '[REDACTED:connection_string]' END AS clean,
 CASE CAST(event_id % 10 AS INT) WHEN 2 THEN 2 WHEN 6 THEN 2 WHEN 7 THEN 0 WHEN 8 THEN 2 ELSE 1 END AS hits,
 CASE CAST(event_id % 10 AS INT) WHEN 1 THEN 'AKIA' || lpad(n, 16, '0') WHEN 2 THEN 'u' || n || '@ex.com' WHEN 4 THEN '2001:db8::' || n WHEN 7 THEN 'plain line' ELSE x END AS secret
FROM (SELECT event_id, user_id, CAST(event_id % 9999 AS STRING) AS n, 'abc' || lpad(CAST(event_id AS STRING), 12, '0') AS x FROM {events})"""


@query("L04_redact_documents", sql=f"WITH {_REDACTED} SELECT doc_id, md5(t) AS digest, hits FROM redacted")
def redact_documents(d: Data):
    rows = L.redact_artifacts(d.spread(d.documents.select("doc_id", "text")))
    return rows.select("doc_id", F.md5("text").alias("digest"), F.col("redaction_hits").alias("hits"))


@query("L04_redact_lines", sql="SELECT event_id, clean, hits FROM {v_secret_line}")
def redact_lines(d: Data):
    rows = L.redact_artifacts(d.v_secret_line.select("event_id", "line"), "line")
    return rows.select("event_id", F.col("line").alias("clean"), F.col("redaction_hits").alias("hits"))


@query("L05_hit_report", sql=f"WITH {_REDACTED}, k AS (UNPIVOT (SELECT " + ", ".join(
    f"sum(h_{kind}) AS {kind}" for kind, _ in R.REDACTIONS) + " FROM redacted) ON COLUMNS(*) INTO NAME kind VALUE hits) SELECT kind, CAST(hits AS BIGINT) AS hits FROM k WHERE hits > 0")
def hit_report(d: Data):
    return L.hit_report(d.spread(d.documents.select("text")))


@query("L06_redact_values", sql="""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE '[REDACTED:sensitive_field]' END AS api_key, 'plain' AS note, '[REDACTED:sensitive_field]' AS inner_token,
       CASE WHEN event_id % 2 = 0 THEN '[REDACTED:sensitive_field]' ELSE 'v' END AS map_value, '[REDACTED:email]' AS list_item FROM {events}""")
def redact_values(d: Data):
    n = F.col("event_id").cast("string")
    rows = d.events.select(
        "event_id", F.when(F.col("event_id") % 3 == 0, "").otherwise(n).alias("apiKey"), F.lit("plain").alias("note"),
        F.struct(n.alias("accessToken"), F.lit(1).alias("port")).alias("nested"),
        F.create_map(F.when(F.col("event_id") % 2 == 0, "client-secret").otherwise("name"), F.lit("v")).alias("settings"),
        F.array(F.concat(F.lit("u"), n, F.lit("@ex.com"))).alias("items"))
    clean = L.redact_columns(rows)
    return clean.select("event_id", F.col("apiKey").alias("api_key"), "note", F.col("nested.accessToken").alias("inner_token"),
                        F.element_at(F.map_values("settings"), 1).alias("map_value"), F.element_at("items", 1).alias("list_item"))


VIEWS["v_key_line"] = """
SELECT 'k' || CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE floor(event_id / 50) + 1 END AS BIGINT) AS artifact_id, event_id AS line_no,
       CASE CAST(user_id % 12 AS INT) WHEN 0 THEN '-----BEGIN RSA PRIVATE KEY-----' WHEN 1 THEN 'x -----END RSA PRIVATE KEY-----' WHEN 2 THEN '-----BEGIN PRIVATE KEY-----m-----END PRIVATE KEY-----'
         ELSE 'row ' || CAST(event_id AS STRING) END AS line FROM {events}"""
_KEY_STATE = """
SELECT artifact_id, line_no, line, last_value(CASE WHEN line LIKE '%END%' THEN 0 WHEN line LIKE '%BEGIN%' THEN 1 END IGNORE NULLS) OVER (PARTITION BY artifact_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inside FROM {v_key_line}"""


@query("L07_key_block_lines", sql=f"""SELECT artifact_id, line_no, CASE WHEN line LIKE '%BEGIN%' THEN '[REDACTED:private_key]' ELSE line END AS line FROM ({_KEY_STATE}) WHERE coalesce(inside, 0) = 0""")
def key_blocks(d: Data):
    return L.key_block_lines(d.v_key_line, ["artifact_id"], "line_no").select("artifact_id", "line_no", "line")


@query("L08_residual_scan", sql="SELECT event_id, hits AS residual_hits FROM {v_secret_line} WHERE hits > 0")
def residual(d: Data):
    return L.residual_report(d.spread(d.v_secret_line.select("event_id", F.col("line").alias("text"))), "event_id")


@query("E04_redaction_recall", sql="""
SELECT count(*) AS expected, count(*) FILTER (WHERE contains(clean, secret)) AS leaked,
       round_even(CAST(count(*) FILTER (WHERE NOT contains(clean, secret)) AS DOUBLE) / count(*), 6) AS recall FROM {v_secret_line}""")
def redaction_recall(d: Data):
    from faultlens.operators.evaluate import redaction_recall as recall

    # Every shape has its secret; what plain lines are said to hold stays and counts as leaked.
    rows = d.v_secret_line
    return recall(d.spread(rows.select("event_id", F.col("line").alias("text"))), rows.select("event_id", "secret"), "event_id")


@query("L03_oversized_lines", sql="SELECT event_id, CASE WHEN user_id > 100 THEN '[REDACTED:oversized_line]' ELSE repeat('x', user_id) END AS line FROM {events}")
def oversized(d: Data):
    rows = d.spread(d.events.select("event_id", "user_id"))  # few bytes make long lines
    return rows.select("event_id", L.oversized_policy(F.expr("repeat('x', cast(user_id as int))"), 100).alias("line"))


@query("L10_bounded_fields", sql="SELECT event_id, substr('a b [REDACTED:email] ' || CAST(user_id AS STRING), 1, 22) AS field FROM {events}")
def bounded(d: Data):
    text = F.concat(F.lit("  a \t b\n u"), F.col("event_id").cast("string"), F.lit("@ex.com  "), F.col("user_id").cast("string"), F.lit(" "))
    return d.events.select("event_id", T.bounded(text, 22).alias("field"))


_LONG = """SELECT floor(event_id / 500) AS log_id, event_id, CASE WHEN event_id % 97 = 5 THEN 'Error at ' ELSE 'line ' END || CAST(event_id AS STRING) AS line FROM {events}"""


@query("L02_log_window", sql=f"""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY event_id) - 1 AS i, line || chr(10) AS t FROM ({_LONG})),
mk AS (SELECT log_id, i, coalesce(lead(i) OVER (PARTITION BY log_id ORDER BY i), 1000000) AS nx FROM l WHERE line LIKE 'Error%'),
ctx AS (SELECT mk.log_id, string_agg(t, '' ORDER BY mk.i, l.i) AS c FROM mk JOIN l ON l.log_id = mk.log_id AND l.i >= mk.i - 20 AND (l.i <= mk.i OR (l.i <= mk.i + 20 AND l.i < mk.nx)) GROUP BY 1),
whole AS (SELECT log_id, string_agg(t, '' ORDER BY i) AS w, string_agg(CASE WHEN i < 10 THEN t END, '' ORDER BY i) AS h FROM l GROUP BY 1)
SELECT CAST(log_id AS BIGINT) AS log_id, md5(CASE WHEN octet_length(encode(w)) <= 2000 + 4096 THEN w ELSE substr(h, 1, 500) || CASE WHEN c IS NULL THEN '' ELSE chr(10) || '--- failure context ---' || chr(10) || substr(c, 1, 2000) END || chr(10) || '--- log tail ---' || chr(10) || right(w, 2000) END) AS digest
FROM whole LEFT JOIN ctx USING (log_id)""")
def window(d: Data):
    logs = d.sql(_LONG).groupBy(F.col("log_id").cast("bigint").alias("log_id")).agg(F.concat(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda r: r["line"]), "\n"), F.lit("\n")).alias("text"))
    return logs.select("log_id", F.md5(L.bounded_window(F.col("text"), 2000, 10)).alias("digest"))
