"""Metric and trace payloads as long tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultlens.operators.traces import span_duration, span_status


def prometheus_samples(df: DataFrame, key: str = "artifact_id", text: str = "text") -> DataFrame:
    """(key, metric, ts_us, value) of range or instant query results; non-finite values drop out."""
    schema = "data struct<result:array<struct<metric:map<string,string>,values:array<array<string>>,value:array<string>>>>"
    series = df.select(key, F.explode(F.from_json(text, schema)["data"]["result"]).alias("s"))
    points = series.select(
        key, F.coalesce(F.nullif(F.col("s.metric")["__name__"], F.lit("")), F.lit("http_5xx_rate")).alias("metric"),
        F.explode(F.when(F.size("s.values") > 0, F.col("s.values")).when(F.col("s.value").isNotNull(), F.array("s.value"))).alias("p"))
    seconds, value = F.try_element_at("p", F.lit(1)).try_cast("double"), F.try_element_at("p", F.lit(2)).try_cast("double")
    infinite = lambda c: F.abs(c) == float("inf")
    rows = points.select(key, "metric", seconds.alias("_s"), value.alias("value"))
    finite = ~F.isnan("_s") & ~F.isnan("value") & ~infinite(F.col("_s")) & ~infinite(F.col("value"))
    return rows.filter(F.col("_s").isNotNull() & F.col("value").isNotNull() & finite).select(
        key, "metric", F.floor(F.col("_s") * 1_000_000 + 0.5).alias("ts_us"), "value")


_VALUE = "struct<stringValue:string,intValue:string,doubleValue:string,boolValue:string>"
_SPAN = (
    "struct<traceId:string,trace_id:string,spanId:string,span_id:string,parentSpanId:string,parent_span_id:string,"
    "service:string,serviceName:string,name:string,startTimeUnixNano:string,start_ns:string,endTimeUnixNano:string,"
    "end_ns:string,status:string,version:string>"
)
_CONTAINER = (
    f"struct<resource:struct<attributes:array<struct<key:string,value:{_VALUE}>>>,scopeSpans:array<struct<spans:array<{_SPAN}>>>>"
)


def _attribute(resource: Column, name: str) -> Column:
    values = F.transform(
        F.filter(resource["attributes"], lambda a: a["key"] == name),
        lambda a: F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["doubleValue"], a["value"]["boolValue"]))
    return F.coalesce(F.try_element_at(F.array_compact(values), F.lit(-1)), F.lit(""))


def trace_spans(df: DataFrame, key: str = "artifact_id", text: str = "text", default_trace: Column | None = None) -> DataFrame:
    """Spans of flat, ``resourceSpans`` and ``batches`` payloads; malformed members are left out."""
    schema = f"spans array<{_SPAN}>, resourceSpans array<{_CONTAINER}>, batches array<{_CONTAINER}>"
    docs = df.select(key, (F.lit("") if default_trace is None else default_trace).alias("_trace"), F.from_json(text, schema).alias("d"))
    empty = F.array().cast(f"array<{_CONTAINER}>")
    containers = F.concat(F.coalesce("d.resourceSpans", empty), F.coalesce("d.batches", empty))
    flat = docs.select(key, "_trace", F.posexplode("d.spans").alias("pos", "s"), F.lit("").alias("_service"), F.lit("").alias("_version"), F.lit(-1).alias("block"))
    nested = docs.select(key, "_trace", F.posexplode(containers).alias("block", "c")).select(
        key, "_trace", "block", _attribute(F.col("c.resource"), "service.name").alias("_service"),
        _attribute(F.col("c.resource"), "service.version").alias("_version"),
        F.posexplode(F.flatten(F.transform("c.scopeSpans", lambda s: s["spans"]))).alias("pos", "s"))
    rows = flat.unionByName(nested).filter(F.col("s").isNotNull())
    some = lambda *names: F.coalesce(*[F.nullif(F.col(name), F.lit("")) for name in names], F.lit(""))
    number = lambda *names: F.coalesce(*[F.nullif(F.col(f"s.{name}"), F.lit("")).try_cast("bigint") for name in names], F.lit(0).cast("bigint"))
    status = F.when(F.col("s.status").startswith("{"), F.get_json_object("s.status", "$.code")).otherwise(F.nullif("s.status", F.lit("")))
    normalized = F.when(F.col("s.status").startswith("{"), span_status(status)).otherwise(F.coalesce(status, F.lit("unknown")))
    return rows.select(
        key, "block", "pos", some("s.traceId", "s.trace_id", "_trace").alias("trace_id"), some("s.spanId", "s.span_id").alias("span_id"),
        some("s.parentSpanId", "s.parent_span_id").alias("parent_span_id"), some("s.service", "s.serviceName", "_service").alias("service"),
        some("s.name").alias("name"), number("startTimeUnixNano", "start_ns").alias("start_ns"), number("endTimeUnixNano", "end_ns").alias("end_ns"),
        normalized.alias("status"), some("s.version", "_version").alias("version"),
    ).withColumn("duration_ns", span_duration(F.col("start_ns"), F.col("end_ns")))
