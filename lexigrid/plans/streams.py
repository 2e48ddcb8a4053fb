"""The batch forms of the streaming operators, with equivalent SQL; tests run the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.plans.queries import query
from lexigrid.sources.tables import shared_path, table
from lexigrid.streaming import counters as ct
from lexigrid.streaming import sketches as sk


@query("SELECT event_id, 'k' AS field, json_extract_string(props, '$.k') AS value FROM events")
def str6_keyword_rows(spark, d):
    return ct.keyword_rows(table(spark, d, "events"), "props", ["event_id"])


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def str9_diagnostics(spark, d):
    return table(spark, d, "events").filter("event_type = 'error'").select("event_id", "user_id")


@query("SELECT event_id, user_id, event_type, value FROM events")
def str3_usage_log(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value")


@query("SELECT user_id, round(sum(value), 6) AS value, max(ts) AS ts FROM events GROUP BY user_id")
def str8_activity(spark, d):
    rows = table(spark, d, "events").select("user_id", "value", "ts", "event_id")
    parts = [ct.activity(rows.filter(f"event_id % 2 = {k}"), "user_id", "value", "ts") for k in (0, 1)]
    return ct.merged(*parts, ["user_id"], ["value"], ["ts"]).withColumn("value", F.round("value", 6))


@query()
def str10_limited(spark, d):
    """No SQL, as each decision depends on those before; tested against a sequential version."""
    return ct.limited(table(spark, d, "events"), "user_id", "ts", "event_id", 86400, 3)


def _stream(spark, d, columns):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").select(*columns)  # a pattern, as the table may be one file


def _folders(spark, name):
    path = shared_path(spark, name)
    return f"{path}/out", f"{path}/check"


@query("SELECT event_id, user_id, event_type, value FROM events")
def str3_appended_stream(spark, d):
    """The log as a stream writes it."""
    out, check = _folders(spark, "usage-log")
    ct.append_stream(_stream(spark, d, ["event_id", "user_id", "event_type", "value"]), out, check).awaitTermination()
    return spark.read.parquet(out)


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def str9_errors_stream(spark, d):
    out, check = _folders(spark, "errors")
    ct.append_stream(_stream(spark, d, ["event_id", "user_id", "event_type"]), out, check, F.col("event_type") == "error").awaitTermination()
    return spark.read.schema("event_id bigint, user_id bigint").parquet(out).select("event_id", "user_id")


@query("SELECT user_id, event_type, round(sum(value), 6) AS value, max(ts) AS ts FROM events GROUP BY user_id, event_type")
def str4_summed_stream(spark, d):
    """Sums by user and type, added up over the stream's batches."""
    out, check = _folders(spark, "sums")
    work = lambda batch: batch.groupBy("user_id", "event_type").agg(F.sum("value").alias("value"), F.max("ts").alias("ts"))
    ct.sum_stream(_stream(spark, d, ["user_id", "event_type", "value", "ts"]), work, out, check).awaitTermination()
    return ct.totals(spark, out, ["user_id", "event_type"], ["value"], ["ts"]).withColumn("value", F.round("value", 6))


@query()
def str5_sketched_stream(spark, d):
    """Users (an estimate) and quantiles of values by type, from the sketches of the stream's batches. Tested within their bounds."""
    out, check = _folders(spark, "sketches")
    work = lambda batch: sk.sketched(batch, ["event_type"], "ts", "user_id", "value")
    ct.sum_stream(_stream(spark, d, ["event_type", "ts", "user_id", "value"]), work, out, check).awaitTermination()
    return sk.sketch_totals(spark, out, ["event_type"])
