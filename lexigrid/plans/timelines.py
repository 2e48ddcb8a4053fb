"""Queries of scans along each user's events: nearest times, silent stretches, voiced spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.operators import timelines
from lexigrid.plans.queries import query
from lexigrid.sources.tables import table

_T = "epoch_us(ts)"


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", timelines.micros(F.col("ts")).alias("t"))


@query(f"""WITH e AS (SELECT event_id, user_id, event_type, value, {_T} AS t FROM events),
p AS (SELECT user_id, t AS time_of, arg_max(event_id, value) AS near_id, max(value) AS near_value FROM (SELECT user_id, t, event_id, value FROM e WHERE event_type = 'purchase') GROUP BY user_id, t),
m AS (SELECT e.event_id, p.time_of, p.near_value, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(p.time_of - e.t), p.time_of) AS k FROM e JOIN p ON e.user_id = p.user_id WHERE e.event_type <> 'purchase')
SELECT e.event_id, m.time_of, m.near_value FROM e LEFT JOIN m ON e.event_id = m.event_id AND m.k = 1 WHERE e.event_type <> 'purchase'""")
def adv41_nearest_times(spark, d):
    """Every other event with the user's purchase that is nearest in time."""
    e = _events(spark, d)
    bought = e.filter("event_type = 'purchase'").select("user_id", "t", F.col("value").alias("near_value"))
    return timelines.joined_by_time(e.filter("event_type <> 'purchase'"), bought, "user_id", "t", ["near_value"]).select("event_id", "time_of", "near_value")


@query("""WITH e AS (SELECT user_id, event_id, coalesce(value < 20, true) AS quiet, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
i AS (SELECT *, k - row_number() OVER (PARTITION BY user_id, quiet ORDER BY event_id) AS island FROM e)
SELECT user_id, CASE WHEN quiet THEN 'silence' ELSE 'sound' END AS kind, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM i GROUP BY user_id, quiet, island""")
def adv41_silences(spark, d):
    return timelines.silences(table(spark, d, "events"), "user_id", "event_id", "value", 20.0)


@query(f"""WITH e AS (SELECT user_id, {_T} AS t, value, event_type FROM events), p AS (SELECT user_id, t, max(CASE WHEN value > 30 THEN 1.0 ELSE 0.0 END) AS tone FROM e WHERE event_type = 'click' GROUP BY user_id, t),
m AS (SELECT e.user_id, e.t, p.tone, row_number() OVER (PARTITION BY e.user_id, e.t ORDER BY abs(p.t - e.t), p.t) AS k FROM (SELECT DISTINCT user_id, t FROM e WHERE value >= 20) e JOIN p ON e.user_id = p.user_id)
SELECT user_id, min(t) AS first, max(t) AS last, round(min(t) + (max(t) - min(t)) * 0.2::DOUBLE, 6) AS core_first, round(min(t) + (max(t) - min(t)) * 0.8::DOUBLE, 6) AS core_last FROM m WHERE k = 1 AND tone > 0 GROUP BY user_id""")
def adv41_voiced_spans(spark, d):
    e = _events(spark, d)
    pitch = e.filter("event_type = 'click'").select("user_id", "t", F.when(F.col("value") > 30, 1.0).otherwise(0.0).alias("tone"))
    return timelines.voiced_spans(e, pitch, "user_id", "t", "value", "tone", 20.0)
