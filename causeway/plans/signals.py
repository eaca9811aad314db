"""The signals view over the driver's event table, and the reference tables beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import severity_rank, template
from ..tables import read

EPOCH, SQUEEZE, SERVICES = 1_704_067_200_000_000, 10, 12


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each event in the shape of a normalised signal. ts is in microseconds; event time is squeezed by
    ten so that small tables have incidents."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    metric = F.when(kind.isin("click", "purchase"), kind)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    level = F.when(kind == "error", "high").when(kind == "purchase", "warning").otherwise("info")
    message = F.concat(kind, F.lit(" k="), k.cast("string"))
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (F.lit(EPOCH) + F.floor((us - EPOCH) / SQUEEZE)).cast("long").alias("ts"),
        F.concat(F.lit("svc"), (F.col("user_id") % SERVICES).cast("string")).alias("service"),
        F.concat(F.lit("c"), (k % 5).cast("string")).alias("component"),
        F.when(kind.isin("error", "signup"), "app_log").when(kind == "view", "grafana_alert").otherwise(
            "cloudwatch_metric").alias("source"),
        level.alias("severity"),
        severity_rank(level).alias("sev_rank"),
        message.alias("message"),
        template(message).alias("template"),
        metric.alias("metric"),
        F.when(metric.isNotNull(), F.col("value")).alias("value"),
        F.when(metric.isNotNull(), F.lit(100.0)).alias("threshold"),
        F.when(kind.isin("error", "signup"), F.concat(F.lit("tr"), F.floor(F.col("event_id") / 3).cast("string"))).alias(
            "trace_id"),
        F.when(kind == "error", F.concat(F.lit("svc"), (k % SERVICES).cast("string"))).alias("mention"),
    )


def edges(spark: SparkSession) -> DataFrame:
    """(caller, callee): the service graph, a binary tree with two more calls."""
    rows = [(f"svc{i}", f"svc{j}") for i in range(6) for j in (2 * i + 1, 2 * i + 2) if j < SERVICES]
    return spark.createDataFrame([*rows, ("svc7", "svc10"), ("svc8", "svc11")], "caller string, callee string")


def registry(spark: SparkSession) -> DataFrame:
    """(service, criticality) of most services; others count 0.5."""
    return spark.createDataFrame([(f"svc{i}", (95 - 6 * i) / 100) for i in range(10)], "service string, criticality double")


EDGES_SQL = """edges AS (SELECT 'svc' || i AS caller, 'svc' || j AS callee FROM (SELECT i, unnest([2 * i + 1, 2 * i + 2]) AS j
    FROM range(6) t(i)) WHERE j < 12 UNION ALL SELECT 'svc7', 'svc10' UNION ALL SELECT 'svc8', 'svc11')"""

SIGNALS_SQL = f"""
ev AS (SELECT *, (props->>'k')::INTEGER AS k FROM events),
signals AS (SELECT event_id AS id, (1704067200000000 + floor((epoch_us(ts) - 1704067200000000) / 10.0))::BIGINT AS ts,
  'svc' || (user_id % 12) AS service, 'c' || (k % 5) AS component,
  CASE WHEN event_type IN ('error', 'signup') THEN 'app_log' WHEN event_type = 'view' THEN 'grafana_alert'
    ELSE 'cloudwatch_metric' END AS source,
  CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS severity,
  CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS sev_rank,
  event_type || ' k=' || k AS message, event_type || ' k=<*>' AS template,
  CASE WHEN event_type IN ('click', 'purchase') THEN event_type END AS metric,
  CASE WHEN event_type IN ('click', 'purchase') THEN value END AS value,
  CASE WHEN event_type IN ('click', 'purchase') THEN 100.0 END AS threshold,
  CASE WHEN event_type IN ('error', 'signup') THEN 'tr' || (event_id // 3) END AS trace_id,
  CASE WHEN event_type = 'error' THEN 'svc' || (k % 12) END AS mention FROM ev),
{EDGES_SQL},
registry AS (SELECT 'svc' || i AS service, (95 - 6 * i) / 100.0 AS criticality FROM range(10) t(i))"""
