"""Running baselines: exponentially weighted mean and variance of each series, folded in time order.

A series is sorted inside its partition and folded as a stream of batches, so memory doesn't grow with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA, WARMUP, Z_LIMIT, LEAST_STD = 0.3, 5, 3.0, 1e-9


def z_scores(points: DataFrame, alpha: float = ALPHA, warmup: int = WARMUP) -> DataFrame:
    """points(series, ts, id, value) with mean and std before each point, n before it and z (null until the series has
    `warmup` points or while its deviation is below LEAST_STD). Null values are left out."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, mean, var, n = None, 0.0, 0.0, 0
        for batch in batches:
            out = []
            for s, x in zip(batch["series"].tolist(), batch["value"].tolist(), strict=True):
                if s != series:
                    series, mean, var, n = s, 0.0, 0.0, 0
                std = var**0.5
                z = (x - mean) / std if n >= warmup and std >= LEAST_STD else None
                out.append((mean if n else None, std if n else None, n, z))
                if n == 0:
                    mean = x
                else:
                    delta = x - mean
                    mean += alpha * delta
                    var = (1 - alpha) * (var + alpha * delta * delta)
                n += 1
            got = pd.DataFrame(out, columns=["mean", "std", "n", "z"], index=batch.index)
            yield pd.concat([batch, got], axis=1)

    rows = points.where("value is not null").select("series", "ts", "id", "value")
    rows = rows.repartition("series").sortWithinPartitions("series", "ts", "id")
    return rows.mapInPandas(fold, "series string, ts long, id long, value double, mean double, std double, n long, z double")


def series_key(service: Column, metric: Column) -> Column:
    return F.concat_ws("|", service, F.coalesce(metric, F.lit("value")))


def metric_judgement(z: Column) -> tuple[Column, Column]:
    """(is_anomaly, score) by z."""
    odd = F.coalesce(F.abs(z) >= Z_LIMIT, F.lit(False))
    return odd, F.when(odd, F.least(F.abs(z) / 6, F.lit(1.0))).otherwise(F.lit(0.0))


def breach(value: Column, threshold: Column) -> Column:
    """Score of a value beyond its threshold; null without either or for threshold 0."""
    over = F.abs(value - threshold) / F.abs(F.nullif(threshold, F.lit(0.0)))
    return F.when(over.isNotNull(), F.least(F.lit(1.0), 0.6 + 2 * over))


def template_rates(counts: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """counts(template, batch, n) with the long-run rate before each batch: a fold over the batches in which the
    template occurs, from 0; null before the first."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rate = None, None
        for batch in batches:
            out = []
            for t, n in zip(batch["template"].tolist(), batch["n"].tolist(), strict=True):
                if t != now:
                    now, rate = t, None
                out.append(rate)
                rate = (1 - alpha) * (rate or 0.0) + alpha * n
            yield batch.assign(rate=pd.Series(out, index=batch.index, dtype="float64"))

    rows = counts.select("template", "batch", "n").repartition("template").sortWithinPartitions("template", "batch")
    return rows.mapInPandas(fold, "template string, batch long, n long, rate double")


def log_judgement(sev_rank: Column, n: Column, rate: Column) -> tuple[Column, Column]:
    """(reason, score) of a log template in a batch: novel, burst, lone error, or none."""
    notable, error = sev_rank <= 2, sev_rank <= 1
    novel = rate.isNull() & notable
    burst = rate.isNotNull() & (n >= 3) & (n >= 4 * rate)
    reason = F.when(novel, "novel").when(burst, "burst").when(error, "error").otherwise("none")
    score = (
        F.when(novel, F.when(error, 0.8).otherwise(0.55))
        .when(burst, F.least(n / 20 + 0.4, F.lit(1.0)))
        .when(error, 0.6)
        .otherwise(0.0)
    )
    return reason, score


def detect(signals: DataFrame) -> DataFrame:
    """signals with is_anomaly and anomaly_score by threshold and severity (rules without history)."""
    over = F.coalesce(F.col("value") > F.col("threshold"), F.lit(False))
    severe = F.col("sev_rank") <= 1
    score = F.greatest(
        F.when(over, breach(F.col("value"), F.col("threshold"))).otherwise(0.0), F.when(severe, 0.6).otherwise(0.0))
    return signals.withColumn("is_anomaly", over | severe).withColumn("anomaly_score", score)


def detect_all(signals: DataFrame, minutes: int = 5) -> DataFrame:
    """Deduplicated signals with is_anomaly, anomaly_score and reason. What its source flags (a value beyond its
    threshold) stays flagged, with the higher of its breach and its z; other metrics go by z, logs by novelty and bursts
    of their template in batches of `minutes`, the rest by severity."""
    logs = F.col("source").isin("app_log", "cloudwatch_log")
    points = signals.where("metric is not null and value is not null").select(series_key(F.col("service"), F.col("metric")).alias("series"), "ts", "id", "value")
    z = z_scores(points).select(F.col("id").alias("z_id"), "z")
    name = F.concat_ws("|", "service", "template").alias("log_name")
    batch = F.floor(F.col("ts") / (minutes * 60_000_000)).alias("log_batch")
    counts = signals.where(logs).groupBy(name, batch).agg(F.sum("occurrence_count").alias("n"))
    rates = template_rates(counts.select(F.col("log_name").alias("template"), F.col("log_batch").alias("batch"), "n")).select(
        F.col("template").alias("of"), F.col("batch").alias("at"), F.col("n").alias("log_n"), "rate")
    out = signals.select("*", F.when(logs, name).alias("log_name"), batch).join(z, F.col("id") == F.col("z_id"), "left").join(
        rates, (F.col("log_name") == F.col("of")) & (F.col("log_batch") == F.col("at")), "left")
    flagged = F.coalesce(F.col("value") > F.col("threshold"), F.lit(False))
    by_z, z_score = metric_judgement(F.col("z"))
    log_reason, log_score = log_judgement(F.col("sev_rank"), F.col("log_n"), F.col("rate"))
    metric, severe = F.col("source") == "cloudwatch_metric", F.col("sev_rank") <= 1
    reason = (
        F.when(flagged, "breach").when(metric, F.when(by_z, "baseline").otherwise("none")).when(logs, log_reason)
        .when(severe, "severity").otherwise("none"))
    score = (
        F.when(flagged, F.greatest(z_score, F.coalesce(breach(F.col("value"), F.col("threshold")), F.lit(0.7))))
        .when(metric, z_score).when(logs, log_score).otherwise(F.lit(0.0)))
    return out.select(*[F.col(c) for c in signals.columns], (reason != "none").alias("is_anomaly"), score.alias("anomaly_score"), reason.alias("reason"))
