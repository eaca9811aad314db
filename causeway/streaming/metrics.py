"""Figures of a run that come with the run: counted while rows pass, not by reading them again.

A DataFrame that is observed gives its measures when the action on it ends; a stream gives them for each batch, and Totals
adds them up. Measures are sums, counts and maxima, so batches add up to what one pass would count; a task that runs
again counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SOURCES = ("app_log", "cloudwatch_log", "cloudwatch_metric", "grafana_alert", "trace_span")


def measures() -> dict[str, Column]:
    """What is counted of signals(source, ts, is_anomaly, anomaly_score, occurrence_count)."""
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    hit = lambda c: whole(F.coalesce(c, F.lit(False)).cast("int"))
    bin_ = F.least(F.floor(F.col("anomaly_score") * 10), F.lit(9))
    return {
        "received": whole(F.col("occurrence_count")), "distinct": F.count(F.lit(1)), "anomalies": hit(F.col("is_anomaly")),
        "repeated": hit(F.col("occurrence_count") > 1), "clock": F.max("ts"),
        **{f"from_{s}": hit(F.col("source") == s) for s in SOURCES}, **{f"score_{k}": hit(bin_ == k) for k in range(10)},
    }


def observed(df: DataFrame, name: str | Observation = "run") -> DataFrame:
    """df, whose next action (or each batch, for a stream) also gives the measures under this name."""
    return df.observe(name, *[c.alias(k) for k, c in measures().items()])


def bundle(row: dict) -> dict:
    """The figures of a row of measures: counts, the share collapsed in percent, and the score histogram."""
    received, distinct = row["received"] or 0, row["distinct"] or 0
    return {
        "received": received, "distinct": distinct, "collapsed": max(received - distinct, 0),
        "collapsed_pct": round(100.0 * max(received - distinct, 0) / received, 1) if received else 0.0,
        "anomalies": row["anomalies"], "clock": row["clock"], "sources": {s: row[f"from_{s}"] for s in SOURCES},
        "score_histogram": [row[f"score_{k}"] for k in range(10)],
    }


class Totals(StreamingQueryListener):
    """Measures of all batches of the streams that are observed under a name: spark.streams.addListener(Totals())."""

    def __init__(self, name: str = "run") -> None:
        self.name, self.row, self.batches = name, dict.fromkeys(measures(), 0), 0
        self.seen: set[tuple] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        got = event.progress.observedMetrics.get(self.name)
        key = (str(event.progress.id), event.progress.batchId)
        if got is None or key in self.seen:  # progress of an idle trigger may come twice
            return
        self.seen.add(key)
        self.batches += 1
        for k in self.row:
            value = getattr(got, k)
            if value is not None:
                self.row[k] = max(self.row[k], value) if k == "clock" else self.row[k] + value

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
