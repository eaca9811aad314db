"""Everything that a reviewer sees of an incident, as rows: (label, section, place, subject, value, body).

A row is one element of the evidence, with what it is about, its leading figure and all of it as JSON in body. An incident of
any size is many rows, never one: a reader asks for the sections and places that it shows. Sections:

summary    what the incident is called, its facts, occurrences and signals, root and priority
signal     each signal in order of time, with its strongest join, badges and whether it speaks for the root
excluded   nearest signals that stayed outside, and why
candidate  each service as a cause, in order of rank, with what speaks for and against it
factor     what severity is made of; trend and diversity for context, without a weight
part       what the confidence is made of
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written


def _rows(df: DataFrame, section: str, subject: Column, value: Column, *order: Column) -> DataFrame:
    """The rows of one section; a section's window is inside one incident."""
    body = F.to_json(F.struct(*[c for c in df.columns if c != "label"]))
    place = F.row_number().over(Window.partitionBy("label").orderBy(*order)) if order else F.lit(1)
    return df.select("label", F.lit(section).alias("section"), place.alias("place"), subject.cast("string").alias("subject"), F.round(
        value.cast("double"), 6).alias("value"), body.alias("body"))


def candidates(scored: DataFrame, roots: DataFrame) -> DataFrame:
    """scored services with why each is or isn't the cause."""
    out = scored.join(roots.select("label", "root"), "label")
    why = (
        F.when(F.col("service") == F.col("root"), F.lit(None).cast("string"))
        .when(F.col("is_symptom"), F.concat(F.lit("symptom of "), F.array_join("symptom_of", ", ")))
        .when(~F.col("survived"), "others explain all that it explains").otherwise("ranked lower"))
    return out.withColumn("rejected_because", why).drop("root")


def factors(impact: DataFrame, trend: DataFrame, diversity: DataFrame) -> DataFrame:
    """(label, factor, weight, score, contribution) of impact(label, blast, criticality, magnitude), trend and diversity."""
    m = impact.select("label", "blast", "criticality", "magnitude").join(trend, "label").join(diversity, "label")
    each = F.array(*[F.struct(F.lit(k).alias("factor"), F.lit(w).alias("weight"), F.col(c).alias("score"), F.lit(n).alias("n")) for n, (k, c, w) in enumerate((
        ("blast radius", "blast", 0.40), ("business criticality", "criticality", 0.35), ("anomaly magnitude", "magnitude", 0.25),
        ("trend direction", "trend", 0.0), ("signal diversity", "diversity", 0.0)))])
    return m.select("label", F.explode(each).alias("f")).select("label", "f.*").withColumn(
        "contribution", F.round(F.col("weight") * F.col("score") + 1e-9, 3))


def bundle(members: DataFrame, joins: DataFrame, drafts: DataFrame, roots: DataFrame, telling: DataFrame, impact: DataFrame, scored: DataFrame,
           near: DataFrame, factor: DataFrame, parts: DataFrame, signals: DataFrame) -> DataFrame:
    """The rows of all incidents. joins: strongest join of each member, telling(label, service, id): the telling signal of
    each service, near(label, id, reason, rank): near misses among signals, factor: from factors(), parts(label, part,
    points): the confidence."""
    root_signal = telling.join(roots.select("label", F.col("root").alias("service")), ["label", "service"]).select(
        "label", "id", F.lit(True).alias("speaks_for_root"))
    told = members.select("label", "id", "ts", "source", "service", "message", "severity", "occurrence_count", "trace_id", "template", "value", "threshold")
    told = told.join(joins, ["label", "id"], "left").join(root_signal, ["label", "id"], "left").withColumn(
        "speaks_for_root", F.coalesce("speaks_for_root", F.lit(False)))
    size = members.groupBy("label").agg(F.sum("occurrence_count").alias("raw_signals"), F.count("*").alias("unique_signals"))
    summary = drafts.join(size, "label").join(roots, "label").join(impact.select("label", "severity", "priority"), "label")
    outside = near.join(signals.select("id", "ts", "source", "service", "message"), "id")
    out = [
        _rows(summary, "summary", F.col("draft_id"), F.col("severity")),
        _rows(told, "signal", F.col("id"), F.col("occurrence_count"), F.col("ts"), F.col("id")),
        _rows(outside, "excluded", F.col("id"), F.col("rank"), F.col("rank")),
        _rows(candidates(scored, roots), "candidate", F.col("service"), F.col("rank_score"), F.desc("rank_score"), F.col("onset"), F.col("service")),
        _rows(factor, "factor", F.col("factor"), F.col("contribution"), F.col("n")),
        _rows(parts, "part", F.col("part"), F.col("points"), F.col("part")),
    ]
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def detail(rows: DataFrame, label: int, sections: list[str], most: int = 200) -> DataFrame:
    """What a page shows of one incident: the named sections up to a place, in order."""
    some = rows.where((F.col("label") == label) & F.col("section").isin(sections) & (F.col("place") <= most))
    return written(some.select("section", "place", "subject", "value", "body"), "detail").orderBy("section", "place")
