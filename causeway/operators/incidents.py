"""Clusters of linked signals: confidence, validation checks, near misses, late arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pairs import BAND

MIN_DENSITY, MIN_ANOMALY, PAIR_CAP = 0.25, 0.60, 2500
FAMILY = {"cloudwatch_metric": "metric", "grafana_alert": "metric", "cloudwatch_log": "log", "app_log": "log",
          "trace_span": "trace"}


def family(source):
    table = F.create_map(*[F.lit(x) for item in FAMILY.items() for x in item])
    return F.coalesce(table[source], F.lit("other"))


def mean_of(value, digits: int = 6):
    """Mean of numbers of at most six decimals, summed and divided as whole numbers and rounded up at a half: neither the
    order of rows nor an engine's rounding changes anything."""
    c = F.col(value) if isinstance(value, str) else value
    total, n = F.sum(F.round(c * 1e6).cast("long")) * (2 * 10 ** (digits - 6)), F.count(c)
    return F.floor((total + n) / (2 * n)) / 10.0**digits


def link_stats(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, n_links, mean_sim, strong_links, reasons) of each cluster."""
    inside = links.join(labels.withColumnRenamed("id", "a_id"), "a_id")
    strong = F.sum(F.when(F.col("gate").isin("shared trace", "same service", "direct dependency"), 1).otherwise(0))
    counts = inside.groupBy("label", "gate").agg(F.count("*").alias("n"))
    reasons = counts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("gate", "n"))).alias("reasons"))
    stats = inside.groupBy("label").agg(
        F.count("*").alias("n_links"), mean_of("sim").alias("mean_sim"), strong.alias("strong_links"))
    return stats.join(reasons, "label")


def annotate(members: DataFrame, links: DataFrame) -> DataFrame:
    """members(label, signal columns): one row for each cluster with sizes, times, density and correlator confidence."""
    labels = members.select("id", "label")
    base = members.groupBy("label").agg(
        F.count("*").alias("n_signals"), F.countDistinct("service").alias("n_services"), F.min("ts").alias("started"),
        F.max("ts").alias("ended"), F.max("anomaly_score").alias("peak"))
    s = link_stats(links, labels)
    n = F.col("n_signals")
    density = F.when(n < 2, 1.0).otherwise(F.col("n_links") / (n * (n - 1) / 2))
    share = F.col("strong_links") / F.nullif("n_links", F.lit(0))
    return base.join(s, "label", "left").withColumn("density", F.round(density, 6)).withColumn(
        "correlator_confidence", F.round(0.35 + 0.45 * share + 0.30 * F.col("mean_sim") + 1e-9, 6))


def validation(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """The checks of each cluster: coherence, anomaly support, independent evidence, time bound, all."""
    what = F.coalesce("metric", F.substring("message", 1, 60))
    seen = members.groupBy("label").agg(
        F.countDistinct(F.struct("service", "source", what.alias("w"))).alias("conditions"),
        F.bool_and(F.col("sev_rank") <= 1).alias("all_severe"))
    out = clusters.join(seen, "label").select(
        "label",
        ((F.col("n_signals") <= 3) | (F.col("density") >= MIN_DENSITY)).alias("coherent"),
        (F.col("peak") >= MIN_ANOMALY).alias("supported"),
        ((F.col("conditions") >= 2) | F.col("all_severe")).alias("independent"))
    return out.withColumn("accepted", F.col("coherent") & F.col("supported") & F.col("independent"))


def confidence_terms(members: DataFrame, links: DataFrame, hops: DataFrame, first: int | None = PAIR_CAP) -> DataFrame:
    """(label, density, topology, evidence): what correlation_confidence weighs. Its topology is that of all pairs, which
    first=None gives here; else that of the first pairs by ids only."""
    topo = _topology(members, hops) if first is None else _first_topology(members, hops, first)
    return _terms(members, links, topo).select("label", "density", F.coalesce("topology", F.lit(1.0)).alias("topology"), "evidence")


def correlation_confidence(members: DataFrame, links: DataFrame, hops: DataFrame) -> DataFrame:
    """0.40 density + 0.35 share of the member pairs at most 2 calls apart + 0.25 mean best link of each signal. All pairs
    count; none is formed."""
    return _terms(members, links, _topology(members, hops)).select("label", F.round(
        0.40 * F.col("density") + 0.35 * F.coalesce("topology", F.lit(1.0)) + 0.25 * F.col("evidence") + 1e-9, 6).alias("confidence"))


def _topology(members: DataFrame, hops: DataFrame) -> DataFrame:
    """(label, topology): the share of a cluster's pairs of members whose services are at most 2 calls apart, from how many
    members each service has. hops holds each pair of services either way round and once."""
    c = members.groupBy("label", "service").agg(F.count("*").alias("c"))
    near = hops.where("hops <= 2").select(F.col("a").alias("service"), "b")
    met = c.join(near, "service").select("label", "service", "c", "b").join(
        c.select("label", F.col("service").alias("b"), F.col("c").alias("d")), ["label", "b"])
    # pairs of members either way round; no member is paired with itself
    both = met.groupBy("label").agg(F.sum(F.col("c") * F.when(F.col("service") == F.col("b"), F.col("d") - 1).otherwise(F.col("d"))).alias("near"))
    n = c.groupBy("label").agg(F.sum("c").alias("n")).where("n > 1")
    return n.join(both, "label", "left").select("label", (F.coalesce("near", F.lit(0)) / (F.col("n") * (F.col("n") - 1))).alias("topology"))


def _first_topology(members: DataFrame, hops: DataFrame, first: int) -> DataFrame:
    """(label, topology) of the first pairs by ids, which come from ranks: a bounded number for each member."""
    order = F.row_number().over(Window.partitionBy("label").orderBy("id")).cast("long")
    # members after the first + 1 are in no pair, so that a large cluster's are not ranked further
    ranked = members.select("label", "id", "service", order.alias("k")).where(F.col("k") <= first + 1)
    m = ranked.join(members.groupBy("label").agg(F.count("*").alias("n")), "label")
    # pair number before member k, in (i, j) order; only members with pairs under `first` take part as first
    before = (F.col("k") - 1) * F.col("n") - F.col("k") * (F.col("k") - 1) / 2
    one = m.withColumn("before", before).where(F.col("before") < first)
    second = ranked.select("label", F.col("k").alias("k2"), F.col("service").alias("s2"))
    pair = one.join(second, "label").where(f"k2 > k and before + k2 - k <= {first}")
    near = hops.select(F.col("a").alias("ha"), F.col("b").alias("hb"), "hops")
    pair = pair.join(near, (F.col("service") == F.col("ha")) & (F.col("s2") == F.col("hb")), "left")
    return pair.groupBy("label").agg(F.avg((F.coalesce("hops", F.lit(9)) <= 2).cast("double")).alias("topology"))


def _terms(members: DataFrame, links: DataFrame, topo: DataFrame) -> DataFrame:
    labels = members.select("id", "label")
    ends = links.select(F.col("a_id").alias("id"), "sim").union(links.select("b_id", "sim"))
    best = labels.join(ends.groupBy("id").agg(F.max("sim").alias("best")), "id", "left")
    best = best.groupBy("label").agg(mean_of(F.coalesce("best", F.lit(0.0)), 9).alias("evidence"))
    dens = annotate(members, links).select("label", "density")
    return dens.join(topo, "label", "left").join(best, "label")


def near_misses(clusters: DataFrame, members: DataFrame, noise: DataFrame, edges: DataFrame, limit: int = 4) -> DataFrame:
    """(label, id, reason, rank): the first `limit` noise signals within 15 minutes of a cluster's span, with why they
    are outside: a call away but below the threshold, or no shared context. Signals of a member service are left out."""
    slot = lambda c: F.floor(c / BAND)
    span = clusters.select("label", "started", "ended", F.explode(F.sequence(
        slot(F.col("started")) - 1, slot(F.col("ended")) + 1)).alias("slot"))
    met = span.join(noise.select("id", "ts", "service", slot(F.col("ts")).alias("slot")), "slot").where(
        (F.col("ts") >= F.col("started") - BAND) & (F.col("ts") <= F.col("ended") + BAND))
    own = members.select("label", "service").distinct()
    met = met.join(own, ["label", "service"], "left_anti")
    both = edges.select(F.col("caller").alias("s"), F.col("callee").alias("t")).union(edges.select("callee", "caller"))
    near = own.join(both.distinct(), own.service == F.col("s")).select("label", F.col("t").alias("service")).distinct()
    met = met.join(near.withColumn("near", F.lit(True)), ["label", "service"], "left")
    reason = F.when(F.col("near"), "below threshold").otherwise("no shared context")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("ts", "id"))
    return met.select("label", "id", reason.alias("reason"), rank.alias("rank")).where(F.col("rank") <= limit)


def late_matches(late: DataFrame, pairs: DataFrame, labels: DataFrame, clusters: DataFrame) -> DataFrame:
    """(id, label): the open cluster a late signal joins, at most 60 minutes after its end; shared trace first, then the
    most similar member. pairs are scored pairs of (a: member, b: late)."""
    limit = 60 * 60_000_000
    met = pairs.where((1 - F.col("sim")) <= 0.55).join(labels.select(F.col("id").alias("a_id"), "label"), "a_id").join(
        late.select(F.col("id").alias("b_id"), "ts"), "b_id").join(clusters.select("label", "ended"), "label")
    met = met.where(F.col("ts") <= F.col("ended") + limit)
    best = Window.partitionBy("b_id").orderBy(F.col("gate") != "shared trace", F.desc("sim"), "label")
    return met.withColumn("r", F.row_number().over(best)).where("r = 1").select(F.col("b_id").alias("id"), "label")
