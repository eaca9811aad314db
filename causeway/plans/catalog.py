"""Named queries over the driver's tables, built from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import redaction
from ..functions import text as T
from ..operators import baseline, bridges, causal, dedup, evaluate, incidents, legacy, pairs, severity, similar_text, splitting, timeline, topology
from ..operators.components import components
from ..sources import sinks
from ..tables import read
from .runs import kept
from .signals import edges, registry, signals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Deduplicated signals judged by the whole detector."""
    # the detector reads the signals three times
    first = lambda: kept(spark, d, "deduplicated", lambda: dedup.dedup_signals(signals(spark, d)))
    return kept(spark, d, "scored", lambda: baseline.detect_all(first()))


def anomalous(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).where("is_anomaly")


def scored_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that the gate lets through, with terms and similarity, and each side's service."""

    def build() -> DataFrame:
        e = edges(spark)
        side = lambda c: F.struct(F.col(f"{c}.service").alias("service")).alias(c)
        out = pairs.similarity(pairs.gated(pairs.candidates(anomalous(spark, d), e), e))
        return out.withColumns({c: side(c) for c in "ab"})

    return kept(spark, d, "pairs", build)


def linked(spark: SparkSession, d: str) -> DataFrame:
    return pairs.links(scored_pairs(spark, d)).select("a_id", "b_id", "gate", "sim")


def membership(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(members: anomalous signals of clusters with label, links)."""
    found = kept(spark, d, "links", lambda: linked(spark, d))
    labels = lambda: components(found.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    return kept(spark, d, "members", lambda: anomalous(spark, d).join(labels(), "id")), found


def reach(spark: SparkSession, d: str) -> DataFrame:
    """(service, dependent): who transitively calls a service."""
    return kept(spark, d, "dependents", lambda: topology.dependents(edges(spark)))


def _scores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m, _ = membership(spark, d)
    return m, kept(spark, d, "causes", lambda: causal.scores(m, edges(spark), reach(spark, d)))


def rooted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, root causes, impact) of every incident."""
    m, s = _scores(spark, d)
    roots = kept(spark, d, "roots", lambda: causal.root_causes(s))
    return m, roots, kept(spark, d, "impact", lambda: severity.impact(m, roots, reach(spark, d), registry(spark)))


# --- signals, dedup, detection


@query
def signal_feed(spark, d):
    """Canonical projection of every signal with its evidence text."""
    s = signals(spark, d)
    whole = lambda c: F.floor(c).cast("string")
    limit = F.concat("metric", F.lit(" = "), whole("value"), F.lit(" vs "), whole("threshold"))
    evidence = F.when(F.col("metric").isNotNull(), limit).otherwise(F.col("message"))
    return s.select("id", "ts", "source", F.lit("unknown").alias("environment"), "service", F.coalesce(
        "component", F.lit("unknown")).alias("component"), evidence.alias("evidence"))


@query
def signal_dedup(spark, d):
    """Repeats of one condition in five minutes collapsed."""
    return dedup.dedup_signals(signals(spark, d)).select("id", "service", "component", "ts", "occurrence_count")


@query
def dedup_share(spark, d):
    s = signals(spark, d)
    return dedup.collapsed_share(s, dedup.dedup_signals(s))


@query
def dedup_alerts_hashed(spark, d):
    return dedup.dedup_alerts(signals(spark, d).select("id", "ts", "service", F.col("template").alias("name")))


@query
def ewma_zscore(spark, d):
    """Running baseline and z of every metric point."""
    s = signals(spark, d).where("source = 'cloudwatch_metric'")
    z = baseline.z_scores(s.select(baseline.series_key(F.col("service"), F.col("metric")).alias("series"), "ts", "id", "value"))
    odd, score = baseline.metric_judgement(F.col("z"))
    return z.select("id", "series", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round(
        "z", 4).alias("z"), odd.alias("is_anomaly"), F.round(score, 4).alias("score"))


@query
def metric_breach(spark, d):
    s = signals(spark, d).where("value > threshold")
    return s.select("id", "service", F.round(baseline.breach(F.col("value"), F.col("threshold")), 6).alias("score"))


@query
def template_rates(spark, d):
    """Long-run rate of each service's log templates and what each five-minute batch makes of it."""
    s = signals(spark, d).where("source = 'app_log'")
    n = s.groupBy(F.concat_ws("|", "service", "template").alias("template"), dedup.bucket(F.col("ts"), 5).alias("batch")).agg(
        F.count("*").alias("n"), F.min("sev_rank").alias("sev_rank"))
    rate = baseline.template_rates(n).join(n.select("template", "batch", "sev_rank"), ["template", "batch"])
    reason, score = baseline.log_judgement(F.col("sev_rank"), F.col("n"), F.col("rate"))
    return rate.select("template", "batch", "n", F.round("rate", 6).alias("rate"), reason.alias("reason"), F.round(
        score, 6).alias("score"))


@query
def reason_tally(spark, d):
    reason = F.when(F.col("anomaly_score") > 0.6, "breach").when(F.col("is_anomaly"), "error").otherwise("none")
    return scored(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query
def score_histogram(spark, d):
    bin_ = F.least(F.lit(9), F.floor(F.col("anomaly_score") * 10)).cast("int")
    return scored(spark, d).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


@query
def minute_volume(spark, d):
    return timeline.minute_volume(baseline.detect(signals(spark, d)))


@query
def top_conditions(spark, d):
    """The fifteen most repeated conditions: a report."""
    key = T.context_key(F.col("service"), F.col("component"), F.lit(None).cast("string"), F.col("metric"), F.col("message"))
    n = signals(spark, d).groupBy(key.alias("context")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max(
        "ts").alias("last"))
    return n.orderBy(F.desc("n"), "context").limit(15)


@query
def source_mix(spark, d):
    return dedup.dedup_signals(signals(spark, d)).groupBy("source").agg(F.sum(F.greatest(F.lit(1), F.col(
        "occurrence_count"))).alias("n"))


@query
def service_stats(spark, d):
    severe = (F.col("sev_rank") <= 1).cast("int")
    return signals(spark, d).groupBy("service").agg(F.count("*").alias("n"), F.sum(severe).alias("severe"), F.round(
        F.avg(severe), 6).alias("error_rate"))


@query
def severity_counts(spark, d):
    return signals(spark, d).groupBy("severity", "sev_rank").agg(F.count("*").alias("n")).orderBy("sev_rank")


@query
def facet_counts(spark, d):
    """Counts of each facet under the other facets' choices (severity high or warning, source not dashboards)."""
    s = signals(spark, d)
    sev, src = F.col("severity").isin("high", "warning"), F.col("source").isin("app_log", "cloudwatch_metric")
    a = s.where(src).groupBy(F.col("severity").alias("value")).agg(F.count("*").alias("n")).withColumn("facet", F.lit("severity"))
    b = s.where(sev).groupBy(F.col("source").alias("value")).agg(F.count("*").alias("n")).withColumn("facet", F.lit("source"))
    c = s.where(sev & src).groupBy(F.col("service").alias("value")).agg(F.count("*").alias("n")).withColumn("facet", F.lit("service"))
    return a.unionByName(b).unionByName(c)


@query
def feed_query(spark, d):
    """The newest 100 anomalous signals with a score of at least 0.6: the feed's own limit."""
    return anomalous(spark, d).where("anomaly_score >= 0.6").orderBy(F.desc("ts"), F.desc("id")).limit(100).select(
        "id", "ts", "service", F.round("anomaly_score", 6).alias("score"))


@query
def rule_classify(spark, d):
    """First matching rule of each part's name and type."""
    kind = (
        F.when(F.lower("p_type").rlike("steel|iron"), "metal").when(F.lower("p_type").rlike("copper|brass"), "alloy").when(
            F.lower("p_type").contains("tin"), "tin").otherwise("other"))
    return read(spark, d, "part").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


# --- graph


@query
def span_edges(spark, d):
    """Edges between nations of customers and suppliers: parent spans are orders, child spans lines."""
    li, o = read(spark, d, "lineitem"), read(spark, d, "orders")
    c, s = read(spark, d, "customer"), read(spark, d, "supplier")
    j = li.select("l_orderkey", "l_suppkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(
        s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    j = j.where("c_nationkey <> s_nationkey")
    return j.groupBy(F.col("c_nationkey").alias("caller"), F.col("s_nationkey").alias("callee")).agg(F.count("*").alias("spans"))


# --- pairs and clusters


@query
def candidate_pairs(spark, d):
    return pairs.candidates(anomalous(spark, d), edges(spark)).select("a_id", "b_id")


@query
def gate_reasons(spark, d):
    e = edges(spark)
    g = pairs.gated(pairs.candidates(anomalous(spark, d), e), e)
    return g.groupBy(F.coalesce("gate", F.lit("rejected")).alias("gate")).agg(F.count("*").alias("n"))


@query
def pair_similarity(spark, d):
    return scored_pairs(spark, d).select("a_id", "b_id", "gate", F.round("time_term", 6).alias("time_term"), "service_term",
                                         "dependency_term", F.round("template_term", 6).alias("template_term"), "component_term", "sim")


@query
def incident_components(spark, d):
    m, _ = membership(spark, d)
    return m.select("id", "label")


@query
def cluster_summary(spark, d):
    m, found = membership(spark, d)
    return incidents.annotate(m, found).select("label", "n_signals", "n_services", "started", "ended", F.round("peak", 6).alias(
        "peak"), "n_links", "mean_sim", "strong_links", "density", "correlator_confidence")


@query
def gate_histogram(spark, d):
    m, found = membership(spark, d)
    r = incidents.link_stats(found, m.select("id", "label"))
    return r.select("label", F.explode("reasons").alias("r")).select("label", "r.gate", "r.n")


@query
def validation_checks(spark, d):
    m, found = membership(spark, d)
    return incidents.validation(m, incidents.annotate(m, found))


@query
def cluster_confidence(spark, d):
    m, found = membership(spark, d)
    return incidents.correlation_confidence(m, found, topology.hops(edges(spark)))


@query
def weak_bridge_parts(spark, d):
    """Clusters after splitting at weak bridges (procedural; rows only)."""
    m, found = membership(spark, d)
    return bridges.split_weak_bridges(m, found)


@query
def causal_split(spark, d):
    """Clusters with several independent causes, by cause (procedural; rows only)."""
    m, s = _scores(spark, d)
    e = edges(spark)
    return splitting.split(m, s, topology.dependents(e), topology.hops(e))


@query
def near_misses(spark, d):
    m, found = membership(spark, d)
    noise = anomalous(spark, d).join(m.select("id"), "id", "left_anti")
    return incidents.near_misses(incidents.annotate(m, found), m, noise, edges(spark))


@query
def pending_expiry(spark, d):
    """Anomalies in no cluster: waiting, or expired 15 minutes before the newest event."""
    m, _ = membership(spark, d)
    s = anomalous(spark, d)
    clock = signals(spark, d).agg(F.max("ts").alias("clock"))
    left = s.join(m.select("id"), "id", "left_anti").join(F.broadcast(clock), F.lit(True))
    return left.select("id", F.when(F.col("clock") - F.col("ts") > 15 * 60_000_000, "expired").otherwise("waiting").alias("fate"))


# --- causes and severity


@query
def service_onsets(spark, d):
    m, _ = membership(spark, d)
    return causal.onsets(m)


@query
def temporal_precedence(spark, d):
    m, _ = membership(spark, d)
    return causal.precedence(causal.onsets(m)).select("label", "service", "temporal")


@query
def causal_scores(spark, d):
    _, s = _scores(spark, d)
    return s.select("label", "service", "temporal", "reach", "strength", "is_symptom", "n_unique", "rank_score")


@query
def root_causes(spark, d):
    return rooted(spark, d)[1]


@query
def representative_signals(spark, d):
    m, _ = membership(spark, d)
    return causal.representative(m)


@query
def impact_severity(spark, d):
    return rooted(spark, d)[2]


@query
def p1_calibration(spark, d):
    return severity.p1_warning(rooted(spark, d)[2])


@query
def trend_direction(spark, d):
    m, _ = membership(spark, d)
    return severity.trend(m)


@query
def flap_counts(spark, d):
    m, _ = membership(spark, d)
    return severity.flaps(m).join(severity.diversity(m), "label")


@query
def maintenance_suppression(spark, d):
    """Clusters that maintenance windows (the first hour of each day for even services, all of the second day) cover."""
    m, _ = membership(spark, d)
    day = 86_400_000_000
    lo = 1_704_067_200_000_000
    rows = [(f"svc{i}", lo + k * day, lo + k * day + day // 4, True) for i in range(0, 12, 2) for k in range(4)]
    rows += [(None, lo + day, lo + 2 * day, True), (None, lo, lo + 30 * day, False)]
    w = spark.createDataFrame(rows, "service string, start_ts long, end_ts long, enabled boolean")
    return severity.suppressed(m, w)


@query
def escalation_risk(spark, d):
    m, _ = membership(spark, d)
    return legacy.escalation_risk(m)


@query
def blast_forecast(spark, d):
    m, _ = membership(spark, d)
    h = topology.hops(edges(spark)).where("hops > 0").select(F.col("a").alias("service"), F.col("b").alias("dependent"), "hops")
    return legacy.forecast(m, h.join(topology.dependents(edges(spark)), ["service", "dependent"], "left_semi"))


# --- evaluation


def truth_table(spark, d):
    m, _ = membership(spark, d)
    s = anomalous(spark, d)
    return s.select("id", F.col("trace_id").alias("truth")).join(m.select("id", "label"), "id", "left")


@query
def pair_evaluation(spark, d):
    return evaluate.pair_scores(truth_table(spark, d))


@query
def story_completeness(spark, d):
    return evaluate.story_scores(truth_table(spark, d))


@query
def mixed_clusters(spark, d):
    return evaluate.mixed_clusters(truth_table(spark, d))


@query
def label_purity(spark, d):
    """Quality labels against sources: purity and pairs from contingency alone."""
    t = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("label")).join(
        read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("truth")), "id")
    return evaluate.pair_scores(t)


@query
def reliability_curve(spark, d):
    m, found = membership(spark, d)
    a = incidents.annotate(m, found)
    pure = evaluate.mixed_clusters(truth_table(spark, d)).select("label", (F.col("majority") / F.col("n")).alias("purity"))
    return evaluate.reliability(a.select("label", F.least("correlator_confidence", F.lit(1.0)).alias("confidence")).join(pure, "label"))


# --- timelines


@query
def timeline_islands(spark, d):
    s = signals(spark, d).select("service", "ts", "id", "source", "template")
    return timeline.islands(s, "service", ["ts", "id"], ["source", "template"])


@query
def story_sessions(spark, d):
    return timeline.sessions(signals(spark, d).where("sev_rank <= 2"), "service", 15)


@query
def busiest_window(spark, d):
    return timeline.busiest(signals(spark, d).where("sev_rank <= 1"))


@query
def adaptive_histogram(spark, d):
    return timeline.histogram(signals(spark, d).select("ts"))


@query
def noise_curve(spark, d):
    k = dedup.dedup_signals(signals(spark, d)).groupBy(F.floor(F.col("ts") / 3_600_000_000).alias("minute")).agg(
        F.count("*").alias("kept"), F.sum("occurrence_count").alias("n"))
    return timeline.noise_curve(k)


@query
def greedy_slices(spark, d):
    s = signals(spark, d).where("source = 'app_log'")
    got = timeline.slices(s.select(F.col("service"), "ts", "id"), "service", 600)
    return got.groupBy("service", "slice").agg(F.count("*").alias("n"), F.min("ts").alias("started"))


@query
def replay_pacing(spark, d):
    return timeline.pacing(signals(spark, d).select("service", "ts", "id"), "service", 2.0).select("id", "wait_s")


@query
def conversation_islands(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("conv"), "turn", "role")
    return timeline.islands(c, "conv", ["turn"], ["role"])


# --- text


@query
def token_sets(spark, d):
    s = signals(spark, d)
    t = T.tokens(F.col("message"), F.col("metric"), F.col("component"))
    return s.select("id", F.array_join(F.array_sort(t), " ").alias("words"))


@query
def library_coverage(spark, d):
    """Benchmark items as a library: the item each document covers best."""
    w = lambda t, k, n: t.select(F.col(k).alias(n), F.explode(F.array_distinct(F.regexp_extract_all(
        F.lower("text"), F.lit("([a-z]{4,})"), 1))).alias("word"))
    lib = w(read(spark, d, "benchmark"), "item_id", "item").distinct()
    return similar_text.library_match(w(read(spark, d, "documents"), "doc_id", "label"), lib, 0.8)


@query
def tfidf_cosine(spark, d):
    """Cosine of benchmark items by TF-IDF of words and word pairs, 0.2 or more."""
    t = similar_text.tfidf(read(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"))
    return similar_text.cosines(t, t).where("a < b").select("a", "b", F.round("cosine", 6).alias("cosine")).where("cosine >= 0.2")


@query
def density_clusters(spark, d):
    """DBSCAN with three samples over links of alike signals."""
    e = linked(spark, d).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return similar_text.density_clusters(e, anomalous(spark, d).select("id"))


@query
def template_masks(spark, d):
    docs = read(spark, d, "conversations")
    return docs.groupBy(T.template(F.col("text")).alias("template")).agg(F.count("*").alias("n"))


@query
def redaction_kinds(spark, d):
    """Kinds of personal data found in documents (patterns both engines read alike)."""
    docs = read(spark, d, "documents")
    return docs.select("doc_id", F.explode(redaction.kinds_found(F.col("text"))).alias("kind")).groupBy("kind").agg(
        F.count("*").alias("n"))


@query
def redacted_documents(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", redaction.redact_simple(F.col("text")).alias("text"))


# --- tables


@query
def upsert_latest(spark, d):
    """Keep-latest merge: the last order status of each customer, of orders that came in two lots."""
    o = read(spark, d, "orders").withColumn("ts", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    last = sinks.keep_latest(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey", "ts", "o_orderkey")
    n = o.groupBy("o_custkey").agg(F.count("*").alias("versions"))
    return last.join(n, "o_custkey").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"), "versions")


@query
def action_overlay(spark, d):
    """Orders with the overlay of urgent actions: a left join with override."""
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    act = read(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    j = o.join(act, o.o_orderkey == act.k, "left")
    return j.groupBy(F.when(F.col("n") >= 2, "escalated").otherwise(F.col("o_orderstatus")).alias("status")).agg(
        F.count("*").alias("orders"))


@query
def stratified_sample(spark, d):
    """2,000 evenly spaced signals over severities: a sampling operator."""
    return legacy.stratified_sample(signals(spark, d).select("id", "ts", "severity"), "severity", 2000)


@query
def median_decision_time(spark, d):
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    j = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority", "o_orderkey").agg(
        F.min(F.datediff("l_shipdate", "o_orderdate")).alias("days"))
    return j.groupBy("o_orderpriority").agg(F.round(F.median("days"), 4).alias("median_days"), F.count("*").alias("n"))
