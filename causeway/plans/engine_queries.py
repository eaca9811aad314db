"""Named queries on mined templates, recordings, streams, splits and sweeps, with their SQL beside them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import scrub
from ..operators import (
    bundle,
    causal,
    evaluate,
    evidence,
    explain,
    incidents,
    pairs,
    propagation,
    severity,
    similar_text,
    splitting,
    sweeps,
    templates,
    text_links,
    tickets,
    topology,
    truth,
    validated,
)
from ..sources import appended, days
from ..streaming import live, metrics
from ..streaming.review import adjusted_weights
from ..tables import read, shared_dir, written
from . import oracles
from .catalog import QUERIES, _scores, anomalous, membership, query, reach, rooted, scored, scored_pairs
from .incident_queries import _NUM
from .incident_queries import _TOLD as _SAID
from .runs import kept
from .signals import edges, signals

TEXTS: dict[str, tuple[str, str]] = {}


def sql(views: str, text: str):
    """The query with its SQL: the views it needs and its SELECT."""

    def add(f):
        TEXTS[f.__name__] = views, text
        return query(f)

    return add


# --- templates


def document_lines(spark, d) -> DataFrame:
    """Lines of all documents as log lines: a document's place in time is its id."""
    return read(spark, d, "documents").select(F.col("doc_id").alias("ts"), F.posexplode(F.split("text", "\n")).alias("id", "message")).select(
        "ts", F.col("id").cast("long").alias("id"), "message")


@query
def mined_templates(spark, d):
    """Templates of all lines of documents by the prefix tree (ordered folds; compared with a slow reader in tests)."""
    return templates.templates(document_lines(spark, d))[0]


@sql("", """SELECT template, n_words, n_lines, n_distinct FROM (SELECT event_type || CASE WHEN count(DISTINCT k) > 1 THEN ' <*>' ELSE ' k=' || min(k) END AS template, 2 AS n_words,
  count(*) AS n_lines, count(DISTINCT k) AS n_distinct FROM ev GROUP BY event_type)""")
def mined_signal_templates(spark, d):
    """Templates of the signals' messages: one for each kind, its value masked where it varies."""
    found, _ = templates.templates(signals(spark, d).select("ts", "id", "message"))
    return found.select("template", "n_words", "n_lines", "n_distinct")


# --- validation


def _environment() -> Column:
    k = F.pmod("id", F.lit(7))
    return F.when(k.isin(1, 2), "staging").when(k > 2, "production")


@query
def validated_incidents(spark, d):
    """What becomes of each candidate cluster: split by cause, environment and weak bridges, then checked (compared with a
    plain worklist in tests)."""
    (m, scores), (_, found) = _scores(spark, d), membership(spark, d)
    down, near = reach(spark, d), topology.hops(edges(spark))
    causes = splitting.split(m, scores, down, near).select("id", "centre")
    verdicts, _ = validated.validated(m.withColumn("environment", _environment()), found, near, causes)
    return verdicts


# --- recordings and streams


def _recording(spark, d) -> DataFrame:
    """Events as lines of a recording: three streams, every fifth event skipped, every seventh without an id."""
    e = read(spark, d, "events")
    stream = F.element_at(F.array(F.lit("app-logs"), F.lit("aws-cloudwatch"), F.lit("dash-grafana")), (F.col("user_id") % 3 + 1).cast("int"))
    outcome = F.when(F.col("event_id") % 5 == 0, "skipped").otherwise("signal")
    ident = F.when(F.col("event_id") % 7 > 0, F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 12, "0")))
    line = F.to_json(F.struct(F.lit("event").alias("kind"), stream.alias("stream"), ident.alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(
        "at"), outcome.alias("outcome"), F.struct("event_type", "value").alias("signal")))
    return e.select("event_id", line.alias("value"))


@sql("", """SELECT ['app-logs', 'aws-cloudwatch', 'dash-grafana'][user_id % 3 + 1] AS stream, count(*) AS events, count_if(event_id % 5 > 0)::BIGINT AS signals, count_if(event_id % 5 = 0)::BIGINT AS skipped, 0::BIGINT AS errors,
  max(CASE WHEN event_id % 7 > 0 THEN 'e' || lpad(event_id::VARCHAR, 12, '0') END) AS last_id FROM events GROUP BY 1""")
def replayed_recording(spark, d):
    """Counters and resume points of a recording that is read as a stream, stopped, grown and resumed."""
    folder = f"{shared_dir(spark)}/recording-{uuid.uuid4().hex}"
    lines, half = _recording(spark, d), read(spark, d, "events").agg(F.expr("percentile(event_id, 0.5)")).first()[0] or 0
    for part in (lines.where(F.col("event_id") <= half), lines.where(F.col("event_id") > half)):
        # later lines come in later files, as a recorder rolls them
        part.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select("value").write.mode("append").text(f"{folder}/lines")
        appended.recorded(spark, f"{folder}/lines").writeStream.format("parquet").option("path", f"{folder}/read").option(
            "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{folder}/read")
    # ids rise with time, so the last by name is the last recorded
    return appended.resume_points(got.select("stream", "id", "outcome", F.coalesce("id", F.lit("")).alias("file"), F.lit(0).alias("place")))


@sql("+members", "SELECT id, label FROM members")
def streamed_members(spark, d):
    """Members of the incidents that the streaming engine forms from all anomalous signals in one batch, every candidate
    accepted and repeats left as the batch dedup has them: what incident_components finds."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    anomalous(spark, d).write.parquet(f"{folder}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    engine = live.IncidentStream(f"{folder}/state", edges(spark), accept=lambda m, _: m.select("label").distinct(), repeat_minutes=0)
    engine.replay(source, f"{folder}/checkpoint")
    return engine.members(spark, 0).select("id", "label")


_HIT = "count_if(coalesce({}, false))::BIGINT AS {}"


@sql("+scored", "SELECT sum(occurrence_count)::BIGINT AS received, count(*) AS distinct_, " + ", ".join([_HIT.format("is_anomaly", "anomalies"), _HIT.format("occurrence_count > 1", "repeated"), "max(ts) AS clock", *[
    _HIT.format(f"source = '{s}'", f"from_{s}") for s in metrics.SOURCES], *[_HIT.format(f"least(floor(anomaly_score * 10), 9) = {k}", f"score_{k}") for k in range(10)]]) + " FROM scored")
def observed_run(spark, d):
    """The figures of a run over all judged signals, counted while they are written."""
    seen = Observation("run")
    written(metrics.observed(scored(spark, d), seen), "observed")
    row = seen.get
    return spark.createDataFrame([tuple(row[k] for k in metrics.measures())], ", ".join(f"{k} long" for k in metrics.measures())).withColumnRenamed("distinct", "distinct_")


# --- sweeps

THRESHOLDS = [0.45, 0.5, 0.55, 0.6, 0.7]


def _truth(spark, d) -> DataFrame:
    return anomalous(spark, d).select("id", F.col("trace_id").alias("truth"), F.floor(F.col("ts") / 86_400_000_000).alias("day"))


_SCORED = """SELECT config{by}, round(coalesce(hit, 0) / predicted, 6) AS precision, round(coalesce(hit, 0) / actual, 6) AS recall, round(coalesce(CASE WHEN coalesce(hit, 0) = 0 THEN 0.0
  ELSE 2 * (hit / predicted) * (hit / actual) / (hit / predicted + hit / actual) END, 0.0), 6) AS f1, round(major / placed::DOUBLE, 6) AS purity FROM (SELECT config{by}, sum(n * (n - 1) / 2.0)::DOUBLE AS predicted FROM (
  SELECT config{by}, label, count(*) AS n FROM placed GROUP BY ALL) GROUP BY ALL) LEFT JOIN (SELECT config{by}, sum(n * (n - 1) / 2.0)::DOUBLE AS hit FROM (
  SELECT config{by}, label, truth, count(*) AS n FROM placed WHERE truth IS NOT NULL GROUP BY ALL) GROUP BY ALL) USING (config{by}) LEFT JOIN (SELECT config{by}, sum(m) AS major, sum(n) AS placed FROM (
  SELECT config{by}, label, max(n) AS m, sum(n) AS n FROM (SELECT config{by}, label, truth, count(*) AS n FROM placed WHERE truth IS NOT NULL GROUP BY ALL) GROUP BY ALL) GROUP BY ALL) USING (config{by})
  {want}"""
_WHOLE = _SCORED.format(by="", want=", (SELECT sum(n * (n - 1) / 2.0)::DOUBLE AS actual FROM (SELECT trace_id, count(*) AS n FROM anom WHERE trace_id IS NOT NULL GROUP BY 1))")
_DAILY = _SCORED.format(by=", day", want="LEFT JOIN (SELECT day, sum(n * (n - 1) / 2.0)::DOUBLE AS actual FROM (SELECT floor(ts / 86400000000.0)::BIGINT AS day, trace_id, count(*) AS n FROM anom WHERE trace_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1) USING (day)")
_CLUSTERS = """both_ways AS (SELECT config, a_id AS p, b_id AS q FROM met UNION SELECT config, b_id, a_id FROM met),
  spreads AS (SELECT config, p AS id, p AS r FROM both_ways UNION SELECT s.config, y.q, s.r FROM spreads s JOIN both_ways y ON y.config = s.config AND y.p = s.id),
  placed AS (SELECT config, m.id, label, trace_id AS truth, floor(ts / 86400000000.0)::BIGINT AS day FROM (SELECT config, id, min(r) AS label FROM spreads GROUP BY ALL) m JOIN anom USING (id))"""
_AT = f"""met AS (SELECT t.config, a_id, b_id FROM sims, (VALUES {', '.join(f'({round(100 * t)})' for t in THRESHOLDS)}) t(config) WHERE round(sim * 1e6)::BIGINT >= t.config * 10000),"""


def _forest(spark, d) -> DataFrame:
    pair = scored_pairs(spark, d).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("sim").alias("w"))
    # pairs below every threshold tie nothing
    return kept(spark, d, "forest", lambda: sweeps.spanning_forest(pair.where(F.col("w") >= min(THRESHOLDS))))


@sql("+sims", f"SELECT * FROM (WITH RECURSIVE {_AT} {_CLUSTERS} {_WHOLE})")
def threshold_sweep(spark, d):
    """Pair scores and purity of the clusters at other thresholds, from one spanning forest."""
    return sweeps.scores(_truth(spark, d).drop("day"), sweeps.at_thresholds(_forest(spark, d), THRESHOLDS))


@sql("+sims", f"SELECT config, round(avg(f1), 6) AS mean_f1, round(median(f1), 6) AS median_f1, min(f1) AS worst_f1 FROM (WITH RECURSIVE {_AT} {_CLUSTERS} {_DAILY}) GROUP BY config")
def benchmark_sweep(spark, d):
    """Mean, median and worst F1 over days of each threshold."""
    daily = sweeps.scores(_truth(spark, d), sweeps.at_thresholds(_forest(spark, d), THRESHOLDS), "day")
    return evaluate.sweep(daily)


def _left_out() -> str:
    term = lambda k, w: f"{w} * {k}_term"
    total = lambda w: "round(" + " + ".join(term(k, v) for k, v in w.items()) + ", 6)"
    return " UNION ALL ".join(f"SELECT '{name}' AS config, a_id, b_id FROM terms WHERE 1 - {total(w)} <= 0.55" for name, w in sweeps.variants())


_ALONE = """UNION ALL SELECT 'time alone', id, label, trace_id, 0 FROM (SELECT *, min(id) OVER (PARTITION BY run) AS label, count(*) OVER (PARTITION BY run) AS n FROM (SELECT *, sum(starts) OVER (ORDER BY ts, id) AS run
  FROM (SELECT id, ts, trace_id, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, id) <= floor(-ln(1 - 0.55::DOUBLE) * 6e7) THEN 0 ELSE 1 END AS starts FROM anom))) WHERE n > 1)"""


@sql("+terms", f"""SELECT *, round(f1 - max(CASE WHEN config = 'all' THEN f1 END) OVER (), 6) AS delta FROM (WITH RECURSIVE met AS ({_left_out()}), {_CLUSTERS[:-1]} {_ALONE} {_WHOLE})""")
def dimension_ablation(spark, d):
    """Pair scores without each dimension of similarity, and by time alone without the gate."""
    found = sweeps.under_weights(scored_pairs(spark, d), sweeps.variants())
    alone = sweeps.by_time_alone(anomalous(spark, d)).select(F.lit("time alone").alias("config"), "id", "label")
    got = written(sweeps.scores(_truth(spark, d).drop("day"), found.union(alone)), "ablation")
    base = got.where("config = 'all'").select(F.col("f1").alias("base"))
    return got.join(F.broadcast(base), F.lit(True), "left").withColumn("delta", F.round(F.col("f1") - F.col("base"), 6)).drop("base")


# --- how incidents spread, the graph they suggest, known stories


@sql("+roots", """SELECT label, row_number() OVER (PARTITION BY label ORDER BY late, len(chain), chain)::INTEGER AS place, service, "from" FROM (WITH RECURSIVE own AS (SELECT label, service, onset, service AS s FROM onset),
  step AS (SELECT DISTINCT o.label, o.service, o.onset, e.callee AS f FROM onset o JOIN edges e ON e.caller = o.service JOIN onset p ON p.label = o.label AND p.service = e.callee
    WHERE p.onset <= o.onset + 300000000 AND e.callee <> o.service),
  walk_ AS (SELECT o.label, o.service, NULL::VARCHAR AS f, [{'onset': o.onset, 'service': o.service}] AS chain FROM onset o JOIN roots r ON r.label = o.label AND r.root = o.service
    UNION ALL SELECT s.label, s.service, s.f, list_append(w.chain, {'onset': s.onset, 'service': s.service}) FROM walk_ w JOIN step s ON s.label = w.label AND s.f = w.service
    WHERE len(list_filter(w.chain, lambda c: c.service = s.service)) = 0),
  best AS (SELECT label, service, arg_min({'f': f, 'chain': chain}, (len(chain), chain)) AS m FROM walk_ GROUP BY 1, 2)
  SELECT label, service, m.f AS "from", m.chain AS chain, 0 AS late FROM best UNION ALL SELECT label, service, NULL, [{'onset': onset, 'service': service}], 1 FROM onset o
  WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.label = o.label AND b.service = o.service))""")
def propagation_path(spark, d):
    """The services of each incident from its root outwards."""
    _, roots, _ = rooted(spark, d)
    return propagation.propagation(_scores(spark, d)[1], roots)


_EDGES = """SELECT m.root AS source, m.service AS target, m.label FROM (SELECT arg_min({'label': v.label, 'root': r.root, 'service': v.service}, (-i.severity, v.label, r.root, v.service)) AS m FROM svcs v JOIN roots r USING (label)
  JOIN impact i USING (label) WHERE v.service <> r.root GROUP BY least(v.service, r.root), greatest(v.service, r.root))"""


@sql("+impact", _EDGES)
def derived_edges(spark, d):
    """Edges between services that incidents tie, each of its riskiest incident."""
    m, roots, impact = rooted(spark, d)
    return propagation.derived_edges(m, roots, impact.select("label", F.col("severity").alias("score")))


@sql("+impact", """SELECT s.service, t.label, coalesce(r.root = s.service, false) AS is_root, round(100 * severe / n::DOUBLE)::INTEGER AS error_rate, CASE WHEN t.label IS NULL THEN 'healthy'
  WHEN coalesce(r.root = s.service, false) OR t.score >= 0.7 THEN 'critical' ELSE 'warning' END AS status FROM (SELECT service, count(*) AS n, count_if(sev_rank <= 1) AS severe FROM signals GROUP BY 1) s
  LEFT JOIN (SELECT service, arg_min(label, (-severity, label)) AS label, max(severity) AS score FROM svcs JOIN impact USING (label) GROUP BY 1) t ON t.service = s.service LEFT JOIN roots r ON r.label = t.label""")
def derived_nodes(spark, d):
    m, roots, impact = rooted(spark, d)
    stats = signals(spark, d).groupBy("service").agg(F.count("*").alias("n"), F.count_if(F.col("sev_rank") <= 1).alias("severe"))
    return propagation.derived_nodes(stats, m, roots, impact.select("label", F.col("severity").alias("score")))


def _labels(spark, d) -> DataFrame:
    """A log of labelled faults: every second event, 0.4 s after it, in stories of forty; every eleventh is a decoy."""
    story = F.when(F.col("id") % 11 == 0, truth.DECOY).otherwise(F.concat(F.lit("story"), F.floor(F.col("id") / 40).cast("string")))
    return signals(spark, d).where("id % 2 = 0").select("service", (F.col("ts") + 400_000).alias("ts"), story.alias("story"))


_TOLD = """lab AS (SELECT service, ts + 400000 AS ts, min(CASE WHEN id % 11 = 0 THEN 'decoy' ELSE 'story' || (id // 40) END) AS story FROM signals WHERE id % 2 = 0 GROUP BY 1, 2),
  told AS (SELECT a.id, arg_min(l.story, (abs(a.ts - l.ts), l.ts)) AS story FROM anom a JOIN lab l ON l.service = a.service AND abs(a.ts - l.ts) <= 5000000 GROUP BY a.id),
  sroot AS (SELECT 'story' || (id // 40) AS story, arg_min(service, (ts, id)) AS root FROM signals GROUP BY 1),
  mine AS (SELECT m.id, m.label FROM members m), known AS (SELECT * FROM told WHERE story <> 'decoy'),
  cell AS (SELECT label, story, count(*) AS n FROM mine JOIN known USING (id) GROUP BY 1, 2),
  clus AS (SELECT label, sum(n) AS n, max(n) AS most, count(*) AS kinds, arg_min(story, (-n, story)) AS story FROM cell GROUP BY 1),
  stor AS (SELECT story, count(*) AS n FROM known GROUP BY 1), lead_ AS (SELECT c.*, s.root AS true_root, r.root FROM clus c JOIN sroot s USING (story) LEFT JOIN roots r USING (label) WHERE c.most >= 0.6 * c.n),
  figs AS (SELECT (SELECT count(*) FROM stor) AS stories, (SELECT count(DISTINCT label) FROM mine) AS incidents, (SELECT coalesce(sum(n * (n - 1) / 2.0), 0)::DOUBLE FROM stor) AS actual,
    (SELECT coalesce(sum(n * (n - 1) / 2.0), 0)::DOUBLE FROM clus) AS predicted, (SELECT coalesce(sum(n * (n - 1) / 2.0), 0)::DOUBLE FROM cell) AS correct)"""


@sql("+roots", f"""SELECT * FROM (WITH {_TOLD} SELECT stories, incidents, actual, predicted, correct, round(correct / predicted, 6) AS precision, round(correct / actual, 6) AS recall,
  round(2 * (correct / predicted) * (correct / actual) / (correct / predicted + correct / actual), 6) AS f1, (SELECT round(sum(most) / sum(n)::DOUBLE, 6) FROM clus) AS purity,
  (SELECT round(avg(coalesce(m, 0) / n::DOUBLE), 6) FROM stor LEFT JOIN (SELECT story, max(n) AS m FROM cell GROUP BY 1) USING (story)) AS completeness,
  (SELECT count(*) FROM told WHERE story = 'decoy') AS decoys, (SELECT count(*) FROM told JOIN mine USING (id) WHERE story = 'decoy') AS decoys_in, (SELECT count(*) FROM clus WHERE kinds > 1) AS mixed_incidents,
  (SELECT count(*) FROM (SELECT story FROM cell GROUP BY 1 HAVING count(*) > 1)) AS split_stories, (SELECT count(*) FROM lead_) AS dominated, (SELECT count_if(root = true_root)::BIGINT FROM lead_) AS root_correct FROM figs)""")
def ground_truth_scores(spark, d):
    """Incidents against a log of labelled faults, joined by service and nearest time within 5 s."""
    m, roots, _ = rooted(spark, d)
    told = truth.attached(anomalous(spark, d).select("id", "service", "ts"), _labels(spark, d), 5_000_000).where("story is not null")
    first = signals(spark, d).groupBy(F.concat(F.lit("story"), F.floor(F.col("id") / 40).cast("string")).alias("story")).agg(
        F.min(F.struct("ts", "id", "service"))["service"].alias("root"))
    return truth.truth_scores(m.select("id", "label"), told.select("id", "story"), roots, first)


# --- evidence


@sql("+impact", """SELECT * FROM (WITH parts AS (SELECT label, 'part' AS section, 'baseline' AS subject, 0.35::DOUBLE AS value FROM clusters UNION ALL SELECT label, 'part', 'strong links', round(0.45 * (strong_links / n_links::DOUBLE) + 1e-9, 2)
  FROM clusters UNION ALL SELECT label, 'part', 'mean similarity', round(0.30 * mean_sim + 1e-9, 2) FROM clusters)
  SELECT label, 'signal' AS section, row_number() OVER (PARTITION BY label ORDER BY ts, id)::INTEGER AS place, id::VARCHAR AS subject, occurrence_count::DOUBLE AS value FROM members
  UNION ALL SELECT label, 'candidate', row_number() OVER (PARTITION BY label ORDER BY rank_score DESC, onset, service)::INTEGER, service, round(rank_score, 6) FROM scores
  UNION ALL SELECT label, section, row_number() OVER (PARTITION BY label ORDER BY subject)::INTEGER, subject, value FROM parts
  UNION ALL SELECT i.label, 'factor', t.n, t.f, round(t.w * t.s + 1e-9, 3) FROM impact i, LATERAL (VALUES (1, 'blast radius', 0.40, blast), (2, 'business criticality', 0.35, criticality), (3, 'anomaly magnitude', 0.25, magnitude)) t(n, f, w, s)
  UNION ALL SELECT label, 'summary', 1, 'draft-' || label || '-' || floor(started / 1000000.0)::BIGINT, round(severity, 6) FROM impact JOIN clusters USING (label))""")
def evidence_bundle(spark, d):
    """The evidence of every incident as rows (near misses, trend and diversity have queries of their own)."""
    m, roots, impact = rooted(spark, d)
    _, found = membership(spark, d)
    noise = anomalous(spark, d).join(m.select("id"), "id", "left_anti")
    clusters, telling = incidents.annotate(m, found), causal.representative(m)
    pair = scored_pairs(spark, d).join(m.select(F.col("id").alias("a_id")), "a_id", "left_semi").join(m.select(F.col("id").alias("b_id")), "b_id", "left_semi")
    rows = bundle.bundle(
        m, evidence.strongest_joins(m, pair), evidence.drafts(m, roots, telling), roots, telling, impact, _scores(spark, d)[1],
        incidents.near_misses(clusters, m, noise, edges(spark)), bundle.factors(impact, severity.trend(m), severity.diversity(m)),
        evidence.confidence_parts(clusters), noise)
    return rows.where("section <> 'excluded' and not (section = 'factor' and place > 3)").drop("body")


LEARNED = [(1, ["svc0", "svc1", "svc2"], ["approve"]), (2, ["svc1", "svc3", "svc4", "svc7"], ["reject"]), (3, ["svc2", "svc5", "svc6", "svc11"], ["approve", "approve"])]


def _learned() -> list[tuple[int, list[str], dict[str, float]]]:
    """Weight sets of three groups of services after a reviewer's decisions."""
    out = []
    for k, services, actions in LEARNED:
        w = dict(pairs.WEIGHTS)
        for action in actions:
            w = adjusted_weights(w, action)
        out.append((k, services, w))
    return out


def _learned_sql() -> str:
    inside = lambda services: " AND ".join(f"list_contains({services!r}, {c}.service)" for c in ("ra", "rb"))
    total = lambda w: " + ".join(f"{v} * {k}_term" for k, v in w.items())
    cases = " ".join(f"WHEN {inside(services)} THEN {total(w)}" for _, services, w in _learned())
    return f"round(CASE {cases} ELSE {total(pairs.WEIGHTS)} END, 6)"


@sql("+sims", f"""SELECT g.a_id, g.b_id, {_learned_sql()} AS sim FROM terms t JOIN gated g ON g.a_id = t.a_id AND g.b_id = t.b_id WHERE 1 - {_learned_sql()} <= 0.55""")
def learned_links(spark, d):
    """Links under the weights that reviewers' decisions have taught for some services, else under the default."""
    e = edges(spark)
    learned = spark.createDataFrame(_learned(), "k int, services array<string>, weights map<string,double>")
    gated = pairs.gated(pairs.candidates(anomalous(spark, d), e), e)
    return pairs.links(pairs.similarity(pairs.learned_sets(gated, learned))).select("a_id", "b_id", "sim")


TEXTS["p1_live_calibration"] = "+impact", f"""SELECT *, coalesce(incidents >= 3 AND p1_share > 0.4, false) AS warn FROM (SELECT count(*) AS incidents, count_if(NOT suppressed)::BIGINT AS live,
  round(avg(CASE WHEN NOT suppressed THEN CASE WHEN priority = 'P1' THEN 1.0 ELSE 0.0 END END), 6) AS p1_share FROM impact JOIN ({oracles.TEXTS['maintenance_suppression'][1]}) USING (label))"""


@query
def p1_live_calibration(spark, d):
    """The share of P1 among incidents that no maintenance window holds back."""
    return severity.p1_warning(rooted(spark, d)[2], suppressed=QUERIES["maintenance_suppression"](spark, d))


TEXTS["validated_confidence_parts"] = "+clusters", "SELECT label, 'density' AS part, round(0.40 * density + 1e-9, 2) AS points FROM clusters"


@query
def validated_confidence_parts(spark, d):
    """The density term of each cluster's confidence (the other terms are in cluster_confidence)."""
    m, found = membership(spark, d)
    terms = incidents.confidence_terms(m, found, topology.hops(edges(spark)), None)
    return evidence.validated_parts(terms).where("part = 'density'")


# --- redaction


@query
def scrubbed_documents(spark, d):
    """Documents after every pass of the redaction, names that their addresses show among them, with the kinds found (both
    engines' patterns differ, so tests compare with plain Python)."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    return scrub.known(scrub.redacted(docs, "text"), "text", scrub.learned(docs, "text"))


@query
def scrubbed_payloads(spark, d):
    """Documents as nested payloads, redacted inside: the service stays, prose at any depth doesn't."""
    note = F.named_struct(F.lit("note"), F.col("text"), F.lit("n"), F.col("doc_id"))
    raw = F.to_json(F.named_struct(F.lit("id"), F.col("doc_id"), F.lit("service"), F.lit("mail ops@example.com"), F.lit("labels"), note, F.lit(
        "lines"), F.slice(F.split("text", "\n"), 1, 2)))
    return read(spark, d, "documents").select("doc_id", scrub.payload(raw).alias("payload"))


# --- texts


def _alerts(spark, d) -> DataFrame:
    return anomalous(spark, d).select("id", "ts", F.concat_ws(" ", "service", "source", "message").alias("text"))


def _terms_sql(text: str) -> str:
    words = f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
    return f"list_concat({words}, list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1]))"


_NEAR = f"""told AS (SELECT id, ts, service || ' ' || source || ' ' || message AS text FROM anom),
  tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_terms_sql('text')}) AS term FROM told) GROUP BY ALL),
  idf AS (SELECT term, ln((1 + (SELECT count(*) FROM told)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf GROUP BY term),
  vec AS (SELECT id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS w FROM tf JOIN idf USING (term)),
  close AS (SELECT a.id AS a, b.id AS b, abs(a.ts - b.ts) / 6e7 AS gap FROM told a JOIN told b ON a.id < b.id AND abs(a.ts - b.ts) <= 4.25 * 60000000),
  like_ AS (SELECT a, b, gap, round(sum(x.w * y.w), 9) AS c FROM close JOIN vec x ON x.id = a JOIN vec y ON y.id = b AND y.term = x.term GROUP BY ALL),
  edge AS (SELECT a, b, round(1 - coalesce(c, 0), 9) AS semantic, round(2 * least(gap / 6, 1.0) ** 2, 9) AS time FROM close LEFT JOIN like_ USING (a, b, gap)),
  near AS (SELECT *, round(greatest(semantic + time, 0.0), 9) AS distance FROM edge WHERE round(semantic + time, 9) <= 1.0)"""


@sql("+anom", f"""SELECT gap, count(*) AS n, round(sum(round(distance * 1e6)::BIGINT)::BIGINT / 1e6, 6) AS distances FROM (SELECT *, floor(time * 10)::INTEGER AS gap FROM (WITH {_NEAR} SELECT * FROM near)) GROUP BY gap""")
def text_distances(spark, d):
    """Pairs of alerts that are near by wording and time, by tenths of the time penalty."""
    got = text_links.near(_alerts(spark, d))
    total = F.round(F.sum(F.round(F.col("distance") * 1e6).cast("long")) / 1e6, 6)
    return got.groupBy(F.floor(F.col("time") * 10).cast("int").alias("gap")).agg(F.count("*").alias("n"), total.alias("distances"))


@sql("+anom", f"""SELECT id, coalesce(label, -1) AS label FROM (WITH RECURSIVE {_NEAR}, two AS (SELECT a AS p, b AS q FROM near UNION SELECT b, a FROM near), core AS (SELECT p AS id FROM two GROUP BY p HAVING count(*) >= 2),
  inn AS (SELECT p, q FROM two WHERE p IN (SELECT id FROM core) AND q IN (SELECT id FROM core)), sp AS (SELECT id, id AS r FROM core UNION SELECT inn.q, sp.r FROM sp JOIN inn ON inn.p = sp.id),
  known AS (SELECT id, min(r) AS label FROM sp GROUP BY id), border AS (SELECT p AS id, min(label) AS label FROM two JOIN known ON known.id = q WHERE p NOT IN (SELECT id FROM core) GROUP BY p)
  SELECT t.id, coalesce(k.label, b.label) AS label FROM told t LEFT JOIN known k ON k.id = t.id LEFT JOIN border b ON b.id = t.id)""")
def text_clusters(spark, d):
    """Density clusters of alerts by wording and time."""
    got = text_links.near(_alerts(spark, d))
    return similar_text.density_clusters(got.select("a", "b"), _alerts(spark, d).select("id"))


@sql("", f"""SELECT label, item, similarity FROM (WITH parts AS (SELECT item_id AS item, i AS part, p AS text FROM (SELECT item_id, unnest(string_split(text, '.')) AS p, generate_subscripts(string_split(text, '.'), 1) AS i FROM benchmark)),
  lines AS (SELECT doc_id AS label, i AS part, p AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
  ptf AS (SELECT item, part, term, count(*) AS tf FROM (SELECT item, part, unnest({_terms_sql('text')}) AS term FROM parts) GROUP BY ALL),
  idf AS (SELECT term, ln((1 + (SELECT count(DISTINCT item_id) FROM benchmark)) / (1 + count(DISTINCT item))::DOUBLE) + 1 AS idf FROM ptf GROUP BY term),
  pv AS (SELECT item, term, sum(w) AS w FROM (SELECT item, part, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY item, part)) AS w FROM ptf JOIN idf USING (term)) GROUP BY ALL),
  iv AS (SELECT item, term, w / sqrt(sum(w * w) OVER (PARTITION BY item)) AS w FROM pv),
  ltf AS (SELECT label, part, term, count(*) AS tf FROM (SELECT label, part, unnest({_terms_sql('text')}) AS term FROM lines) GROUP BY ALL),
  lv AS (SELECT label, term, sum(w) AS w FROM (SELECT label, part, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY label, part)) AS w FROM ltf JOIN idf USING (term)) GROUP BY ALL),
  cv AS (SELECT label, term, w / sqrt(sum(w * w) OVER (PARTITION BY label)) AS w FROM lv)
  SELECT label, item, round(sum(cv.w * iv.w), 6) AS similarity FROM cv JOIN iv USING (term) GROUP BY label, item HAVING round(sum(cv.w * iv.w), 6) >= 0.25
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(sum(cv.w * iv.w), 6) DESC, item) = 1)""")
def library_argmax(spark, d):
    """The benchmark item whose sentences each document's lines are most like, by centroids."""
    part = lambda t, key, cut: read(spark, d, t).select(F.col(key), F.posexplode(F.split("text", cut)).alias("part", "text"))
    library = text_links.Library(part("benchmark", "item_id", r"\.").withColumnRenamed("item_id", "item"))
    return library.best(part("documents", "doc_id", "\n").withColumnRenamed("doc_id", "label"))


# --- explanations and comparisons


def _labels_of(spark, d) -> DataFrame:
    return membership(spark, d)[0].select("id", "label")


_CONF = "least(greatest({}, 0), 1) + 1e-9"


@sql("+labels", f"""SELECT *, round_even(round((time_proximity + template_similarity + service_affinity + cohesion) * 25, 6), 0)::INTEGER AS confidence_pct FROM (WITH {_NEAR},
  own AS (SELECT l.label, t.id, t.ts, a.service FROM told t JOIN labels l USING (id) JOIN anom a USING (id)),
  pr AS (SELECT x.label, x.id AS a, y.id AS b, abs(x.ts - y.ts) AS gap FROM own x JOIN own y ON x.label = y.label AND x.id < y.id),
  dots AS (SELECT pr.label, sum(x.w * y.w) AS dots FROM pr JOIN vec x ON x.id = pr.a JOIN vec y ON y.id = pr.b AND y.term = x.term GROUP BY 1),
  g AS (SELECT label, avg(gap) / 6e7 AS gap, count(*)::DOUBLE AS pairs FROM pr GROUP BY 1), sv AS (SELECT label, max(c) / sum(c)::DOUBLE AS share, sum(c) AS n FROM (SELECT label, service, count(*) AS c FROM own GROUP BY 1, 2) GROUP BY 1),
  cl AS (SELECT x.label, count(*) AS close FROM near JOIN own x ON x.id = near.a JOIN own y ON y.id = near.b AND y.label = x.label GROUP BY 1)
  SELECT g.label, sv.n::BIGINT AS n, round({_CONF.format('1 - gap / 6')}, 2) AS time_proximity, round({_CONF.format('coalesce(dots, 0) / pairs')}, 2) AS template_similarity, round({_CONF.format('share')}, 2) AS service_affinity,
    round({_CONF.format('coalesce(close, 0) / pairs')}, 2) AS cohesion FROM g JOIN sv USING (label) LEFT JOIN dots USING (label) LEFT JOIN cl USING (label))""")
def correlation_explanation(spark, d):
    """Why the alerts of each incident stand together, in four shares and their mean."""
    alerts = anomalous(spark, d).select("id", "ts", "service", F.concat_ws(" ", "service", "source", "message").alias("text"))
    return explain.explanation(alerts, _labels_of(spark, d), text_links.near(alerts))


@sql("+labels", f"""SELECT label, id, distance, place::INTEGER AS place FROM (WITH {_NEAR.replace('4.25 * 60000000', '5.4 * 60000000').replace('<= 1.0)', '<= 1.6)')},
  two AS (SELECT a AS id, b AS member, distance FROM near UNION ALL SELECT b, a, distance FROM near),
  best AS (SELECT l.label, two.id, min(distance) AS distance FROM two JOIN labels l ON l.id = two.member WHERE two.id NOT IN (SELECT id FROM labels) GROUP BY 1, 2)
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, id) AS place FROM best) WHERE place <= 4""")
def excluded_alerts(spark, d):
    """The four nearest alerts that each incident left out."""
    return explain.nearly(_alerts(spark, d), _labels_of(spark, d))


@sql("+roots", """SELECT s.label, s.service, is_root, CASE WHEN is_root THEN least(99, greatest(70, pct)) ELSE least(72, greatest(18, pct)) END::INTEGER AS confidence FROM (SELECT o.label, o.service, r.root = o.service AS is_root,
  floor((35 * CASE WHEN o.first = min(o.first) OVER (PARTITION BY o.label) THEN 100 ELSE 45 END + 25 * CASE sev WHEN 0 THEN 100 WHEN 1 THEN 75 ELSE 50 END + 25 * CASE WHEN r.root = o.service THEN 100 ELSE 40 END
  + 15 * CASE WHEN r.root = o.service AND o.label % 3 = 0 THEN 90 ELSE 50 END + 50) / 100.0) AS pct FROM (SELECT label, service, min(ts) AS first, min(sev_rank) AS sev FROM members GROUP BY 1, 2) o JOIN roots r USING (label)) s""")
def root_confidence_graph(spark, d):
    """How sure each service is the cause, one incident in three being known."""
    m, roots, _ = rooted(spark, d)
    return explain.confidence_graph(m, roots, m.where("label % 3 = 0").select("label"))


@sql("+members", """SELECT label, item, symptom_pct, overlap_pct, CASE WHEN b = n AND b = t THEN 'match' WHEN b > 0 THEN 'partial' ELSE 'different' END AS services FROM (
  SELECT m.label, m.item, round_even(100 * m.similarity, 0)::INTEGER AS symptom_pct, round_even(100 * b / greatest(n, 1)::DOUBLE, 0)::INTEGER AS overlap_pct, b, n, t FROM (
  SELECT label, label % 12 AS item, (label % 100) / 100.0 AS similarity, count(DISTINCT service) AS n, count(DISTINCT CASE WHEN list_contains([label % 12, (label + 1) % 12, (label + 2) % 12], substr(service, 4)::INTEGER) THEN service END) AS b,
  3 AS t FROM members GROUP BY label) m)""")
def history_comparison(spark, d):
    """Each incident beside a known one: twelve of three neighbouring services each, matched by number."""
    m, _, _ = rooted(spark, d)
    history = signals(spark, d).select("service").distinct().select(F.substring("service", 4, 9).cast("long").alias("k"), "service").select(
        F.explode(F.array(*[F.pmod(F.col("k") - j, F.lit(12)) for j in range(3)])).alias("item"), "service")
    matches = m.select("label", F.pmod("label", F.lit(12)).alias("item"), (F.pmod("label", F.lit(100)) / 100).alias("similarity")).distinct()
    return explain.compared(m, matches, history)


_REST = "list_filter(services, lambda x: x <> root)"
_DETAIL = _SAID.replace("ELSE message END", "ELSE substr(message, 1, 110) END")


@sql("+impact", f"""SELECT label, n || ' correlated signals across ' || len(services) || ' service(s), scored ' || priority || '. Causal analysis points to ' || root || CASE WHEN len({_REST}) > 0 THEN ', with knock-on failures in ' || array_to_string({_REST}[1:3], ', ')
  ELSE '' END || '.' AS summary, 'Suspected: ' || root || ' (' || told || ', first seen ' || strftime(make_timestamp(ts), '%H:%M:%S') || '). Selected by counterfactual analysis over the dependency graph (' || round(100 * causal_confidence)::INTEGER
  || '% causal confidence); unconfirmed until checked on the service.' AS hypothesis, array_to_string(list_filter(['Inspect ' || root || ' first: causal analysis identifies it as the origin.', CASE WHEN metric IS NOT NULL THEN 'Check ' || metric || ' on ' || root
  || CASE WHEN threshold IS NOT NULL THEN ' against its threshold (' || {_NUM.format('threshold')} || ')' ELSE '' END || '.' END, CASE WHEN len({_REST}) > 0 THEN 'Confirm ' || array_to_string({_REST}[1:3], ', ') || ' recover once ' || root
  || ' is healthy; if they do not, there is a second independent fault.' END], lambda x: x IS NOT NULL), ' ') AS steps FROM (SELECT label, count(*) AS n, list_sort(list(DISTINCT service)) AS services FROM members GROUP BY 1) JOIN roots USING (label)
  JOIN (SELECT label, priority FROM impact) USING (label) JOIN (SELECT label, service AS root, arg_min({{'told': {_DETAIL}, 'metric': metric, 'threshold': threshold, 'ts': ts}}, (CASE WHEN metric IS NOT NULL OR source = 'grafana_alert' THEN 0 ELSE 1 END, sev_rank, ts, id)) AS t
  FROM members GROUP BY 1, 2) USING (label, root), LATERAL (SELECT t.told AS told, t.metric AS metric, t.threshold AS threshold, t.ts AS ts)""")
def ticket_prose(spark, d):
    """What a ticket says of each incident: summary, hypothesis and steps."""
    m, roots, impact = rooted(spark, d)
    return tickets.prose(m, roots, causal.representative(m), impact).withColumn("steps", F.array_join("steps", " "))


@sql("+impact", """SELECT label, count(*) + 18 + 1 + CASE WHEN bool_or(lead) THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT service) > 1 THEN 1 ELSE 0 END + 2 AS n FROM (SELECT m.*, t.metric IS NOT NULL AS lead FROM members m JOIN roots r ON r.label = m.label JOIN (
  SELECT label, service, arg_min({'m': metric}, (CASE WHEN metric IS NOT NULL OR source = 'grafana_alert' THEN 0 ELSE 1 END, sev_rank, ts, id)).m AS metric FROM members GROUP BY 1, 2) t ON t.label = r.label AND t.service = r.root) GROUP BY label""")
def ticket_lines(spark, d):
    """How many lines the ticket of each incident has."""
    m, roots, impact = rooted(spark, d)
    telling = causal.representative(m)
    rows = tickets.lines(m, evidence.drafts(m, roots, telling), tickets.prose(m, roots, telling, impact), impact)
    return rows.groupBy("label").agg(F.max("place").cast("long").alias("n"))


# --- batches


@sql("", """SELECT id, at_s FROM (WITH e AS (SELECT id, ts, max(ts) OVER () AS newest FROM signals), r AS (SELECT *, min(ts) OVER () AS t0, row_number() OVER (ORDER BY ts, id) AS k FROM e WHERE ts >= newest - 3000000000),
  b AS (SELECT id, k, (ts // 1000 - t0 // 1000) / greatest(newest // 1000 - t0 // 1000, 1)::DOUBLE * 23.0 + 0.5 - 0.08 * k AS lead FROM r)
  SELECT id, 0.0::DOUBLE AS at_s FROM e WHERE ts < newest - 3000000000 UNION ALL SELECT id, least(round(max(lead) OVER (ORDER BY k) + 0.08 * k, 6), 24.0) FROM b)""")
def replay_schedule(spark, d):
    """When each signal shows in a replay of half a minute."""
    return days.schedule(signals(spark, d).select("id", "ts")).withColumnRenamed("at", "at_s")


@sql("", """SELECT id, ts + move AS ts FROM (SELECT id, ts, floor(ts / 86400000000.0)::BIGINT AS day FROM signals) JOIN (SELECT day, (first_value(lo) OVER (ORDER BY day) + coalesce(sum(hi - lo + 7200000000) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0) - lo)::BIGINT AS move FROM (SELECT floor(ts / 86400000000.0)::BIGINT AS day, min(ts) AS lo, max(ts) AS hi FROM signals GROUP BY 1)) USING (day)""")
def concatenated_days(spark, d):
    """Signals of all days back to back, two hours between them."""
    rows = signals(spark, d).select("id", "ts", F.floor(F.col("ts") / 86_400_000_000).alias("day"))
    return days.concatenated(rows).select("id", "ts")


@sql("", "SELECT id, (ts + floor((1767225600123456 - max(ts) OVER ()) / 300000000.0)::BIGINT * 300000000)::BIGINT AS ts FROM signals")
def shifted_batch(spark, d):
    """Signals moved to end at about a given time, by whole windows."""
    return days.shifted(signals(spark, d).select("id", "ts"), 1_767_225_600_123_456)


@sql("", """SELECT id FROM (SELECT *, ceil(k * take / size::DOUBLE) AS i FROM (SELECT s.id, row_number() OVER (PARTITION BY s.component, s.severity ORDER BY s.ts, s.id) - 1 AS k, p.size, p.take FROM signals s JOIN (
  SELECT component, severity, size, CASE WHEN kept THEN size ELSE least(size, base + floor(greatest(1000 - sum(CASE WHEN kept THEN size ELSE base END) OVER (), 0) * coalesce(weight / sum(weight) OVER (), 0) + 1e-9)) END::BIGINT AS take
  FROM (SELECT *, CASE WHEN NOT kept THEN sqrt(size - base) * CASE WHEN severity = 'high' THEN 0.35 ELSE 1.0 END END AS weight FROM (SELECT component, severity, count(*) AS size, severity = 'warning' AND count(*) <= 500 AS kept,
  least(count(*), 5) AS base FROM signals GROUP BY 1, 2))) p ON p.component IS NOT DISTINCT FROM s.component AND p.severity = s.severity)) WHERE floor(i * size / take::DOUBLE) = k AND i < take""")
def level_sample(spark, d):
    """1,000 signals over components and severities: warnings whole, the severe damped; a sampling operator."""
    rows = signals(spark, d).select("id", "ts", "component", "severity")
    return days.sampled(rows, ["component", "severity"], 1000, F.col("severity") == "warning", F.col("severity") == "high").select("id")


@sql("", """SELECT caller, callee FROM (SELECT *, row_number() OVER (ORDER BY sha1('7:' || caller || ':' || callee)) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT 'svc' || (p.user_id % 12) AS caller, 'svc' || (c.user_id % 12) AS callee
  FROM events c JOIN events p ON c.event_id % 4 > 0 AND p.event_id = c.event_id - 1 WHERE p.user_id % 12 <> c.user_id % 12)) WHERE k <= greatest(floor(0.6 * n), 1)""")
def observed_topology(spark, d):
    """Six in ten of the calls that spans show, as partial tracing would."""
    return days.observed(QUERIES["payload_span_edges"](spark, d), 0.6, 7)


RULES = [("payments", "svc3", "error|purchase"), ("checkout", None, r"purchase k=[0-4]\b"), ("signups", None, "^signup"), ("faults", None, "error")]


@sql("", """SELECT story, origin, count(*) AS n, count_if(candidate)::BIGINT AS candidates FROM (SELECT CASE WHEN service = 'svc3' AND regexp_matches(lower(message), 'error|purchase') THEN 'payments' WHEN regexp_matches(lower(message), 'purchase k=[0-4]\\b')
  THEN 'checkout' WHEN regexp_matches(lower(message), '^signup') THEN 'signups' WHEN regexp_matches(lower(message), 'error') THEN 'faults' END AS story, CASE WHEN source LIKE '%grafana%' THEN 'grafana_alerts' WHEN source LIKE '%metric%'
  THEN 'cloudwatch_metrics' ELSE 'application_logs' END AS origin, source IN ('cloudwatch_metric', 'grafana_alert') OR severity IN ('critical', 'high', 'warning') AS candidate FROM signals) GROUP BY ALL""")
def story_rules(spark, d):
    """Signals by the first rule that fits, with the family of their source and how many a person would label."""
    s = signals(spark, d).select(days.first_rule(RULES).alias("story"), days.canonical_source(F.col("source")).alias("origin"), days.candidate().alias("c"))
    return s.groupBy("story", "origin").agg(F.count("*").alias("n"), F.count_if("c").alias("candidates"))


ORACLE_SQL = {name: oracles.oracle(name, TEXTS) for name in TEXTS}
