"""Named queries on evidence, drafts, review, detection and payloads, with their SQL beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import causal, dedup, evidence, incidents, pairs, review_tables, topology
from ..sources import adapters
from ..tables import once, read, written
from . import oracles
from .catalog import QUERIES, anomalous, membership, query, rooted, scored, scored_pairs
from .signals import EDGES_SQL, edges, signals

TEXTS: dict[str, tuple[str, str]] = {}


def sql(views: str, text: str):
    """The query with its SQL: the views it needs and its SELECT."""

    def add(f):
        TEXTS[f.__name__] = views, text
        return query(f)

    return add


def _pairs_of(spark, d, m: DataFrame) -> DataFrame:
    """Scored pairs of members."""
    one = lambda c: m.select(F.col("id").alias(c))
    return scored_pairs(spark, d).join(one("a_id"), "a_id", "left_semi").join(one("b_id"), "b_id", "left_semi")


_BOTH = """SELECT a_id AS id, b_id AS other, * FROM sims UNION ALL SELECT b_id, a_id, * FROM sims"""


@sql("+members", f"""SELECT label, id, gate, other AS linked_to, sim, gate = 'same service' OR service_term >= 1 AS badge_service, dependency_term > 0 AS badge_dependency,
  gate = 'shared trace' AS badge_trace, template_term >= 0.3 AS badge_template, time_term > 0 AS badge_window FROM (SELECT l.label, p.*, row_number() OVER (PARTITION BY p.id
  ORDER BY CASE gate WHEN 'shared trace' THEN 0 WHEN 'same service' THEN 1 WHEN 'direct dependency' THEN 2 ELSE 9 END, sim DESC, other) AS rn
  FROM ({_BOTH}) p JOIN labels l ON l.id = p.id JOIN labels o ON o.id = p.other AND o.label = l.label) WHERE rn = 1""")
def signal_joins(spark, d):
    """The strongest join of each member to its incident, with badges."""
    m, _ = membership(spark, d)
    return evidence.strongest_joins(m, _pairs_of(spark, d, m))


@sql("+labels", """SELECT label, dimension, round(floor((2000 * sum(round(v * 1e6)::BIGINT)::BIGINT + count(*)) / (2 * count(*))::DOUBLE) / 1e9 * any_value(w) + 1e-9, 6) AS contribution FROM (
  SELECT l.label, t.dimension, t.v, t.w FROM sims s JOIN labels l ON l.id = s.a_id, LATERAL (VALUES ('time', round(time_term, 6), 0.36::DOUBLE), ('service', round(service_term::DOUBLE, 6), 0.06),
  ('dependency', round(dependency_term::DOUBLE, 6), 0.33), ('template', round(template_term, 6), 0.19), ('component', round(component_term::DOUBLE, 6), 0.06)) t(dimension, v, w)
  WHERE 1 - s.sim <= 0.55) GROUP BY label, dimension""")
def dimension_means(spark, d):
    """Mean contribution of each similarity dimension to the links of each incident."""
    m, _ = membership(spark, d)
    return evidence.dimension_means(m.select("id", "label"), pairs.links(_pairs_of(spark, d, m)), pairs.WEIGHTS)


@sql("+clusters", """SELECT label, 'baseline' AS part, 0.35::DOUBLE AS points FROM clusters UNION ALL SELECT label, 'strong links', round(0.45 * (strong_links / n_links::DOUBLE) + 1e-9, 2) FROM clusters
  UNION ALL SELECT label, 'mean similarity', round(0.30 * mean_sim + 1e-9, 2) FROM clusters""")
def confidence_parts(spark, d):
    m, found = membership(spark, d)
    return evidence.confidence_parts(incidents.annotate(m, found))


_ENV = "CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'staging' WHEN 2 THEN 'staging' ELSE 'production' END"


@sql("+members", f"""SELECT m.id, m.label, coalesce({_ENV}, most) AS environment, coalesce(mixed, false) AS mixed FROM members m LEFT JOIN (SELECT label, arg_min(env, (-n, env)) AS most,
  count(*) > 1 AS mixed FROM (SELECT label, {_ENV} AS env, count(*) AS n FROM members GROUP BY 1, 2) WHERE env IS NOT NULL GROUP BY label) e ON e.label = m.label""")
def environment_parts(spark, d):
    """Incidents split by environment (three hosts in seven are of staging or unnamed)."""
    m, _ = membership(spark, d)
    k = F.pmod("id", F.lit(7))
    env = F.when(k.isin(1, 2), "staging").when(k > 2, "production")
    return evidence.environment_split(m.withColumn("environment", env))


_NUM = r"regexp_replace(printf('%.2f', {}), '\.?0+$', '')"
_TOLD = f"CASE WHEN metric IS NOT NULL AND value IS NOT NULL THEN metric || ' = ' || {_NUM.format('value')} || ' (threshold ' || {_NUM.format('threshold')} || ')' ELSE message END"


@sql("+roots", f"""SELECT s.label, 'draft-' || s.label || '-' || floor(started / 1000000.0)::BIGINT AS draft_id, '[DRAFT] ' || root || ': ' || coalesce(metric, substr(split_part(message, ':', 1), 1, 48))
  || CASE WHEN services > 1 THEN ' cascading to ' || (services - 1) || ' service(s)' ELSE '' END AS title, n || ' anomalous signals from ' || n_sources || ' stream(s) (' || sources || ') between '
  || strftime(make_timestamp(started), '%H:%M:%S') || ' and ' || strftime(make_timestamp(ended), '%H:%M:%S') || ' UTC.' || chr(10) || 'First signal: ' || f.s || ' - ' || f.t || '.' || chr(10) ||
  'Strongest anomaly: ' || p.s || ' - ' || p.t || '.' AS facts FROM (SELECT label, min(ts) AS started, max(ts) AS ended, count(*) AS n, count(DISTINCT service) AS services, count(DISTINCT source) AS n_sources,
  string_agg(DISTINCT source, ', ' ORDER BY source) AS sources, arg_min({{'s': service, 't': {_TOLD}}}, (ts, id)) AS f, arg_min({{'s': service, 't': {_TOLD}}}, (-anomaly_score, ts, id)) AS p FROM members GROUP BY label) s
  JOIN roots r ON r.label = s.label JOIN (SELECT label, service, arg_min(id, (CASE WHEN metric IS NOT NULL OR source = 'grafana_alert' THEN 0 ELSE 1 END, sev_rank, ts, id)) AS id FROM members GROUP BY 1, 2) t
  ON t.label = r.label AND t.service = r.root JOIN members m ON m.id = t.id""")
def incident_drafts(spark, d):
    """Draft id, title and facts of each incident."""
    m, roots, _ = rooted(spark, d)
    return evidence.drafts(m, roots, causal.representative(m))


@sql("+members", """SELECT label, count(*) || '-' || sum(('0x' || substr(sha1(id::VARCHAR), 1, 12))::BIGINT)::BIGINT AS members_key FROM members GROUP BY label""")
def member_keys(spark, d):
    m, _ = membership(spark, d)
    return evidence.member_keys(m)


# --- review


def decisions(m: DataFrame) -> DataFrame:
    """(draft_id, seq, action, at): a reviewer's decisions, a literal rule over labels: three incidents in four are decided
    within minutes, some published ones are resolved later."""
    k = F.pmod("label", F.lit(4))
    step = lambda seq, action, minutes: F.struct(F.lit(seq).alias("seq"), action.alias("action"), (
        F.col("started") + minutes.cast("long") * 60_000_000).alias("at"))
    second = F.when(k == 1, "approve").when(k == 2, "reject").when(k == 3, "merge")
    steps = F.array(step(1, F.lit("submit"), F.lit(0)), step(2, second, 3 + F.pmod("label", F.lit(11))),
                    step(3, F.when(F.pmod("label", F.lit(8)) == 1, "resolve"), F.lit(60)))
    return m.groupBy("label").agg(F.min("ts").alias("started")).select(F.col("label").alias("draft_id"), F.explode(F.filter(
        steps, lambda x: x["action"].isNotNull())).alias("e")).select("draft_id", "e.*")


_DECISIONS = """SELECT label AS draft_id, seq, action, started + minutes::BIGINT * 60000000 AS at FROM (SELECT label, min(ts) AS started FROM members GROUP BY label) c, LATERAL (VALUES (1, 'submit', 0),
  (2, CASE label % 4 WHEN 1 THEN 'approve' WHEN 2 THEN 'reject' WHEN 3 THEN 'merge' END, 3 + label % 11), (3, CASE WHEN label % 8 = 1 THEN 'resolve' END, 60)) t(seq, action, minutes) WHERE action IS NOT NULL"""
_STATUS = f"""SELECT draft_id, CASE a WHEN 'approve' THEN 'published' WHEN 'reject' THEN 'rejected' WHEN 'merge' THEN 'merged' WHEN 'resolve' THEN 'resolved' ELSE 'awaiting' END AS status, n - 1 AS decisions
  FROM (SELECT draft_id, arg_max(action, seq) AS a, count(*) AS n FROM ({_DECISIONS}) GROUP BY draft_id)"""


@sql("+members", _STATUS)
def draft_statuses(spark, d):
    m, _ = membership(spark, d)
    return review_tables.statuses(decisions(m))


@sql("+members", f"""SELECT s AS status, count(draft_id) AS n FROM (SELECT unnest(['awaiting', 'published', 'rejected', 'merged', 'resolved']) AS s) LEFT JOIN ({_STATUS}) ON status = s GROUP BY s""")
def review_stats(spark, d):
    m, _ = membership(spark, d)
    return review_tables.status_counts(review_tables.statuses(decisions(m)))


@sql("+members", f"SELECT draft_id, string_agg(action, ' > ' ORDER BY seq) AS trail FROM ({_DECISIONS}) GROUP BY draft_id")
def audit_trail(spark, d):
    m, _ = membership(spark, d)
    return review_tables.trail(decisions(m))


@sql("+members", f"""SELECT strftime(make_timestamp(last), '%Y-%m-%d') AS day, round(median((last - first) / 6e7), 4) AS median_minutes, count(*) AS n FROM (SELECT draft_id, min("at") AS first, max("at") AS last,
  count(*) AS n FROM ({_DECISIONS}) GROUP BY draft_id) WHERE n > 1 GROUP BY 1""")
def decision_times(spark, d):
    m, _ = membership(spark, d)
    return review_tables.decision_times(decisions(m))


@sql("+impact", f"""SELECT i.label, s.status, priority, severity, row_number() OVER (ORDER BY status <> 'awaiting', priority, severity DESC, i.label)::INTEGER AS place FROM impact i JOIN ({_STATUS}) s
  ON s.draft_id = i.label WHERE status <> 'merged'""")
def incident_ranking(spark, d):
    """Incidents in the queue's order."""
    m, _, got = rooted(spark, d)
    status = review_tables.statuses(decisions(m)).withColumnRenamed("draft_id", "label")
    return review_tables.ranked(got.join(status, "label").select("label", "status", "priority", "severity"))


@sql("+members", f"""SELECT label, started FROM (SELECT c.label, started, services FROM (SELECT label, min(ts) AS started, list(DISTINCT service) AS services FROM members GROUP BY label) c JOIN ({_STATUS}) s
  ON s.draft_id = c.label WHERE status = 'published' AND started >= (SELECT max(ts) FROM signals) - 48 * 3600000000 ORDER BY started DESC, label LIMIT 50) WHERE list_contains(services, 'svc3')""")
def archive_query(spark, d):
    """Of the last 48 hours' newest 50 published incidents (the archive's own limit), those with a service."""
    m, _ = membership(spark, d)
    c = m.groupBy("label").agg(F.min("ts").alias("started"), F.collect_set("service").alias("services"), F.lit("").alias("title"))
    c = c.join(review_tables.statuses(decisions(m)).withColumnRenamed("draft_id", "label"), "label")
    since = (signals(spark, d).agg(F.max("ts")).first()[0] or 0) - 48 * 3_600_000_000
    return review_tables.archive(c, since, "published", "svc3").select("label", "started")


@sql("+clusters", "SELECT label, n_signals, started FROM clusters ORDER BY n_signals DESC, started, label LIMIT 10")
def top_incidents(spark, d):
    """The ten largest incidents: a report."""
    m, found = membership(spark, d)
    return incidents.annotate(m, found).orderBy(F.desc("n_signals"), "started", "label").limit(10).select("label", "n_signals", "started")


@sql("+roots svcs", """SELECT n.s AS service, (SELECT count(*) FROM (SELECT DISTINCT label, service FROM members) v WHERE v.service = n.s) AS open_incidents, (SELECT count(*) FROM roots r WHERE r.root = n.s) AS root_of
  FROM names n""")
def topology_overlay(spark, d):
    m, roots, _ = rooted(spark, d)
    names = edges(spark).select(F.explode(F.array("caller", "callee")).alias("service")).distinct()
    return review_tables.overlay(names, m, roots)


@sql("+members", """SELECT s.id, CASE WHEN ts >= started - 1000000 THEN 'correlated' WHEN is_anomaly THEN 'anomaly' ELSE 'normal' END AS class FROM scored s LEFT JOIN (SELECT service, min(started) AS started FROM (
  SELECT label, min(ts) AS started FROM members GROUP BY label) c JOIN (SELECT DISTINCT label, service FROM members) v USING (label) GROUP BY service) f ON f.service = s.service""")
def signal_classes(spark, d):
    m, _ = membership(spark, d)
    start = m.groupBy("label").agg(F.min("ts").alias("started"))
    return review_tables.signal_class(scored(spark, d), m.select("label", "service").distinct().join(start, "label"))


@sql("", """SELECT sum(n)::BIGINT AS alerts, coalesce(sum(CASE WHEN id = '' THEN n END), 0)::BIGINT AS no_id, sum(bad)::BIGINT AS bad_time, sum(CASE WHEN id <> '' AND n > 1 THEN 1 ELSE 0 END)::BIGINT AS repeated_ids
  FROM (SELECT CASE WHEN event_id % 50 = 0 THEN '' ELSE 'u' || (event_id // 3) END AS id, count(*) AS n, sum(CASE WHEN event_id % 20 = 0 THEN 1 ELSE 0 END) AS bad FROM events GROUP BY 1)""")
def ingest_checks(spark, d):
    """What is wrong with a batch of pushed alerts: ids that are empty or repeat, times that can't be read."""
    e = read(spark, d, "events")
    ident = F.when(F.col("event_id") % 50 == 0, "").otherwise(F.concat(F.lit("u"), F.floor(F.col("event_id") / 3).cast("string")))
    at = F.when(F.col("event_id") % 20 == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return review_tables.ingest_faults(e.select(ident.alias("id"), at.alias("timestamp")))


@sql("+labels", """SELECT a, b, CASE WHEN least(ka, kb, kc) < 9 THEN least(ka, kb, kc) ELSE 0 END AS k FROM (SELECT a, b, CASE WHEN list_contains(['svc0', 'svc1', 'svc2'], a) AND list_contains(['svc0', 'svc1', 'svc2'], b) THEN 1 ELSE 9 END AS ka,
  CASE WHEN list_contains(['svc1', 'svc3', 'svc4', 'svc7'], a) AND list_contains(['svc1', 'svc3', 'svc4', 'svc7'], b) THEN 2 ELSE 9 END AS kb,
  CASE WHEN list_contains(['svc2', 'svc5', 'svc6', 'svc11'], a) AND list_contains(['svc2', 'svc5', 'svc6', 'svc11'], b) THEN 3 ELSE 9 END AS kc
  FROM (SELECT DISTINCT x.service AS a, y.service AS b FROM links l JOIN anom x ON x.id = l.a_id JOIN anom y ON y.id = l.b_id))""")
def learned_weights(spark, d):
    """The learned weight set that each linked pair of services would use (0: the default)."""
    learned = spark.createDataFrame([(1, ["svc0", "svc1", "svc2"]), (2, ["svc1", "svc3", "svc4", "svc7"]), (3, ["svc2", "svc5", "svc6", "svc11"])], "k int, services array<string>")
    found = pairs.links(scored_pairs(spark, d)).select(F.col("a.service").alias("a"), F.col("b.service").alias("b")).distinct()
    return review_tables.pair_weights(written(found, "pairs"), learned).fillna({"k": 0})


@sql("+labels", """SELECT received, kept, anomalies, clustered, anomalies - clustered AS noise, incidents, round(100 * (1 - kept / received::DOUBLE), 1) AS dedup_pct, round(100 * (1 - incidents / received::DOUBLE), 1) AS noise_reduction_pct,
  round(100 * (1 - met / (anomalies * (anomalies - 1) / 2.0)), 1) AS blocking_saved_pct, greatest(round(received * 30 / 60.0) - 2, 0)::BIGINT AS minutes_saved FROM (SELECT count(*) AS received FROM signals), (SELECT count(*) AS kept FROM dedup),
  (SELECT count(*) AS anomalies FROM anom), (SELECT count(*) AS clustered, count(DISTINCT label) AS incidents FROM labels), (SELECT count(*) AS met FROM cand)""")
def run_report(spark, d):
    """One run in figures: what came, what was kept, judged, compared and raised."""
    s, odd = signals(spark, d), anomalous(spark, d)
    m, _ = membership(spark, d)
    one = lambda df, *c: df.agg(*c)
    n = F.count("*")
    out = one(s, n.alias("received")).join(one(dedup.dedup_signals(s), n.alias("kept"))).join(one(odd, n.alias("anomalies"))).join(
        one(m, n.alias("clustered"), F.countDistinct("label").alias("incidents"))).join(one(pairs.candidates(odd, edges(spark)), n.alias("met")))
    return out.select(
        "received", "kept", "anomalies", "clustered", (F.col("anomalies") - F.col("clustered")).alias("noise"), "incidents",
        review_tables.funnel(F.col("received"), F.col("kept")).alias("dedup_pct"),
        review_tables.funnel(F.col("received"), F.col("incidents")).alias("noise_reduction_pct"),
        review_tables.funnel(F.col("anomalies") * (F.col("anomalies") - 1) / 2, F.col("met")).alias("blocking_saved_pct"),
        review_tables.minutes_saved(F.col("received")).alias("minutes_saved"))


@sql("+members", """SELECT label, arg_min(id, (ts, sev_rank, id)) AS id FROM members GROUP BY label""")
def earliest_roots(spark, d):
    """The offline view's root: the earliest signal, of equal ones the most severe."""
    m, _ = membership(spark, d)
    return m.groupBy("label").agg(F.min(F.struct("ts", "sev_rank", "id"))["id"].alias("id"))


# --- detection


@sql("keyed dedup scored", "SELECT id, is_anomaly, round(anomaly_score, 6) AS anomaly_score, reason FROM scored")
def detected_signals(spark, d):
    """The whole detector: thresholds, running baselines, log novelty and bursts, severities."""
    return scored(spark, d).select("id", "is_anomaly", F.round("anomaly_score", 6).alias("anomaly_score"), "reason")


TEXTS["detection_tally"] = TEXTS["detected_signals"][0], f"SELECT reason, count(*) AS n FROM ({TEXTS['detected_signals'][1]}) WHERE is_anomaly GROUP BY reason"


@query
def detection_tally(spark, d):
    return anomalous(spark, d).groupBy("reason").agg(F.count("*").alias("n"))



# --- payloads: rows of the event table in the shape each source sends them, read back by its adapter


def _raw(spark, d, raw) -> DataFrame:
    return read(spark, d, "events").select(once(raw).alias("raw"), (F.unix_micros(F.col("ts").cast("timestamp"))).alias("received_us"))


def _k() -> Column:
    return F.get_json_object("props", "$.k")


def _svc() -> Column:
    return F.concat(F.lit("svc"), (F.col("user_id") % 12).cast("string"))


def _iso() -> Column:
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")


_AT = "(epoch(date_trunc('second', ts)) * 1000000)::BIGINT"
_S, _KK = "'svc' || (user_id % 12)", "(props->>'k')"


@sql("", f"""SELECT {_S} AS service, 'c' || ({_KK}::INTEGER % 5) AS component, CASE event_type WHEN 'error' THEN 'high' WHEN 'view' THEN 'warning' WHEN 'click' THEN 'info' ELSE 'critical' END AS severity, {_AT} AS ts,
  event_type || ' k=' || {_KK} AS message, CASE user_id % 3 WHEN 0 THEN 'production' WHEN 1 THEN 'staging' END AS environment, {_KK} AS k FROM events WHERE event_type <> 'signup'""")
def payload_log_lines(spark, d):
    """Log lines; a level that is none (of signups) gives no row."""
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "WARN").when(
        F.col("event_type") == "click", "DEBUG").when(F.col("event_type") == "signup", "LOUD").otherwise("FATAL")
    host = F.element_at(F.array(F.lit("web-prod-1"), F.lit("db.stg.7"), F.lit("box9")), (F.col("user_id") % 3 + 1).cast("int"))
    line = F.concat_ws(" ", _iso(), level, _svc(), F.concat(F.lit("c"), (_k().cast("int") % 5).cast("string")), F.concat(
        F.lit("[host:"), host, F.lit(" k:"), _k(), F.lit("]")), F.concat("event_type", F.lit(" k="), _k()))
    got = adapters.log_lines(_raw(spark, d, line))
    return got.select("service", "component", "severity", "ts", "message", "environment", F.col("labels")["ctx.k"].alias("k"))


@sql("", f"""SELECT CASE WHEN event_id % 3 = 0 THEN {_S} ELSE 'db' || (user_id % 4) END AS service, {_AT} AS ts, 'metric' || {_KK} AS metric, floor(value)::DOUBLE AS value, 100.0::DOUBLE AS threshold, 'critical' AS severity, true AS is_anomaly
  FROM events WHERE event_type IN ('error', 'click')""")
def payload_alarms(spark, d):
    """Metric alarms whose value stands in prose only; alarms in state OK give no row."""
    state = F.when(F.col("event_type").isin("error", "click"), "ALARM").otherwise("OK")
    prose = F.concat(F.lit("Threshold Crossed: 1 datapoint ["), F.floor("value").cast("string"), F.lit(".0 (01/01/24 00:00:00)] was greater than the threshold (100.0)."))
    named = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(_svc().alias("service"))))
    raw = F.concat(F.lit('{"AlarmName":"a","NewStateValue":"'), state, F.lit('","StateChangeTime":"'), _iso(), F.lit('","NewStateReason":"'), prose, F.lit(
        '","Trigger":{"MetricName":"metric'), _k(), F.lit('","Threshold":100.0,"Dimensions":[{"name":"DBInstanceIdentifier","value":"db'), (
        F.col("user_id") % 4).cast("string"), F.lit('"}]}'), F.coalesce(F.concat(F.lit(',"AffectedResources":'), named), F.lit("")), F.lit("}"))
    return adapters.alarms(_raw(spark, d, raw)).select("service", "ts", "metric", "value", "threshold", "severity", "is_anomaly")


@sql("", f"""SELECT CASE WHEN event_id % 2 = 0 THEN {_S} ELSE 'board' END AS service, CASE WHEN event_type = 'view' THEN 'warning' ELSE 'high' END AS severity, epoch_us(ts) AS ts, 'cpu' AS metric, floor(value)::DOUBLE AS value,
  90.5::DOUBLE AS threshold, event_type <> 'view' AS is_anomaly FROM events WHERE event_type IN ('error', 'view')""")
def payload_dashboard_alerts(spark, d):
    state = F.when(F.col("event_type") == "error", "alerting").when(F.col("event_type") == "view", "pending").otherwise("ok")
    tags = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"service":"'), _svc(), F.lit('"}'))).otherwise("{}")
    raw = F.concat(F.lit('{"title":"CPU — board","state":"'), state, F.lit('","message":"cpu above 90.5","evalMatches":[{"metric":"cpu","value":'), F.floor(
        "value").cast("string"), F.lit(',"tags":'), tags, F.lit("}]}"))
    return adapters.dashboard_alerts(_raw(spark, d, raw)).select("service", "severity", "ts", "metric", "value", "threshold", "is_anomaly")


@sql("", f"""SELECT {_S} AS service, CASE event_type WHEN 'error' THEN 'critical' WHEN 'view' THEN 'high' ELSE 'info' END AS severity, {_AT} AS ts, 'rule ' || {_KK} AS message, floor(value)::DOUBLE AS value FROM events
  WHERE event_type <> 'click'""")
def payload_webhook_alerts(spark, d):
    """Batches of a firing alert and one that is resolved."""
    level = F.when(F.col("event_type") == "error", "page").when(F.col("event_type") == "view", "Major").otherwise("?")
    one = lambda status: F.concat(F.lit('{"status":"'), status, F.lit('","labels":{"service":"'), _svc(), F.lit('","severity":"'), level, F.lit(
        '","alertname":"rule '), _k(), F.lit('"},"startsAt":"'), _iso(), F.lit('","valueString":"[ var=A value='), F.floor("value").cast("string"), F.lit(' ]"}'))
    firing = F.when(F.col("event_type") == "click", "resolved").otherwise("firing")
    raw = F.concat(F.lit('{"alerts":['), one(firing), F.lit(","), one(F.lit("resolved")), F.lit("]}"))
    return adapters.webhook_alerts(_raw(spark, d, raw)).select("service", "severity", "ts", "message", "value")


@sql("", f"""SELECT {_S} AS service, CASE event_type WHEN 'error' THEN 'high' ELSE 'info' END AS severity, epoch_us(ts) // 1000 * 1000 AS ts, event_type || ' in k ' || {_KK} AS message FROM events""")
def payload_log_groups(spark, d):
    raw = F.concat(F.lit('{"logGroupName":"/aws/app/'), _svc(), F.lit('","events":[{"timestamp":'), F.floor(F.unix_micros(F.col("ts").cast(
        "timestamp")) / 1000).cast("string"), F.lit(',"message":"'), F.col("event_type"), F.lit(" in k "), _k(), F.lit('"}]}'))
    return adapters.log_groups(_raw(spark, d, raw)).select("service", "severity", "ts", "message")


@sql("", f"""SELECT {_S} AS service, CASE event_type WHEN 'error' THEN 'high' WHEN 'view' THEN 'warning' ELSE 'info' END AS severity, {_AT} AS ts, event_type AS message, 't' || (event_id // 3) AS trace_id, {_KK} AS k FROM events""")
def payload_otlp_logs(spark, d):
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "Warn").otherwise("TRACE9")
    nanos = F.concat(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("string"), F.lit("000000000"))
    raw = F.concat(F.lit('{"resourceLogs":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"'), _svc(), F.lit(
        '"}}]},"scopeLogs":[{"logRecords":[{"timeUnixNano":"'), nanos, F.lit('","severityText":"'), level, F.lit('","body":{"stringValue":"'), F.col(
        "event_type"), F.lit('"},"traceId":"t'), F.floor(F.col("event_id") / 3).cast("string"), F.lit('","attributes":[{"key":"k","value":{"intValue":"'), _k(), F.lit('"}}]}]}]}]}'))
    return adapters.otlp_logs(_raw(spark, d, raw)).select("service", "severity", "ts", "message", "trace_id", F.col("labels")["k"].alias("k"))


def _spans(spark, d) -> DataFrame:
    parent = F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("s"), (F.col("event_id") - 1).cast("string"))).otherwise("")
    nanos = F.concat(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("string"), F.lit("000000000"))
    raw = F.concat(F.lit('{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"'), _svc(), F.lit(
        '"}}]},"scopeSpans":[{"spans":[{"traceId":"t'), F.floor(F.col("event_id") / 4).cast("string"), F.lit('","spanId":"s'), F.col("event_id").cast("string"), F.lit(
        '","parentSpanId":"'), parent, F.lit('","name":"'), F.col("event_type"), F.lit('","startTimeUnixNano":"'), nanos, F.lit('","status":{"code":'), F.when(
        F.col("event_type") == "error", "2").otherwise("1"), F.lit("}}]}]}]}"))
    return adapters.spans(_raw(spark, d, raw))


_PARENT = "events c LEFT JOIN events p ON c.event_id % 4 > 0 AND p.event_id = c.event_id - 1"


@sql("", f"""SELECT 'svc' || (c.user_id % 12) AS service, (epoch(date_trunc('second', c.ts)) * 1000000)::BIGINT AS ts, 's' || c.event_id AS span_id, nullif('svc' || (p.user_id % 12), 'svc' || (c.user_id % 12)) AS parent_service
  FROM {_PARENT} WHERE c.event_type = 'error'""")
def payload_error_spans(spark, d):
    """Failed spans with the service of their parent, healthy or not."""
    return adapters.error_spans(_spans(spark, d)).select("service", "ts", "span_id", "parent_service")


@sql("", f"""SELECT DISTINCT 'svc' || (p.user_id % 12) AS caller, 'svc' || (c.user_id % 12) AS callee FROM {_PARENT} WHERE p.user_id % 12 <> c.user_id % 12""")
def payload_span_edges(spark, d):
    return adapters.span_edges(_spans(spark, d))


def span_graph(spark, d) -> DataFrame:
    """The calls that all spans show, those to the next two services by number: a graph without circles."""
    gap = F.substring("callee", 4, 9).cast("int") - F.substring("caller", 4, 9).cast("int")
    # walks join it again and again: the spans are read once
    return written(payload_span_edges(spark, d).where(gap.isin(1, 2)), "span-graph")


HARVESTED = f"""edges AS (SELECT DISTINCT 'svc' || (p.user_id % 12) AS caller, 'svc' || (c.user_id % 12) AS callee FROM {_PARENT} WHERE c.user_id % 12 - p.user_id % 12 IN (1, 2))"""


@sql("calls walk hop", "SELECT a, b, hops FROM hop")
def dependency_hops(spark, d):
    return topology.hops(span_graph(spark, d))


@sql("dep", "SELECT DISTINCT service, dependent FROM dep WHERE service <> dependent")
def dependents_closure(spark, d):
    return topology.dependents(span_graph(spark, d))


@sql("", "SELECT e.caller AS service, d.callee AS dependency FROM edges e JOIN edges d ON d.caller = e.caller UNION SELECT service, dependency FROM (WITH RECURSIVE down AS (SELECT caller AS service, callee AS dependency FROM edges UNION SELECT w.service, e.callee FROM down w JOIN edges e ON e.caller = w.dependency) SELECT * FROM down)")
def dependencies_closure(spark, d):
    return topology.dependencies(span_graph(spark, d))


@sql("", """SELECT caller, callee, array_to_string(arg_min(path, (len(path), path)), ' > ') AS path FROM (WITH RECURSIVE p AS (SELECT caller, callee, [caller, callee] AS path FROM edges UNION ALL
  SELECT p.caller, e.callee, list_append(p.path, e.callee) FROM p JOIN edges e ON e.caller = p.callee WHERE NOT list_contains(p.path, e.callee) AND len(p.path) < 7) SELECT * FROM p) GROUP BY caller, callee""")
def call_paths(spark, d):
    return topology.call_paths(span_graph(spark, d)).withColumn("path", F.array_join("path", " > "))


@sql("", f"""SELECT {_S} AS service, CASE event_type WHEN 'error' THEN 'critical' WHEN 'view' THEN 'warning' ELSE 'info' END AS severity, {_AT} AS ts, event_type AS message FROM events WHERE event_id % 10 > 0""")
def payload_generic(spark, d):
    """Flat records under names of their own; those without a time are dropped."""
    level = F.when(F.col("event_type") == "error", "FATAL").when(F.col("event_type") == "view", "medium").otherwise("?")
    at = F.when(F.col("event_id") % 10 > 0, _iso()).otherwise("")
    rows = read(spark, d, "events").select(_svc().alias("HostName"), level.alias("priority"), at.alias("@timestamp"), F.col("event_type").alias("msg"))
    return adapters.generic(rows).select("service", "severity", "ts", "message")


@sql("", f"""SELECT source, count(*) AS n, min(ts) AS first, max(ts) AS last FROM (SELECT 'app_log' AS source, {_AT} AS ts FROM events WHERE event_type <> 'signup' UNION ALL SELECT 'cloudwatch_metric', {_AT} FROM events
  WHERE event_type IN ('error', 'click') UNION ALL SELECT 'cloudwatch_log', epoch_us(ts) // 1000 * 1000 FROM events) GROUP BY source""")
def payload_union(spark, d):
    """Signals of several sources as one table."""
    parts = [payload_log_lines(spark, d).select("ts").withColumn("source", F.lit("app_log")), payload_alarms(spark, d).select("ts").withColumn(
        "source", F.lit("cloudwatch_metric")), payload_log_groups(spark, d).select("ts").withColumn("source", F.lit("cloudwatch_log"))]
    return adapters.union(*parts).groupBy("source").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


ORACLE_SQL = {name: oracles.oracle(name, TEXTS) for name in TEXTS}
# these walk the harvested graph
ORACLE_SQL |= {name: ORACLE_SQL[name].replace(EDGES_SQL, HARVESTED) for name in ("dependency_hops", "dependents_closure", "dependencies_closure", "call_paths")}
