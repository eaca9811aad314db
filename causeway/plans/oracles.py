"""The same rows in DuckDB SQL, for each query that SQL can express. Each text is put together from the views it needs."""

from __future__ import annotations

from .signals import SIGNALS_SQL

#: View name -> SQL; a view may use those above it.
VIEWS = {
    "keyed": """SELECT *, CASE WHEN source IN ('app_log', 'cloudwatch_log') THEN 'tpl:' || template
  ELSE 'alert:' || coalesce(nullif(metric, ''), substr(message, 1, 60)) END AS content, floor(ts / 300000000.0) AS slot FROM signals""",
    "dedup": """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY service, component, content, slot) AS occurrence_count,
  row_number() OVER (PARTITION BY service, component, content, slot ORDER BY ts, id) AS rn FROM keyed) WHERE rn = 1""",
    "scored": """SELECT d.*, t.is_anomaly, t.anomaly_score, t.reason FROM dedup d JOIN (SELECT s.id,
  CASE WHEN pre THEN greatest(CASE WHEN abs(z) >= 3 THEN least(abs(z) / 6, 1.0) ELSE 0.0 END, least(1.0, 0.6 + 2 * abs(value - threshold) / abs(threshold)))
    WHEN source = 'cloudwatch_metric' THEN CASE WHEN abs(z) >= 3 THEN least(abs(z) / 6, 1.0) ELSE 0.0 END
    WHEN source = 'app_log' THEN CASE log WHEN 'novel' THEN CASE WHEN sev_rank <= 1 THEN 0.8 ELSE 0.55 END WHEN 'burst' THEN least(nb / 20.0 + 0.4, 1.0) WHEN 'error' THEN 0.6 ELSE 0.0 END ELSE 0.0 END AS anomaly_score,
  pre OR CASE WHEN source = 'cloudwatch_metric' THEN coalesce(abs(z) >= 3, false) WHEN source = 'app_log' THEN log <> 'none' ELSE sev_rank <= 1 END AS is_anomaly,
  CASE WHEN pre THEN 'breach' WHEN source = 'cloudwatch_metric' THEN CASE WHEN abs(z) >= 3 THEN 'baseline' ELSE 'none' END WHEN source = 'app_log' THEN log WHEN sev_rank <= 1 THEN 'severity' ELSE 'none' END AS reason
  FROM (SELECT s.*, b.z, r.n AS nb, coalesce(value > threshold, false) AS pre, CASE WHEN r.rate IS NULL AND sev_rank <= 2 THEN 'novel' WHEN r.rate IS NOT NULL AND r.n >= 3 AND r.n >= 4 * r.rate THEN 'burst'
    WHEN sev_rank <= 1 THEN 'error' ELSE 'none' END AS log FROM dedup s LEFT JOIN (SELECT id, CASE WHEN n >= 5 AND std >= 1e-9 THEN (x - mean) / std END AS z FROM (
  WITH RECURSIVE o AS (SELECT service || '|' || metric AS series, ts, id, value AS x, row_number() OVER (PARTITION BY service, metric ORDER BY ts, id) AS k FROM dedup WHERE metric IS NOT NULL AND value IS NOT NULL),
  f AS (SELECT series, k, id, x, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, 0::BIGINT AS n, x AS m, 0.0::DOUBLE AS v FROM o WHERE k = 1 UNION ALL SELECT o.series, o.k, o.id, o.x, f.m, sqrt(f.v), f.n + 1,
    f.m + 0.3 * (o.x - f.m), 0.7 * (f.v + 0.3 * (o.x - f.m) * (o.x - f.m)) FROM f JOIN o ON o.series = f.series AND o.k = f.k + 1) SELECT * FROM f)) b ON b.id = s.id
  LEFT JOIN (WITH RECURSIVE c AS (SELECT service || '|' || template AS t, floor(ts / 300000000.0)::BIGINT AS batch, sum(occurrence_count)::BIGINT AS n FROM dedup WHERE source = 'app_log' GROUP BY 1, 2),
  o AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY batch) AS k FROM c), f AS (SELECT t, batch, n, k, NULL::DOUBLE AS rate, (0.3 * n)::DOUBLE AS nxt FROM o WHERE k = 1 UNION ALL
    SELECT o.t, o.batch, o.n, o.k, f.nxt, 0.7 * f.nxt + 0.3 * o.n FROM f JOIN o ON o.t = f.t AND o.k = f.k + 1) SELECT * FROM f) r
  ON s.source = 'app_log' AND r.t = s.service || '|' || s.template AND r.batch = floor(s.ts / 300000000.0)::BIGINT) s) t ON t.id = d.id""",
    "anom": """SELECT *, list_filter(list_distinct(list_transform(list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace(
  message || ' ' || coalesce(metric, '') || ' ' || coalesce(component, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'),
  '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')), '[a-z][a-z0-9]{2,}'), lambda w: NOT list_contains(drops, w)),
  lambda w: CASE WHEN length(w) > 4 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN substr(w, 1, length(w) - 1) ELSE w END)),
  lambda w: NOT list_contains(drops, w)) AS words FROM scored, (SELECT string_split('the a an in on of to for is was and at by threshold crossed datapoint datapoints greater less than alarm state value values error errors failed failure exceeded exceeds warn warning info debug notice trace', ' ') AS drops) WHERE is_anomaly""",
    "calls": "SELECT caller AS x, callee AS y FROM edges UNION SELECT callee, caller FROM edges",
    "walk": """SELECT DISTINCT x AS a, x AS b, 0 AS h FROM calls UNION SELECT x, y, 1 FROM calls
  UNION SELECT p.x, q.y, 2 FROM calls p JOIN calls q ON p.y = q.x
  UNION SELECT p.x, r.y, 3 FROM calls p JOIN calls q ON p.y = q.x JOIN calls r ON q.y = r.x""",
    "hop": "SELECT a, b, min(h) AS hops FROM walk GROUP BY a, b",
    "cand": """SELECT a.id AS a_id, b.id AS b_id, a AS ra, b AS rb FROM anom a JOIN anom b ON a.id < b.id AND abs(a.ts - b.ts) <= 900000000
  WHERE a.service = b.service OR a.trace_id = b.trace_id OR lower(a.component) = lower(b.component) OR a.mention = b.service
  OR b.mention = a.service OR EXISTS (SELECT 1 FROM calls WHERE x = a.service AND y = b.service)""",
    "gated": """SELECT c.*, h.hops, coalesce(ra.mention = rb.service, false) OR coalesce(rb.mention = ra.service, false) AS named,
  CASE WHEN ra.trace_id = rb.trace_id THEN 'shared trace' WHEN ra.service = rb.service THEN 'same service'
  WHEN h.hops = 1 THEN 'direct dependency' WHEN coalesce(ra.mention = rb.service, false) OR coalesce(rb.mention = ra.service, false)
  THEN 'named in evidence' WHEN lower(ra.component) = lower(rb.component) AND h.hops <= 2 THEN 'same component' END AS gate
  FROM cand c LEFT JOIN hop h ON h.a = c.ra.service AND h.b = c.rb.service""",
    "terms": """SELECT a_id, b_id, gate, exp(-abs(ra.ts - rb.ts) / 6e7) AS time_term,
  CASE WHEN ra.service = rb.service AND ra.component = rb.component THEN 1.0 WHEN ra.service = rb.service THEN 0.85 ELSE 0.0 END AS service_term,
  CASE WHEN ra.service = rb.service THEN 1.0 ELSE CASE hops WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.45 WHEN 3 THEN 0.15 ELSE 0.0 END END AS dependency_term,
  greatest(CASE WHEN named THEN 0.6 ELSE 0.0 END, CASE WHEN ra.source = 'app_log' AND rb.source = 'app_log' AND ra.template = rb.template THEN 1.0
    WHEN len(ra.words) = 0 OR len(rb.words) = 0 THEN 0.0
    ELSE len(list_intersect(ra.words, rb.words)) / len(list_distinct(list_concat(ra.words, rb.words)))::DOUBLE END) AS template_term,
  CASE WHEN ra.component = rb.component THEN 1.0 ELSE 0.0 END AS component_term FROM gated WHERE gate IS NOT NULL""",
    "sims": """SELECT *, round(0.36 * time_term + 0.06 * service_term + 0.33 * dependency_term + 0.19 * template_term + 0.06 * component_term, 6) AS sim FROM terms""",
    "links": "SELECT a_id, b_id, gate, sim FROM sims WHERE 1 - sim <= 0.55",
    "sym": "SELECT a_id AS p, b_id AS q FROM links UNION SELECT b_id, a_id FROM links",
    "spread": "SELECT p AS id, p AS r FROM sym UNION SELECT sym.q, spread.r FROM spread JOIN sym ON sym.p = spread.id",
    "labels": "SELECT id, min(r) AS label FROM spread GROUP BY id",
    "members": "SELECT a.*, l.label FROM anom a JOIN labels l ON a.id = l.id",
    "lstats": """SELECT label, count(*) AS n_links, floor((2 * sum(round(sim * 1e6)::BIGINT)::BIGINT + count(*)) / (2 * count(*))::DOUBLE) / 1e6 AS mean_sim,
  sum(CASE WHEN gate IN ('shared trace', 'same service', 'direct dependency') THEN 1 ELSE 0 END)::BIGINT AS strong_links
  FROM links JOIN labels ON id = a_id GROUP BY label""",
    "clusters": """SELECT m.label, n_signals, n_services, started, ended, peak, n_links, mean_sim, strong_links,
  round(CASE WHEN n_signals < 2 THEN 1.0 ELSE n_links / (n_signals * (n_signals - 1) / 2.0) END, 6) AS density,
  round(0.35 + 0.45 * (strong_links / n_links::DOUBLE) + 0.30 * mean_sim + 1e-9, 6) AS correlator_confidence
  FROM (SELECT label, count(*) AS n_signals, count(DISTINCT service) AS n_services, min(ts) AS started, max(ts) AS ended,
  max(anomaly_score) AS peak FROM members GROUP BY label) m LEFT JOIN lstats s ON s.label = m.label""",
    "dep": "SELECT callee AS service, caller AS dependent FROM edges UNION SELECT d.service, e.caller FROM dep d JOIN edges e ON e.callee = d.dependent",
    "fam": "SELECT *, CASE WHEN source IN ('cloudwatch_metric', 'grafana_alert') THEN 'metric' ELSE 'log' END AS family FROM members",
    "onset": """SELECT label, service, min(ts) AS onset, count(*) AS n_signals, round(least(0.40 * max(anomaly_score) + 0.25 * (1 - min(sev_rank) / 3.0)
  + 0.35 * least(count(DISTINCT family) / 3.0, 1.0), 1.0), 6) AS strength FROM fam GROUP BY label, service""",
    "prec": """SELECT o.*, CASE WHEN count(*) OVER (PARTITION BY label) = 1 THEN 1.0 ELSE round((SELECT count(*) FROM onset p
  WHERE p.label = o.label AND p.onset > o.onset) / (count(*) OVER (PARTITION BY label) - 1.0), 6) END AS temporal FROM onset o""",
    "reach": """SELECT o.label, o.service, round(coalesce(avg(CASE WHEN d.service IS NOT NULL AND p.onset >= o.onset - 300000000 THEN 1.0
  WHEN p.service IS NOT NULL THEN 0.0 END), 0.0), 6) AS reach FROM onset o LEFT JOIN onset p ON p.label = o.label AND p.service <> o.service
  LEFT JOIN dep d ON d.service = o.service AND d.dependent = p.service GROUP BY o.label, o.service""",
    "sympt": """SELECT DISTINCT o.label, o.service FROM onset o JOIN edges e ON e.caller = o.service JOIN onset p ON p.label = o.label
  AND p.service = e.callee WHERE p.onset <= o.onset + 300000000""",
    "names": "SELECT caller AS s FROM edges UNION SELECT callee FROM edges",
    "wo": """SELECT n.s AS removed, e.callee AS service, e.caller AS dependent FROM names n JOIN edges e ON e.caller <> n.s AND e.callee <> n.s
  UNION SELECT w.removed, w.service, e.caller FROM wo w JOIN edges e ON e.callee = w.dependent AND e.caller <> w.removed AND e.callee <> w.removed""",
    "uniq": """SELECT o.label, o.service, count(p.service) AS n_unique FROM onset o LEFT JOIN (SELECT a.label, a.service AS c, b.service
  FROM onset a JOIN onset b ON a.label = b.label AND a.service <> b.service JOIN dep d ON d.service = a.service AND d.dependent = b.service
  WHERE NOT EXISTS (SELECT 1 FROM onset x JOIN wo w ON w.service = x.service AND w.removed = a.service WHERE x.label = a.label
  AND x.service <> a.service AND w.dependent = b.service)) p ON p.label = o.label AND p.c = o.service GROUP BY o.label, o.service""",
    "scores": """SELECT p.label, p.service, p.onset, temporal, reach, strength, s.service IS NOT NULL AS is_symptom, n_unique,
  round(0.30 * temporal + 0.40 * reach + 0.30 * strength, 4) AS rank_score FROM prec p JOIN reach r ON r.label = p.label AND r.service = p.service
  JOIN uniq u ON u.label = p.label AND u.service = p.service LEFT JOIN sympt s ON s.label = p.label AND s.service = p.service""",
    "pool": """SELECT * FROM (SELECT *, n_unique > 0 AND NOT is_symptom AS ok, NOT bool_or(n_unique > 0 AND NOT is_symptom) OVER (PARTITION BY label) AS fell_back
  FROM scores) WHERE ok OR fell_back""",
    "ranked": """SELECT *, row_number() OVER w AS rn, coalesce(lead(rank_score) OVER w, 0.0) AS runner_up FROM pool
  WINDOW w AS (PARTITION BY label ORDER BY rank_score DESC, onset, service)""",
    "roots": """SELECT label, service AS root, rank_score, fell_back, round(least(greatest((0.30 * least(greatest(rank_score - runner_up, 0.0) / 0.25, 1.0)
  + 0.30 * reach + 0.20 * strength + 0.20 * CASE WHEN n_unique > 0 THEN 1.0 ELSE 0.0 END) * CASE WHEN fell_back THEN 0.6 ELSE 1.0 END
  * CASE WHEN is_symptom THEN 0.5 ELSE 1.0 END, 0.0), 1.0), 2) AS causal_confidence FROM ranked WHERE rn = 1""",
    "svcs": "SELECT DISTINCT label, service FROM members",
    "blast": """SELECT s.label, count(*) AS n_services, coalesce(any_value(f.n), 0) AS n_further,
  round(0.7 * least(count(*) / 5.0, 1.0) + 0.3 * least(coalesce(any_value(f.n), 0) / 5.0, 1.0), 3) AS blast FROM svcs s LEFT JOIN (
  SELECT r.label, count(*) AS n FROM roots r JOIN dep d ON d.service = r.root WHERE NOT EXISTS (SELECT 1 FROM svcs s WHERE s.label = r.label
  AND s.service = d.dependent) GROUP BY r.label) f ON f.label = s.label GROUP BY s.label""",
    "impact": """SELECT *, CASE WHEN severity >= 0.75 THEN 'P1' WHEN severity >= 0.50 THEN 'P2' WHEN severity >= 0.25 THEN 'P3' ELSE 'P4' END AS priority
  FROM (SELECT b.*, criticality, magnitude, round(0.40 * blast + 0.35 * criticality + 0.25 * magnitude + 1e-9, 3) AS severity FROM blast b
  JOIN (SELECT label, round(max(coalesce(criticality, 0.5)), 3) AS criticality FROM svcs LEFT JOIN registry USING (service) GROUP BY label) USING (label)
  JOIN (SELECT label, round(least(greatest(max(anomaly_score), 0.0), 1.0), 3) AS magnitude FROM members GROUP BY label) USING (label))""",
    "truth": "SELECT a.id, a.trace_id AS truth, l.label FROM anom a LEFT JOIN labels l ON l.id = a.id",
}
RECURSIVE = {"spread", "dep", "wo"}
_PAIRS = """SELECT both_n AS both, predicted, actual, round(both_n / nullif(predicted, 0), 6) AS precision, round(both_n / nullif(actual, 0), 6) AS recall,
  round(2 * (both_n / nullif(predicted, 0)) * (both_n / nullif(actual, 0)) / nullif(both_n / nullif(predicted, 0) + both_n / nullif(actual, 0), 0), 6) AS f1,
  round(major / nullif(placed, 0), 6) AS purity FROM
  (SELECT coalesce(sum(n * (n - 1) / 2.0), 0.0) AS both_n FROM (SELECT count(*) AS n FROM {t} WHERE label IS NOT NULL AND truth IS NOT NULL GROUP BY label, truth)),
  (SELECT coalesce(sum(n * (n - 1) / 2.0), 0.0) AS predicted FROM (SELECT count(*) AS n FROM {t} WHERE label IS NOT NULL GROUP BY label)),
  (SELECT coalesce(sum(n * (n - 1) / 2.0), 0.0) AS actual FROM (SELECT count(*) AS n FROM {t} WHERE truth IS NOT NULL GROUP BY truth)),
  (SELECT sum(m)::DOUBLE AS major, sum(n)::DOUBLE AS placed FROM (SELECT label, max(n) AS m, sum(n) AS n FROM (SELECT label, truth, count(*) AS n FROM {t}
    WHERE label IS NOT NULL AND truth IS NOT NULL GROUP BY label, truth) GROUP BY label))"""
_MIXED = """SELECT label, sum(n)::BIGINT AS n, sum(CASE WHEN truth IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS stories,
  coalesce(max(CASE WHEN truth IS NOT NULL THEN n END), 0) AS majority, coalesce(max(CASE WHEN truth IS NOT NULL THEN n END), 0) >= 0.6 * sum(n) AS dominated
  FROM (SELECT label, truth, count(*) AS n FROM truth WHERE label IS NOT NULL GROUP BY label, truth) GROUP BY label"""


def _islands(table: str, key: str, order: str, same: list[str]) -> str:
    cols = ", ".join(same)
    new = " OR ".join(f"{c} IS DISTINCT FROM lag({c}) OVER w" for c in same)
    return f"""SELECT {key}, island, {cols}, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM (SELECT *, sum(st) OVER (
  PARTITION BY {key} ORDER BY pos)::BIGINT AS island FROM (SELECT *, row_number() OVER w AS pos, CASE WHEN lag(1) OVER w IS NULL OR {new} THEN 1 ELSE 0 END AS st
  FROM {table} WINDOW w AS (PARTITION BY {key} ORDER BY {order}))) GROUP BY {key}, island, {cols}"""


_WORDS = "list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))"
_GRAMS = """bw AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[a-z0-9_]{2,}') AS w FROM benchmark),
  bt AS (SELECT id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM bw),
  tf AS (SELECT id, term, count(*) AS tf FROM bt GROUP BY id, term),
  dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  wt AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM benchmark)) / (1.0 + df)) + 1) AS w FROM tf JOIN dfq USING (term)),
  nrm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM wt GROUP BY id),
  vec AS (SELECT id, term, w / norm AS x FROM wt JOIN nrm USING (id))"""
_MASK = r"""regexp_replace(regexp_replace(regexp_replace(text, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}', '<*>', 'g'), '\b[0-9a-fA-F]{16,}\b', '<*>', 'g'), '\b[0-9]+(?:\.[0-9]+)?\b', '<*>', 'g')"""


def _redacted(text: str) -> str:
    from ..functions.redaction import SIMPLE, tag

    for kind, pattern in SIMPLE:
        text = f"regexp_replace({text}, '{pattern}', '{tag(kind)}', 'g')"
    return text


def _kinds() -> str:
    from ..functions.redaction import SIMPLE

    return " UNION ALL ".join(
        f"SELECT '{k}' AS kind, count(*) AS n FROM documents WHERE regexp_matches(text, '{p}') HAVING count(*) > 0" for k, p in SIMPLE)


#: Query -> (views it needs beside the signals, its SELECT).
TEXTS: dict[str, tuple[str, str]] = {
    "signal_feed": ("", """SELECT id, ts, source, 'unknown' AS environment, service, coalesce(component, 'unknown') AS component,
  CASE WHEN metric IS NOT NULL THEN metric || ' = ' || floor(value)::BIGINT || ' vs ' || floor(threshold)::BIGINT ELSE message END AS evidence FROM signals"""),
    "signal_dedup": ("keyed dedup", "SELECT id, service, component, ts, occurrence_count FROM dedup"),
    "dedup_share": ("keyed dedup", """SELECT received, distinct_signals, round(100 * (1 - distinct_signals / received::DOUBLE), 1) AS collapsed_pct
  FROM (SELECT count(*) AS received FROM signals), (SELECT count(*) AS distinct_signals FROM dedup)"""),
    "dedup_alerts_hashed": ("", """SELECT fingerprint, arg_min(id, (ts, id)) AS id, count(*) AS duplicate_count FROM (SELECT *, substr(sha1(service || '|' || template || '|' ||
  floor(ts / 300000000.0)::BIGINT), 1, 16) AS fingerprint FROM signals) GROUP BY fingerprint"""),
    "metric_breach": ("", "SELECT id, service, round(least(1.0, 0.6 + 2 * abs(value - threshold) / abs(threshold)), 6) AS score FROM signals WHERE value > threshold"),
    "reason_tally": ("keyed dedup scored", """SELECT CASE WHEN anomaly_score > 0.6 THEN 'breach' WHEN is_anomaly THEN 'error' ELSE 'none' END AS reason, count(*) AS n
  FROM scored GROUP BY 1"""),
    "score_histogram": ("keyed dedup scored", "SELECT least(9, floor(anomaly_score * 10))::INTEGER AS bin, count(*) AS n FROM scored GROUP BY 1"),
    "minute_volume": ("", """SELECT floor(ts / 60000000.0)::BIGINT AS minute, source, count(*) AS n,
  sum(CASE WHEN coalesce(value > threshold, false) OR sev_rank <= 1 THEN 1 ELSE 0 END)::BIGINT AS anomalous FROM signals GROUP BY 1, 2"""),
    "top_conditions": ("", """SELECT service || '|' || coalesce(component, '-') || '|' || coalesce(metric, substr(message, 1, 40)) AS context, count(*) AS n, min(ts) AS first,
  max(ts) AS last FROM signals GROUP BY 1 ORDER BY n DESC, context LIMIT 15"""),
    "source_mix": ("keyed dedup", "SELECT source, sum(greatest(1, occurrence_count))::BIGINT AS n FROM dedup GROUP BY source"),
    "service_stats": ("", """SELECT service, count(*) AS n, sum(CASE WHEN sev_rank <= 1 THEN 1 ELSE 0 END)::BIGINT AS severe,
  round(avg(CASE WHEN sev_rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM signals GROUP BY service"""),
    "severity_counts": ("", "SELECT severity, sev_rank, count(*) AS n FROM signals GROUP BY severity, sev_rank"),
    "facet_counts": ("", """SELECT severity AS value, count(*) AS n, 'severity' AS facet FROM signals WHERE source IN ('app_log', 'cloudwatch_metric') GROUP BY 1
  UNION ALL SELECT source, count(*), 'source' FROM signals WHERE severity IN ('high', 'warning') GROUP BY 1
  UNION ALL SELECT service, count(*), 'service' FROM signals WHERE severity IN ('high', 'warning') AND source IN ('app_log', 'cloudwatch_metric') GROUP BY 1"""),
    "feed_query": ("keyed dedup scored", "SELECT id, ts, service, round(anomaly_score, 6) AS score FROM scored WHERE is_anomaly AND anomaly_score >= 0.6 ORDER BY ts DESC, id DESC LIMIT 100"),
    "rule_classify": ("", """SELECT CASE WHEN regexp_matches(lower(p_type), 'steel|iron') THEN 'metal' WHEN regexp_matches(lower(p_type), 'copper|brass') THEN 'alloy'
  WHEN contains(lower(p_type), 'tin') THEN 'tin' ELSE 'other' END AS kind, count(*) AS n FROM part GROUP BY 1"""),
    "dependency_hops": ("calls walk hop", "SELECT a, b, hops FROM hop"),
    "dependents_closure": ("dep", "SELECT service, dependent FROM dep"),
    "span_edges": ("", """SELECT c_nationkey AS caller, s_nationkey AS callee, count(*) AS spans FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2"""),
    "candidate_pairs": ("keyed dedup scored anom calls cand", "SELECT a_id, b_id FROM cand"),
    "gate_reasons": ("keyed dedup scored anom calls walk hop cand gated", "SELECT coalesce(gate, 'rejected') AS gate, count(*) AS n FROM gated GROUP BY 1"),
    "pair_similarity": ("+terms sims", """SELECT a_id, b_id, gate, round(time_term, 6) AS time_term, service_term::DOUBLE AS service_term,
  dependency_term::DOUBLE AS dependency_term, round(template_term, 6) AS template_term, component_term::DOUBLE AS component_term, sim FROM sims"""),
    "incident_components": ("+labels", "SELECT id, label FROM labels"),
    "cluster_summary": ("+clusters", "SELECT * REPLACE (round(peak, 6) AS peak) FROM clusters"),
    "gate_histogram": ("+labels", "SELECT label, gate, count(*) AS n FROM links JOIN labels ON id = a_id GROUP BY 1, 2"),
    "validation_checks": ("+clusters", """SELECT label, coherent, supported, independent, coherent AND supported AND independent AS accepted FROM (SELECT c.label,
  n_signals <= 3 OR density >= 0.25 AS coherent, peak >= 0.6 AS supported, conditions >= 2 OR all_severe AS independent FROM clusters c JOIN (
  SELECT label, count(DISTINCT (service, source, coalesce(metric, substr(message, 1, 60)))) AS conditions, bool_and(sev_rank <= 1) AS all_severe
  FROM members GROUP BY label) s ON s.label = c.label)"""),
    "cluster_confidence": ("+clusters", """SELECT c.label, round(0.40 * density + 0.35 * coalesce(topology, 1.0) + 0.25 * evidence + 1e-9, 6) AS confidence FROM clusters c
  LEFT JOIN (SELECT label, sum(CASE WHEN coalesce(h.hops, 9) <= 2 THEN n ELSE 0 END)::DOUBLE / sum(n) AS topology FROM (SELECT p.label, p.service AS s1, q.service AS s2,
    CASE WHEN p.service = q.service THEN p.n * (p.n - 1) // 2 ELSE p.n * q.n END AS n FROM (SELECT label, service, count(*) AS n FROM members GROUP BY 1, 2) p
    JOIN (SELECT label, service, count(*) AS n FROM members GROUP BY 1, 2) q ON p.label = q.label AND p.service <= q.service) s
    LEFT JOIN hop h ON h.a = s1 AND h.b = s2 GROUP BY label) t ON t.label = c.label
  JOIN (SELECT label, floor((2000 * sum(round(best * 1e6)::BIGINT)::BIGINT + count(*)) / (2 * count(*))::DOUBLE) / 1e9 AS evidence FROM (SELECT l.label, l.id, max(sim) AS best FROM labels l JOIN (SELECT a_id AS id, sim FROM links UNION ALL
    SELECT b_id, sim FROM links) e ON e.id = l.id GROUP BY l.label, l.id) GROUP BY label) b ON b.label = c.label"""),
    "near_misses": ("+clusters svcs", """SELECT label, id, reason, rank FROM (SELECT c.label, a.id, CASE WHEN EXISTS (SELECT 1 FROM svcs s JOIN calls e ON e.x = s.service
  WHERE s.label = c.label AND e.y = a.service) THEN 'below threshold' ELSE 'no shared context' END AS reason, row_number() OVER (PARTITION BY c.label ORDER BY a.ts, a.id) AS rank
  FROM clusters c JOIN anom a ON a.ts >= c.started - 900000000 AND a.ts <= c.ended + 900000000 WHERE a.id NOT IN (SELECT id FROM labels)
  AND NOT EXISTS (SELECT 1 FROM svcs s WHERE s.label = c.label AND s.service = a.service)) WHERE rank <= 4"""),
    "pending_expiry": ("+labels", """SELECT id, CASE WHEN (SELECT max(ts) FROM signals) - ts > 900000000 THEN 'expired' ELSE 'waiting' END AS fate FROM anom
  WHERE id NOT IN (SELECT id FROM labels)"""),
    "service_onsets": ("+onset", "SELECT * FROM onset"),
    "temporal_precedence": ("+prec", "SELECT label, service, temporal FROM prec"),
    "causal_scores": ("+scores", "SELECT label, service, temporal, reach, strength, is_symptom, n_unique, rank_score FROM scores"),
    "root_causes": ("+roots", "SELECT * FROM roots"),
    "representative_signals": ("+members", """SELECT label, service, arg_min(id, (CASE WHEN metric IS NOT NULL OR source = 'grafana_alert' THEN 0 ELSE 1 END, sev_rank, ts, id)) AS id
  FROM members GROUP BY 1, 2"""),
    "impact_severity": ("+impact", "SELECT * FROM impact"),
    "p1_calibration": ("+impact", """SELECT *, incidents >= 3 AND p1_share > 0.4 AS warn FROM (SELECT count(*) AS incidents,
  round(avg(CASE WHEN priority = 'P1' THEN 1.0 ELSE 0.0 END), 6) AS p1_share FROM impact)"""),
    "trend_direction": ("+members", """SELECT label, CASE WHEN n < 4 THEN 0.5 WHEN hi = lo THEN 0.8 ELSE round(least((n - f) / f::DOUBLE / 2, 1.0), 3) END AS trend FROM (
  SELECT m.label, lo, hi, n, sum(CASE WHEN (ts - lo) * 2 <= hi - lo THEN 1 ELSE 0 END) AS f FROM members m JOIN (SELECT label, min(ts) AS lo, max(ts) AS hi,
  count(*) AS n FROM members GROUP BY label) s ON s.label = m.label GROUP BY m.label, lo, hi, n)"""),
    "flap_counts": ("+fam", """SELECT label, flap_count, diversity FROM (SELECT label, max(n) AS flap_count FROM (SELECT label, service, coalesce(template, metric) AS w, count(*) AS n
  FROM members GROUP BY 1, 2, 3) GROUP BY label) JOIN (SELECT label, round(least(count(DISTINCT family) / 3.0, 1.0), 3) AS diversity FROM fam GROUP BY label) USING (label)"""),
    "maintenance_suppression": ("+svcs", """SELECT s.label, bool_and(EXISTS (SELECT 1 FROM (SELECT 'svc' || i AS service, 1704067200000000 + k * 86400000000 AS a,
    1704067200000000 + k * 86400000000 + 21600000000 AS b FROM (SELECT unnest([0, 2, 4, 6, 8, 10]) AS i), (SELECT unnest([0, 1, 2, 3]) AS k)
    UNION ALL SELECT NULL, 1704067200000000 + 86400000000, 1704067200000000 + 2 * 86400000000) w
  WHERE st.started >= w.a AND st.started <= w.b AND (w.service IS NULL OR w.service = s.service))) AS suppressed
  FROM svcs s JOIN (SELECT label, min(ts) AS started FROM members GROUP BY label) st ON st.label = s.label GROUP BY s.label"""),
    "escalation_risk": ("+members", """SELECT label, round(growth, 6) AS growth, round(tr, 6) AS severity_trend, round(spread, 6) AS spread,
  round(0.40 * growth + 0.35 * tr + 0.25 * spread, 6) AS risk FROM (SELECT label, least(n / greatest(minutes, 0.5) / 5, 1.0) AS growth,
  CASE WHEN n < 3 THEN mean ELSE least(greatest(mean + 0.4 * (tail - head), 0.0), 1.0) END AS tr, least(s / 5.0, 1.0) AS spread FROM (
  SELECT label, max(n) AS n, (max(ts) - min(ts)) / 6e7 AS minutes, avg(sev) AS mean, avg(CASE WHEN k <= third THEN sev END) AS head,
  avg(CASE WHEN k > n - third THEN sev END) AS tail, count(DISTINCT service) AS s FROM (SELECT *, greatest(n // 3, 1) AS third FROM (SELECT label, service, ts,
  1 - sev_rank / 3.0 AS sev, row_number() OVER (PARTITION BY label ORDER BY ts, id) AS k, count(*) OVER (PARTITION BY label) AS n FROM members)) GROUP BY label))"""),
    "blast_forecast": ("+svcs dep", """SELECT h.label, step * 5 AS minutes, have + (SELECT count(*) FROM (SELECT d.dependent, min(p.hops) AS hops FROM svcs s JOIN dep d ON d.service = s.service
  JOIN hop p ON p.a = d.service AND p.b = d.dependent WHERE s.label = h.label AND p.hops > 0 AND NOT EXISTS (SELECT 1 FROM svcs x WHERE x.label = h.label AND x.service = d.dependent)
  GROUP BY d.dependent) WHERE hops <= step) AS services FROM (SELECT label, count(*) AS have FROM svcs GROUP BY label) h, (SELECT unnest([1, 2, 3]) AS step)"""),
    "pair_evaluation": ("+truth", _PAIRS.format(t="truth")),
    "story_completeness": ("+truth", """SELECT truth, sum(n)::BIGINT AS n, sum(CASE WHEN label IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS clusters,
  coalesce(max(CASE WHEN label IS NOT NULL THEN n END), 0) AS best, round(coalesce(max(CASE WHEN label IS NOT NULL THEN n END), 0) / sum(n)::DOUBLE, 6) AS completeness
  FROM (SELECT truth, label, count(*) AS n FROM truth WHERE truth IS NOT NULL GROUP BY 1, 2) GROUP BY truth"""),
    "mixed_clusters": ("+truth", _MIXED),
    "label_purity": ("", "SELECT * FROM (WITH t AS (SELECT d.source AS label, l.quality AS truth FROM documents d JOIN labels l USING (doc_id)) " + _PAIRS.format(t="t") + ")"),
    "reliability_curve": ("+clusters truth", f"""SELECT least(9, floor(confidence * 10))::INTEGER AS decile, count(*) AS n, round(avg(confidence), 6) AS confidence,
  round(avg(purity), 6) AS purity FROM (SELECT least(c.correlator_confidence, 1.0) AS confidence, m.majority / m.n::DOUBLE AS purity FROM clusters c
  JOIN ({_MIXED}) m ON m.label = c.label) GROUP BY 1"""),
    "timeline_islands": ("", _islands("signals", "service", "ts, id", ["source", "template"])),
    "conversation_islands": ("", _islands("(SELECT conv_id AS conv, turn, role FROM conversations)", "conv", "turn", ["role"])),
    "story_sessions": ("", """SELECT service, session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY service ORDER BY ts, id)::BIGINT AS session
  FROM (SELECT *, CASE WHEN coalesce(ts - lag(ts) OVER (PARTITION BY service ORDER BY ts, id) > 900000000, true) THEN 1 ELSE 0 END AS new FROM signals WHERE sev_rank <= 2)) GROUP BY 1, 2"""),
    "busiest_window": ("", """SELECT n, ts AS window_end, first - 60000000 AS start_at FROM (SELECT ts, count(*) OVER w AS n, min(ts) OVER w AS first FROM signals WHERE sev_rank <= 1
  WINDOW w AS (ORDER BY ts RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW)) ORDER BY n DESC, ts LIMIT 1"""),
    "adaptive_histogram": ("", """SELECT slot * width AS bucket, (SELECT count(*) FROM signals WHERE floor(ts / width::DOUBLE)::BIGINT = slot) AS n FROM (SELECT width,
  unnest(range(lo // width, hi // width + 1)) AS slot FROM (SELECT lo, hi, coalesce(list_filter([60000000, 300000000, 900000000, 1800000000, 3600000000, 10800000000, 21600000000,
  43200000000, 86400000000], lambda w: hi // w - lo // w + 1 <= 30)[1], 86400000000) AS width FROM (SELECT min(ts) AS lo, max(ts) AS hi FROM signals)))"""),
    "noise_curve": ("keyed dedup", """SELECT minute, received, kept, round(100 * (1 - kept / received::DOUBLE), 6) AS removed_pct FROM (SELECT minute, sum(n) OVER (ORDER BY minute)::BIGINT AS received,
  sum(k) OVER (ORDER BY minute)::BIGINT AS kept FROM (SELECT floor(ts / 3600000000.0)::BIGINT AS minute, count(*) AS k, sum(occurrence_count) AS n FROM dedup GROUP BY 1))"""),
    "replay_pacing": ("", """SELECT id, round(least(greatest(coalesce((ts - lag(ts) OVER (PARTITION BY service ORDER BY ts, id)) / 1e6, 0.0), 0.0), 6.0) / 2.0, 6) AS wait_s FROM signals"""),
    "token_sets": ("", """SELECT id, array_to_string(list_sort(list_filter(regexp_extract_all(lower(message || ' ' || coalesce(metric, '') || ' ' || coalesce(component, '')), '[a-z][a-z0-9]{2,}'),
  lambda w: w <> 'error')[1:1]), ' ') AS words FROM signals"""),
    "library_coverage": ("", f"""SELECT label, item, coverage FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY coverage DESC, item) AS rn FROM (
  SELECT d.label, l.item, round(count(*) / any_value(z.size)::DOUBLE, 6) AS coverage FROM (SELECT doc_id AS label, unnest({_WORDS}) AS word FROM documents) d
  JOIN (SELECT item_id AS item, unnest({_WORDS}) AS word FROM benchmark) l USING (word) JOIN (SELECT item_id AS item, len({_WORDS}) AS size FROM benchmark) z ON z.item = l.item
  GROUP BY d.label, l.item) WHERE coverage >= 0.8) WHERE rn = 1"""),
    "tfidf_cosine": ("", f"SELECT * FROM (WITH {_GRAMS} SELECT p.id AS a, q.id AS b, round(sum(p.x * q.x), 6) AS cosine FROM vec p JOIN vec q ON p.term = q.term AND p.id < q.id GROUP BY 1, 2 HAVING round(sum(p.x * q.x), 6) >= 0.2)"),
    "density_clusters": ("+sym", """SELECT a.id, coalesce(c.label, b.label, -1) AS label FROM anom a LEFT JOIN (SELECT id, min(r) AS label FROM (WITH RECURSIVE core AS (SELECT p AS id FROM sym GROUP BY p
    HAVING count(*) >= 2), inn AS (SELECT s.p, s.q FROM sym s WHERE s.p IN (SELECT id FROM core) AND s.q IN (SELECT id FROM core)), sp AS (SELECT id, id AS r FROM core UNION SELECT inn.q, sp.r
    FROM sp JOIN inn ON inn.p = sp.id) SELECT * FROM sp) GROUP BY id) c ON c.id = a.id LEFT JOIN (SELECT s.p AS id, min(l.label) AS label FROM sym s JOIN (SELECT id, min(r) AS label FROM (
    WITH RECURSIVE core AS (SELECT p AS id FROM sym GROUP BY p HAVING count(*) >= 2), inn AS (SELECT s.p, s.q FROM sym s WHERE s.p IN (SELECT id FROM core) AND s.q IN (SELECT id FROM core)),
    sp AS (SELECT id, id AS r FROM core UNION SELECT inn.q, sp.r FROM sp JOIN inn ON inn.p = sp.id) SELECT * FROM sp) GROUP BY id) l ON l.id = s.q GROUP BY s.p) b ON b.id = a.id"""),
    "template_masks": ("", f"SELECT {_MASK} AS template, count(*) AS n FROM conversations GROUP BY 1"),
    "redaction_kinds": ("", _kinds()),
    "redacted_documents": ("", f"SELECT doc_id, {_redacted('text')} AS text FROM documents"),
    "upsert_latest": ("", """SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status,
  count(*) AS versions FROM orders GROUP BY 1"""),
    "action_overlay": ("", """SELECT CASE WHEN n >= 2 THEN 'escalated' ELSE o_orderstatus END AS status, count(*) AS orders FROM orders LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON o_orderkey = k GROUP BY 1"""),
    "stratified_sample": ("", """SELECT s.id, s.ts, s.severity FROM (SELECT id, ts, severity, row_number() OVER (PARTITION BY severity ORDER BY ts, id) AS k FROM signals) s JOIN (
  SELECT severity, n, CASE WHEN n <= 500 THEN n ELSE least(n, greatest(1, floor((2000 - taken) * sqrt(n) / roots)))::BIGINT END AS take FROM (SELECT severity, count(*) AS n FROM signals GROUP BY 1),
  (SELECT coalesce(sum(CASE WHEN n <= 500 THEN n END), 0) AS taken, sum(CASE WHEN n > 500 THEN sqrt(n) END) AS roots FROM (SELECT count(*) AS n FROM signals GROUP BY severity))) p
  ON p.severity = s.severity WHERE floor(k * take / n::DOUBLE) > floor((k - 1) * take / n::DOUBLE)"""),
    "median_decision_time": ("", """SELECT o_orderpriority, round(median(days), 4) AS median_days, count(*) AS n FROM (SELECT o_orderpriority, o_orderkey,
  min(date_diff('day', o_orderdate, l_shipdate)) AS days FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) GROUP BY 1"""),
    "greedy_slices": ("", """SELECT service, slice, count(*) AS n, min(ts) AS started FROM (WITH RECURSIVE o AS (SELECT service, ts, id, row_number() OVER (PARTITION BY service ORDER BY ts, id) AS k
  FROM signals WHERE source = 'app_log'), f AS (SELECT service, k, ts, ts AS st, 0 AS slice FROM o WHERE k = 1 UNION ALL SELECT o.service, o.k, o.ts, CASE WHEN o.ts - f.st >= 600000000 THEN o.ts ELSE f.st END,
  CASE WHEN o.ts - f.st >= 600000000 THEN f.slice + 1 ELSE f.slice END FROM f JOIN o ON o.service = f.service AND o.k = f.k + 1) SELECT * FROM f) GROUP BY 1, 2"""),
    "ewma_zscore": ("", """SELECT id, series, n, round(mean, 6) AS mean, round(std, 6) AS std, round(z, 4) AS z, coalesce(abs(z) >= 3.0, false) AS is_anomaly,
  round(CASE WHEN abs(z) >= 3.0 THEN least(abs(z) / 6, 1.0) ELSE 0.0 END, 4) AS score FROM (SELECT *, CASE WHEN n >= 5 AND std >= 1e-9 THEN (x - mean) / std END AS z FROM (
  WITH RECURSIVE o AS (SELECT service || '|' || metric AS series, ts, id, value AS x, row_number() OVER (PARTITION BY service, metric ORDER BY ts, id) AS k FROM signals
    WHERE source = 'cloudwatch_metric' AND value IS NOT NULL),
  f AS (SELECT series, k, id, x, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, 0::BIGINT AS n, x AS m, 0.0::DOUBLE AS v FROM o WHERE k = 1
    UNION ALL SELECT o.series, o.k, o.id, o.x, f.m, sqrt(f.v), f.n + 1, f.m + 0.3 * (o.x - f.m), 0.7 * (f.v + 0.3 * (o.x - f.m) * (o.x - f.m)) FROM f JOIN o ON o.series = f.series AND o.k = f.k + 1)
  SELECT * FROM f))"""),
    "template_rates": ("", """SELECT template, batch, n, round(rate, 6) AS rate, CASE WHEN rate IS NULL AND sev_rank <= 2 THEN 'novel' WHEN rate IS NOT NULL AND n >= 3 AND n >= 4 * rate THEN 'burst'
  WHEN sev_rank <= 1 THEN 'error' ELSE 'none' END AS reason, round(CASE WHEN rate IS NULL AND sev_rank <= 2 THEN CASE WHEN sev_rank <= 1 THEN 0.8 ELSE 0.55 END
  WHEN rate IS NOT NULL AND n >= 3 AND n >= 4 * rate THEN least(n / 20.0 + 0.4, 1.0) WHEN sev_rank <= 1 THEN 0.6 ELSE 0.0 END, 6) AS score FROM (
  WITH RECURSIVE c AS (SELECT service || '|' || template AS template, floor(ts / 300000000.0)::BIGINT AS batch, count(*) AS n, min(sev_rank) AS sev_rank FROM signals WHERE source = 'app_log' GROUP BY 1, 2),
  o AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY batch) AS k FROM c),
  f AS (SELECT template, batch, n, sev_rank, k, NULL::DOUBLE AS rate, (0.3 * n)::DOUBLE AS nxt FROM o WHERE k = 1 UNION ALL SELECT o.template, o.batch, o.n, o.sev_rank, o.k, f.nxt, 0.7 * f.nxt + 0.3 * o.n
  FROM f JOIN o ON o.template = f.template AND o.k = f.k + 1) SELECT * FROM f)"""),
}


def _closure(names: str) -> list[str]:
    """The views to write out: those named, and for +x all views up to x that incidents need."""
    order, want = list(VIEWS), set()
    for name in names.split():
        if name.startswith("+"):
            want |= set(order[: order.index(name[1:]) + 1])
        else:
            want.add(name)
    return [v for v in order if v in want]


def oracle(name: str, texts: dict[str, tuple[str, str]] = TEXTS) -> str:
    needs, text = texts[name]
    views = "".join(f",\n{v} AS ({VIEWS[v]})" for v in _closure(needs))
    return f"WITH RECURSIVE {SIGNALS_SQL}{views}\n{text}"


ORACLE_SQL = {name: oracle(name) for name in TEXTS}
