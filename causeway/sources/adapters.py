"""Payloads of each telemetry source to rows of one signal shape. All take a DataFrame with a string column `raw`
(one payload a row) and are total: what can't be read gives no row, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.redaction import kinds_found, redact, redact_map
from ..functions.text import environment, event_time, log_severity, mentioned, severity, stable_id
from ..tables import once

COLUMNS = ("id", "source", "service", "component", "environment", "region", "severity", "ts", "message", "metric", "value",
           "threshold", "trace_id", "span_id", "parent_service", "labels", "is_anomaly")
_KINDS = {"ts": "long", "value": "double", "threshold": "double", "labels": "map<string,string>", "is_anomaly": "boolean"}

#: Tasks among which spans are dealt by id.
PARTS = 200


def _some(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(F.trim(c), F.lit(""))


def _timed(df: DataFrame, ts: Column) -> DataFrame:
    """df with `__ts`, the time of each row, computed once; rows without one are dropped."""
    return df.select("*", once(ts.cast(_KINDS["ts"])).alias("__ts")).where("__ts is not null")


def _shape(df: DataFrame, ts: Column | None = None, **given: Column) -> DataFrame:
    """df in COLUMNS: given ones, the rest null; rows without a time (ts, where df isn't timed yet) are dropped; ids are
    hashes of what tells them apart."""
    df = df if ts is None else _timed(df, ts)
    given["ts"] = F.col("__ts")
    out = df.select(*[given[c].cast(_KINDS.get(c, "string")).alias(c) if c in given else F.lit(None).cast(
        _KINDS.get(c, "string")).alias(c) for c in COLUMNS])
    ident = stable_id(F.col("source"), F.col("service"), F.col("ts"), F.coalesce("metric", "message"))
    return out.withColumn("id", F.coalesce("id", ident)).withColumn(
        "is_anomaly", F.coalesce("is_anomaly", F.lit(False)))


def log_lines(df: DataFrame) -> DataFrame:
    """`time LEVEL service component [key:value ...] message`; lines with another shape, an unknown level or a bad time
    are dropped. Context keys become labels ctx.key."""
    head = r"^(\S+)\s+([A-Z]+)\s+(\S+)\s+(\S+)\s+(?:\[([^\]]*)\]\s+)?(.*)$"
    part = lambda k: F.regexp_extract("raw", head, k)
    levels = {"CRITICAL": "critical", "FATAL": "critical", "ERROR": "high", "WARN": "warning", "WARNING": "warning",
              "INFO": "info", "DEBUG": "info"}
    level = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])[part(2)]
    pairs = F.transform(F.filter(F.split(part(5), r"\s+"), lambda p: F.instr(p, ":") > 1), lambda p: F.struct(
        F.concat(F.lit("ctx."), F.substring_index(p, ":", 1)).alias("k"), F.substr(p, F.instr(p, ":") + 1).alias("v")))
    fields = F.map_from_entries(F.array_distinct(pairs))
    rows = df.select("raw", once(level).alias("level")).where("level is not null")
    rows = _timed(rows, event_time(part(1))).withColumn("fields", fields)
    host = F.coalesce(rows["fields"]["ctx.host"], rows["fields"]["ctx.ip"])
    return _shape(rows, source=F.lit("app_log"), service=part(3), component=part(4), severity=F.col("level"),
                  message=part(6), labels=F.col("fields"), environment=environment(host))


_ALARM = """AlarmName string, AlarmDescription string, StateChangeTime string, Region string, NewStateValue string,
NewStateReason string, Trigger struct<MetricName:string,Namespace:string,Threshold:double,ObservedValue:double,Statistic:string,
Dimensions:array<struct<name:string,value:string>>>, AffectedResources struct<service:string,component:string,environment:string,region:string>"""


def reason_value(reason: Column) -> Column:
    """A number from the prose of an alarm: [200.0 (...)] or "was greater/less than the threshold (n"."""
    a = F.regexp_extract(reason, r"\[(-?[0-9]+(?:\.[0-9]+)?) \(", 1)
    b = F.regexp_extract(reason, r"was (?:greater|less) than[^0-9-]*(-?[0-9]+(?:\.[0-9]+)?)", 1)
    return F.coalesce(_some(a), _some(b)).try_cast("double")


def alarms(df: DataFrame) -> DataFrame:
    """Metric alarms in state ALARM, with value and threshold from the trigger or the prose; critical and anomalous."""
    a = df.select(F.from_json("raw", _ALARM).alias("a")).select("a.*").where("NewStateValue = 'ALARM'")
    dims = F.transform(F.coalesce(F.col("Trigger.Dimensions"), F.array().cast("array<struct<name:string,value:string>>")),
                       lambda d: F.struct(d["name"].alias("k"), d["value"].alias("v")))
    named = F.map_from_entries(F.array_distinct(F.filter(dims, lambda d: d["k"].isNotNull())))
    a = _timed(a, event_time(F.col("StateChangeTime"))).withColumn("dims", named)
    service = F.coalesce(_some(F.col("AffectedResources.service")), _some(F.col("dims")["ServiceName"]), _some(F.col(
        "dims")["DBInstanceIdentifier"]), _some(F.col("dims")["FunctionName"]), _some(F.col("dims")["LoadBalancer"]), _some(
        F.col("AlarmName")), F.lit("unknown"))
    return _shape(a, source=F.lit("cloudwatch_metric"), service=service, component=F.col("AffectedResources.component"),
                  environment=F.col("AffectedResources.environment"), region=F.coalesce("AffectedResources.region", "Region"),
                  severity=F.lit("critical"),
                  message=F.coalesce(_some(F.col("AlarmDescription")), F.col("NewStateReason"), F.col("AlarmName")),
                  metric=F.col("Trigger.MetricName"), value=F.coalesce("Trigger.ObservedValue", reason_value(F.col(
                      "NewStateReason"))), threshold=F.col("Trigger.Threshold"), labels=F.col("dims"), is_anomaly=F.lit(True))


_DASH = """title string, state string, ruleName string, message string, evalMatches array<struct<metric:string,value:double,
tags:map<string,string>>>, tags map<string,string>"""


def dashboard_alerts(df: DataFrame, received: Column | None = None) -> DataFrame:
    """Dashboard alerts that are alerting or pending. They carry no time: `received` (microseconds) stamps them, by
    default the column received_us. Tags of the first match overlay the payload's; the threshold is read from prose."""
    received = F.col("received_us") if received is None else received
    a = df.select(F.from_json("raw", _DASH).alias("a"), received.alias("at")).select("a.*", "at").where(
        "state in ('alerting', 'pending')")
    first = F.get("evalMatches", F.lit(0))
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce("tags", none), F.coalesce(first["tags"], none)
    merged = F.map_concat(F.map_filter(
        old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)
    a = a.withColumn("all", merged)
    after_dash = F.when(F.instr("title", "—") > 0, F.trim(F.substring_index("title", "—", -1)))
    limit = F.regexp_extract("message", r"(?:>|<|above|below|threshold(?: of)?|exceeds)\s*(-?[0-9]+(?:\.[0-9]+)?)", 1)
    return _shape(a, source=F.lit("grafana_alert"), service=F.coalesce(_some(F.col("all")["service"]), _some(after_dash), _some(
        F.col("ruleName")), F.lit("unknown")), component=F.col("all")["component"], environment=F.coalesce(F.col("all")[
            "environment"], F.col("all")["env"]), region=F.col("all")["region"], severity=F.when(
                F.col("state") == "pending", "warning").otherwise("high"), ts=F.col("at"), message=F.coalesce(_some(F.col(
                    "message")), F.col("title")), metric=first["metric"], value=first["value"], threshold=_some(
                        limit).try_cast("double"), labels=F.col("all"), is_anomaly=F.col("state") == "alerting")


_HOOK = "alerts array<struct<status:string,labels:map<string,string>,annotations:map<string,string>,startsAt:string,valueString:string>>"


def webhook_alerts(df: DataFrame) -> DataFrame:
    """Batches of unified alerts: the firing ones; message is description, summary or name."""
    a = df.select(F.explode(F.from_json("raw", _HOOK)["alerts"]).alias("a")).select("a.*").where("status = 'firing'")
    value = F.regexp_extract("valueString", r"value=(-?[0-9]*\.?[0-9]+)", 1)
    labels, notes = F.col("labels"), F.col("annotations")
    return _shape(a, source=F.lit("grafana_alert"), service=F.coalesce(_some(labels["service"]), _some(labels["job"]), F.lit(
        "unknown")), component=labels["component"], environment=F.coalesce(labels["environment"], labels["env"]), severity=severity(
            labels["severity"]), ts=event_time(F.col("startsAt")), message=F.coalesce(_some(notes["description"]), _some(
                notes["summary"]), labels["alertname"]), metric=F.coalesce(labels["metric"], labels["__name__"]), value=_some(
                    value).try_cast("double"), labels=labels, is_anomaly=F.lit(True))


def log_groups(df: DataFrame) -> DataFrame:
    """Log groups with events in milliseconds; service is the last part of the group, else the stream."""
    schema = "logGroupName string, events array<struct<timestamp:bigint,message:string,logStreamName:string>>"
    a = df.select(F.from_json("raw", schema).alias("a")).select("a.logGroupName", F.explode("a.events").alias("e"))
    service = F.coalesce(_some(F.element_at(F.split("logGroupName", "/"), -1)), _some(F.col("e.logStreamName")), F.lit("unknown"))
    return _shape(a, source=F.lit("cloudwatch_log"), service=service, severity=log_severity(F.col("e.message")), ts=F.col(
        "e.timestamp") * 1000, message=F.col("e.message"))


_ATTRS = "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:string,boolValue:string>>>"


def _attributes(c: Column) -> Column:
    v = lambda a: F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["doubleValue"], a["value"][
        "boolValue"])
    pairs = F.transform(F.filter(F.coalesce(c, F.array().cast(_ATTRS)), lambda a: a["key"].isNotNull()), lambda a: F.struct(
        a["key"].alias("k"), v(a).alias("v")))
    return F.map_from_entries(F.array_distinct(pairs))


def otlp_logs(df: DataFrame) -> DataFrame:
    """Log records, three levels deep."""
    schema = f"""resourceLogs array<struct<resource:struct<attributes:{_ATTRS}>,scopeLogs:array<struct<logRecords:array<struct<
timeUnixNano:string,severityText:string,body:struct<stringValue:string>,traceId:string,spanId:string,attributes:{_ATTRS}>>>>>>"""
    a = df.select(F.explode(F.from_json("raw", schema)["resourceLogs"]).alias("r")).select(
        _attributes(F.col("r.resource.attributes")).alias("res"), F.explode("r.scopeLogs").alias("s")).select(
        "res", F.explode("s.logRecords").alias("l"))
    return _shape(a, source=F.lit("app_log"), service=F.coalesce(_some(F.col("res")["service.name"]), F.lit("unknown")),
                  environment=F.col("res")["deployment.environment"], severity=severity(F.col("l.severityText")), ts=event_time(
                      F.col("l.timeUnixNano")), message=F.col("l.body.stringValue"), trace_id=_some(F.col("l.traceId")),
                  span_id=_some(F.col("l.spanId")), labels=_attributes(F.col("l.attributes")))


def spans(df: DataFrame) -> DataFrame:
    """(service, trace_id, span_id, parent_id, name, ts, status, message) of all spans."""
    schema = f"""resourceSpans array<struct<resource:struct<attributes:{_ATTRS}>,scopeSpans:array<struct<spans:array<struct<traceId:string,
spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,status:struct<code:int,message:string>>>>>>>"""
    a = df.select(F.explode(F.from_json("raw", schema)["resourceSpans"]).alias("r")).select(
        _attributes(F.col("r.resource.attributes")).alias("res"), F.explode("r.scopeSpans").alias("s")).select(
        "res", F.explode("s.spans").alias("p"))
    return a.select(F.coalesce(_some(F.col("res")["service.name"]), F.lit("unknown")).alias("service"), _some(F.col(
        "p.traceId")).alias("trace_id"), _some(F.col("p.spanId")).alias("span_id"), _some(F.col("p.parentSpanId")).alias("parent_id"),
        F.col("p.name").alias("name"), event_time(F.col("p.startTimeUnixNano")).alias("ts"), F.col("p.status.code").alias("status"),
        F.col("p.status.message").alias("message"))


def _with_parent(some: DataFrame, all_spans: DataFrame) -> DataFrame:
    """some spans with `parent`, the service of the span that called them; of spans with one id the first service by name."""
    # dealt out before it is grouped, to a number that isn't lowered to that of cores: no task sorts a large share of the spans
    dealt = all_spans.where("span_id is not null").select(F.col("span_id").alias("__p"), F.col("service").alias("parent")).repartition(PARTS, "__p")
    parent = dealt.groupBy("__p").agg(F.min("parent").alias("parent"))
    return some.join(parent, F.col("parent_id") == F.col("__p"), "left").drop("__p")


def error_spans(all_spans: DataFrame) -> DataFrame:
    """Failed spans (status 2) with the service of their parent, null where it is their own."""
    a = _with_parent(all_spans.where("status = 2"), all_spans)
    return _shape(a, source=F.lit("trace_span"), service=F.col("service"), severity=F.lit("high"), ts=F.col("ts"), message=F.coalesce(
        _some(F.col("message")), F.col("name")), trace_id=F.col("trace_id"), span_id=F.col("span_id"), parent_service=F.nullif(
            "parent", "service"), is_anomaly=F.lit(True))


def span_edges(all_spans: DataFrame) -> DataFrame:
    """(caller, callee) of all spans, healthy ones too."""
    return _with_parent(all_spans.select("service", "parent_id"), all_spans).where("parent is not null and parent <> service").select(
        F.col("parent").alias("caller"), F.col("service").alias("callee")).distinct()


#: Names under which generic records keep each concept, first non-empty wins.
SYNONYMS = {
    "service": "service service_name app application host hostname source_service resource".split(),
    "severity": "severity level priority status_level".split(),
    "time": "timestamp time ts @timestamp event_time created_at date".split(),
    "message": "message msg description summary text title".split(),
    "ident": "id event_id alert_id uid".split(),
}


def generic(df: DataFrame) -> DataFrame:
    """Flat records of any schema with one name of SYNONYMS for each concept; rows without a usable time are dropped."""
    names = {c.lower(): c for c in df.columns}

    def pick(concept: str) -> Column:
        got = [_some(F.col(f"`{names[n]}`").cast("string")) for n in SYNONYMS[concept] if n in names]
        return F.coalesce(*got) if got else F.lit(None).cast("string")

    return _shape(df, id=pick("ident"), source=F.lit("app_log"), service=F.coalesce(pick("service"), F.lit("unknown")), severity=severity(
        pick("severity")), ts=event_time(pick("time")), message=F.coalesce(pick("message"), F.lit("")))


def union(*parts: DataFrame) -> DataFrame:
    """Signals of several sources as one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def finalised(signals: DataFrame, services: list[str]) -> DataFrame:
    """Redacted message and labels, kinds of what was redacted, and the other services that the text names."""
    known = F.array(*[F.lit(s) for s in services]) if services else F.array().cast("array<string>")
    return (
        signals.withColumn("redacted_fields", kinds_found(F.coalesce("message", F.lit(""))))
        .withColumn("mentions", mentioned(F.coalesce("message", F.lit("")), known, F.col("service")))
        .withColumn("message", redact(F.col("message")))
        .withColumn("labels", redact_map(F.col("labels")))
    )


def edges_from_adjacency(spark: SparkSession, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of adjacency payloads {service: [callees]}; services without calls stay nodes."""
    a = raw.select(F.explode(F.from_json("raw", "map<string,array<string>>")).alias("caller", "callees"))
    edges = a.select("caller", F.explode("callees").alias("callee")).distinct()
    nodes = a.select(F.col("caller").alias("service")).union(edges.select("callee")).distinct()
    return nodes, edges


def raw_system_log(df: DataFrame, days: list[str] | None = None) -> DataFrame:
    """System log lines of ten white-space fields: label, epoch, date, node, time, node again, kind, component, level, text."""
    f = F.split("raw", r"\s+", 10)
    a = df.select(*[F.get(f, F.lit(k)).alias(n) for k, n in enumerate(
        "label epoch date node time node2 kind component level text".split())]).where("text is not null")
    return a.where(F.col("date").isin(*days)) if days else a
