"""Scalar text functions on columns: tokens, templates, severities, stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that tell nothing about what failed.
STOP = "the a an in on of to for is was and at by".split()
BOILERPLATE = (
    "threshold crossed datapoint datapoints greater less than alarm state value values error errors failed failure "
    "exceeded exceeds warn warning info debug notice trace"
).split()
GENERIC_NAME_PARTS = "service svc api app server cluster primary".split()
#: Spellings of the four severities.
SEVERITIES = {
    "critical": "critical", "crit": "critical", "fatal": "critical", "emergency": "critical", "alert": "critical",
    "page": "critical", "high": "high", "error": "high", "err": "high", "major": "high", "warning": "warning",
    "warn": "warning", "medium": "warning", "minor": "warning", "info": "info", "low": "info", "notice": "info",
}
SEVERITY_RANK = {"critical": 0, "high": 1, "warning": 2, "info": 3}
#: Families of log templates' variable parts.
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def _fold(word: Column) -> Column:
    """A simple plural without its s."""
    plural = (F.length(word) > 4) & word.endswith("s") & ~word.endswith("ss")
    return F.when(plural, F.substr(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def tokens(message: Column, metric: Column, component: Column) -> Column:
    """Distinct comparable words: camel case split, lower case, no stop words or boilerplate, plurals folded."""
    none = F.lit("")
    raw = F.concat_ws(" ", F.coalesce(message, none), F.coalesce(metric, none), F.coalesce(component, none))
    spaced = F.regexp_replace(F.regexp_replace(raw, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    drop = F.array(*[F.lit(w) for w in [*STOP, *BOILERPLATE]])
    found = F.regexp_extract_all(F.lower(spaced), F.lit("([a-z][a-z0-9]{2,})"), 1)
    folded = F.transform(F.array_except(found, drop), _fold)
    return F.array_except(folded, drop)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays of distinct words; 0 where one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def template(message: Column) -> Column:
    """A log message with identifiers and numbers masked."""
    out = message
    for pattern in (UUID, r"\b[0-9a-fA-F]{16,}\b", r"\b[0-9]+(?:\.[0-9]+)?\b"):
        out = F.regexp_replace(out, pattern, "<*>")
    return out


def mask_raw_log(message: Column) -> Column:
    """Template of a system log line: hexadecimal numbers, locations and numbers masked."""
    out = F.regexp_replace(message, "0x[0-9a-fA-F]+", "<HEX>")
    return F.regexp_replace(F.regexp_replace(out, "R[0-9]+(?:-[A-Z0-9]+)+", "<LOC>"), "[0-9]+", "<NUM>")


def severity(raw: Column) -> Column:
    """One of the four severities; unknown spellings are info."""
    table = F.create_map(*[F.lit(x) for item in SEVERITIES.items() for x in item])
    return F.coalesce(table[F.lower(F.trim(raw))], F.lit("info"))


def severity_rank(level: Column) -> Column:
    table = F.create_map(*[F.lit(x) for item in SEVERITY_RANK.items() for x in item])
    return F.coalesce(table[level], F.lit(3))


def log_severity(message: Column) -> Column:
    """Severity inferred from words of a log message, most severe word first."""
    low = F.lower(message)
    return (
        F.when(low.contains("critical") | low.contains("fatal"), "critical")
        .when(low.contains("error") | low.contains("exception"), "high")
        .when(low.contains("warn"), "warning")
        .otherwise("info")
    )


def stable_id(*parts: Column) -> Column:
    """The first 16 digits of a hash of the parts."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 16)


def context_key(service: Column, component: Column, template_id: Column, metric: Column, message: Column) -> Column:
    """service|component or -|template, metric or the start of the message; empty strings count as absent."""
    some = lambda c: F.nullif(c, F.lit(""))
    what = F.coalesce(some(template_id), some(metric), F.substring(message, 1, 40))
    return F.concat_ws("|", service, F.coalesce(some(component), F.lit("-")), what)


def environment(host: Column) -> Column:
    """Environment named by a part of a host name."""
    parts = F.split(F.lower(host), r"[^a-z0-9]+")
    has = lambda w: F.array_contains(parts, w)
    return (
        F.when(has("prod") | has("production"), "production")
        .when(has("staging") | has("stg"), "staging")
        .when(has("dev") | has("development"), "development")
    )


def name_tokens(service: Column) -> Column:
    """Telling words of a service name."""
    parts = F.filter(F.split(F.lower(F.coalesce(service, F.lit(""))), "[^a-z0-9]+"), lambda p: F.length(p) > 2)
    return F.array_except(parts, F.array(*[F.lit(w) for w in GENERIC_NAME_PARTS]))


def mentioned(text: Column, services: Column, own: Column) -> Column:
    """Known services named in text as whole words (a hyphen may come before, not after), without its own."""
    names = F.filter(services, lambda s: (s != own) & F.regexp_like(
        text, F.concat(F.lit(r"(?:^|[^A-Za-z0-9_])"), F.regexp_replace(s, r"([\\.+*?\[^\]$(){}=!<>|:\-])", r"\\$1"),
                       F.lit(r"(?:$|[^A-Za-z0-9_\-])"))))
    return F.array_sort(F.array_distinct(names))


def event_time(raw: Column) -> Column:
    """Microseconds since 1970 of a number (seconds, milliseconds, microseconds or nanoseconds, by size) or of an
    ISO time (UTC where it has no zone); null where it is neither."""
    # what has a colon is no number: it isn't tried as one, as each failure is an exception inside
    number = lambda r: F.when(F.instr(r, ":") == 0, r.try_cast("double"))
    scaled = lambda n: F.when(n >= 1e17, n / 1e3).when(n >= 1e14, n).when(n >= 1e11, n * 1e3).when(
        n.isNotNull(), n * 1e6).cast("long")
    # arrays of one, so that raw and its number, which are named often, are computed once
    one = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    return one(raw, lambda r: F.coalesce(one(number(r), scaled), F.unix_micros(F.try_to_timestamp(r))))
