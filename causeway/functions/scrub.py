"""The whole redaction: cards, 23 patterns in order, names after cues, known first names, learned names, nested payloads.

What is found becomes [REDACTED:KIND]; where a pattern names the key of a secret, only the secret goes. Passes follow each
other, each on what the one before left, so each is a projection of its own and its kind is noted when it changed the
text. All of it is native; learned names are a table of hashes that texts meet by a join.

Defined cases: null stays null with no kinds; empty text stays empty; text that was redacted before is left as it is, but for
secrets under a key, which get the key's kind.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import written

#: Kinds and patterns in their order; where there are two groups, the second is the secret.
PATTERNS = (
    ("JWT", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"),
    ("AWS_KEY", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("BEARER", r"(?i)\bbearer\s+[A-Za-z0-9._\-]{12,}"),
    ("API_KEY", r"(?i)(\b(?:api[_-]?key|secret|token|password|passwd|pwd)\b\s*[=:]\s*[\"']?)([^\s\"',;)]{6,})"),
    ("SERVICE_ACCOUNT", r"\bsvc[-_.][A-Za-z0-9._-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("SESSION", r"\bsess_[A-Za-z0-9]+\b"),
    ("SESSION", r"(?i)(\bsession(?:[_ -]?id)?\s*[:=]\s*)([A-Za-z0-9_-]{4,})"),
    ("ACCOUNT", r"\bACC-[0-9]{4,}\b"),
    ("ACCOUNT", r"(?i)(\b(?:acc|account(?:[_ -]?(?:id|no|number))?)\s*[:=]\s*)([A-Za-z0-9-]{4,})"),
    ("ACCOUNT", r"(?i)(\b(?:acc(?:ount)?)(?:[_ -]?(?:id|no|num|number))?\.?\s+#?)([0-9]{6,})\b"),
    ("CLOUD_ACCOUNT", r"(?<![0-9.-])[0-9]{12}(?![0-9.-])"),
    ("SSN", r"\b(?!000|666|9[0-9][0-9])[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}\b"),
    ("PHONE", r"(?<![0-9.])(?:\+91[\s-]?)?[6-9][0-9]{4}[\s-]?[0-9]{5}(?![0-9.])"),
    ("PHONE", r"(?<![0-9.])(?:\+[0-9]{1,3}[\s-]?)?(?:\([0-9]{3}\)|[0-9]{3})[\s-][0-9]{3}[\s-][0-9]{4}(?![0-9.])"),
    ("PHONE", r"(?<![0-9.])0?7[0-9]{3}[\s-][0-9]{6}(?![0-9.])"),
    ("PHONE", r"(?<![0-9.])\+[0-9]{1,3}[\s-][0-9]{3,5}[\s-][0-9]{4,7}(?![0-9.])"),
    ("IPV6", r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b"),
    ("IPV6", r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:])"),
    ("IPV6", r"(?<![\w:])::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}(?![\w:])"),
    ("IPV6", r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){1,7}:(?![\w:])"),
    ("IPV4", r"\b(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\b"),
    ("MRN", r"(?i)(\b(?:mrn|patient[_-]?id)\b\s*[=:]\s*[\"']?)([A-Za-z0-9-]{4,})"),
)
CARD = r"\b[0-9](?:[ -]?[0-9]){12,18}\b"
#: Words before a name, and what a name looks like.
CUE = (
    r"((?:\b(?:[Cc]ustomer|[Uu]ser|[Cc]lient|[Cc]ontact|[Nn]ame|[Mm]ember|[Aa]gent|[Pp]olicyholder|[Ii]nsured|[Cc]aller)"
    r"|\b(?:Mr|Mrs|Ms|Dr)\.?)\s*[:=-]?\s*)"
    r"((?:[A-Z][a-z]+|[A-Z]{2,})(?:\s+(?:[A-Z][A-Za-z'’-]+|[A-Z]{2,})){1,2})\b"
)
WORD, SURNAME = r"(?:[A-Z][a-z]+|[A-Z]{2,})", r"(?:[A-Z][A-Za-z'’-]+|[A-Z]{2,})"
MAIL_NAME = r"\b([A-Za-z]{2,})[._]([A-Za-z]{2,})@"
PAIR = r"(?=\b([A-Z][a-z]+)\s+([A-Z][a-z]+)\b)"
#: Fields of a payload that are identifiers or choices, not prose.
STRUCTURAL = (
    "id timestamp status severity source service component fingerprint ground_truth duplicate_count cluster_id acked "
    "escalated assignee status_override incident_key"
).split()
#: Words after a first name that make no surname of it.
NOT_SURNAMES = (
    "service server system pool queue cache database host node cluster manager engine gateway handler worker error failure "
    "timeout exhausted exceeded connection request response policy premium payment account"
).split()
KINDS = ("CARD", *dict.fromkeys(k for k, _ in PATTERNS), "NAME")


def tag(kind: str) -> str:
    return f"[REDACTED:{kind}]"


def cards(text: Column) -> Column:
    """Card numbers that pass the Luhn check replaced."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({CARD})"), 1))
    good = F.filter(found, lambda m: F.call_function("luhn_check", F.regexp_replace(m, "[ -]", "")))
    # longest first, so that none is replaced inside another
    good = F.array_sort(good, lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(good, text, lambda t, m: F.regexp_replace(t, F.concat(F.lit(r"\b"), m, F.lit(r"\b")), F.lit(tag("CARD"))))


def known_names(first_names: list[str], not_surnames: list[str]) -> tuple[str, str]:
    """Patterns of a known first name with a surname after it, and of the surname, a comma and the first name. Only true
    pairs match, so a word before a name never uses up the name."""
    firsts = "(?i:" + "|".join(sorted(first_names)) + ")"
    no = "(?!(?i:" + "|".join(sorted(not_surnames)) + r")\b)" if not_surnames else ""
    after = r"(?![A-Za-z'’-])"
    return (rf"\b(?={WORD}\s){firsts}\s+{no}{SURNAME}\b",
            rf"\b{no}{SURNAME},\s+(?={WORD}\b){firsts}{after}")


def passes(first_names: list[str] = (), not_surnames: list[str] = NOT_SURNAMES) -> list[tuple[str, object]]:
    """(kind, function of a text column) of every pass, in order."""

    def replaced(kind: str, pattern: str):
        keep = "$1" if re.compile(pattern).groups == 2 else ""
        return lambda t: F.regexp_replace(t, pattern, keep + tag(kind))

    out = [("CARD", cards), *[(k, replaced(k, p)) for k, p in PATTERNS], ("NAME", replaced("NAME", CUE))]
    if first_names:
        out += [("NAME", replaced("NAME", p)) for p in known_names(list(first_names), list(not_surnames))]
    return out


def redact(text: Column, first_names: list[str] = (), not_surnames: list[str] = NOT_SURNAMES) -> Column:
    """text after all passes."""
    for _, work in passes(first_names, not_surnames):
        text = work(text)
    return text


def redacted(df: DataFrame, column: str, first_names: list[str] = (), not_surnames: list[str] = NOT_SURNAMES, kinds: str = "redacted_fields") -> DataFrame:
    """df with the column after all passes and the kinds found, in order of the passes."""
    out, marks = df.withColumn("__t", F.col(f"`{column}`")), []
    for k, (kind, work) in enumerate(passes(first_names, not_surnames)):
        marks.append((kind, f"__k{k}"))
        out = out.withColumn("__n", work(F.col("__t"))).withColumn(f"__k{k}", F.coalesce(F.col("__n") != F.col("__t"), F.lit(False))).drop(
            "__t").withColumnRenamed("__n", "__t")
    found = F.array_distinct(F.array_compact(F.array(*[F.when(F.col(c), F.lit(kind)) for kind, c in marks])))
    return out.withColumn(kinds, found).withColumn(column, F.col("__t")).drop("__t", *[c for _, c in marks])


def name_hash(first: Column, last: Column) -> Column:
    """Hash of a name, by which it is known without being kept."""
    return F.sha2(F.concat_ws(" ", F.lower(first), F.lower(last)), 256)


def learned(texts: DataFrame, column: str) -> DataFrame:
    """(name): hashes of the names that addresses of the form first.last@ show, each once. Take texts as they were before
    redaction."""
    both = [F.regexp_extract_all(F.col(column), F.lit(MAIL_NAME), k) for k in (1, 2)]
    pairs = F.arrays_zip(*[b.alias(n) for b, n in zip(both, ("f", "l"), strict=True)])
    return texts.select(F.explode(pairs).alias("p")).select(name_hash(F.col("p.f"), F.col("p.l")).alias("name")).distinct()


def known(df: DataFrame, column: str, names: DataFrame, kinds: str = "redacted_fields") -> DataFrame:
    """df with the pairs of capitalised words of the column that names(name) knows replaced, overlapping pairs looked at
    each. Only texts with such pairs meet the table of names, each pair once."""
    base = written(df.withColumn("__row", F.monotonically_increasing_id()), "texts")
    both = [F.regexp_extract_all(F.col(f"`{column}`"), F.lit(PAIR), k) for k in (1, 2)]
    pair = base.select("__row", F.explode(F.array_distinct(F.arrays_zip(*both))).alias("p")).toDF("__row", "p").select(
        "__row", F.col("p")["0"].alias("first"), F.col("p")["1"].alias("last"))
    hit = pair.withColumn("name", name_hash(F.col("first"), F.col("last"))).join(names.select("name").distinct(), "name", "left_semi")
    pattern = F.concat(F.lit(r"\b"), "first", F.lit(r"\s+"), "last", F.lit(r"\b"))
    hit = hit.groupBy("__row").agg(F.array_sort(F.collect_set(pattern)).alias("__names"))
    out = base.join(hit, "__row", "left")
    clean = F.aggregate("__names", F.col(f"`{column}`"), lambda t, p: F.regexp_replace(t, p, F.lit(tag("NAME"))))
    if kinds in df.columns:
        out = out.withColumn(kinds, F.when(F.col("__names").isNotNull(), F.array_union(kinds, F.array(F.lit("NAME")))).otherwise(F.col(kinds)))
    return out.withColumn(column, F.when(F.col("__names").isNotNull(), clean).otherwise(F.col(f"`{column}`"))).drop("__row", "__names")


def payload(raw: Column, structural: list[str] = STRUCTURAL, first_names: list[str] = (), not_surnames: list[str] = NOT_SURNAMES) -> Column:
    """A JSON payload with every string inside it redacted, whatever its depth, but for what stands under a structural key
    of the outermost object. Keys, numbers, order and white space stay as they are. Text that is no JSON is redacted whole."""
    pieces = F.regexp_extract_all(raw, F.lit(r'("(?:[^"\\]|\\.)*+"(?:\s*:)?|[^"]+)'), 1)
    plain = lambda s: F.get(F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>"), F.lit(0))
    whole = lambda s: F.regexp_replace(F.to_json(F.array(s)), r"^\[|\]$", "")

    def clean(s: Column) -> Column:
        out = redact(plain(s), first_names, not_surnames)
        return F.when(out == plain(s), s).otherwise(F.coalesce(whole(out), s))

    count = lambda s, marks: F.length(s) - F.length(F.translate(s, marks, ""))

    def step(state: Column, s: Column) -> Column:
        key = s.startswith('"') & s.endswith(":")
        text = s.startswith('"') & ~s.endswith(":")
        kept = F.when(key & (state["depth"] == 1), plain(F.regexp_replace(s, r"\s*:$", "")).isin(*structural)).otherwise(state["kept"])
        depth = state["depth"] + F.when(s.startswith('"'), 0).otherwise(count(s, "{[") - count(s, "}]"))
        return F.struct(depth.cast("int").alias("depth"), F.coalesce(kept, F.lit(False)).alias("kept"), F.concat(
            state["out"], F.array(F.when(text & ~state["kept"], clean(s)).otherwise(s))).alias("out"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("kept"), F.array().cast("array<string>").alias("out"))
    walked = F.aggregate(pieces, start, step, lambda s: F.array_join(s["out"], ""))
    return F.when(F.try_parse_json(raw).isNotNull(), walked).otherwise(redact(raw, first_names, not_surnames))


def kinds_in(text: Column) -> Column:
    """Kinds of the marks that stand in a text, in order of the passes."""
    return F.array_compact(F.array(*[F.when(text.contains(tag(k)), F.lit(k)) for k in KINDS]))
