"""Pattern redaction of personal data in text columns.

An ordered chain of native replacements; `redact` is the full list with card numbers gated by the Luhn check and names
after cue words, `redact_simple` the part whose patterns other engines read alike. Both keep what is not personal and
do nothing to text that is clean already.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds and patterns, in order of precedence.
SIMPLE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("api_key", r"(?i)(?:api[_-]?key|token|password|secret)\s*[=:]\s*\"?[A-Za-z0-9_./+-]{8,}\"?"),
    ("phone", r"\+[0-9]{1,3}[ .-]?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}"),
    ("card", r"\b[0-9]{13,19}\b"),
    ("ipv4", r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"),
)
FULL = (
    ("jwt", r"\beyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}"),
    ("aws_key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("bearer", r"(?i)\bbearer\s+[A-Za-z0-9._~+/-]{8,}=*"),
    ("api_key", r"(?i)\b(?:api[_-]?key|token|password|passwd|secret)\b\s*[=:]\s*\"?[^\s\",;]{6,}\"?"),
    ("service_account", r"\bsvc-[a-z0-9-]+@[a-z0-9.-]+\b|\bsa-[a-z0-9-]{6,}\b"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("session", r"(?i)\bsess(?:ion)?(?:[_-]?id)?\s*[=:]\s*[A-Za-z0-9-]{6,}"),
    ("account", r"(?i)\b(?:acct?|account)(?:[_ -]?(?:id|no|number))?\s*[=:#]\s*[A-Za-z0-9-]{4,}"),
    ("cloud_account", r"(?<=arn:aws:[a-z0-9-]{1,20}:[a-z0-9-]{0,20}:)[0-9]{12}\b"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ("phone", r"(?<![0-9.])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}\b"),
    ("ipv6", r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}\b|(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){1,6}:(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,5})?"),
    ("ipv4", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9.])"),
    ("mrn", r"(?i)\bMRN[ :#-]*[0-9]{5,}\b"),
)
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
#: Fields whose content is personal whatever it looks like, compared without separators.
PERSONAL_FIELDS = "user username email phone ssn ip clientip session sessionid account accountid acc name fullname".split()


def tag(kind: str) -> str:
    return f"[{kind.upper()}]"


def redact_simple(text: Column) -> Column:
    for kind, pattern in SIMPLE:
        text = F.regexp_replace(text, pattern, tag(kind))
    return text


def kinds_found(text: Column) -> Column:
    """Kinds of SIMPLE found in the text as it is, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(text.rlike(p), F.lit(False)), F.lit(k)) for k, p in SIMPLE]))


def _cards(text: Column) -> Column:
    """Card numbers that pass the Luhn check replaced; other digit runs stay."""
    found = F.regexp_extract_all(text, F.lit(f"({CARD})"), 1)
    good = F.filter(found, lambda m: F.call_function("luhn_check", F.regexp_replace(m, "[ -]", "")))
    return F.aggregate(good, text, lambda t, m: F.replace(t, m, F.lit(tag("card"))))


def redact(text: Column) -> Column:
    """The full chain: cards, patterns, names after cue words."""
    out = _cards(text)
    for kind, pattern in FULL:
        out = F.regexp_replace(out, pattern, tag(kind))
    cue = r"((?i:\b(?:user|customer|client|patient|member|mr|mrs|ms|dr|contact|agent)\b[.:]?\s+))"
    return F.regexp_replace(out, cue + r"\p{Lu}\p{Ll}+(?:[ -]\p{Lu}\p{Ll}+){1,2}", "$1" + tag("name"))


def redact_field(key: Column, value: Column) -> Column:
    """A labelled field: replaced outright where the key is personal, else by patterns."""
    plain = F.regexp_replace(F.lower(key), "[_ .-]", "")
    return F.when(plain.isin(*PERSONAL_FIELDS), F.concat(F.lit("["), F.upper(plain), F.lit("]"))).otherwise(redact(value))


def redact_map(labels: Column) -> Column:
    return F.transform_values(labels, redact_field)
