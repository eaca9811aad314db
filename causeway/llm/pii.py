"""PII surrogates in native DataFrame functions: projections over the text, no Python, and no shuffle of texts.

One pattern marks every entity of a text. An entity's canonical form (a card's or phone's digits, an address in lower
case or written out, an IBAN without blanks, each word of a name) is replaced by its image under a keyed permutation of
the strings of its own format: a four-round Feistel network over its characters, in which every character moves inside
its class (digit to digit, upper case to upper case, a vowel to a vowel of the same script, ...) by an amount that a
keyed SHA-256 draws from the other half. The image is laid over the separators and the case that stood there. So

* the same entity gets the same surrogate in every document and every way to write it (coreference), without a table;
* different entities get different surrogates (a permutation), however many there are;
* separators, lengths, case, script and kind stay: cards keep their first digit and pass the Luhn check, IBANs keep
  their country and their distance to the valid check digits, IPv4 stays IPv4, phone numbers keep the country code, mail
  addresses keep the top-level domain, secrets keep their key word, names keep title (hence gender), script, particles
  and the last two letters of each longer word, which carry gender. Common first names become others of their gender
  and script: the groups of FIRST_NAMES are permuted in themselves.

Numbers like cards that fail the Luhn check are no cards and stay; ten bare digits are a phone number after a word like
`call` or `tel`. Names are found by their title. In the same text the whole name is then replaced wherever it stands, and
so is its last word alone, but not where that is likely an ordinary word: after an article, before a number, where it names a
month or a day, or where the text has it in small letters too. First names alone stay, as do names that never have a title.

The collision check runs first (`second_images`): distinct entities are gathered, one row each. Those whose image is another
real entity, itself or taken are given images under further keys, round by round, until theirs is neither real nor taken;
what LAST_ROUND leaves over becomes a placeholder of the kind and 128 bits of a keyed hash. Texts that hold such
entities meet them by a join on the text's hash; no other text changes. `collisions` lists surrogates that two entities
share, which must be none.

Defined cases: null text stays null, empty text empty; very long texts are split once at the marks; texts that hold
the mark character are escaped first; repeated rows get equal results; other columns, whatever their names, are kept;
an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import fresh, written

KEY = "causeway-surrogates-1"
ROUNDS = 4
#: A noncharacter that marks entities; where a text holds it, it is escaped.
MARK = "﷐"

#: Rounds of further keys for entities whose image is real.
LAST_ROUND = 8

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Lady|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Señorita|Sr|Sra|Srta|Don|Doña|Господин|Госпожа|Κύριος|Κυρία)"
#: Letters that titles begin with: what may begin a match is looked at first, as most places begin none.
_FIRST = "[MDPSLHFГΚ]"
#: A word of a name: O'Brien, McDonald, García-López; or in capitals.
_PART = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:(?<=Mc|Mac)\p{Lu}\p{Ll}+)?"
_NAME = rf"{_PART}(?:-{_PART})?"
_CAPITALS = r"(?:\p{Lu}['’])?\p{Lu}{2,}(?:-\p{Lu}{2,})?(?!\p{Ll})"
_BETWEEN = "(?:de la|de los|del|de|da|dos|di|du|van der|van den|van|von|y)"
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Calling codes by their first digits, one to three digits long.
_CODE = r"^(?:1|7|2[1-69][0-9]|3[578][0-9]|42[0-9]|50[0-9]|59[0-9]|6[789][0-9]|8[0578][0-9]|9[679][0-9]|[0-9]{2})"
#: The kinds in order of precedence, and what each looks like.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-]@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}",
    "secret": r"(?=[pPsStTaA])(?i:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth)(?:\"|')?\s{0,3}[=:]\s{0,3}(?:\"|')?[A-Za-z0-9+/_.~-]{5,}[A-Za-z0-9+/_~-]",
    "key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}|\bsk-[A-Za-z0-9-]{20,}|\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "ip": rf"\b{_OCTET}(?:\.{_OCTET}){{3}}\b",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{{0,4}}:)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|(?:{_HEX}:){{2,7}}:)(?![0-9A-Za-z:])",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}\b|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}\b|\b[0-9]{3}-[0-9]{3}-[0-9]{4}\b|\b[0-9]{3}\.[0-9]{3}\.[0-9]{4}\b|\b(?i:telephone|phone|tel|call|fax|mobile|cell)[.:]{0,2} ?[2-9][0-9]{2}[2-9][0-9]{6}\b",
    "card": r"\b[2-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}\b|\b3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "name": rf"(?={_FIRST}){_BEFORE}{_TITLE}\.? (?:{_NAME}(?: {_NAME}){{0,2}}(?: {_BETWEEN} {_NAME}(?: {_NAME})?){{0,2}}|{_CAPITALS}(?: {_CAPITALS})?)",
}
#: Months and days, which are names only beside a title.
CALENDAR = frozenset(
    "January February March April May June July August September October November December Monday Tuesday Wednesday Thursday "
    "Friday Saturday Sunday".split()
)
#: Common first names; each line is one group: a gender and a script, and an ending where that tells the gender.
FIRST_NAMES = (
    "Maria Sofia Julia Lucia Claudia Silvia Patricia Natalia Olivia Amelia Cecilia Victoria Antonia Emilia",
    "Anna Emma Laura Clara Sara Martha Linda Barbara Paula Elena Helena Christina Angela Monika Petra Carla",
    "Mary Alice Jane Susan Karen Ruth Helen Margaret Elizabeth Charlotte Sophie Marie Claire Ingrid Carmen Isabel",
    "John James Robert Michael William Will David Thomas Charles Daniel Paul Mark George Peter Henry Jack Bob Tom",
    "Juan Carlos Luis Pedro Miguel Jorge Diego Pablo Antonio Francisco Pierre Jean Louis Hans Karl Jürgen Klaus Stefan",
    "Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана", "Иван Пётр Алексей Сергей Дмитрий Николай Андрей Михаил",
    "Μαρία Ελένη Κατερίνα Σοφία Άννα", "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης",
)
#: Classes of characters that replace each other.
DIGIT, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX = "0123456789abcdef"
LETTERS = (
    "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "áéíóúàèùâêîôûäöü", "ÁÉÍÓÚÀÈÙÂÊÎÔÛÄÖÜ",
    "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ",
    "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
)


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _other_names(key: str) -> Column:
    """Each of FIRST_NAMES to the next of its group, in an order that the key draws: one cycle, so none is itself."""
    pairs = []
    for names in FIRST_NAMES:
        order = sorted(names.split(), key=lambda n: hashlib.sha256(f"{key}|{n}".encode()).digest())
        pairs += [f"{a}:{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)]
    return F.str_to_map(F.lit(",".join(pairs)), F.lit(","), F.lit(":"))


def _amount(key: str, kind: Column, r: Column, i: Column, other: Column) -> Column:
    """28 keyed bits for position i in round r, given the other half."""
    text = F.concat_ws("|", F.lit(key), kind, r.cast("string"), i.cast("string"), other)
    return F.conv(F.substring(F.sha2(text, 256), 1, 7), 16, 10).cast("long")


def _moved(c: Column, n: Column, classes: Column) -> Column:
    """Character c, n places on in its class; itself where it has none."""
    mine = F.filter(classes, lambda letters: (c != "") & (F.instr(letters, c) > 0))
    return F.coalesce(F.get(F.transform(mine, lambda letters: F.substr(letters, (F.pmod(
        F.instr(letters, c) - 1 + n, F.length(letters)) + 1).cast("int"), F.lit(1))), F.lit(0)), c)


def permuted(text: Column, kind: Column, classes: Column, key: str) -> Column:
    """The keyed permutation of the strings that have text's format."""
    half = F.floor(F.length(text) / 2)

    def one_round(now: Column, r: Column) -> Column:
        mine = lambda i: (i < half) == (r % 2 == 0)
        # the other half is bound once
        return F.flatten(F.transform(F.array(F.array_join(F.filter(now, lambda c, i: ~mine(i)), "")), lambda other: F.transform(
            now, lambda c, i: F.when(mine(i), _moved(c, _amount(key, kind, r, i, other), classes)).otherwise(c))))

    return F.array_join(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.split(text, ""), one_round), "")


def _numbered(number: Column, kind: Column, key: str) -> Column:
    """A 32-bit number under a keyed permutation (an IPv4 address as one number)."""
    pair = F.array(F.shiftright(number, 16), number.bitwiseAND(F.lit(0xFFFF)))

    def one_round(now: Column, r: Column) -> Column:
        step = _amount(key, kind, r, F.lit(0), now[1].cast("string"))
        return F.array(now[1], (now[0] + step) % 65536)

    out = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), pair, one_round)
    return out[0] * 65536 + out[1]


def _bare(e: Column, drop: str = "[^0-9]") -> Column:
    return F.regexp_replace(e, drop, "")


def _laid(e: Column, new: Column, letters: str) -> Column:
    """e with each of its characters in letters replaced by the next one of new."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    mine = lambda c: (c != "") & (F.instr(F.lit(letters), c) > 0)

    def step(now: Column, c: Column) -> Column:
        return F.struct(F.concat(now["out"], F.when(mine(c), F.substr(new, now["k"], F.lit(1))).otherwise(c)).alias("out"), (
            now["k"] + F.when(mine(c), 1).otherwise(0)).alias("k"))

    return F.aggregate(F.split(e, ""), start, step)["out"]


def _full(e: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address."""
    low = F.lower(e)
    side = lambda t: F.filter(F.split(t, ":"), lambda g: g != "")
    left, right = side(F.substring_index(low, "::", 1)), side(F.when(F.instr(low, "::") > 0, F.substring_index(low, "::", -1)).otherwise(""))
    gap = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0)))
    return F.array_join(F.transform(F.concat(left, gap, right), lambda g: F.lpad(g, 4, "0")), "")


def _mod97(text: Column) -> Column:
    """The remainder of an IBAN's number: digits as they are, letters as 10 to 35."""
    value = lambda c: F.instr(F.lit(DIGIT + UPPER), c) - 1
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(F.pmod(
        a * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97)).cast("int")))


def canonical(e: Column, kind: Column) -> Column:
    """What is the same however an entity is written. For a name this is of one word of it."""
    digits = _bare(e)
    return (
        F.when(kind == "email", F.lower(e))
        .when(kind == "card", digits)
        .when(kind == "phone", F.when(e.startswith("+"), digits).otherwise(F.concat(F.lit("1"), digits)))
        .when(kind == "iban", F.regexp_replace(e, " ", ""))
        .when(kind == "ipv6", _full(e))
        .when(kind == "secret", F.regexp_replace(e, _SECRET, ""))
        .when((kind == "name") & _capital(e), F.concat(F.substr(e, F.lit(1), F.lit(1)), F.lower(F.substr(e, F.lit(2)))))
        .otherwise(e)
    )


def _capital(e: Column) -> Column:
    return e.rlike(r"^\p{Lu}['’-]?\p{Lu}[\p{Lu}'’-]*$")


#: The part of a secret before its value.
_SECRET = r"^(?i)[a-z_-]+[\"']?\s{0,3}[=:]\s{0,3}[\"']?"


def _lists(*classes: str) -> Column:
    return F.array(*[F.lit(x) for x in classes])


def image(c: Column, kind: Column, key: str = KEY) -> Column:
    """The permutation of canonical forms: a head and a tail stay, what is between moves, check digits are made anew."""
    n = F.length(c)
    hexed = (kind == "secret") & c.rlike("^[0-9a-f]+$")
    head = (
        F.when(kind == "phone", F.regexp_extract(c, _CODE, 0))
        .when(kind == "key", F.regexp_extract(c, r"^(?:AKIA|ASIA|gh[pousr]_|sk-|eyJ|)", 0))
        .when(kind == "name", F.regexp_extract(c, r"^(?:(?:Mc|Mac|\p{Lu}['’])(?=\p{Lu})|)", 0))
        .otherwise(F.substr(c, F.lit(1), F.when(kind == "card", 1).when(kind == "iban", 4).when(kind == "ipv6", 4).otherwise(0)))
    )
    # the last two letters of the words of names carry gender in many languages
    tail = F.when(kind == "email", F.regexp_extract(c, r"\.[a-z]+$", 0)).otherwise(F.substr(
        c, n - _stay(kind, n) + 1, _stay(kind, n)))
    classes = (
        F.when(hexed | (kind == "ipv6"), _lists(HEX))
        .when(kind == "name", _lists(*LETTERS))
        .when(kind == "email", _lists(DIGIT, LOWER))
        .when(kind == "iban", _lists(DIGIT, UPPER))
        .when(kind.isin("secret", "key"), _lists(DIGIT, LOWER, UPPER))
        .otherwise(_lists(DIGIT))
    )
    tens = F.split(F.lit("0 1 2 3 4 5 6 7 8 9"), " ")
    parts = F.array(F.struct(head.alias("h"), tail.alias("t"), classes.alias("c")))
    valid = lambda land, body: 98 - _mod97(F.concat(body, land, F.lit("00")))

    def closed(h: Column, body: Column, old: Column, t: Column) -> Column:
        land = F.substr(h, F.lit(1), F.lit(2))
        check = F.pmod(valid(land, body) + F.substr(h, F.lit(3), F.lit(2)).try_cast("int") - valid(land, old), F.lit(100))
        return (
            F.when(kind == "card", F.concat(h, body, F.get(F.filter(tens, lambda d: _luhn(F.concat(h, body, d))), F.lit(0))))
            .when(kind == "iban", F.concat(land, F.lpad(check.cast("string"), 2, "0"), body))
            .otherwise(F.concat(h, body, t))
        )

    def moved(_: Column, x: Column) -> Column:
        old = F.substr(c, F.length(x["h"]) + 1, n - F.length(x["h"]) - F.length(x["t"]))
        label = F.when(hexed, "hex").otherwise(kind)
        return F.aggregate(F.array(permuted(old, label, x["c"], key)), F.lit(""), lambda _, b: closed(x["h"], b, old, x["t"]))

    other = F.when(kind == "name", F.try_element_at(_other_names(key), c))
    return F.when(kind == "ip", _ip(c, key)).when(other.isNotNull(), other).otherwise(F.aggregate(parts, F.lit(""), moved))


def _stay(kind: Column, n: Column) -> Column:
    """How many characters at the end stay or are made anew."""
    return F.when(kind == "card", 1).when((kind == "name") & (n > 3), 2).otherwise(0)


def _ip(e: Column, key: str) -> Column:
    octets = F.transform(F.split(e, r"\."), lambda x: x.cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x)

    def dotted(n: Column) -> Column:
        return F.array_join(
            F.transform(F.array(*[F.lit(k) for k in (16777216, 65536, 256, 1)]),
                        lambda d: (F.floor(n / d) % 256).cast("string")), ".")

    return F.aggregate(F.array(number), F.lit(""), lambda _, n: dotted(_numbered(n, F.lit("ip"), key)))


def placeholder(c: Column, kind: Column, key: str = KEY) -> Column:
    return F.concat(F.lit("["), F.upper(kind), F.lit("-"), F.substring(
        F.sha2(F.concat_ws("|", F.lit(key), kind, c), 256), 1, 32), F.lit("]"))


def _styled(e: Column, c: Column, new: Column, kind: Column) -> Column:
    """The image in the way the entity was written."""
    cased = F.array_join(F.zip_with(F.split(e, ""), F.split(new, ""), lambda a, b: F.when(a.rlike("[A-Z]"), F.upper(b)).otherwise(b)), "")
    groups = F.transform(F.sequence(F.lit(1), F.lit(29), F.lit(4)), lambda k: F.substr(new, k, F.lit(4)))
    short = F.transform(groups, lambda g: F.regexp_replace(g, "^0{1,3}", ""))
    hexed = F.array_join(F.when(F.instr(e, "::") > 0, short).otherwise(groups), ":")
    return (
        F.when(kind == "email", cased)
        .when(kind == "card", _laid(e, new, DIGIT))
        .when(kind == "phone", _laid(e, F.when(e.startswith("+"), new).otherwise(F.substr(new, F.lit(2))), DIGIT))
        .when(kind == "iban", _laid(e, new, DIGIT + UPPER))
        .when(kind == "ipv6", F.when(e.rlike("[A-F]"), F.upper(hexed)).otherwise(hexed))
        .when(kind == "secret", F.concat(F.regexp_extract(e, _SECRET, 0), new))
        .when((kind == "name") & _capital(e), F.upper(new))
        .otherwise(new)
    )


def _replaced(e: Column, kind: Column, key: str, second: Column | None) -> Column:
    """e in its style with its image, or with that which second (a map by _named forms) has for it; a placeholder where
    that is one, or is e itself."""
    known = F.array(F.struct(canonical(e, kind).alias("c")))

    def styled(_: Column, x: Column) -> Column:
        first = F.nullif(image(x["c"], kind, key), x["c"])
        new = first if second is None else F.coalesce(F.try_element_at(second, _form(kind, x["c"])), first)
        before = F.when(kind == "secret", F.regexp_extract(e, _SECRET, 0)).when(kind == "phone", F.regexp_extract(e, r"^[A-Za-z.: ]*", 0)).otherwise("")
        return F.aggregate(F.array(new), F.lit(""), lambda _, n: F.when(n.isNotNull() & ~n.startswith("["), _styled(
            e, x["c"], n, kind)).otherwise(F.concat(before, placeholder(x["c"], kind, key))))

    return F.aggregate(known, F.lit(""), styled)


def _form(kind: Column, c: Column) -> Column:
    """An entity's key: its kind and canonical form."""
    return F.concat_ws("|", kind, c)


def _any() -> str:
    return "|".join(f"(?:{p})" for p in PATTERNS.values())


def hinted(text: Column) -> Column:
    """Whether text has something that every pattern needs one of; texts without are not searched further."""
    marks = [text.contains(m) for m in ("::", "AKIA", "ASIA", "sk-", "eyJ", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")]
    out = text.rlike("[0-9@]") | text.rlike(r"(?=[pPsStTaA])(?i:pass|pwd|secret|token|api|access|auth)") | text.rlike(f"(?={_FIRST}){_TITLE}")
    for m in marks:
        out = out | m
    return out



def kind_of(e: Column) -> Column:
    """The first kind whose pattern matches all of e."""
    out = F.lit(None).cast("string")
    for k, p in reversed(PATTERNS.items()):
        out = F.when(e.rlike(f"^(?:{p})$"), F.lit(k)).otherwise(out)
    return out


def _parts(text: Column) -> Column:
    """text cut at its entities: plain, entity, plain, ..."""
    safe = F.replace(text, F.lit(MARK), F.lit(MARK + "e"))
    return F.split(F.regexp_replace(safe, f"({_any()})", f"{MARK}b$1{MARK}b"), MARK + "b", -1)


def _bare_name(e: Column) -> Column:
    return F.regexp_replace(e, rf"^{_TITLE}\.? ", "")


def _name_words(e: Column) -> Column:
    """The words of a name, without title and particles."""
    return F.filter(F.split(_bare_name(e), " "), lambda w: w.rlike(r"^\p{Lu}"))


def _sought(text: Column, parts: Column) -> Column:
    """Patterns of the names among the parts of a text: whole ones first, then last words that aren't likely ordinary."""
    names = F.array_distinct(F.transform(F.filter(F.filter(parts, lambda p, i: i % 2 == 1), lambda p: p.rlike(f"^{PATTERNS['name']}$")), _bare_name))
    last = F.array_distinct(F.transform(names, lambda n: F.substring_index(n, " ", -1)))
    usual = lambda w: F.contains(text, F.concat(F.lit(" "), F.lower(w), F.lit(" "))) | w.isin(*sorted(CALENDAR))
    alone = F.transform(F.filter(last, lambda w: ~usual(w)), lambda w: F.concat(
        F.lit(r"(?<!\b[Aa]n? |\b[Tt]he )"), w, F.lit("(?! [0-9])")))
    return F.concat(F.filter(names, lambda n: F.contains(n, F.lit(" "))), alone)


def replaced(text: Column, key: str = KEY, second: Column | None = None) -> Column:
    """text with every entity replaced; texts without one are passed on as they are."""

    def entity(p: Column) -> Column:
        """A part that is an entity; what only looks like a card stays."""
        known = F.array(F.struct(p.alias("e"), kind_of(p).alias("k")))  # bound once, used often
        return F.aggregate(known, F.lit(""), lambda _, x: F.when(
            (x["k"] == "card") & ~_luhn(_bare(x["e"])), x["e"]).otherwise(_replaced(x["e"], x["k"], key, second)))

    def renamed(p: Column) -> Column:
        """A name without its title, word by word."""
        return F.array_join(F.transform(F.split(p, " "), lambda w: F.when(w.rlike(r"^\p{Lu}"), _replaced(
            w, F.lit("name"), key, second)).otherwise(w)), " ")

    def named(p: Column, words: Column) -> Column:
        """Plain text with the text's names replaced."""
        at = F.concat(F.lit(_BEFORE + "("), F.array_join(words, "|"), F.lit(")" + _AFTER))
        cut = F.split(F.regexp_replace(p, at, F.lit(f"{MARK}n$1{MARK}n")), MARK + "n", -1)
        return F.array_join(F.transform(cut, lambda x, i: F.when(i % 2 == 1, renamed(x)).otherwise(x)), "")

    def whole(x: Column) -> Column:
        name = lambda p: p.rlike(f"^{PATTERNS['name']}$")
        done = F.transform(x["p"], lambda p, i: F.when((i % 2 == 1) & name(p), F.concat(F.regexp_extract(
            p, rf"^{_TITLE}\.? ", 0), renamed(_bare_name(p)))).when(i % 2 == 1, entity(p)).when(F.size(x["w"]) > 0, named(
            p, x["w"])).otherwise(p))
        return F.replace(F.array_join(done, ""), F.lit(MARK + "e"), F.lit(MARK))

    # parts and words are bound once
    done = F.aggregate(F.array(_parts(text)), F.lit(""), lambda _, parts: F.aggregate(
        F.array(F.struct(parts.alias("p"), _sought(text, parts).alias("w"))), F.lit(""), lambda _, x: whole(x)))
    return F.when(hinted(text) & text.rlike(_any()), done).otherwise(text)


def _found(e: Column) -> Column:
    """(kind, canonical form) of what an entity holds: one, or each word of a name."""
    kind = kind_of(e)
    one = lambda k, x: F.struct(k.alias("kind"), canonical(x, k).alias("entity"))
    return F.aggregate(F.array(kind), F.array().cast("array<struct<kind:string,entity:string>>"), lambda _, k: F.when(
        k == "name", F.transform(_name_words(e), lambda w: one(F.lit("name"), w))).when(
        (k == "card") & ~_luhn(_bare(e)), F.array().cast("array<struct<kind:string,entity:string>>")).otherwise(F.array(one(k, e))))


def entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, entity, surrogate, n): the distinct canonical entities of all texts, their images and how often each is
    found. Counted where they are read, then one row each."""
    text = F.col("`text`")
    found = docs.where(hinted(text) & text.rlike(_any())).select(F.posexplode(_parts(text)).alias("i", "e")).where("i % 2 = 1")
    found = found.groupBy("e").agg(F.count("*").alias("n")).select("n", F.inline(_found(F.col("e"))))
    each = found.groupBy("kind", "entity").agg(F.sum("n").alias("n"))
    return each.select("kind", "entity", image(F.col("entity"), F.col("kind"), key).alias("surrogate"), "n")


def collisions(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Surrogates that more than one entity of a kind has, after the collision check: none, unless it were broken."""
    found = written(entities(docs, key).select("kind", "entity", "surrogate"), "entities")
    second = second_images(found, key).withColumnRenamed("surrogate", "second")
    each = found.join(second, ["kind", "entity"], "left").withColumn("surrogate", F.coalesce("second", "surrogate"))
    return each.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1")


def second_images(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, entity, surrogate) for the entities whose image won't do: it is real, itself, a common first name that
    another may turn into, or a lesser entity's too. Common first names are left out: they point at nobody, and among
    themselves their images are distinct. Each round asks only for what the last one left."""
    real = found.select("kind", F.col("entity").alias("surrogate"))
    common = F.map_keys(_other_names(key))
    is_common = lambda c: (F.col("kind") == "name") & F.array_contains(common, F.col(c))

    def unfit(images: DataFrame, taken: DataFrame) -> DataFrame:
        first = images.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        free = first.join(taken, ["kind", "surrogate"], "left_anti").where((F.col("surrogate") != F.col("entity")) & ~is_common("surrogate"))
        return images.join(free, ["kind", "entity"], "left_anti")

    left = written(unfit(found.where(~is_common("entity")), real).select("kind", "entity"), "clashes")
    done = left.withColumn("surrogate", F.lit("")).limit(0)
    for n in range(1, LAST_ROUND + 1):
        if left.isEmpty():
            return done
        images = written(left.withColumn("surrogate", image(F.col("entity"), F.col("kind"), f"{key}#{n}")), "images")
        taken = real.unionByName(found.select("kind", "surrogate")).unionByName(done.select("kind", "surrogate"))
        left = written(unfit(images, taken).select("kind", "entity"), "clashes")
        done = written(done.unionByName(images.join(left, ["kind", "entity"], "left_anti")), "second_images")
    return done.unionByName(left.withColumn("surrogate", placeholder(F.col("entity"), F.col("kind"), key)))


def scrub(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with the entities of text replaced. Only where some images won't do are texts joined with their second ones,
    by the hash of the text, as rows have no key of their own."""
    second = second_images(written(entities(docs, key).select("kind", "entity", "surrogate"), "entities"), key)
    text, columns = F.col("`text`"), [F.col(f"`{c}`") for c in docs.columns]
    if second.isEmpty():
        return docs.withColumn("text", replaced(text, key))
    held = docs.where(hinted(text) & text.rlike(_any())).select(F.sha2(text, 256).alias("h"), F.explode(F.filter(
        _parts(text), lambda p, i: i % 2 == 1)).alias("e")).select("h", F.inline(_found(F.col("e")))).distinct()
    held = held.join(second, ["kind", "entity"]).groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct(
        _form(F.col("kind"), F.col("entity")), "surrogate"))).alias("m"))
    at, h = fresh(docs, "second"), fresh(docs, "hash")
    held = held.select(F.col("h").alias(h), F.col("m").alias(at))
    joined = docs.join(held, F.sha2(text, 256) == F.col(h), "left")
    return joined.select(*[replaced(text, key, F.col(at)).alias("text") if name == "text" else c for name, c in zip(docs.columns, columns, strict=True)])
