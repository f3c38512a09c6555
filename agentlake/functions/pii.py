"""PII detection and redaction expressions.

One six-alternative pattern, leftmost-first, matched by the JVM regex engine
inside ``regexp_replace`` / ``regexp_extract_all`` — no Python in the path.
Digits and word boundaries are Unicode on every engine and JDK: the flag ``(?U)``
asks for them here, Python's ``re`` means them anyway. White space is a class
written out, the same for all.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agentlake.functions.once import once

SPACE = r" \t\n\x0B\f\r"
# The PII alternatives, in match-priority order, with the
# category each one reports.
PII_ALTERNATIVES = [
    ("CREDIT_CARD", rf"\b\d{{4}}[{SPACE}-]?\d{{4}}[{SPACE}-]?\d{{4}}[{SPACE}-]?\d{{4}}\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,7}\b"),
    ("PHONE", rf"\b(?:\+1[{SPACE}])?\(?\d{{3}}\)?[{SPACE}.-]\d{{3}}[{SPACE}.-]\d{{4}}\b"),
    ("AADHAAR", rf"\b\d{{4}}[{SPACE}-]?\d{{4}}[{SPACE}-]?\d{{4}}\b"),
    ("IFSC", r"\b[A-Z]{4}0[A-Z0-9]{6}\b"),
    ("BANK_ACCOUNT", r"\b\d{9,12}\b"),
]
# Fixed value: replacement text of a redacted match.
REDACTED = "[REDACTED_PII]"

PII_PATTERN = "|".join(p for _, p in PII_ALTERNATIVES)
PII_JAVA = "(?U)" + PII_PATTERN
# Every alternative needs a digit or '@' (the IFSC form has a literal 0), so a
# text without either cannot match: a one-class scan gates the full pattern.
PII_GATE = r"[\p{Nd}@]"
WORD_END = r"\b"
PII_GROUPED = "(?U)" + "|".join(f"({p})" for _, p in PII_ALTERNATIVES)
CATEGORIES = [c for c, _ in PII_ALTERNATIVES]


def _gated(text: Column, expr: Column, default: Column) -> Column:
    return F.when(text.rlike(PII_GATE), expr).otherwise(default)


def _by_alphabet(text: Column, apply) -> Column:
    """The same result by the cheaper pattern where all characters are ASCII: Unicode
    digits and word characters are the ASCII ones there."""
    return F.when(F.octet_length(text) == F.char_length(text), apply(PII_PATTERN)).otherwise(apply(PII_JAVA))


def has_pii(text: Column) -> Column:
    return _gated(text, _by_alphabet(text, text.rlike), F.when(text.isNotNull(), F.lit(False)))


def redact_text(text: Column) -> Column:
    return _gated(text, _by_alphabet(text, lambda pattern: F.regexp_replace(text, pattern, REDACTED)), text)


def _category(value: Column) -> Column:
    """Category of a match: the first alternative that covers the whole of it. All alternatives stand
    between word boundaries, so one that covers a match would have matched there."""
    out = F
    for name, p in PII_ALTERNATIVES:
        out = out.when(value.rlike(rf"(?U)\A(?:{p.removeprefix(WORD_END).removesuffix(WORD_END)})\z"), name)
    return out


def pii_matches(text: Column) -> Column:
    """ARRAY<STRUCT<idx INT, category STRING, value STRING>> of all matches in order; the text is searched once."""
    whole = _by_alphabet(text, lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    empty = F.array().cast("array<struct<idx:int,category:string,value:string>>")
    found = F.transform(whole, lambda x, i: F.struct((i + 1).alias("idx"), _category(x).alias("category"), x.alias("value")))
    return _gated(text, found, F.when(text.isNotNull(), empty))


def token_names(matches: Column) -> Column:
    """``[EMAIL_1]`` for each match: numbers of a category's values by first appearance."""
    key = lambda x: F.concat(x["category"], F.lit("\u0000"), x["value"])
    categories = F.array(*[F.lit(c) for c in CATEGORIES])
    values = F.array_distinct(F.transform(matches, key))
    of = once(values, lambda vs: F.transform(categories, lambda c: F.filter(vs, lambda v: v.startswith(F.concat(c, F.lit("\u0000"))))))

    def name(x: Column, of: Column) -> Column:
        mine = F.element_at(of, F.array_position(categories, x["category"]).cast("int"))
        return F.concat(F.lit("["), x["category"], F.lit("_"), F.array_position(mine, key(x)).cast("string"), F.lit("]"))

    return once(of, lambda o: F.transform(matches, lambda x: name(x, o)))


def tokenize(text: Column, matches: Column, tokens: Column) -> Column:
    """Rebuild ``text`` with the i-th match replaced by ``tokens[i]``.

    ``split`` on the same pattern yields the n+1 pieces between the n matches.
    """
    pieces = _by_alphabet(text, lambda pattern: F.split(text, pattern, -1))
    return once(pieces, lambda p: F.concat(F.array_join(F.transform(tokens, lambda t, i: F.concat(F.get(p, i), t)), ""), F.element_at(p, -1)))


def injection_flag(text: Column) -> Column:
    from agentlake.functions.classify import INJECTION_PHRASES
    return F.lower(text).rlike("|".join(INJECTION_PHRASES))
