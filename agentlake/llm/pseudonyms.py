"""PII: format-preserving Feistel pseudonyms.

Values are found by pattern, validated (Luhn, mod 97, calendar, octets, ...),
ranked within the set of all values of their format, and permuted there by a
keyed Feistel network: a card number becomes another valid card number, a date
another date, an address another address of the same shape. The permutation
depends on key and kind only, so equal values get equal pseudonyms in all
documents and partitions without any exchange of data, and whoever holds the
key can undo them. Only where a pseudonym would make a candidate beside it valid
that was not (a chance of one in ten for each overlapping number that could be a
card) is another one taken in its place, so that undoing stays exact.

Numbers often stand side by side, so every start and every end at a separator is
tried: a value is found whatever number is before or behind it. Text in the shape
of a date, address, SSN, IBAN or card in four groups of four whose check fails is
not taken for a phone, and numbers that are phones throughout are not cut into
cards of unusual groups. Not covered: dates with month names, two-digit years or
one-digit days, IPv6 addresses, phones without a country code that have a group
of one or of more than four digits, names and postal addresses.

The Feistel cipher E is made a bijection of any set of N values by walking its
cycle until the value is below N. What is applied is E^-1(E(x) + 1 mod N): also
a bijection, and one that leaves no value as it is if N > 1.

Defined results: a null text stays null with nothing found, an empty one stays
empty; text without valid values is returned unchanged; repeated rows get the
same result; an empty table gives an empty result; all other columns stay.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlake.llm.common import small_batches

ROUNDS = 8
FIRST_DAY, DAYS = datetime.date(1000, 1, 1).toordinal(), datetime.date(2999, 12, 31).toordinal() - datetime.date(1000, 1, 1).toordinal() + 1

_B, _E = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: Kinds that their surroundings mark; they are always valid and taken first.
MARKED = {
    "email": r"(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,63})@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?i:pass(?:word|wd|phrase)|secret|token|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?P<secret_value>[A-Za-z0-9+/_.-]{8,})",
    "access_key": _B + r"(?:AKIA|ASIA)[A-Z0-9]{16}" + _E,
}
FINDER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in MARKED.items()))
#: Kinds with one shape.
SHAPES = {
    "date": re.compile(r"(?<![0-9A-Za-z+])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}(?P<sep>[/.])[0-9]{2}(?P=sep)[0-9]{4})(?!(?!T[0-9]{2}(?::|[0-9]{2}))[0-9A-Za-z]|[./-][0-9])"),
    "ip": re.compile(r"(?<![0-9A-Za-z.+])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"),
    "ssn": re.compile(r"(?<![0-9A-Za-z+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"),
}
#: All other values stand in stretches of these characters.
STRETCH = re.compile(r"[0-9A-Z+(][0-9A-Z ./()+-]{6,}")
NUMBER = re.compile(_B + "[0-9]+" + _E)
IBAN_START, IBAN = re.compile(_B + "[A-Z]{2}[0-9]{2}(?=[ A-Z0-9])"), re.compile("[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?")
IBAN_LENGTHS = {c: int(n) for n, cs in {
    "15": "NO", "16": "BE", "18": "DK FI FK FO GL NL SD", "19": "MK SI", "20": "AT BA EE KZ LT LU MN XK", "21": "CH HR LI LV",
    "22": "BG BH CR DE GB GE IE ME RS VA", "23": "AE GI IL IQ OM SO TL", "24": "AD CZ ES MD PK RO SA SE SK TN VG", "25": "LY PT ST",
    "26": "IS TR", "27": "BI DJ FR GR IT MC SM", "28": "AL AZ BY CY DO GT HU LB NI PL SV", "29": "BR EG PS QA UA", "30": "JO KW MU YE", "31": "MT SC", "32": "LC", "33": "RU"}.items() for c in cs.split()}
#: Digits in the groups of printed cards, besides all 13 to 19 in one.
CARD_GROUPS = {(4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4), (4, 3, 3, 3), (4, 4, 5), (6, 13), (8, 8)}
_PHONE = _B + r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{1,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{2,4}(?:[ .-][0-9]{2,4}){%d}(?![0-9A-Za-z]|[.-][0-9])"
PHONE_START = re.compile(_B + r"(?:[0-9]{2,4}[ .-]|[+(][0-9])")
PHONES = [re.compile(_PHONE % n) for n in (1, 2, 3)] + [re.compile(_B + r"\+[0-9]{8,15}" + _E)]
#: After a country code groups have any length; the total is checked.
PHONES += [re.compile(_B + r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,10}(?:[ .-][0-9]{1,10}){%d}(?![0-9A-Za-z]|[.-][0-9])" % n) for n in range(7)]
#: Every pattern needs one of these.
GATE = "0123456789@=:"


# -- the permutation ----------------------------------------------------------------------------------------------------

class Feistel:
    """Keyed permutations of range(n)."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _network(self, x: int, half: int, tweak: bytes, rounds) -> int:
        mask = (1 << half) - 1
        left, right, size = x >> half, x & mask, (half + 7) // 8
        for r in rounds:
            seed = hashlib.blake2b(tweak + bytes((r,)) + right.to_bytes(size, "big"), key=self.key, digest_size=64).digest()
            while len(seed) < size:
                seed += hashlib.blake2b(seed, key=self.key, digest_size=64).digest()
            left, right = right, left ^ (int.from_bytes(seed[:size], "big") & mask)
        return (right << half) | left

    def _walk(self, x: int, n: int, tweak: bytes, rounds) -> int:
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        while True:
            x = self._network(x, half, tweak, rounds)
            if x < n:
                return x

    def _shift(self, x: int, n: int, tweak: bytes, by: int) -> int:
        if n < 2:
            return x
        tweak = tweak + b"/" + str(n).encode()
        return self._walk((self._walk(x, n, tweak, range(ROUNDS)) + by) % n, n, tweak, range(ROUNDS - 1, -1, -1))

    def apply(self, x: int, n: int, tweak: bytes) -> int:
        return self._shift(x, n, tweak, 1)

    def undo(self, x: int, n: int, tweak: bytes) -> int:
        return self._shift(x, n, tweak, -1)


# -- formats: text <-> rank ---------------------------------------------------------------------------------------------

def _rank(chars: str, radices: list[int]) -> tuple[int, int]:
    x, n = 0, 1
    for c, r in zip(chars, radices):
        x, n = x * r + int(c, 36) - (10 if r == 26 else 0), n * r
    return x, n


def _unrank(x: int, radices: list[int]) -> str:
    out = []
    for r in reversed(radices):
        x, d = divmod(x, r)
        out.append("0123456789abcdefghijklmnopqrstuvwxyz"[d + (10 if r == 26 else 0)])
    return "".join(reversed(out))


def _refill(pattern: str, chars: str, where) -> str:
    """The pattern with its characters at ``where`` replaced in turn, each in the case it had."""
    out = list(pattern)
    for i, c in zip(where, chars):
        out[i] = c.upper() if out[i].isupper() else c
    return "".join(out)


def _by_class(value: str, where: list[int], step, tweak: bytes, hexadecimal: bool = False) -> str:
    """Permutes the letters and digits at these places: digits to digits, letters to letters."""
    chars = "".join(value[i] for i in where).lower()
    radices = [16 if hexadecimal else 10 if c.isdigit() else 26 for c in chars]
    shape = "".join("d" if r == 10 else "l" if r == 26 else "x" for r in radices)
    x, n = _rank(chars, radices)
    return _refill(value, _unrank(step(x, n, tweak + shape.encode()), radices), where)


def _alnum(value: str, start: int = 0, stop: int | None = None) -> list[int]:
    return [i for i in range(start, len(value) if stop is None else stop) if value[i].isascii() and value[i].isalnum()]


def luhn(digits: str) -> int:
    """The check digit that these digits need after them."""
    return -sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits))) % 10


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _email(v, step):
    at, dot = v.index("@"), v.rindex(".")
    # hyphens, dots and the last part of the domain stay
    return _by_class(v, _alnum(v, 0, at) + _alnum(v, at + 1, dot), step, b"email")


def _secret(v, step):
    where = _alnum(v)
    is_hex = len(where) >= 16 and all(v[i] in "0123456789abcdef" for i in where) and any(v[i].isdigit() for i in where)
    return _by_class(v, where, step, b"secret", hexadecimal=is_hex)


def _access_key(v, step):
    return _by_class(v, _alnum(v, 4), step, b"access_key")


def _iban(v, step):
    s = v.replace(" ", "")
    if not 15 <= len(s) <= 34 or _mod97(s) != 1:
        return None
    body = _by_class(s, _alnum(s, 4), step, b"iban" + s[:2].encode())
    check = 98 - _mod97(body[:2] + "00" + body[4:])
    done = f"{body[:2]}{check:02d}{body[4:]}"
    return _refill(v, done, _alnum(v))


def _date(v, step):
    d = v[4] if not v[4].isdigit() else v[2]
    a, b, c = v.split(d)
    orders = [(a, b, c, "{y:04d}{d}{m:02d}{d}{t:02d}")] if len(a) == 4 else [(c, b, a, "{t:02d}{d}{m:02d}{d}{y:04d}"), (c, a, b, "{m:02d}{d}{t:02d}{d}{y:04d}")]
    for y, m, t, form in orders:  # day before month first; the other way if that is no date
        try:
            day = datetime.date(int(y), int(m), int(t)).toordinal() - FIRST_DAY
        except ValueError:
            continue
        if 0 <= day < DAYS:
            new = datetime.date.fromordinal(step(day, DAYS, b"date") + FIRST_DAY)
            return form.format(y=new.year, m=new.month, t=new.day, d=d)
    return None


def _ip(v, step):
    parts = [int(p) for p in v.split(".")]
    if max(parts) > 255:
        return None
    x = step(int.from_bytes(bytes(parts), "big"), 1 << 32, b"ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ssn(v, step):
    area, group, serial = map(int, v.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    x = step(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, b"ssn")
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _card(v, step):
    where = _alnum(v)
    s = "".join(v[i] for i in where)
    if not 13 <= len(s) <= 19 or luhn(s[:-1]) != int(s[-1]) or len(set(s)) == 1:
        return None
    n = len(s) - 2  # the first digit (the network) stays, the last is computed
    body = s[0] + str(step(int(s[1:-1]), 10 ** n, b"card" + s[:1].encode())).zfill(n)
    return _refill(v, body + str(luhn(body)), where)


def _phone(v, step):
    where = _alnum(v)
    if not 8 <= len(where) <= 15:
        return None
    if v[0] == "+":  # the country code stays: digits up to the first separator, at least one
        code = re.match(r"\+([0-9]{1,3})(?![0-9])", v)
        where = where[len(code[1]) if code else 1:]
    n = len(where)
    digits = str(step(int("".join(v[i] for i in where)), 10 ** n, b"phone")).zfill(n)
    return _refill(v, digits, where)


KINDS = {"email": _email, "secret": _secret, "access_key": _access_key, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone}


#: No candidate is longer.
LONGEST = 48


def _marked(n: int, spans) -> bytearray:
    out = bytearray(n)
    for i, j, *_ in spans:
        out[i:j] = b"\1" * (j - i)
    return out


def _ibans(t: str) -> Iterator[tuple[int, int, str]]:
    """At each start, what has the length of its country, then longer before shorter ones."""
    for m in IBAN_START.finditer(t):
        i, ends = m.start(), []
        for j in range(i + 12, min(len(t), i + 45) + 1):
            if t[j - 1] != " " and not (j < len(t) and t[j].isascii() and t[j].isalnum()) and IBAN.fullmatch(t, i, j):
                n = j - i - t.count(" ", i, j)
                if 15 <= n <= 34:
                    ends.append((n != IBAN_LENGTHS.get(t[i:i + 2]), -n, j))
        yield from ((i, j, "iban") for _, _, j in sorted(ends))


def _runs(t: str) -> list[list[tuple[int, int]]]:
    """Numbers joined by single spaces or hyphens."""
    runs: list[list[tuple[int, int]]] = []
    for m in NUMBER.finditer(t):
        if runs and m.start() - runs[-1][-1][1] == 1 and t[m.start() - 1] in " -":
            runs[-1].append(m.span())
        else:
            runs.append([m.span()])
    return runs


def _cards(t: str, run: list[tuple[int, int]]) -> tuple[list, list]:
    """Candidates of 13 to 19 digits: (in the groups of printed cards, all others, longest first)."""
    printed, others = [], []
    for a, (i, _) in enumerate(run):
        if t[i - 1:i] == "+":
            continue
        groups: tuple[int, ...] = ()
        for b in range(a, len(run)):
            groups += (run[b][1] - run[b][0],)
            n, j = sum(groups), run[b][1]
            if n > 19:
                break
            if n < 13:
                continue
            if len(groups) == 1 or groups in CARD_GROUPS:
                printed.append((i, j, "card"))
            # the first or last number must not be part of an address, date or fraction
            elif not (t[i - 1:i] in (".", "/") and t[i - 2:i - 1].isdigit()) and not (t[j:j + 1] in (".", "/") and t[j + 1:j + 2].isdigit()):
                others.append((-n, i, j))
    return printed, [(i, j, "card") for _, i, j in sorted(others)]


def _phones(t: str, lo: int, hi: int, barred: bytearray) -> list[tuple[int, int, str]]:
    """The phones that cover most digits of t[lo:hi], as few of them as can; decided by shape alone."""
    found = []
    for m in PHONE_START.finditer(t, lo, hi):
        for p in PHONES:
            c = p.match(t, m.start())
            if c and c.end() <= hi and 8 <= (n := len(_alnum(c[0]))) <= 15 and barred.find(1, *c.span()) < 0:
                found.append((c.end(), -c.start(), n))
    ends, best = [lo], [(0, 0, None)]  # (digits, -phones, (phone, state before it))
    for j, i, n in sorted(set(found)):
        k = bisect_right(ends, -i) - 1
        new = (best[k][0] + n, best[k][1] - 1, ((-i, j, "phone"), best[k][2]))
        if new[:2] > best[-1][:2]:
            ends.append(j)
            best.append(new)
    out, link = [], best[-1][2]
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def _candidates(t: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """All candidates of checked kinds in a stretch, by precedence, and the
    spans in the printed shape of one, which are no phones. Depends on shapes only."""
    ibans = list(_ibans(t))
    shaped = [(*m.span(), kind) for kind, p in SHAPES.items() for m in p.finditer(t)]
    barred = _marked(len(t), shaped)
    printed, whole, others, rows = [], [], [], []
    for run in _runs(t):
        p, o = _cards(t, run)
        printed += p
        for four, group in groupby(run, lambda x: x[1] - x[0] == 4):
            group = list(group)
            if four and len(group) == 4:
                rows.append((group[0][0], group[-1][1]))
        lo, hi = run[0][0], run[-1][1]
        whole += [c for c in o if c[:2] == (lo, hi)]
        o = [c for c in o if c[:2] != (lo, hi)]
        if o:
            phones = _phones(t, lo, hi, barred)
            # numbers that are phones throughout are not cut into cards
            if sum(j - i + 1 for i, j, _ in phones) - 1 < hi - lo:
                others += o
    firsts = {i: (i, j) for i, j, _ in reversed(ibans)}
    return ibans + shaped + printed + whole + others, [c[:2] for c in shaped] + rows + list(firsts.values())


class Pseudonymizer:
    """Row-local: texts in, texts with pseudonyms out.

    In a stretch of numbers and capitals the values of checked kinds are taken by
    precedence (IBANs; dates, addresses, SSNs; cards as printed; other cards),
    then phones from what is left. A pseudonym must not make a candidate valid
    that came before its value: its permutation is walked on until none is, so
    that the new text has its values at the same places and can be undone."""

    def __init__(self, key: bytes, undo: bool = False):
        cipher = Feistel(key)
        step = cipher.undo if undo else cipher.apply
        self.undo, self.value = undo, lru_cache(maxsize=1 << 16)(lambda kind, v: KINDS[kind](v, step))

    def text(self, t: str) -> tuple[str, dict[str, int]]:
        found: dict[str, int] = {}
        if not any(c in t for c in GATE):
            return t, found
        new, hidden, at = [], [], 0
        for m in FINDER.finditer(t):
            kind = m.lastgroup if m.lastgroup != "secret_value" else "secret"
            i, j = m.span("secret_value") if kind == "secret" else m.span()
            new.append((i, j, self.value(kind, t[i:j])))
            hidden += [t[at:m.start()], "x" * (m.end() - m.start())]
            found[kind], at = found.get(kind, 0) + 1, m.end()
        rest = "".join([*hidden, t[at:]])
        for m in STRETCH.finditer(rest):
            lo = max(0, m.start() - 1)
            for i, j, kind, v in self._stretch(rest[lo:m.end() + 1]):
                new.append((lo + i, lo + j, v))
                found[kind] = found.get(kind, 0) + 1
        out, at = [], 0
        for i, j, v in sorted(new):
            out += [t[at:i], v]
            at = j
        return "".join([*out, t[at:]]), found

    def _stretch(self, t: str) -> list[tuple[int, int, str, str]]:
        """(start, stop, kind, pseudonym) of the values of a stretch."""
        candidates, shapes = _candidates(t)
        taken, rivals, used = [], [], bytearray(len(t))  # with their precedence; rivals are tried in vain
        for k, c in enumerate(candidates):
            if used.find(1, c[0], c[1]) < 0:
                if self.value(c[2], t[c[0]:c[1]]) is None:
                    rivals.append((c, k))
                else:
                    taken.append((c, k))
                    used[c[0]:c[1]] = b"\1" * (c[1] - c[0])
        shapes = [x for x in shapes if used.find(1, *x) < 0]
        barred = _marked(len(t), [x for x, _ in taken] + shapes)
        taken += [(c, len(candidates)) for c in _phones(t, 0, len(t), barred)]
        taken.sort()
        rivals.sort()
        spans, values = [c for c, _ in taken], [t[c[0]:c[1]] for c, _ in taken]

        def now(lo: int, hi: int) -> str:
            out, at = [], lo
            for x in range(max(0, bisect_left(spans, (lo - LONGEST,))), bisect_left(spans, (hi,))):
                i, j, v = *spans[x][:2], values[x]
                if at < j:
                    out += [t[at:i], v if len(v) != j - i else v[max(0, at - i):hi - i]]
                    at = j
            return "".join([*out, t[at:hi]])

        for x in reversed(range(len(taken))) if self.undo else range(len(taken)):
            (i, j, kind), k = taken[x]
            near = [r for r, n in rivals[bisect_left(rivals, ((i - LONGEST,),)):bisect_left(rivals, ((j,),))] if r[1] > i and n < k]
            while True:
                values[x] = self.value(kind, values[x])
                if all(self.value(r[2], now(r[0], r[1])) is None for r in near):
                    break
        return [(*c, v) for c, v in zip(spans, values)]


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text", undo: bool = False) -> DataFrame:
    """The frame with pseudonyms in ``text``, and columns pii_found (number of
    values replaced) and pii_kinds (map of kind to number)."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("text string, found long, kinds map<string,long>")
    def swapped(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = Pseudonymizer(key, undo)
        for s in texts:
            done = [(None, {}) if t is None else p.text(t) for t in s]
            yield pd.DataFrame({"text": [t for t, _ in done], "found": [sum(k.values()) for _, k in done], "kinds": [k for _, k in done]})

    out = docs.withColumn("__p", swapped(F.col(text)))
    return out.withColumns({text: F.col("__p.text"), "pii_found": F.col("__p.found"), "pii_kinds": F.col("__p.kinds")}).drop("__p")
