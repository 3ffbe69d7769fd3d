"""Format-preserving pseudonyms for personal data.

Values are found by pattern and validated (check digits, ranges, calendar), then permuted within
their format by a keyed Feistel network over the number of values that the format has: a card stays a
card with a right check digit, a date a date, an address an address. The permutation depends on the
key and the kind only, so equal values have equal pseudonyms in all documents, however they are
grouped or punctuated, and different ones differ.

Kinds: email (local part; the domain stays), secret (hex of 32 digits or more), iban, card (Luhn; the
first digit stays), ip, ssn, phone (the country's code stays), date (1900-2099). What doesn't validate stays
as it is. A date is read as year-month-day, else day-month-year, else month-day-year (so a date that can be read
day first is); its day is permuted among the days whose number in the month is up to 12, or over 12, like its own,
so the pseudonym is read in the same order, and one day has one pseudonym in every order and with any padding.
Day and month are written with a leading zero unless the source leaves it out. Dates with the month in words and addresses of
IPv6 aren't looked for: they stay.

The key comes from the setting spark.citelab.pii.key. If it is unset, each process draws a key of its own that
nobody knows: values are linked within that process's runs only. The registered query, whose rows are compared between
processes, takes QUERY_KEY then; pseudonymise() never does.

Nulls: a null text stays null with no findings; a null doc_id changes nothing. Repeated rows give
equal results; an empty table no rows. Texts are read whole. Extra columns are kept by pseudonymise();
those named like a result column are replaced.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import re
import secrets
import string

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelab.llm import common

ROUNDS = 8
SETTING = "spark.citelab.pii.key"
#: Of the registered query only, in a session without a key: no secret.
QUERY_KEY = "the key of op8_pii in tests"
_drawn = secrets.token_hex(32)

#: The forms that are looked for, in the order in which they claim text.
PATTERNS = [
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]*[\w%+-]@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")),
    ("secret", re.compile(r"(?<![\w])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![\w])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("date", re.compile(r"(?<![\d./-])(?:\d{4}([./-])\d{1,2}\1\d{1,2}|\d{1,2}([./-])\d{1,2}\2\d{4})(?![\d/-]|\.\d)")),
    ("ip", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]?\d{4}(?![\w])|(?<![\w+])\+\d(?:[ .()-]{0,2}\d){7,14}(?!\w)")),
    ("card", re.compile(r"(?<![\d])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d])")),
]
MAYBE = re.compile(r"[@0-9]")
YEARS = (1900, 2099)
#: Calling codes of one and of two digits; all others have three.
ONE_DIGIT = frozenset("1 7".split())
TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


# --- permutations ------------------------------------------------------------------------------


class Feistel:
    """Keyed permutations of 0 .. n-1, one for each tweak."""

    def __init__(self, key: str) -> None:
        self.key = hashlib.sha256(key.encode()).digest()

    def _round(self, tweak: bytes, i: int, n: int, half: int, most: int) -> int:
        size = 16 + (most.bit_length() + 7) // 8
        h = hashlib.blake2b(b"%d|%d|%d|" % (i, n, half) + tweak, key=self.key, digest_size=min(64, size)).digest()
        while len(h) < size:
            h += hashlib.blake2b(h, key=self.key).digest()
        return int.from_bytes(h[:size], "big") % most

    def permute(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        if n < 2:
            return x
        a = int(n**0.5) if n < 1 << 50 else 1 << (n.bit_length() // 2)
        a = max(a, 1)
        b = -(-n // a)
        t = tweak.encode()
        while True:  # what leaves the range goes through again, so the range is permuted
            left, right = divmod(x, b)
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if i % 2:
                    d = self._round(t, i, n, left, b)
                    right = (right - d if back else right + d) % b
                else:
                    d = self._round(t, i, n, right, a)
                    left = (left - d if back else left + d) % a
            x = left * b + right
            if x < n:
                return x

    def characters(self, s: str, tweak: str, back: bool = False) -> str:
        """s with digits for digits and letters for letters; everything else stays."""
        sets = [next((c for c in (string.digits, string.ascii_lowercase, string.ascii_uppercase) if ch in c), None) for ch in s]
        n = x = 0
        n = 1
        for ch, c in zip(s, sets, strict=True):
            if c:
                x, n = x * len(c) + c.index(ch), n * len(c)
        x = self.permute(x, n, f"{tweak}|{''.join('d' if c == string.digits else 'l' if c else '-' for c in sets)}", back)
        out = []
        for ch, c in zip(reversed(s), reversed(sets), strict=True):
            if c:
                x, r = divmod(x, len(c))
                ch = c[r]
            out.append(ch)
        return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The check sum of all digits; 0 if they are valid."""
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10


def iban_rest(code: str) -> int:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def into(form: str, digits: str) -> str:
    """form with its letters and digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isalnum() else c for c in form)


def _card(f: Feistel, form: str, back: bool) -> str | None:
    d = re.sub(r"\D", "", form)
    if luhn(d) or len(set(d)) == 1:
        return None
    n = len(d) - 2
    body = f"{f.permute(int(d[1:-1]), 10**n, f'card{len(d)}', back):0{n}d}"
    return into(form, d[0] + body + str(-luhn(d[0] + body + "0") % 10))


def _iban(f: Feistel, form: str, back: bool) -> str | None:
    c = form.replace(" ", "")
    if not 15 <= len(c) <= 34 or iban_rest(c) != 1:
        return None
    body = f.characters(c[4:], "iban" + c[:2], back)
    return into(form, c[:2] + f"{98 - iban_rest(c[:2] + '00' + body):02d}" + body)


def _ip(f: Feistel, form: str, back: bool) -> str | None:
    parts = [int(p) for p in form.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in form.split(".")):
        return None
    x = f.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ssn(f: Feistel, form: str, back: bool) -> str | None:
    a, g, s = (int(p) for p in form.split("-"))
    if a in (0, 666) or a > 899 or not g or not s:
        return None
    area = a - 1 - (a > 666)
    x = f.permute((area * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, "ssn", back)
    x, s = divmod(x, 9999)
    area, g = divmod(x, 99)
    a = area + 1
    return f"{a + (a >= 666):03d}-{g + 1:02d}-{s + 1:04d}"


def _phone(f: Feistel, form: str, back: bool) -> str | None:
    d = re.sub(r"\D", "", form)
    if len(d) > 15:
        return None
    plain = d[1:] if len(d) == 11 and d[0] == "1" else d if len(d) == 10 and not form.startswith("+") else None
    if plain and plain[0] in "23456789" and plain[3] in "23456789":
        x = (((int(plain[0]) - 2) * 100 + int(plain[1:3])) * 8 + int(plain[3]) - 2) * 1_000_000 + int(plain[4:])
        x = f.permute(x, 64 * 100 * 1_000_000, "nanp", back)
        x, low = divmod(x, 1_000_000)
        x, e = divmod(x, 8)
        p, q = divmod(x, 100)
        return into(form, d[: len(d) - 10] + f"{p + 2}{q:02d}{e + 2}{low:06d}")
    if not form.startswith("+"):
        return None
    keep = 1 if d[0] in ONE_DIGIT else 2 if d[:2] in TWO_DIGITS else 3
    n, x = len(d) - keep, int(d[keep:])
    while True:  # what would read as a number of the plan above goes through again
        x = f.permute(x, 10**n, "phone" + d[:keep] + str(n), back)
        digits = f"{x:0{n}d}"
        if d[0] != "1" or n != 10 or digits[0] not in "23456789" or digits[3] not in "23456789":
            return into(form, d[:keep] + digits)


@functools.cache
def _late_days() -> list[int]:
    """For each month of YEARS, the days beyond the 12th in the months before; at the end, all of them."""
    out = [0]
    for y in range(YEARS[0], YEARS[1] + 1):
        for m in range(1, 13):
            after = datetime.date(y + m // 12, m % 12 + 1, 1)
            out.append(out[-1] + (after - datetime.date(y, m, 1)).days - 12)
    return out


def other_day(f: Feistel, day: datetime.date, back: bool) -> datetime.date:
    """The pseudonym of a day; both or neither are beyond the 12th of their month."""
    month = (day.year - YEARS[0]) * 12 + day.month - 1
    late = _late_days()
    if day.day <= 12:
        month, n = divmod(f.permute(month * 12 + day.day - 1, (len(late) - 1) * 12, "date", back), 12)
    else:
        x = f.permute(late[month] + day.day - 13, late[-1], "late date", back)
        month = bisect.bisect_right(late, x) - 1
        n = x - late[month] + 12
    return datetime.date(YEARS[0] + month // 12, month % 12 + 1, n + 1)


def _date(f: Feistel, form: str, back: bool) -> str | None:
    sep = re.search(r"[./-]", form)[0]
    raw = form.split(sep)
    parts = [int(p) for p in raw]
    for y, m, d in [(0, 1, 2)] if len(raw[0]) == 4 else [(2, 1, 0), (2, 0, 1)]:
        try:
            day = datetime.date(parts[y], parts[m], parts[d])
        except ValueError:
            continue
        if not YEARS[0] <= day.year <= YEARS[1]:
            return None
        new = other_day(f, day, back)
        # two digits say nothing of padding unless the first is 0; then the other number does
        zero = lambda own, other: len(raw[own]) == 2 and (raw[own][0] == "0" or len(raw[other]) == 2)
        values = {y: f"{new.year:04d}", m: f"{new.month:02d}" if zero(m, d) else str(new.month), d: f"{new.day:02d}" if zero(d, m) else str(new.day)}
        return sep.join(values[i] for i in range(3))
    return None


def _email(f: Feistel, form: str, back: bool) -> str | None:
    local, _, domain = form.partition("@")
    return f.characters(local, "email", back) + "@" + domain


def _secret(f: Feistel, form: str, back: bool) -> str | None:
    n = len(form)
    x = f"{f.permute(int(form, 16), 16**n, f'hex{n}', back):0{n}x}"
    return x.upper() if form.upper() == form and not form.isdigit() else x


MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "card": _card, "ip": _ip, "ssn": _ssn, "phone": _phone, "date": _date}


def findings(text: str, f: Feistel, back: bool = False) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym), in order and apart from each other."""
    if not MAYBE.search(text):
        return []
    out: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))
    for kind, pattern in PATTERNS:
        if kind == "email" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            s, e = m.span()
            if any(taken[s:e]):
                continue
            new = MAKERS[kind](f, m[0], back)
            if new is not None:
                out.append((s, e, kind, new))
                taken[s:e] = b"\1" * (e - s)
    return sorted(out)


def replace(text: str, found: list[tuple[int, int, str, str]]) -> str:
    parts, at = [], 0
    for s, e, _, new in found:
        parts += [text[at:s], new]
        at = e
    return "".join([*parts, text[at:]])


ADDED = [
    T.StructField("n_pii", T.LongType()),
    T.StructField("pii", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))),
    T.StructField("clean_text", T.StringType()),
]


def pseudonymise(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with n_pii, pii (where in the text, and what) and clean_text; key: that of the session if not given."""
    key = key or docs.sparkSession.conf.get(SETTING, None) or _drawn

    def fn(batch):
        f, n, where, texts = Feistel(key), [], [], []
        for x in common.column(batch, "text"):
            text = x.as_py()
            found = findings(text, f) if text else []
            n.append(len(found))
            where.append([{"start": s, "end": e, "kind": k} for s, e, k, _ in found])
            texts.append(replace(text, found) if found else text)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        return [pa.array(n, pa.int64()), pa.array(where, kind), pa.array(texts, pa.string())]

    return common.annotate(docs, "text", ADDED, fn)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(common.documents(spark, sf_dir).select("doc_id", "text"), spark.conf.get(SETTING, QUERY_KEY))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("pii", lambda p: p["kind"]))), ",")
    return out.select("doc_id", F.col("clean_text").alias("text"), "n_pii", kinds.alias("kinds"))
