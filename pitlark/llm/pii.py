"""Personal data: validated values become format-preserving pseudonyms.

A value's digits and letters, read as one number in the mixed radix of its format, go through a keyed Feistel
permutation of exactly that domain (cycle walking); a long value is cut into blocks that are chained in both directions,
so every character depends on all others at linear cost. Equal values get equal pseudonyms in every document, different
values different ones; separators, letter case, and check digits keep their form, so results validate again and the
holder of the key can restore them.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
import warnings
from bisect import bisect_left
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The session's setting that holds the secret key, and the public key of tests that stands in where it is unset.
KEY_SETTING = "spark.pitlark.pii.key"
KEY = b"pitlark: set a secret key of your own"
ROUNDS = 8
#: Characters of one block of a long value; a value has blocks of this size to twice this size.
BLOCK = 128


def session_key(spark: SparkSession) -> bytes:
    """The key in the session's settings. Where it is unset, the public one of the tests if the master is local; a cluster gets an
    error, as anyone can undo what was done with a public key."""
    given = spark.conf.get(KEY_SETTING, None)
    if not given and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {KEY_SETTING} to a key of your own")
    return given.encode() if given else KEY


_DRAWN: dict[str, bytes] = {}


def query_key(spark: SparkSession) -> bytes:
    """session_key(), or on a cluster without one a key drawn at random for this application: equal values still get equal
    pseudonyms, nobody can undo them, and another run gives others. A key of one's own is what restores values and links runs."""
    context = spark.sparkContext
    if context.master.startswith("local") or spark.conf.get(KEY_SETTING, None):
        return session_key(spark)
    if context.applicationId not in _DRAWN:
        warnings.warn(f"{KEY_SETTING} is unset: pseudonyms of this application cannot be restored", stacklevel=2)
        _DRAWN[context.applicationId] = secrets.token_bytes(32)
    return _DRAWN[context.applicationId]


@lru_cache(maxsize=200_000)
def permute(x: int, size: int, key: bytes, kind: bytes, back: bool = False) -> int:
    """A keyed permutation of 0..size-1, or its inverse: a balanced Feistel network over the next even number of bits,
    walked until it lands inside."""
    if size < 2:
        return x
    half = max(1, -(-(size - 1).bit_length() // 2))
    mask, width = (1 << half) - 1, -(-half // 8)
    head = hashlib.sha256(kind).digest() + size.to_bytes(-(-size.bit_length() // 8), "big")

    def mix(value: int, r: int) -> int:
        f = hmac.digest(key, head + bytes([r]) + value.to_bytes(width, "big"), "sha256")
        more = f if width <= len(f) else hashlib.shake_256(f).digest(width)
        return int.from_bytes(more[:width], "big") & mask

    while True:
        left, right = x >> half, x & mask
        for r in range(ROUNDS):
            if back:
                left, right = right ^ mix(left, ROUNDS - 1 - r), left
            else:
                left, right = right, left ^ mix(right, r)
        x = left << half | right
        if x < size:
            return x


#: The alphabets that a character stays in.
_PLAIN = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = ("0123456789abcdef", "0123456789ABCDEF")


class Cipher:
    """Pseudonyms under a key; `back` restores the values instead."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = key, back

    def number(self, x: int, size: int, kind: str, ok: Callable[[int], bool] = lambda x: True) -> int:
        """x permuted among the numbers below size that are `ok` (x is one of them)."""
        while True:
            x = permute(x, size, self.key, kind.encode(), self.back)
            if ok(x):
                return x

    def characters(self, text: str, kind: str, alphabets: tuple[str, ...] = _PLAIN) -> str:
        """Each character stays in its alphabet; those of none stay as they are."""
        of = {c: a for a in reversed(alphabets) for c in a}
        spots = [(i, of[c]) for i, c in enumerate(text) if c in of]
        values = [a.index(text[i]) for i, a in spots]
        tag = hashlib.sha256(f"{kind}:{''.join(a[-1] for _, a in spots)}".encode()).digest()
        blocks = max(1, len(spots) // BLOCK)
        ranges = [(len(spots) * k // blocks, len(spots) * (k + 1) // blocks) for k in range(blocks)]
        rounds = [(0, ranges)] if blocks == 1 else [(0, ranges), (1, ranges[::-1])]
        for turn, order in reversed(rounds) if self.back else rounds:
            chain = tag + bytes([turn])
            for lo, hi in order:
                x, size = 0, 1
                for k in range(lo, hi):
                    n = len(spots[k][1])
                    x, size = x * n + values[k], size * n
                new = permute(x, size, self.key, chain, self.back)
                # what was written goes on into the next block; in both directions of the cipher that is the same number
                chain = hashlib.sha256(chain + (x if self.back else new).to_bytes(-(-size.bit_length() // 8), "big")).digest()
                for k in range(hi - 1, lo - 1, -1):
                    new, values[k] = divmod(new, len(spots[k][1]))
        out = list(text)
        for (i, a), v in zip(spots, values):
            out[i] = a[v]
        return "".join(out)

    def caseless(self, text: str, kind: str) -> str:
        """The same pseudonym for any case, in the case of the value."""
        low = text.lower() if text.isascii() else text
        return "".join(n.upper() if c.isascii() and c.isupper() else n for n, c in zip(self.characters(low, kind), text))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _refilled(text: str, pattern: str, found: str) -> str:
    it = iter(found)
    return re.sub(pattern, lambda _: next(it), text)


def _card(m: re.Match, cipher: Cipher) -> str | None:
    text = m.group()
    digits = re.sub(r"[^0-9]", "", text)
    if not 13 <= len(digits) <= 19 or not luhn(digits) or len(set(digits)) == 1:
        return None
    n = len(digits) - 1

    def whole(x: int) -> str:
        body = f"{x:0{n}d}"
        return body + next(c for c in "0123456789" if luhn(body + c))

    return _refilled(text, "[0-9]", whole(cipher.number(int(digits[:-1]), 10**n, "card", lambda x: len(set(whole(x))) > 1)))


def _iban(m: re.Match, cipher: Cipher) -> str | None:
    text = m.group()
    plain = text.replace(" ", "")
    check = lambda body: f"{98 - int(''.join(str(int(c, 36)) for c in body + plain[:2] + '00')) % 97:02d}"
    if not 15 <= len(plain) <= 34 or plain[2:4] != check(plain[4:]):
        return None
    body = cipher.characters(plain[4:], "iban")
    return _refilled(text, r"\S", plain[:2] + check(body) + body)


def _ipv4(m: re.Match, cipher: Cipher) -> str | None:
    parts = m.group().split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = cipher.number(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ipv4")
    return ".".join(map(str, x.to_bytes(4, "big")))


#: Country calling codes of one and of two digits; all others have three.
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def _phone(m: re.Match, cipher: Cipher) -> str | None:
    """The country code stays; the national number is permuted whatever its separators, with or without the code."""
    text = m.group()
    digits = re.sub(r"[^0-9]", "", text)
    if not 7 <= len(digits) <= 15:
        return None
    code = next((c for c in CALLING_CODES if digits.startswith(c)), digits[:3]) if text[0] == "+" else ""
    return _refilled(text, "[0-9]", code + cipher.characters(digits[len(code) :], "phone"))


def _ssn(m: re.Match, cipher: Cipher) -> str | None:
    area, group, serial = map(int, m.group().split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    # the 898 valid areas, numbered without a gap
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(cipher.number(x, 898 * 99 * 9999, "ssn"), 9999)
    area, group = divmod(x, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


_FIRST, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days
#: English month names.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def _shape(d: date) -> tuple:
    """What a date's text shows of it: digits of month and day, whether day and month can be told apart, and whether the
    month's name is its own abbreviation. Dates are permuted among those of one shape, whatever their format."""
    return d.month > 9, d.day > 9, d.day > 12, d.month == 5


@cache
def _days() -> dict[tuple, list[int]]:
    out: dict[tuple, list[int]] = {}
    for k in range(_DAYS):
        out.setdefault(_shape(_FIRST + timedelta(k)), []).append(k)
    return out


def _date(order: str) -> Callable:
    def change(m: re.Match, cipher: Cipher) -> str | None:
        g = m.groupdict()
        named = not g["m"].isdigit()
        month = next(i + 1 for i, n in enumerate(MONTHS) if n.lower().startswith(g["m"].lower())) if named else int(g["m"])
        year, day = int(g["y"]), int(g["d"])
        swap = order == "?" and month > 12 >= day
        if swap:
            month, day = day, month
        try:
            old = date(year, month, day)
        except ValueError:
            return None
        if not 1900 <= year < 2100:
            return None
        alike = _days()[_shape(old)]
        at = bisect_left(alike, (old - _FIRST).days)
        new = _FIRST + timedelta(alike[cipher.number(at, len(alike), f"date{_shape(old)}")])
        fields = {"y": f"{new.year:04d}", "m": str(new.month), "d": str(new.day)}
        if named:
            name = MONTHS[new.month - 1] if len(g["m"]) > 3 else MONTHS[new.month - 1][:3]
            fields["m"] = name.upper() if g["m"].isupper() else name.lower() if g["m"].islower() else name
        if swap:
            fields["m"], fields["d"] = fields["d"], fields["m"]
        out, place = "", m.start()
        for name in sorted("ymd", key=m.start):
            out += m.string[place : m.start(name)] + (fields[name] if name == "m" and named else fields[name].zfill(len(g[name])))
            place = m.end(name)
        return out + m.string[place : m.end()]

    return change


def _email(m: re.Match, cipher: Cipher) -> str:
    """The name depends on its host, the host (all but the last label) on itself; case plays no part in either."""
    local, _, host = m.group().partition("@")
    labels, _, top = host.rpartition(".")
    labels_ = cipher.caseless(labels, "host:" + top.lower())
    true = (labels_ if cipher.back else labels) + "." + top
    return cipher.caseless(local, "email:" + true.lower()) + "@" + labels_ + "." + top


def _hexadecimal(value: str) -> bool:
    return len(value) >= 16 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) is not None and not value.isdigit() and not value.isalpha()


def _secret(m: re.Match, cipher: Cipher) -> str:
    name = next(n for n in "vwx" if m.group(n) is not None)
    value = m.group(name)
    kind = _hexadecimal(value)
    alphabets = (_HEX[value.isupper()],) if kind else _PLAIN
    new = cipher.characters(value, "secret", alphabets)
    while _hexadecimal(new) != kind:
        new = cipher.characters(new, "secret", alphabets)
    return m.group()[: m.start(name) - m.start()] + new + m.group()[m.end(name) - m.start() :]


#: Kind, pattern, and what makes the pseudonym (None: the match is no valid value and stays). Earlier kinds win a place.
_NAMES = "|".join(f"{n[:3]}(?:{n[3:]})?" if len(n) > 3 else n for n in MONTHS)
KINDS: list[tuple[str, re.Pattern, Callable]] = [
    ("secret", re.compile(r"\bAKIA(?P<v>[0-9A-Z]{16})\b|(?i:\b(?:pass(?:word|wd)?|pwd|secret|token|api[_-]?key)\b\"?\s*[=:]\s*[\"']?)(?P<w>[^\s\"']{6,})|\b(?:ghp|gho|sk|pk|xox[abp])[_-](?P<x>[0-9A-Za-z_-]{16,})"), _secret),
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}"), _email),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,4})?\b"), _iban),
    ("card", re.compile(r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d]|\.\d)"), _card),
    ("date", re.compile(r"(?<!\d)(?P<y>\d{4})(?P<s>[-/.])(?P<m>\d{2})(?P=s)(?P<d>\d{2})(?!\d)"), _date("ymd")),
    ("date", re.compile(r"(?<!\d)(?P<m>\d{1,2})(?P<s>[-/.])(?P<d>\d{1,2})(?P=s)(?P<y>\d{4})(?!\d)"), _date("?")),
    ("date", re.compile(rf"\b(?P<m>(?ai:{_NAMES}))\.? (?P<d>\d{{1,2}}),? (?P<y>\d{{4}})\b"), _date("mdy")),
    ("date", re.compile(rf"\b(?P<d>\d{{1,2}}) (?P<m>(?ai:{_NAMES}))\.?,? (?P<y>\d{{4}})\b"), _date("dmy")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), _ssn),
    ("ipv4", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"), _ipv4),
    ("phone", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"), _phone),
]
_HINT = re.compile(r"[@\d]|AKIA|ghp|gho|sk[_-]|pk[_-]|xox|(?i:pass|pwd|secret|token|api.?key)")
#: What a match of some kind needs somewhere; cheap to look for.
_NEEDS = {"secret": re.compile(r"AKIA|ghp|gho|sk[_-]|pk[_-]|xox|(?i:pass|pwd|secret|token|api[_-]?key)"), "email": re.compile("@"), "date": re.compile(r"\d{4}")}


def find(text: str, cipher: Cipher) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the personal values of a text, in order, without overlap; linear in the text."""
    if not _HINT.search(text):
        return []
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))
    for kind, pattern, change in KINDS:
        if kind in _NEEDS and not _NEEDS[kind].search(text):
            continue
        for m in pattern.finditer(text):
            if taken.find(1, m.start(), m.end()) < 0 and (new := change(m, cipher)) is not None:
                found.append((m.start(), m.end(), kind, new))
                taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    return sorted(found)


def rewrite(text: str | None, key: bytes = KEY, back: bool = False) -> tuple[str | None, list[tuple[int, int, str, str]]]:
    """The text with pseudonyms (with `back`: with the values they stand for), and the places in the old text."""
    found = find(text, Cipher(key, back)) if text else []
    if not found:
        return text, found
    out, at = [], 0
    for s, e, _, new in found:
        out += [text[at:s], new]
        at = e
    return "".join(out) + text[at:], found


SPANS = "array<struct<start:int,end:int,kind:string,pseudonym:string>>"


def pseudonymize(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, text with pseudonyms, spans (places in the old text, kind, pseudonym).

    One row per row, whole texts, no shuffle. Null text stays null and has no spans; texts without values stay as they
    are; repeated rows are treated alike; a null doc_id stays null; an empty table gives no rows. Values and texts of any
    length take linear time. `key` is a secret of the caller's (queries read it from KEY_SETTING).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("pseudonym", pa.string())]))
        for batch in batches:
            texts, spans = [], []
            for t in batch.column(1).to_pylist():
                new, found = rewrite(t, key)
                texts.append(new)
                spans.append([dict(zip(("start", "end", "kind", "pseudonym"), f)) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, kind)], ["doc_id", "text", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, text string, spans {SPANS}")


def pseudonymized_documents(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """docs with its own columns, text and n_chars (where there is one) after pseudonymization; nothing is joined."""
    schema = docs.withColumn("text", F.col("text").cast("string")).schema
    place, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([rewrite(t, key)[0] for t in batch.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == place else c for i, c in enumerate(batch.columns)], names)

    out = docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)
    return out.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), query_key(spark))
    return found.select("doc_id", "text", F.size("spans").alias("n_values"), "spans")
