"""PII: format-preserving Feistel pseudonyms.

Personal values are found by pattern, validated (Luhn, mod 97, octet and calendar ranges), and each
validated value is moved by a keyed permutation of its own format: a card becomes another card with
a right check digit, a date another date in the same notation, an address another address of the
same shape. The permutation depends on key and format alone, so equal values stay linked across
documents, and whoever holds the key can undo it (``permute`` with ``inverse``).

The permutation is a ten-round Feistel network on a square at least as large as the format's number
of values, with a keyed BLAKE2 hash as its round function; results outside the format are walked on
until they are inside.

Defined results: null stays null without spans; empty texts stay empty; repeated rows change alike;
overlapping finds are settled by the order of ``KINDS``, then by place; no value is left out.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from kvloom.llm.common import append

KINDS = ("email", "iban", "card", "phone", "ssn", "ip", "date")
ROUNDS = 10
FIRST_DAY, DAYS = datetime.date(1900, 1, 1), (datetime.date(2099, 12, 31) - datetime.date(1900, 1, 1)).days + 1

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,4})?)(?![A-Za-z0-9])", re.ASCII)
CARD = re.compile(r"(?<![\d+])(?:\d{13,19}|\d{4}(?P<s>[ -])\d{4}(?P=s)\d{4}(?P=s)\d{1,7}|\d{4}(?P<t>[ -])\d{6}(?P=t)\d{4,5})(?!\d)", re.ASCII)
PHONE = re.compile(r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,5}(?!\d)|(?<![\w+(])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\w+.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])", re.ASCII)
SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", re.ASCII)
IP = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", re.ASCII)
DATE = re.compile(r"(?<![\d/.-])(?:(?P<y>\d{4})(?P<a>[-/.])(?P<m>\d{2})(?P=a)(?P<d>\d{2})|(?P<p>\d{1,2})(?P<b>[-/.])(?P<q>\d{1,2})(?P=b)(?P<z>\d{4}))(?![\d/-])", re.ASCII)
DIGIT = re.compile(r"\d", re.ASCII)

# Names of months in the corpus' languages, January first.
MONTHS = (
    "January February March April May June July August September October November December".split(),
    "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(),
    "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
)
_NAMES = "|".join(sorted({m for names in MONTHS for m in names}, key=lambda m: (-len(m), m)))
NAMED_DATE = re.compile(rf"(?<![\w.])(?:(?P<d>\d{{1,2}})(?P<s>\.?\x20(?:de\x20)?)(?P<m>{_NAMES})(?P<t>,?\x20(?:de\x20)?)(?P<y>\d{{4}})|(?P<n>{_NAMES})(?P<u>\.?\x20)(?P<e>\d{{1,2}})(?P<v>,?\x20)(?P<z>\d{{4}}))(?!\w)")


class Permutation:
    """Keyed permutations of number ranges."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def mix(self, tweak: str, size: int, turn: int, right: int) -> int:
        width = (right.bit_length() + 7) // 8 or 1
        message = f"{tweak}|{size}|{turn}|".encode() + right.to_bytes(width, "big")
        return int.from_bytes(hashlib.blake2b(message, key=self.key, digest_size=32).digest(), "big")

    def once(self, x: int, size: int, side: int, tweak: str, inverse: bool) -> int:
        left, right = divmod(x, side)
        if inverse:
            for turn in reversed(range(ROUNDS)):
                left, right = (right - self.mix(tweak, size, turn, left)) % side, left
        else:
            for turn in range(ROUNDS):
                left, right = right, (left + self.mix(tweak, size, turn, right)) % side
        return left * side + right

    def walk(self, x: int, size: int, tweak: str, inverse: bool) -> int:
        """The network on the square, walked on until it is below ``size`` again."""
        side = math.isqrt(size - 1) + 1
        x = self.once(x, size, side, tweak, inverse)
        while x >= size:
            x = self.once(x, size, side, tweak, inverse)
        return x

    def permute(self, x: int, size: int, tweak: str, inside: Callable[[int], bool] = lambda _: True, inverse: bool = False) -> int:
        """Where ``x`` goes among the numbers below ``size`` that are ``inside`` the format.

        The network orders all numbers in one hidden circle, and each goes to the next one inside: so
        no value stays itself unless it is the only one.
        """
        while True:
            x = self.walk((self.walk(x, size, tweak, False) + (-1 if inverse else 1)) % size, size, tweak, True)
            if inside(x):
                return x


def refill(shape: str, fresh: str, kind: Callable[[str], bool] = str.isdigit) -> str:
    """``shape`` with its characters of a kind replaced by those of ``fresh`` in order."""
    it = iter(fresh)
    return "".join(next(it) if kind(c) else c for c in shape)


def luhn(digits: str) -> int:
    """Check sum of a digit string; 0 for a valid number."""
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def ascii_digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def email(p: Permutation, value: str) -> str | None:
    local, domain = value.rsplit("@", 1)
    # letters and digits of the part before the @ are moved together, each within its class
    classes = [(10, "0123456789") if c.isdigit() else (26, "abcdefghijklmnopqrstuvwxyz") for c in local if c.isalnum()]
    if not classes:
        return None
    x, size = 0, 1
    for c, (n, letters) in zip((c for c in local if c.isalnum()), classes, strict=True):
        x, size = x * n + letters.index(c.lower()), size * n
    x = p.permute(x, size, "email|" + "".join("9" if n == 10 else "a" for n, _ in classes))
    fresh = []
    for n, letters in reversed(classes):
        x, k = divmod(x, n)
        fresh.append(letters[k])
    fresh.reverse()
    moved = refill(local, "".join(fresh), str.isalnum)
    return "".join(f.upper() if c.isupper() else f for c, f in zip(local, moved, strict=True)) + "@" + domain


def iban(p: Permutation, value: str) -> str | None:
    bare = value.replace(" ", "")
    if not 15 <= len(bare) <= 34 or mod97(bare) != 1:
        return None
    digits = ascii_digits(bare[4:])
    if not digits:
        return None
    body = refill(bare[4:], str(p.permute(int(digits), 10 ** len(digits), f"iban|{bare[:2]}|{len(bare)}")).zfill(len(digits)))
    check = 98 - mod97(bare[:2] + "00" + body)
    return refill(value, f"{bare[:2]}{check:02d}{body}", str.isalnum)


def card(p: Permutation, value: str) -> str | None:
    digits = ascii_digits(value)
    if luhn(digits) or not digits.strip("0"):
        return None
    n = len(digits) - 1
    body = str(p.permute(int(digits[:-1]), 10**n, f"card|{n}")).zfill(n)
    return refill(value, body + str(-luhn(body + "0") % 10))


def phone(p: Permutation, value: str) -> str | None:
    country = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", value)
    start = country.end() if country else 0
    digits = ascii_digits(value[start:])
    if not 7 <= len(digits) <= 14:
        return None
    return value[:start] + refill(value[start:], str(p.permute(int(digits), 10 ** len(digits), f"phone|{len(digits)}")).zfill(len(digits)))


def ssn_valid(x: int) -> bool:
    area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def ssn(p: Permutation, value: str) -> str | None:
    x = int(value.replace("-", ""))
    return refill(value, f"{p.permute(x, 10**9, 'ssn', ssn_valid):09d}") if ssn_valid(x) else None


def ip(p: Permutation, value: str) -> str | None:
    parts = value.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in parts):
        return None
    x = p.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def date(p: Permutation, value: str) -> str | None:
    m = DATE.fullmatch(value)
    if m["y"]:
        orders = [(int(m["y"]), int(m["m"]), int(m["d"]))]
    else:
        orders = [(int(m["z"]), int(m["p"]), int(m["q"])), (int(m["z"]), int(m["q"]), int(m["p"]))]
        if m["b"] == ".":
            orders.reverse()
    for k, (y, month, day) in enumerate(orders):
        try:
            x = (datetime.date(y, month, day) - FIRST_DAY).days
        except ValueError:
            continue
        if not 0 <= x < DAYS:
            return None
        to = FIRST_DAY + datetime.timedelta(days=p.permute(x, DAYS, "date"))
        if m["y"]:
            return f"{to.year:04d}{m['a']}{to.month:02d}{m['a']}{to.day:02d}"
        first, second = (to.day, to.month) if (k == 1) != (m["b"] == ".") else (to.month, to.day)
        return f"{first:0{len(m['p'])}d}{m['b']}{second:0{len(m['q'])}d}{m['b']}{to.year:04d}"
    return None


def named_date(p: Permutation, value: str) -> str | None:
    m = NAMED_DATE.fullmatch(value)
    name, day, year = m["m"] or m["n"], int(m["d"] or m["e"]), int(m["y"] or m["z"])
    names = next(n for n in MONTHS if name in n)
    try:
        x = (datetime.date(year, names.index(name) + 1, day) - FIRST_DAY).days
    except ValueError:
        return None
    if not 0 <= x < DAYS:
        return None
    to = FIRST_DAY + datetime.timedelta(days=p.permute(x, DAYS, "date"))
    fresh = names[to.month - 1]
    return f"{to.day}{m['s']}{fresh}{m['t']}{to.year}" if m["d"] else f"{fresh}{m['u']}{to.day}{m['v']}{to.year}"


FINDERS = (("email", EMAIL, email), ("iban", IBAN, iban), ("card", CARD, card), ("phone", PHONE, phone), ("ssn", SSN, ssn), ("ip", IP, ip), ("date", DATE, date), ("date", NAMED_DATE, named_date))


def pseudonyms(p: Permutation, text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, pseudonym) of every validated value, by place; code points, end exclusive."""
    if not text:
        return []
    at_sign, digit = "@" in text, DIGIT.search(text) is not None
    taken: list[tuple[str, int, int, str]] = []  # by place
    for kind, pattern, make in FINDERS:
        if not (at_sign if kind == "email" else digit):
            continue
        found, at = [], 0
        for m in pattern.finditer(text):  # by place too, so one pass along both
            start, end = m.span()
            while at < len(taken) and taken[at][2] <= start:
                at += 1
            if (at == len(taken) or end <= taken[at][1]) and (fresh := make(p, m[0])) is not None:
                found.append((kind, start, end, fresh))
        if found:
            taken = sorted(taken + found, key=lambda x: x[1])
    return taken


def replace(text: str | None, found: list[tuple[str, int, int, str]]) -> str | None:
    if not found:
        return text
    out, at = [], 0
    for _, a, b, fresh in found:
        out += (text[at:a], fresh)
        at = b
    return "".join([*out, text[at:]])


SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("pseudonym", StringType())])
SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("pseudonym", pa.string())]))


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", to: str = "text", spans: str = "pii_spans") -> DataFrame:
    """``docs`` with the pseudonymised text in column ``to`` and what was found in ``spans``."""

    def make():
        p = Permutation(key)

        def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            texts = batch.column(text).to_pylist()
            found = [pseudonyms(p, t) for t in texts]
            names = ("kind", "start", "end", "pseudonym")
            return {
                to: pa.array([replace(t, x) for t, x in zip(texts, found, strict=True)], pa.string()),
                spans: pa.array([[dict(zip(names, s, strict=True)) for s in x] for x in found], SPAN_ARROW),
            }

        return step

    return append(docs, [StructField(to, StringType()), StructField(spans, ArrayType(SPAN))], make)


def digest(docs: DataFrame, key: bytes) -> DataFrame:
    """One row a document: values found by kind, and the text with pseudonyms."""
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return pseudonymise(docs.select("doc_id", "text"), key).select("doc_id", *[count(k) for k in KINDS], "text")
