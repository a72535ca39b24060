"""Secret scans by assignment-aware lexing.

Fixed patterns find the well-known shapes (assignments to secret-like names, access keys, long
hexadecimal runs). On top of them the text is lexed as source or configuration: every
``name <operator> value`` becomes a name-literal pair, whether the name is typed, a subscript, an
option or an XML element and the value bracketed, made of adjacent strings, on the next line or an
indented block; a pair called ``name`` or ``key`` names the pair called ``value`` after it. Names bound
to literals earlier in the text are propagated into later right-hand sides, string concatenations are
joined, and each literal is scored by how sensitive its target name is and how random the literal looks.

Propagated values are kept as references to what they are made of, with character counts worked out
once, and never spelled out: a value that doubles on every line costs a line's work.

Defined results: null and empty texts have no spans; repeated rows are scanned alike; spans are
half-open code point ranges, ordered by start, then by the order of ``KINDS``, then by end.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

# The base patterns and their least lengths.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "literal")
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Parts of a target name and how strongly each says that its value is a secret.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "accesskey": 1.0, "privatekey": 1.0, "secretkey": 1.0, "authkey": 0.9, "signingkey": 0.9, "encryptionkey": 0.9,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.8, "bearer": 0.8, "key": 0.4, "salt": 0.5, "session": 0.4, "cookie": 0.4,
}
#: A literal is reported when name weight times literal strength reaches this.
SCORE_LEAST = 0.5
#: Names of this weight and more may have passphrases, with white space, as their values.
PHRASE_WEIGHT = 0.9
#: Literals of this many characters and more count as long in full.
STRONG_LENGTH = 16
#: Character counts above this are scaled down together; only their shares count from there on.
MOST_COUNT = 1e12

# What makes up an assignment. Runs are possessive, so names and strings of any length cost their size.
# Types may have brackets inside brackets; what they hold ends at a colon, so no text is read over and over.
INNER = r"[^\n=:\[\]<>]*+"
NESTED = INNER
for _ in range(4):
    NESTED = rf"{INNER}(?:[\[<]{NESTED}[\]>]{INNER})*+"
TYPE = rf"[&*]?(?:'\w+\x20)?[A-Za-z_][\w.]*+(?:[\[<]{NESTED}[\]>])*+[?!]?"
PAIR = re.compile(
    r"(?<![A-Za-z0-9_.\-])(?P<flag>--)?(?P<q>[\"']?)(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)(?P=q)"
    r"(?P<subs>(?:[\x20\t]*+\[\s*+(?:\"[^\"\n]*+\"|'[^'\n]*+'|[A-Za-z0-9_.\-]*+)\s*+\])*+)[\x20\t]*+"
    rf"(?:[?!]?:[\x20\t]*+(?P<type>{TYPE}(?:[\x20\t]*+\|[\x20\t]*+{TYPE})*+)(?:[\x20\t]++=(?![=>])|=(?=[\x20\t]*+[\"'`(]))|:=|=>|=(?!=)|:(?![:/])|(?(flag)(?<=\x20)(?=[\"'A-Za-z0-9])|(?!)))"
)
# <name ...>value</name>, and what names an element beside its tag.
ELEMENT = re.compile(r"<(?P<tag>[A-Za-z_][\w.\-]*+)(?P<more>(?:\s[^<>]*+)?)(?<!/)>\s*+(?:<!\[CDATA\[(?P<data>[^\]<]*+)\]\]>\s*+|(?P<text>[^<>]++))</(?P=tag)\s*>")
LABEL = re.compile(r"""\b(?:name|key|id)\s*+=\s*+(?:"([^"<>]*+)"|'([^'<>]*+)')""")
# The head of an indented block, and one of its lines.
BLOCK, BLOCK_LINE = re.compile(r"[\x20\t]*+[|>][+\-]?[0-9]?[\x20\t\r]*+\n"), re.compile(r"([\x20\t]*+)([^\n]*+)(?:\n|\Z)")
# Schemes that stand before a credential.
SCHEME = re.compile(r"(?:Bearer|Basic|Token|bearer|basic|token)\x20++(?=[^\s\"']{8})")
SUBSCRIPT = re.compile(r"\[\s*(?:\"([^\"\n]*)\"|'([^'\n]*)'|([A-Za-z_][A-Za-z0-9_.\-]*))\s*\]")
STRING = re.compile(
    r"(?:[rRbBuUfF]{1,2}(?=[\"']))?(?:\"\"\"((?:(?!\"\"\").)*+)\"\"\"|\'\'\'((?:(?!\'\'\').)*+)\'\'\'"
    r"|\"((?:[^\"\\\n]|\\.)*+)\"|'((?:[^'\\\n]|\\.)*+)'|\"([^\"\n]*+)\"|'([^'\n]*+)'|`([^`\n]*+)`)",
    re.DOTALL,
)
BARE = re.compile(r"[A-Za-z0-9+/_.=\-$@%!#^&*~]+")
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
# White space inside a line (a backslash carries it on), and over lines.
INLINE, LINES = re.compile(r"(?:[\x20\t]|\\\r?\n)*+"), re.compile(r"(?:\s|\\\r?\n)*+")
#: What follows a key, and the end of a line.
KEY_END, LINE_END = re.compile(r"[\x20\t]*+(?:[:=]|\[)"), re.compile(r"[\x20\t\r]*+(?:\n|\Z)")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def name_weight(name: str) -> float:
    """Sensitivity of a target name, by its parts and by neighbouring parts put together."""
    parts = [p.lower() for p in CAMEL.findall(name)]
    joined = parts + [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((NAME_WEIGHTS.get(p, 0.0) for p in joined), default=0.0)


class Value:
    """What a name is bound to: literals (start, end) of the text and other values, in order."""

    __slots__ = ("terms", "quoted", "counted", "reported")

    def __init__(self, terms: list, quoted: bool):
        self.terms, self.quoted = terms, quoted
        self.counted: dict[str, float] | None = None  # characters, once asked for
        self.reported = 0.0  # best score its literals were found with

    def counts(self, text: str) -> dict[str, float]:
        """How often each character is in the value, in proportion beyond ``MOST_COUNT``."""
        todo = [self]
        while todo:
            x = todo[-1]
            below = [] if x.counted is not None else [t for t in x.terms if isinstance(t, Value) and t.counted is None]
            if below:
                todo += below
                continue
            todo.pop()
            if x.counted is None:
                total: Counter = Counter()
                for t in x.terms:
                    total.update(t.counted if isinstance(t, Value) else text[t[0] : t[1]])
                n = sum(total.values())
                x.counted = {c: k * (MOST_COUNT / n) for c, k in total.items()} if n > MOST_COUNT else total
        return self.counted

    def report(self, name: str, score: float, found: dict[tuple[int, int], tuple[str, float]]) -> None:
        """Put all literals of the value into ``found``, where this score is the best so far."""
        todo = [self]
        while todo:
            x = todo.pop()
            if x.reported >= score:
                continue
            x.reported = score
            for t in x.terms:
                if isinstance(t, Value):
                    todo.append(t)
                elif t[0] < t[1] and score > found.get(t, ("", 0.0))[1]:
                    found[t] = (name, score)


def strength(counts: dict[str, float], spaces: bool = False) -> float:
    """0 to 1: length, entropy of characters and mixture of character classes of a literal, from its character counts.

    Literals with white space count only where ``spaces`` says so.
    """
    n = sum(counts.values())
    if n < 8 or (not spaces and any(c.isspace() for c in counts)):
        return 0.0
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values() if k / n > 0)
    classes = sum(any(f(c) for c in counts) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, n / STRONG_LENGTH) * min(1.0, entropy / 3.0) * (0.4 if classes == 1 else 1.0)


def base_spans(text: str) -> list[tuple[str, int, int, str, float]]:
    """(kind, start, end, name, score) of the fixed patterns."""
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [("assign", m.start(), m.end(), m[1], 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), "", 1.0) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), "", 1.0) for m in HEX.finditer(text)]
    return found


def block(text: str, start: int, at: int) -> tuple[int, int] | None:
    """Where the indented block lies that is the value of a key at ``start``, if there is one."""
    head = BLOCK.match(text, at)
    if not head:
        return None
    line = text.rfind("\n", 0, start) + 1
    indent = start - line if not text[line:start].strip(" \t-") else -1
    first = end = at = head.end()
    while at < len(text):
        m = BLOCK_LINE.match(text, at)
        if m[2].strip():
            if indent < 0 or len(m[1]) <= indent:
                break
            if first == end:
                first = m.start(2)
            end = m.end(2)
        at = m.end()
    return (first, end) if first < end else None


def over_comments(text: str, at: int, ends: list[int]) -> int:
    """Where white space and comments from ``at`` on end. ``ends`` keeps the last line end looked up, so that a long line is read once."""
    while True:
        at = LINES.match(text, at).end()
        if not text.startswith(("#", "//"), at):
            return at
        if not ends[0] <= at <= ends[1]:
            end = text.find("\n", at)
            ends[:] = at, len(text) if end < 0 else end
        at = ends[1]


def value_terms(text: str, at: int, ends: list[int]) -> tuple[list[tuple[str, int, int, bool]], int]:
    """Terms (text, start, end, whether quoted) of the value that begins after an operator, and where it ends.

    Terms are joined by ``+`` or stand side by side as strings, in round brackets also on further
    lines. A value on the next line is a string, brackets or a word that fills the line, no key.
    """
    terms: list[tuple[str, int, int, bool]] = []
    depth, end, wanted = 0, at, True
    while True:
        i = over_comments(text, end, ends) if depth else (LINES if wanted else INLINE).match(text, end).end()
        moved = not depth and "\n" in text[end:i]
        if i >= len(text):
            break
        if wanted and text[i] == "(":
            depth, end = depth + 1, i + 1
        elif not wanted and depth and text[i] == ")":
            depth, end = depth - 1, i + 1
        elif not wanted and text[i] == "+":
            wanted, end = True, i + 1
        elif (m := STRING.match(text, i)) and (wanted or terms[-1][3]):
            if (moved and not depth or not wanted) and KEY_END.match(text, m.end()):
                break
            k = m.lastindex
            scheme = SCHEME.match(text, m.start(k), m.end(k))
            start = scheme.end() if scheme else m.start(k)
            terms.append((text[start : m.end(k)], start, m.end(k), True))
            wanted, end = False, m.end()
        elif wanted and not terms and not depth and (scheme := SCHEME.match(text, i)) and (m := BARE.match(text, scheme.end())):
            terms.append((m[0], m.start(), m.end(), False))
            wanted, end = False, m.end()
        elif wanted and (m := (NAME if terms or depth else BARE).match(text, i)):
            if moved and not depth and not terms and not (LINE_END.match(text, m.end()) and not m[0].endswith("=")):
                break
            terms.append((m[0], m.start(), m.end(), False))
            wanted, end = False, m.end()
        else:
            break
    return terms, end


def literal_spans(text: str) -> list[tuple[str, int, int, str, float]]:
    """Literals that reach a sensitive name directly, by concatenation or through constants."""
    if not any(sign in text for sign in ("=", ":", "--", "</")):
        return []
    bound: dict[str, Value] = {}
    found: dict[tuple[int, int], tuple[str, float]] = {}

    def judge(name: str, value: Value) -> None:
        weight = name_weight(name)
        score = weight and weight * strength(value.counts(text), value.quoted and weight >= PHRASE_WEIGHT)
        if score >= SCORE_LEAST:
            value.report(name, score, found)

    if "</" in text:
        for m in ELEMENT.finditer(text):
            part = "data" if m["data"] is not None else "text"
            start, end = m.span(part)
            end = start + len(text[start:end].rstrip())
            label = LABEL.search(m["more"])
            names = [m["tag"], *(x for x in (label.groups() if label else ()) if x)]
            judge(max(names, key=name_weight), Value([(start, end)], True))
    at, label, ends = 0, "", [0, -1]
    while m := PAIR.search(text, at):
        inside = block(text, m.start(), m.end()) if text[m.end() - 1] == ":" else None
        if inside:
            terms, at = [(text[inside[0] : inside[1]], *inside, True)], m.end()
        else:
            terms, at = value_terms(text, m.end(), ends)
        if not terms:
            at = m.end()
            continue
        made, quoted = [], True
        for piece, start, end, string in terms:
            if not string and piece in bound:
                made.append(bound[piece])
                quoted = quoted and bound[piece].quoted
            elif string or len(terms) == 1 or not IDENTIFIER.match(piece):
                made.append((start, end))
                quoted = quoted and string
        value = made[0] if len(made) == 1 and isinstance(made[0], Value) else Value(made, quoted)
        subscripts = SUBSCRIPT.findall(m["subs"])
        name = next((x for x in subscripts[-1] if x), m["name"]) if subscripts else m["name"]
        bound[m["name"] + m["subs"]] = value
        if m["type"] and name_weight(m["type"]) > name_weight(name):  # a label before an assignment looks like a typed name
            name = m["type"]
        if name.lower() == "value" and label:
            name = label
        label = terms[0][0] if name.lower() in ("name", "key") and len(terms) == 1 else ""
        judge(name, value)
    return [("literal", a, b, name, score) for (a, b), (name, score) in found.items()]


def spans(text: str | None) -> list[tuple[str, int, int, str, float]]:
    """All spans of a text; literals inside a base span are left to it."""
    if not text:
        return []
    base = sorted(base_spans(text), key=lambda x: x[1])
    starts, reach = [b[1] for b in base], list(accumulate((b[2] for b in base), max))
    within = lambda x: (k := bisect_right(starts, x[1])) and x[2] <= reach[k - 1]
    more = [x for x in literal_spans(text) if not within(x)]
    return sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str | None, found: list[tuple[str, int, int, str, float]], mask: str) -> str | None:
    """The text with every maximal run of overlapping spans replaced by ``mask``."""
    if not found:
        return text
    out, at = [], 0
    start, end = found[0][1], found[0][2]
    for _, a, b, *_ in found[1:]:
        if a > end:
            out += [text[at:start], mask]
            at, start, end = end, a, b
        else:
            end = max(end, b)
    return "".join([*out, text[at:start], mask, text[end:]])


SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("name", StringType()), StructField("score", DoubleType())])
SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))


def scan_secrets(docs: DataFrame, text: str = "text", redacted: str | None = None, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with ``secret_spans`` (and, if named, a column with the redacted text)."""
    from kvloom.llm.common import append

    fields = [StructField("secret_spans", ArrayType(SPAN))]
    if redacted:
        fields.append(StructField(redacted, StringType()))

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            texts = batch.column(text).to_pylist()
            found = [spans(t) for t in texts]
            keys = ("kind", "start", "end", "name", "score")
            out = {"secret_spans": pa.array([[dict(zip(keys, s, strict=True)) for s in x] for x in found], SPAN_ARROW)}
            if redacted:
                out[redacted] = pa.array([redact(t, x, mask) for t, x in zip(texts, found, strict=True)], pa.string())
            return out

        return step

    return append(docs, fields, make)


def joined(spans_of):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans_of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """One row a document: counts of the base kinds, a hash of the base spans, and all spans."""
    s = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long")
    return scan_secrets(docs.select("doc_id", "text")).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.filter(s, lambda x: x["kind"] != "literal")), 256).alias("base_sha256"),
        joined(s).alias("spans"),
    )
