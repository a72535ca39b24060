"""BPE encoding and decoding with content-defined chunk reuse.

A text's bytes are cut where a rolling hash of the last eight bytes hits a mask, so that equal
passages of different documents give equal chunks wherever they stand. A chunk is encoded once by a
worker and kept in a bounded store. A chunk's first and last word may be cut through, so its kept
encoding covers the words that lie between white space inside it; at every join of chunks, the
two ragged ends are put together and encoded again, over as many chunks as it takes until a
white space on either side makes the ids agree with those of the whole text. White space is
where the vocabulary's own splitting rules always break, and nothing composes across it, so
agreement there is exact.

That holds for files that compose characters (NFC), turn white space into spaces, lower-case, and
split at white space; the file's own rules are read, and with any other rules every text is
encoded whole. Words of ASCII alone are kept in small letters; others as they are, since composing
comes before lower-casing and capitals compose otherwise than small letters.

Defined results: null counts as empty; an empty text has no ids and decodes to the empty string;
texts that hold a special token's string are encoded whole; repeated rows give repeated results.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField

from kvloom.llm.common import append

#: Bytes of the rolling hash's window, and its mask: chunks of 512 bytes on the mean.
ROLL, MASK = 8, 511
#: Most chunks and most words kept by a worker; a full store is cut back to what is in use.
CHUNKS_KEPT, WORDS_KEPT = 20_000, 500_000
#: Words and chunks of more bytes are forgotten after the batch, so that a full store has a size.
LONG = 8192
#: Words put together in one call of the tokenizers library.
LINE = 200
SPACE = b" \t\n\x0b\x0c\r"
FACTORS = np.array([pow(0x9E3779B1, i + 1, 1 << 32) for i in range(ROLL)], np.uint32)
# The rules of a file whose texts may be cut at white space.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def cuts_at_space(path: str) -> bool:
    """Whether a tokenizer file's rules let a text be encoded word by word."""
    with open(path, encoding="utf-8") as file:
        parsed = json.load(file)
    normalizer, before = parsed.get("normalizer") or {}, parsed.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers") or [{}]
    return (
        normalizer.get("normalizers") == NORMALIZERS
        and steps[0].get("type") == "Split" and steps[0].get("pattern") == {"Regex": SPLIT} and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
        and all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex") for x in steps[1:])
        and not parsed.get("post_processor") and not parsed["model"].get("dropout")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or set(t["content"].encode()) & set(SPACE) for t in parsed.get("added_tokens", []))
    )


def word_form(word: bytes) -> bytes:
    """What a word is kept under: words with equal forms have equal ids."""
    return word.lower() if word.isascii() else word


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of ``data``; a chunk never ends inside a character."""
    b = np.frombuffer(data, np.uint8)
    if len(b) <= ROLL:
        return [len(b)] if len(b) else []
    h = np.zeros(len(b) - ROLL, np.uint32)
    wide = b.astype(np.uint32)
    for i in range(ROLL):
        h += wide[i : i + len(h)] * FACTORS[i]
    h ^= h >> np.uint32(15)
    cut = np.flatnonzero(((h & np.uint32(MASK)) == 0) & ((b[ROLL:] & 0xC0) != 0x80)) + ROLL
    return [*cut.tolist(), len(b)]


class ChunkedBpe:
    """Encoder and decoder of one tokenizer file; keeps what chunks and words gave, as bytes of 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_word = cuts_at_space(path)
        self.plain = self.tokenizer.decoder is None  # then decoding joins the tokens with spaces
        self.vocabulary = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.words: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, tuple[bytes, bytes | None, bytes]] = {}
        self.encoded_chunks = self.seen_chunks = 0

    def learn(self, needed: set[bytes]) -> None:
        """Encode the words that are not kept yet, many to a line; offsets tell them apart again."""
        if len(self.words) > WORDS_KEPT:
            self.words = {w: self.words[w] for w in needed if w in self.words}
        missing = [w for w in needed if w not in self.words]
        for at in range(0, len(missing), LINE):
            line = missing[at : at + LINE]
            texts = [w.decode("utf-8") for w in line]  # a word holds whole characters, since chunks do
            encoded = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            ids = np.array(encoded.ids, "<i4")
            starts = np.fromiter((o[0] for o in encoded.offsets), np.int64, len(ids))
            ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])) * 4
            data, begin = ids.tobytes(), 0
            for w, end in zip(line, ends.tolist(), strict=True):
                self.words[w] = data[begin:end]
                begin = end

    @staticmethod
    def ragged(data: bytes, words: list[bytes]) -> tuple[bytes, list[bytes] | None, bytes]:
        """Head before the first white space, words between the first and the last, tail after the last; without any, (data, None, b"")."""
        head = b"" if data[:1] in SPACE_SET else words[0]
        if head == data:
            return data, None, b""
        tail = b"" if data[-1:] in SPACE_SET else words[-1]
        return head, words[bool(head) : len(words) - bool(tail)], tail

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, four bytes each."""
        if len(self.chunks) > CHUNKS_KEPT:
            self.chunks = {}
        new: dict[bytes, tuple[bytes, list[bytes] | None, bytes]] = {}
        parts: list[list[bytes] | str] = []
        for text in texts:
            data = text.encode("utf-8")
            low = data.lower()
            # special strings must not arise from small letters
            if not self.by_word or any(s in text or s.encode("utf-8") in low for s in self.special):
                parts.append(text)
                continue
            at, own = 0, []
            for end in chunk_ends(data):
                chunk = data[at:end]
                at = end
                own.append(chunk)
                if chunk not in self.chunks and chunk not in new:
                    new[chunk] = self.ragged(chunk, chunk.split())
            self.seen_chunks += len(own)
            parts.append(own)
        self.encoded_chunks += len(new)
        # the joins: ends of neighbouring chunks put together, over chunks without white space too
        joins: list[list[bytes]] = []
        for own in parts:
            found, rest = [], b""
            for chunk in own if isinstance(own, list) else ():
                head, inner, tail = self.chunks.get(chunk) or new[chunk]
                rest += head
                if inner is not None:
                    found.append(word_form(rest))
                    rest = tail
            joins.append([*found, word_form(rest)])
        new = {c: (head, None if inner is None else [word_form(w) for w in inner], tail) for c, (head, inner, tail) in new.items()}
        needed = {w for _, inner, _ in new.values() if inner for w in inner} | {w for found in joins for w in found if w}
        self.learn(needed)
        known = self.words
        for chunk, (head, inner, tail) in new.items():
            self.chunks[chunk] = (head, None if inner is None else b"".join([known[w] for w in inner]), tail)
        out = []
        for own, found in zip(parts, joins, strict=True):
            if isinstance(own, str):
                out.append(np.array(self.tokenizer.encode(own, add_special_tokens=False).ids, "<i4").tobytes())
                continue
            pieces, k = [], 0
            for chunk in own:
                inner = self.chunks[chunk][1]
                if inner is not None:
                    pieces += (known[found[k]] if found[k] else b"", inner)
                    k += 1
            out.append(b"".join([*pieces, known[found[k]] if found[k] else b""]))
        for store, used in ((self.chunks, new), (self.words, needed)):
            for x in used:
                if len(x) > LONG:
                    store.pop(x, None)
        return out

    def decode(self, ids: list[int]) -> str:
        if not self.plain:
            return self.tokenizer.decode(ids, skip_special_tokens=False)
        return " ".join(map(self.vocabulary.__getitem__, ids))


#: Encoders of this worker by file, so that later tasks find what earlier ones encoded.
KEPT: dict[str, ChunkedBpe] = {}
SPACE_SET = {SPACE[i : i + 1] for i in range(len(SPACE))}


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """``docs`` with the ids of each text and, if named, what decoding them gives."""
    fields = [StructField(ids, ArrayType(IntegerType()))] + ([StructField(decoded, StringType())] if decoded else [])

    def make():
        bpe = KEPT.get(tokenizer_path) or KEPT.setdefault(tokenizer_path, ChunkedBpe(tokenizer_path))

        def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            flat = bpe.encode([t or "" for t in batch.column(text).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in flat])]).astype(np.int32)
            out = {ids: pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(flat), "<i4")))}
            if decoded:
                out[decoded] = pa.array([bpe.decode(np.frombuffer(x, "<i4").tolist()) for x in flat], pa.string())
            return out

        return step

    return append(docs, fields, make)


def digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row a document: number of ids, and hashes of the ids and of the decoded text."""
    return encode(docs.select("doc_id", "text"), tokenizer_path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
