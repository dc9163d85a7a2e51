"""Operator 6: byte-level BPE with the tokenizers library over Arrow batches.

A rank file (base64 token, rank) becomes a tokenizers BPE model: bytes are written as the printable characters of the
usual byte-to-character table, a token's id is its rank, and every pair of tokens whose join is a token is a merge of that token's rank.
A text is cut into pieces by the pattern, each piece is encoded by itself, and a piece met before is looked up, so
the library sees each different piece of a worker once.  Decoding reverses the table: ids to bytes, bytes to text; a
character split over tokens comes together again because bytes are joined first.

Null texts count as empty and give no ids; an empty table gives no rows; texts of any length are handled whole; repeated rows are encoded
alike; ties don't arise (merges are ordered by rank); columns of other names are ignored.  Special tokens don't exist here: their strings are ordinary text.
"""

from __future__ import annotations

import base64
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_map, mix64, pick, text_bytes

#: Pieces remembered by a worker; beyond it the memory starts anew.  Longer pieces aren't remembered.
CACHE_PIECES, CACHE_LENGTH = 150_000, 48
#: Bytes of text that are cut and matched at once; the arrays over their characters take some 60 times as much.
TEXT_BYTES = 1 << 20


def byte_characters() -> list[str]:
    """The printable character of each byte: itself where printable, else from U+0100 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The rank file as a model of the tokenizers library."""
    from tokenizers import Tokenizer, models

    table, chars = ranks(path), byte_characters()
    shown = {t: "".join(chars[b] for b in t) for t in table}
    merges = []
    for token in sorted((t for t in table if len(t) > 1), key=table.__getitem__):
        merges += [(shown[token[:i]], shown[token[i:]]) for i in range(1, len(token)) if token[:i] in table and token[i:] in table]
    return Tokenizer(models.BPE(vocab={shown[t]: r for t, r in table.items()}, merges=merges, ignore_merges=True, fuse_unk=False))


_OTHER, _LETTER, _NUMBER, _SPACE, _END = range(5)
#: Fixed value: the pattern that `cut` follows.  Any other is left to the regex module.
CUT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """Letter, number, white space or other, for every code point, as the rank files' own library tells them apart: asked
    with a vocabulary of single bytes, it gives back what a class matches."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    table = np.full(0x110000, _OTHER, np.uint8)
    for kind, name in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        found = tiktoken.Encoding(name, pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}).encode_ordinary(every)
        table[np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)] = kind
    return table


def cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The matches of public_tokenizers.PATTERN in each text, found for all texts at once: the texts' code points (each text ends with an
    extra zero), where each piece begins and stops, and how many pieces each text has.

    Letters, numbers and other characters form runs, and a single space before a run belongs to it.  White space before a run
    keeps its last character apart; at a text's end it is one piece.  An apostrophe that begins a piece takes s, t, m, d, re, ve
    or ll with it.
    """
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    n = len(points)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    kind = kinds()[points]
    kind[ends] = _END
    begins = np.empty(n, bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins[ends] = True
    begins[ends[:-1] + 1] = True
    space = kind == _SPACE
    last = np.flatnonzero(space[:-1] & (kind[1:] < _SPACE))  # white space just before a run
    begins[last] = True
    begins[last[points[last] == 32] + 1] = False
    quote = np.flatnonzero((points == 39) & begins)
    if len(quote):
        one, two = points[np.minimum(quote + 1, n - 1)], points[np.minimum(quote + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        begins[quote[short] + 2] = True
        begins[quote[short] + 1] = False
        begins[quote[long] + 3] = True
        begins[quote[long] + 1] = False
    at = np.flatnonzero(begins)
    real = kind[at] != _END
    stop = np.append(at[1:], n)[real]
    at = at[real]
    return points, at, stop, np.diff(np.searchsorted(at, ends), prepend=0)


def cut_by(pattern: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for any pattern, by the regex module."""
    spans = [[m.span() for m in regex.finditer(pattern, t) if m.end() > m.start()] for t in texts]
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    base = np.cumsum([0, *[len(t) + 1 for t in texts]])
    flat = np.array([(b + x, b + y) for b, own in zip(base.tolist(), spans, strict=False) for x, y in own], np.int64).reshape(-1, 2)
    return points, flat[:, 0], flat[:, 1], np.array([len(x) for x in spans], np.int64)


def distinct(points: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One piece for each different string, and each piece's place among those.  Pieces are matched by a 64-bit sum over
    their characters and then compared character by character with the piece that stands for them; should two strings
    ever share a sum, every piece stands for itself."""
    length = stop - at
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    chars = points[np.repeat(at, length) + place].astype(np.uint64)
    begin = np.cumsum(length) - length
    key = np.add.reduceat(mix64(chars << np.uint64(32) | place.astype(np.uint64)), begin)
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    stands = first[inverse]
    if (length[stands] != length).any() or (points[np.repeat(at[stands], length) + place] != chars).any():
        return np.arange(len(at)), np.arange(len(at))
    return first, inverse


class Codec:
    """Encodes and decodes in one worker."""

    def __init__(self, path: str, pattern: str):
        self.cut = cut if pattern == CUT_PATTERN else partial(cut_by, pattern)
        self.model = tokenizer(path)
        self.chars = byte_characters()
        table = ranks(path)
        self.bytes_of: list[bytes] = [b""] * (max(table.values(), default=-1) + 1)
        for t, r in table.items():
            self.bytes_of[r] = t
        self.known: dict[str, bytes] = {}

    def pieces(self, new: list[str]) -> list[bytes]:
        """The ids of some pieces, as little-endian 32-bit integers."""
        shown = ["".join(map(self.chars.__getitem__, p.encode())) for p in new]
        done = self.model.encode(shown, is_pretokenized=True, add_special_tokens=False)  # each piece by itself
        raw = np.array(done.ids, dtype="<u4").tobytes()
        upto = (np.cumsum(np.bincount(np.array(done.word_ids, np.int64), minlength=len(new))) * 4).tolist()
        return [raw[x:y] for x, y in zip([0, *upto], upto, strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not any(texts):
            return [b""] * len(texts)
        points, at, stop, counts = self.cut(texts)
        if not len(at):
            return [b""] * len(texts)
        first, inverse = distinct(points, at, stop)
        whole = "\0".join([*texts, ""])
        strings = [whole[x:y] for x, y in zip(at[first].tolist(), stop[first].tolist(), strict=True)]
        known = self.known
        if len(known) > CACHE_PIECES:
            known.clear()
        new = [p for p in strings if p not in known]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            known.update(zip(part, self.pieces(part), strict=True))
        made = [known[p] for p in strings]
        for p in new:
            if len(p) > CACHE_LENGTH:
                known.pop(p, None)
        flat = np.frombuffer(b"".join(made), "<u4")
        size = np.fromiter(map(len, made), np.int64, len(made)) // 4
        tokens = size[inverse]
        source = np.repeat((np.cumsum(size) - size)[inverse], tokens) + np.arange(int(tokens.sum())) - np.repeat(np.cumsum(tokens) - tokens, tokens)
        ids = flat[source].tobytes()
        upto = np.concatenate([[0], np.cumsum(tokens)])[np.cumsum(counts)] * 4
        return [ids[x:y] for x, y in zip([0, *upto.tolist()], upto.tolist(), strict=False)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> np.ndarray:
        """Where each token begins, in bytes, and after them the whole length."""
        return np.concatenate([[0], np.cumsum([len(self.bytes_of[i]) for i in np.frombuffer(ids, "<u4").tolist()])]).astype(np.int64)


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec of a vocabulary, made once."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", offsets: bool = False, decoded: bool = False) -> DataFrame:
    """Per row: key, n_tokens, ids (little-endian unsigned 32-bit integers), with `offsets` each token's first byte, and with
    `decoded` the bytes that the ids stand for, made in the same worker (a round trip in one pass, with one codec a task)."""

    def run(batch: pa.RecordBatch) -> dict:
        c = codec(path, pattern)
        ids = c.encode([(t or b"").decode("utf-8", "replace") for t in text_bytes(batch)])
        return {"key": batch.column(0), "n_tokens": [len(x) // 4 for x in ids], "ids": ids} | ({"offsets": [c.offsets(x)[:-1] for x in ids]} if offsets else {}) | ({"decoded": [c.decode(x) for x in ids]} if decoded else {})

    rows = pick(df, key=key, text=text)
    return arrow_map(rows, run, f"key {rows.schema['key'].dataType.simpleString()}, n_tokens long, ids binary" + ", offsets array<long>" * offsets + ", decoded binary" * decoded, most=TEXT_BYTES).withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The table with another binary column: the bytes that the ids stand for.  Null ids give null."""
    from pyspark.sql import functions as F

    @F.arrow_udf("binary")
    def turn(column: pa.Array) -> pa.Array:
        c = codec(path, pattern)
        return pa.array([None if x is None else c.decode(x) for x in column.to_pylist()], pa.binary())

    return df.withColumn(into, turn(F.col(ids)))


def digests(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """Per row of `encode`: key, n_tokens, SHA-256 of the ids and of the bytes they decode to."""
    from pyspark.sql import functions as F

    made = encoded if "decoded" in encoded.columns else decode(encoded, path, pattern)
    return made.select(key, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
