"""Operator 7: benchmark decontamination by SimHash over item-sized windows.

Texts and items become words (`[0-9a-z]` and everything beyond ASCII, A-Z lower-cased).  For an item of m words every window
of m consecutive words of a document is compared with the item; a document of fewer words is one window, its whole text:

1. A window's and an item's fingerprints are 128-bit SimHashes of their weighted five-word shingles (64-bit hashes), made for all windows of a
   size at once from running sums of votes.  A vote is the square root of the shingle's weight, so that the cosine of two vectors of votes is at least
   0.88 where the similarity is 0.8, however unequal the weights are.  A window of which less than `threshold` of its own weight is in shingles that any item has at all can't
   match whatever item and gets no fingerprint (an exact bound; it asks nothing about which item).
2. Candidates are the items of the window's size whose fingerprints lie within Hamming distance RADIUS.  Fingerprints are cut into
   16 blocks of eight bits; two within RADIUS agree in some block up to RADIUS // 16 bits, so looking up each block among the
   values that near to items' blocks finds every fingerprint within the radius, none excepted.
3. Candidates are verified by exact weighted Jaccard similarity of their shingle multisets: sum of minima over sum of
   maxima, a shingle weighing ln(1 + items / items that have it) (unknown shingles as if in one item).  A pair of at least `threshold` (less 1e-9, for rounding) is a match.

At a similarity of 0.8 fingerprints differ in 19 bits of 128 on average (deviation 4), so RADIUS = 47, nearly seven deviations more, misses next to
nothing; those of unrelated windows differ in 64 (deviation 5.7).

Items of fewer than five words are one shingle, their whole sequence.  Items and texts that are null or without words match nothing;
equal items match alike, each under its own id; of windows with equal similarity (ties) the earliest is told; repeated documents match alike; empty tables
give no rows; other columns are ignored (`clean` carries them along).  Texts are searched whole: memory for fingerprints is bounded by SPAN positions at a time.
Items go to the workers in blocks of at most BLOCK_BYTES of text, one block after another, whatever the size of the item table; documents
aren't shuffled.  Weights are those of the whole item table in every block: how many items there are and how many hold each shared
shingle is counted once by Spark and goes along with each block (12 bytes a shared shingle).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_filter, arrow_map, durable, mix64, pick, text_bytes

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 47
BITS, PARTS = 128, 16
BLOCK_BYTES = 8 << 20
#: Shingle places whose votes are summed at once.
SPAN = 1 << 13
_WORD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))
#: A block's neighbours: all eight-bit masks of at most RADIUS // PARTS bits.
MASKS = [sum(1 << b for b in bits) for n in range(RADIUS // PARTS + 1) for bits in combinations(range(8), n)]
_BITS = np.arange(64, dtype=np.uint64)


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_WORD).split()


def word_codes(w: list[bytes]) -> np.ndarray:
    code = {x: xxhash.xxh3_64_intdigest(x) | 1 for x in set(w)}
    return np.fromiter(map(code.__getitem__, w), np.uint64, len(w))


def shingles(codes: np.ndarray, width: int) -> np.ndarray:
    """The hash of the `width` words from each place on."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, width, np.uint64)
    for j in range(width):
        acc = mix64(acc + codes[j : n + j])
    return acc


def votes(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Each shingle's vote on each bit; in whole 4096ths, so that running sums are exact."""
    w = np.rint(np.sqrt(weight) * 4096).astype(np.int64)[:, None]
    return np.concatenate([np.where(x[:, None] >> _BITS & np.uint64(1), w, -w) for x in (h, mix64(h + np.uint64(1)))], axis=1)


def signs(sums: np.ndarray) -> np.ndarray:
    """SimHashes, as 16 bytes each; a tie counts as 1."""
    return np.packbits(sums >= 0, axis=1)


class Blocks:
    """Multi-index of fingerprints: for each block, the items near each of its 256 values, by the items' group."""

    def __init__(self, prints: np.ndarray, group: np.ndarray):
        self.prints, self.lists = prints.reshape(-1, PARTS), []
        for b in range(PARTS):
            own = self.prints[:, b]
            value = np.concatenate([group * 256 + (own ^ np.uint8(m)) for m in MASKS])
            item = np.tile(np.arange(len(own), dtype=np.int32), len(MASKS))
            order = np.argsort(value, kind="stable")
            self.lists.append((np.searchsorted(value[order], np.arange(256 * (int(group.max(initial=0)) + 1) + 1)), item[order]))

    def near(self, prints: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every (fingerprint, item) of one group within RADIUS, by place."""
        pairs = []
        for b, (starts, item) in enumerate(self.lists):
            v = group * 256 + prints[:, b]
            n = starts[v + 1] - starts[v]
            own = item[np.repeat(starts[v] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            pairs.append(np.repeat(np.arange(len(prints)) * len(self.prints), n) + own)
        pair = np.concatenate(pairs)
        q, k = pair // len(self.prints), pair % len(self.prints)
        ok = np.bitwise_count(prints[q] ^ self.prints[k]).sum(axis=1, dtype=np.int64) <= RADIUS
        pair = np.unique(pair[ok])
        return pair // len(self.prints), pair % len(self.prints)


class Index:
    """One block of items.  `counted`: the whole table's number of items, shared shingles (sorted) and how many items hold each."""

    def __init__(self, items: list[tuple], shingle: int = SHINGLE, threshold: float = THRESHOLD, counted: tuple[int, np.ndarray, np.ndarray] | None = None):
        self.threshold, self.shingle = threshold, shingle
        self.items = [(i, w) for i, t in items if (w := words((t or "").encode()))]
        self.vocabulary: dict[bytes, int] = {x: xxhash.xxh3_64_intdigest(x) | 1 for _, w in self.items for x in w}
        grams = [shingles(word_codes(w), self.width(len(w))) for _, w in self.items]
        if counted is None:
            known, held = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, grams)]), return_counts=True)
            counted = len(self.items), known[held > 1], held[held > 1]
        n, self.shared, held = counted
        self.unknown = math.log(1 + max(1, n))
        self.shared_weight = np.log(1 + max(1, n) / held)  # a shingle that only one item holds weighs as an unknown one
        self.grams = [np.unique(g, return_counts=True) for g in grams]
        self.total = [float((c * self.weigh(g)).sum()) for g, c in self.grams]
        prints = [signs(votes(g, self.weigh(g)).sum(axis=0)[None, :])[0] for g in grams]
        self.sizes = sorted({len(w) for _, w in self.items})
        self.blocks = Blocks(np.array(prints, np.uint8), np.searchsorted(self.sizes, [len(w) for _, w in self.items]))
        self.known = {m: np.unique(np.concatenate([g for g, (_, w) in zip(grams, self.items, strict=True) if self.width(len(w)) == m])) for m in {self.width(len(w)) for _, w in self.items}}

    def width(self, n: int) -> int:
        return min(self.shingle, n)

    def weigh(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.unknown)
        if len(self.shared):
            at = np.searchsorted(self.shared, h).clip(0, len(self.shared) - 1)
            hit = self.shared[at] == h
            out[hit] = self.shared_weight[at[hit]]
        return out

    def similarity(self, window: np.ndarray, k: int) -> float:
        """Exact weighted Jaccard similarity of a window's shingles and an item."""
        h, c = np.unique(window, return_counts=True)
        g, d = self.grams[k]
        _, x, y = np.intersect1d(h, g, assume_unique=True, return_indices=True)
        w = self.weigh(h)
        both = float((np.minimum(c[x], d[y]) * w[x]).sum())
        total = float((c * w).sum()) + self.total[k] - both
        return both / total if total else 0.0

    def search(self, raw: bytes) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window of each item that matches; the earliest of equals."""
        w = words(raw)
        n = len(w)
        ids = np.fromiter(map(self.vocabulary.get, w, repeat(0)), np.uint64, n)
        found: dict[int, tuple] = {}
        for m in sorted(self.known):
            if n < m:
                continue
            whole = np.convolve(ids == 0, np.ones(m, np.int64), "valid") == 0  # shingles of items' words only
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            h = np.zeros(n - m + 1, np.uint64)
            h[at] = shingles(ids, m)[at]
            place = np.searchsorted(self.known[m], h[at]).clip(0, len(self.known[m]) - 1)
            at = at[self.known[m][place] == h[at]]
            if len(at):
                self._windows(w, m, at, found)
        return [(k, *v) for k, v in sorted(found.items())]

    def _windows(self, w: list[bytes], m: int, at: np.ndarray, found: dict[int, tuple]) -> None:
        """Match the windows around the known shingles (of m words, at the places `at`)."""
        n, h = len(w), shingles(word_codes(w), m)
        weight = self.weigh(h)
        known = np.zeros(len(h))
        known[at] = weight[at]
        total, held = (np.concatenate([[0.0], np.cumsum(x)]) for x in (weight, known))
        tried: list[tuple[np.ndarray, int, int]] = []  # window starts, shingles of a window, group of items
        for group, size in enumerate(self.sizes):
            if self.width(size) == m:
                span = min(size, n)
                count = span - m + 1
                p = np.arange(max(0, at[0] + m - span), min(at[-1], n - span) + 1)
                good = p[held[p + count] - held[p] >= self.threshold * (total[p + count] - total[p]) - 1e-9]
                if len(good):
                    tried.append((good, count, group))
        if not tried:
            return
        for lo in range(min(int(p[0]) for p, _, _ in tried), max(int(p[-1]) for p, _, _ in tried) + 1, SPAN):
            part = [(p[(p >= lo) & (p < lo + SPAN)], count, group) for p, count, group in tried]
            begin = np.concatenate([p for p, _, _ in part])
            if not len(begin):
                continue
            count, group = (np.repeat([x[k] for x in part], [len(x[0]) for x in part]) for k in (1, 2))
            lo, hi = int(begin.min()), int((begin + count).max())
            sums = np.concatenate([np.zeros((1, BITS), np.int64), np.cumsum(votes(h[lo:hi], weight[lo:hi]), axis=0)])
            prints = signs(sums[begin - lo + count] - sums[begin - lo])
            for q, k in zip(*(x.tolist() for x in self.blocks.near(prints, group)), strict=True):
                p, c = int(begin[q]), int(count[q])
                s = self.similarity(h[p : p + c], k)
                if s >= self.threshold - 1e-9 and (s, -p) > found.get(k, (0.0,))[:1] + (-found.get(k, (0.0, 0))[1],):
                    found[k] = (s, p, c + m - 1)


def _blocks(items: DataFrame) -> list[DataFrame]:
    """The item table in parts of about BLOCK_BYTES, by a hash of id and text."""
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = int(size // BLOCK_BYTES) + 1
    return [items] if n == 1 else [items.where(F.pmod(F.xxhash64(*items.columns), F.lit(n)) == k) for k in range(n)]


def _counted(items: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Items with words, and the shingles that several of them have with how many do."""

    def run(batch: pa.RecordBatch) -> dict:
        grams = [np.unique(shingles(word_codes(w), min(SHINGLE, len(w)))).view(np.int64) for t in text_bytes(batch) if (w := words(t or b""))]
        return {"gram": np.concatenate([np.zeros(0, np.int64), *grams])}

    n = arrow_map(items, lambda b: {"n": [sum(1 for t in text_bytes(b) if words(t or b""))]}, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0
    held = arrow_map(items, run, "gram long").groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").toPandas()
    gram = held["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(gram)
    return n, gram[order], held["n"].to_numpy(np.int64)[order]


def _indexes(items: DataFrame, threshold: float) -> Iterator[tuple[Index, bool]]:
    """An index of each block, all with the weights of the whole table, and whether it is the only one."""
    parts = _blocks(items)
    counted = _counted(items) if len(parts) > 1 else None
    for part in parts:
        yield Index([tuple(r) for r in part.collect()], threshold=threshold, counted=counted), len(parts) == 1


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and item that match: key, item_id, similarity, first_word, n_words of the best window."""
    rows = pick(docs, key=key, text=text)
    wanted = pick(items, item=item, text=item_text).where(F.col("text").isNotNull())
    kind, item_kind = rows.schema["key"].dataType.simpleString(), wanted.schema["item"].dataType.simpleString()
    out = None
    for block, alone in _indexes(wanted, threshold):
        index = docs.sparkSession.sparkContext.broadcast(block)  # of BLOCK_BYTES of text, about

        def run(batch: pa.RecordBatch, index=index) -> dict:
            own = index.value
            cols: dict = {c: [] for c in ("key", "item_id", "similarity", "first_word", "n_words")}
            for key_, t in zip(batch.column(0).to_pylist(), text_bytes(batch), strict=True):
                for k, s, p, size in own.search(t) if t else ():
                    for c, v in zip(cols, (key_, own.items[k][0], s, p, size), strict=True):
                        cols[c].append(v)
            return cols

        made = arrow_map(rows, run, f"key {kind}, item_id {item_kind}, similarity double, first_word long, n_words long")
        if not alone:  # one block after another: this one's broadcast can go
            made = durable(made, "matches")
            index.unpersist()
        out = made if out is None else out.unionByName(made)
    return out.withColumnRenamed("key", key)


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that match no item, with all their columns.  Rows are judged one by one, so null or repeated keys don't matter."""
    wanted = pick(items, item=item, text=item_text).where(F.col("text").isNotNull())
    out = docs
    for block, alone in _indexes(wanted, threshold):
        index = docs.sparkSession.sparkContext.broadcast(block)
        out = arrow_filter(out, lambda batch, index=index: [not (t and index.value.search(t)) for t in text_bytes(batch, text)], text)
        if not alone:
            out = durable(out, "clean")
            index.unpersist()
    return out
