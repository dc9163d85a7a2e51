"""Operator 5: removal of long repeated strings by longest-previous-factor (LPF) arrays over partitioned suffixes.

A window is a string of `least` bytes.  A byte is removed if a window that covers it also starts elsewhere (every copy goes), or, with `keep_first`,
if it also starts earlier, in the order of key, text hash and place (the first copy stays).  Windows never cross documents.

1. Partition.  A window's anchor is its k-gram (k = least // 4) of least hash, leftmost of equals; equal windows have equal anchors at
   equal offsets, so only suffixes of windows with the same anchor need comparing.  Consecutive windows with one anchor form a region
   (about 2 / (least - k + 2) of the bytes start one).  Regions of equal bytes are collapsed into one with a count, before any bytes move: first inside a text,
   whose later copies are known to repeat (a megabyte of one letter is two rows), then among all.
2. An anchor with one region string is settled by the count.  The others' region bytes are fetched, once for each different
   string, and dealt by anchor.  Per block a suffix array of all starts is built by prefix doubling up to `least` bytes; the
   previous and next smaller positions in suffix order are the nearest earlier matches, and LPF >= least holds where one of them
   agrees in `least` bytes; the same with mirrored positions finds later matches, where every copy goes.  Positions follow the global order of the regions' first occurrences, so an earlier position is an earlier copy.
3. An anchor with more than GROUP different regions (a passage in that many surroundings) isn't gathered: hashes of cells of CELL
   windows, then of the single windows at passages' edges, are counted by Spark, which decides the same question and spreads over all tasks.
4. Spans return to their documents; a document's spans are merged and cut out.

Null texts are empty; texts under `least` bytes are never touched; rows that agree in key and text count as copies of each other, and with keep_first share what is
removed; ties don't arise (places are ordered in full); very long texts are taken in pieces of PIECE bytes that overlap by a window, so nothing is lost at the cuts, and
a text's spans, which meet in one row, are a few per cent of its length; an empty table gives no rows; columns of other names are ignored (`clean` carries them along).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, durable, mix64, text_bytes

LEAST = 400
#: Different regions of an anchor that meet in one task.
GROUP = 256
#: Windows that are first taken together where an anchor has more regions than that.
CELL = 8
#: Bytes of one suffix array, about; the arrays made for it take some hundred times as much.
BLOCK = 1 << 19
#: Bytes of a text whose anchors are found at once; window starts are divided, so nothing is lost at the cuts.
PIECE = 3 << 18
#: Bytes of regions that are divided into cells or windows at once.
CELLS_BYTES = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)
_CODE = mix64(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step
        have += more
    return out


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _tables:
        _tables.clear()
        _tables[size] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _tables[size][0][:n], _tables[size][1][:n]


def regions(texts: list[bytes], least: int) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor offset in the first window, anchor hash, region hash) of every region."""
    k = least // 4
    w = least - k + 1
    out: list[tuple] = []
    pieces, size = [], 0

    def flush() -> None:
        nonlocal pieces, size
        if pieces:
            out.append(_regions(pieces, least, k, w))
        pieces, size = [], 0

    for i, t in enumerate(texts):
        for at in range(0, len(t) - least + 1, PIECE):
            part = t[at : at + PIECE + least - 1]
            if size and size + len(part) > PIECE + least:
                flush()
            pieces.append((i, at, part))
            size += len(part)
    flush()
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _regions(pieces: list[tuple[int, int, bytes]], least: int, k: int, w: int) -> tuple[np.ndarray, ...]:
    raw = b"".join(p[2] for p in pieces)
    b = np.frombuffer(raw, np.uint8)
    n = len(b)
    up, down = _power_tables(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODE[b] * up[:n], out=prefix[1:])
    gram = mix64((prefix[k:] - prefix[:-k]) * down[: n - k + 1])  # equal k-grams give equal numbers anywhere
    lengths = np.array([len(p[2]) for p in pieces])
    ends = np.cumsum(lengths)
    rank = gram & ~_PLACE | np.arange(len(gram), dtype=np.uint64)
    width = 1
    low = rank
    while 2 * width <= w:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(gram) - w + 1], low[w - width :][: len(gram) - w + 1]) if width < w else low
    ok = np.zeros(n + 1, np.int32)  # starts of windows inside one piece
    ok[ends - lengths] += 1
    np.add.at(ok, ends - least + 1, -1)
    start = np.flatnonzero(np.cumsum(ok)[: len(low)] > 0)
    anchor = (low[start] & _PLACE).astype(np.int64)
    change = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
    first, last, at = start[change], start[np.r_[change[1:] - 1, len(start) - 1]], anchor[change]
    piece = np.searchsorted(ends, first, "right")
    digest = xxhash.xxh3_64_intdigest
    view = memoryview(raw)
    own = np.fromiter((digest(view[x : y + least], p - x) for x, y, p in zip(first.tolist(), last.tolist(), at.tolist(), strict=True)), np.uint64, len(first))
    text, base = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces]) - (ends - lengths)
    return text[piece], first + base[piece], last + base[piece], at - first, gram[at].view(np.int64), own.view(np.int64)


def suffix_classes(raw: np.ndarray, least: int) -> np.ndarray:
    """For every position a number that orders its next `least` bytes (prefix doubling); beyond the end bytes count as least.
    Positions known to differ from all others keep numbers of their own and are no longer sorted."""
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(least + 8, np.uint8)])
    value = np.zeros(n, np.uint64)
    for j in range(min(8, least)):
        value = value << np.uint64(8) | padded[j : n + j]
    _, rank = np.unique(value, return_inverse=True)
    width = min(8, least)
    while width < least:
        step = min(width, least - width)
        count = np.bincount(rank, minlength=n + 1)
        active = np.flatnonzero(count[rank] > 1)
        if not len(active):
            return rank
        after = np.where(active + step < n, rank[np.minimum(active + step, n - 1)] + 1, 0)
        _, order = np.unique(rank[active].astype(np.int64) * (n + 1) + after, return_inverse=True)
        # suffixes of one old rank stay together: a new rank is the old one's first place plus the order within it
        firsts = np.cumsum(count) - count
        least_order = np.full(n + 1, np.iinfo(np.int64).max)
        np.minimum.at(least_order, rank[active], order)
        fresh = firsts[rank]
        fresh[active] += order - least_order[rank[active]]
        rank, width = fresh, width + step
    return rank


def previous_smaller(v: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it with a smaller value, else -1; by pointer jumping."""
    at = np.arange(-1, len(v) - 1)
    while True:
        wrong = np.flatnonzero((at >= 0) & (v[np.maximum(at, 0)] > v))
        if not len(wrong):
            return at
        at[wrong] = at[at[wrong]]


def earlier_match(position: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where LPF >= least: the previous or the next smaller position in suffix order, the nearest earlier matches, agrees in `least` bytes
    (has the same kind)."""
    before = previous_smaller(position)
    after = len(position) - 1 - previous_smaller(position[::-1])[::-1]  # next smaller
    return (before >= 0) & (kind[np.maximum(before, 0)] == kind) | (after < len(position)) & (kind[np.minimum(after, len(position) - 1)] == kind)


def repeated_starts(raw: np.ndarray, starts: np.ndarray, least: int, keep_first: bool) -> np.ndarray:
    """Which of the window starts repeat: with keep_first those with LPF >= least, else also those with a later match (the same of mirrored places)."""
    rank = suffix_classes(raw, least)[starts]
    order = np.lexsort((starts, rank))
    position, kind = starts[order], rank[order]
    hit = earlier_match(position, kind)
    if not keep_first:
        hit |= earlier_match(-position, kind)
    out = np.zeros(len(starts), bool)
    out[order] = hit
    return out


def within_texts(text: np.ndarray, first: np.ndarray, last: np.ndarray, ah: np.ndarray, rh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Regions that repeat inside one text: (rows to send on, how many regions each stands for, rows of the later copies)."""
    order = np.lexsort((first, rh, ah, text))
    fresh = np.r_[True, np.any([c[order][1:] != c[order][:-1] for c in (text, ah, rh)], axis=0)] if len(order) else np.zeros(0, bool)
    at = np.flatnonzero(fresh)
    return order[fresh], np.diff(np.r_[at, len(order)]), order[~fresh]


def joined_runs(text: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjoining ranges of windows of a text made one: (text, first, last)."""
    order = np.lexsort((first, text))
    text, first, last = text[order], first[order], last[order]
    cut = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (first[1:] > last[:-1] + 1)]) if len(order) else np.zeros(0, np.int64)
    return text[cut], first[cut], last[np.r_[cut[1:] - 1, len(order) - 1]] if len(order) else last


def _settle(df: DataFrame, least: int, keep_first: bool) -> DataFrame:
    """(ah, rh, first, last): window starts, relative to the region, that repeat among the regions of an anchor."""
    dealt = df.select("ah", "rh", "key", "text_hash", "s0", "region").repartition("ah").sortWithinPartitions("ah", "key", "text_hash", "s0")

    def block(groups: list[pa.Table]) -> pa.RecordBatch | None:
        t = pa.concat_tables(groups)
        # rows that repeat key and text fetch a region again; it mustn't count as a copy of itself
        _, once = np.unique(np.stack([t["ah"].to_numpy(), t["rh"].to_numpy()]), axis=1, return_index=True)
        if len(once) < t.num_rows:
            t = t.take(pa.array(np.sort(once)))
        # sorted by anchor, then by the global order: only equal anchors can match, so the order within an anchor is what counts
        raw = t["region"].to_pylist()
        lengths = np.array([len(x) for x in raw])
        begin = np.cumsum(lengths) - lengths
        windows = lengths - least + 1
        starts = np.arange(int(windows.sum())) + np.repeat(begin - (np.cumsum(windows) - windows), windows)
        hit = repeated_starts(np.frombuffer(b"".join(raw), np.uint8), starts, least, keep_first)
        if not hit.any():
            return None
        own = np.repeat(np.arange(len(raw)), windows)[hit]
        at = starts[hit] - begin[own]
        cut = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)])
        end = np.r_[cut[1:] - 1, len(at) - 1]
        ah, rh = t["ah"].to_numpy(), t["rh"].to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(ah[own[cut]]), pa.array(rh[own[cut]]), pa.array(at[cut]), pa.array(at[end])], names=["ah", "rh", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ah = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(ah[1:] != ah[:-1]) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if size >= BLOCK and held[-1]["ah"][-1].as_py() != ah[x]:
                    if (made := block(held)) is not None:
                        yield made
                    held, size = [], 0
                part = pa.Table.from_batches([batch.slice(x, y - x)])
                held.append(part)
                size += part["region"].nbytes
        if held and (made := block(held)) is not None:
            yield made

    return dealt.mapInArrow(run, "ah long, rh long, first long, last long")


def _settle_large(df: DataFrame, least: int, keep_first: bool) -> DataFrame:
    """The same for anchors with very many regions, in Spark.  Windows are first taken CELL at a time, by their places relative to the
    anchor: all windows of a cell hold its core, so a cell whose core no other region has is done, and equal cells are settled by their count.  Only the windows of
    different cells with equal cores (those at the edges of a passage) are then matched one by one, by 128-bit fingerprints."""
    kind = df.schema["key"].dataType.simpleString()
    rows = df.select("ah", "rh", "key", "text_hash", "s0", "off", "region")

    def divide(batch: pa.RecordBatch) -> dict:
        out: dict = {c: [] for c in ("ah", "rh", "key", "text_hash", "s0", "first", "last", "cell", "core", "whole")}
        for ah, rh, key, th, s0, off, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            last = len(raw) - least
            for cell in range((off - last) // CELL, off // CELL + 1):  # a window at i has place off - i
                x, y = max(0, off - (cell + 1) * CELL + 1), min(last, off - cell * CELL)
                core = raw[off - cell * CELL : off - (cell + 1) * CELL + 1 + least]
                for c, v in zip(out, (ah, rh, key, th, s0, x, y, cell, xxhash.xxh3_64_intdigest(core) - (1 << 63), xxhash.xxh3_128_digest(raw[x : y + least], off - x)), strict=True):
                    out[c].append(v)
        return out

    cells = durable(arrow_map(rows, divide, f"ah long, rh long, key {kind}, text_hash long, s0 long, first long, last long, cell long, core long, whole binary", text="region", most=CELLS_BYTES), "cells")
    same = ["ah", "cell", "core"]
    kinds = cells.groupBy(*same, "whole").agg(F.count("*").alias("n"), F.min(F.struct("key", "text_hash", "s0", "first", "last", "rh")).alias("one"))
    kinds = durable(kinds.join(kinds.groupBy(*same).agg(F.count("*").alias("d"), F.sum("n").alias("of")).where("of > 1"), same), "cellkinds")
    equal = cells.join(kinds.where("n > 1").select(*same, "whole", "one"), [*same, "whole"])
    if keep_first:
        equal = equal.where(~F.struct("key", "text_hash", "s0", "first", "last", "rh").eqNullSafe(F.col("one")))
    edge = kinds.where("d > 1").select("ah", F.col("one.rh").alias("rh"), F.col("one.first").alias("first"), F.col("one.last").alias("last"))
    at_edge = rows.join(edge, ["ah", "rh"]).select(*rows.columns, "first", "last")

    def single(batch: pa.RecordBatch) -> dict:
        out: dict = {c: [] for c in ("ah", "rh", "key", "text_hash", "s0", "at", "place", "print")}
        for ah, rh, key, th, s0, off, raw, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for i in range(first, last + 1):
                for c, v in zip(out, (ah, rh, key, th, s0, i, off - i, xxhash.xxh3_128_digest(raw[i : i + least])), strict=True):
                    out[c].append(v)
        return out

    windows = durable(arrow_map(at_edge, single, f"ah long, rh long, key {kind}, text_hash long, s0 long, at long, place long, print binary", text="region", most=CELLS_BYTES), "windows")
    alike = ["ah", "place", "print"]
    count = windows.groupBy(*alike).agg(F.count("*").alias("n"), F.min(F.struct("key", "text_hash", "s0", "at")).alias("one")).where("n > 1")
    hit = windows.join(count, alike)
    if keep_first:
        hit = hit.where(~F.struct("key", "text_hash", "s0", "at").eqNullSafe(F.col("one")))
    return equal.select("ah", "rh", "first", "last").unionByName(hit.select("ah", "rh", F.col("at").alias("first"), F.col("at").alias("last")))


def spans(docs: DataFrame, least: int = LEAST, keep_first: bool = False) -> DataFrame:
    """(key, text_hash, spans): merged [start, stop) byte spans to remove, for documents with any.  docs: key, text, text_hash."""
    kind = docs.schema["key"].dataType.simpleString()

    def find(batch: pa.RecordBatch) -> dict:
        text, first, last, off, ah, rh = regions([t or b"" for t in text_bytes(batch)], least)
        own, n, copies = within_texts(text, first, last, ah, rh)
        gone, g0, g1 = joined_runs(text[copies], first[copies], last[copies])
        none, rows = np.zeros(len(gone), np.int64), pa.array(np.r_[text[own], gone])
        cols = {"key": batch.column(0).take(rows), "text_hash": batch.column(2).take(rows)}
        return cols | {c: np.r_[x[own], y] for c, x, y in (("s0", first, g0), ("s1", last, g1), ("off", off, none), ("ah", ah, none), ("rh", rh, none))} | {"n": np.r_[n, none]}

    # n: regions of the text that a row stands for; 0: windows known to repeat earlier in their text, in runs
    every = durable(arrow_map(docs, find, f"key {kind}, text_hash long, s0 long, s1 long, off long, ah long, rh long, n long"), "regions")
    known = every.where("n = 0").select("key", "text_hash", F.lit(0).cast("long").alias("first"), F.struct(F.col("s0").alias("start"), (F.col("s1") + least).alias("stop")).alias("spans"))
    every = every.where("n > 0")
    again = durable(every.groupBy("ah").agg(F.sum("n").alias("n")).where("n > 1").select("ah"), "again")  # a table, so that a crowded anchor's partition can be split
    seen = durable(every.join(again, "ah", "left_semi"), "repeated")
    unique = seen.groupBy("ah", "rh").agg(F.sum("n").alias("n"), F.min(F.struct("key", "text_hash", "s0", "s1", "off")).alias("one"))
    kinds = durable(unique, "kinds")
    many = durable(kinds.groupBy("ah").agg(F.count("*").alias("d")).where("d > 1"), "many")
    open_ = kinds.join(many, "ah").select("ah", "rh", "n", "d", "one.*")
    wanted = docs.join(open_.withColumnRenamed("key", "_key").withColumnRenamed("text_hash", "_hash"), (F.col("text_hash") == F.col("_hash")) & F.col("key").eqNullSafe(F.col("_key")))
    cut = F.substring(F.col("text").cast("binary"), F.col("s0").cast("int") + 1, (F.col("s1") - F.col("s0")).cast("int") + least)
    fetched = durable(wanted.select("ah", "rh", "d", "key", "text_hash", "s0", "off", cut.alias("region")), "fetched")
    found = _settle(fetched.where(F.col("d") <= GROUP), least, keep_first)
    if fetched.where(F.col("d") > GROUP).limit(1).count():
        found = found.unionByName(_settle_large(fetched.where(F.col("d") > GROUP), least, keep_first))
    # a region's windows all hold its anchor, so those that repeat cover one run of bytes: the first and last of them say it all
    parts = found.groupBy("ah", "rh").agg(F.min("first").alias("p0"), F.max("last").alias("p1"))
    settled = durable(kinds.join(parts, ["ah", "rh"], "left").where("n > 1 OR p0 IS NOT NULL").select("ah", "rh", "n", F.struct("one.key", "one.text_hash", "one.s0").alias("one"), "p0", "p1"), "settled")
    here = seen.select("key", "text_hash", "s0", "s1", "ah", "rh").join(settled, ["ah", "rh"])
    in_part = F.struct("key", "text_hash", "s0").eqNullSafe(F.col("one")) if keep_first else F.col("n") == 1
    first, last = F.when(in_part, F.col("p0")).otherwise(0), F.when(in_part, F.col("p1")).otherwise(F.col("s1") - F.col("s0"))
    bytes_ = here.select("key", "text_hash", first.alias("first"), F.struct((F.col("s0") + first).alias("start"), (F.col("s0") + last + least).alias("stop")).alias("spans")).where("first IS NOT NULL")
    return bytes_.unionByName(known).groupBy("key", "text_hash").agg(F.collect_list("spans").alias("spans"))


def merged(own: list[dict] | None) -> list[tuple[int, int]]:
    """Overlapping and touching spans made one."""
    out: list[tuple[int, int]] = []
    for x, y in sorted((s["start"], s["stop"]) for s in own or ()):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def without(raw: bytes, own: list[tuple[int, int]]) -> bytes:
    edges = [0, *(e for s in own for e in s), len(raw)]
    return b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))


def _spanned(df: DataFrame, least: int, keep_first: bool, key: str, text: str, rest: bool) -> DataFrame:
    base = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"), *([F.struct(*[F.col(c) for c in df.columns if c != text]).alias("rest")] if rest else []))
    found = spans(base.select("key", "text", "text_hash"), least, keep_first).select(F.col("key").alias("_key"), F.col("text_hash").alias("_hash"), "spans")
    return base.join(found, (F.col("text_hash") == F.col("_hash")) & F.col("key").eqNullSafe(F.col("_key")), "left").drop("_key", "_hash")


def remove_repeats(df: DataFrame, least: int = LEAST, keep_first: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes, n_removed, spans (merged), kept (the remaining bytes)."""
    rows = _spanned(df, least, keep_first, key, text, False)

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {"key": batch.column(0), "n_bytes": [], "n_removed": [], "spans": [], "kept": []}
        for t, own in zip(text_bytes(batch), batch.column(batch.schema.get_field_index("spans")).to_pylist(), strict=True):
            raw, cut = t or b"", merged(own)
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(sum(y - x for x, y in cut))
            out["spans"].append([{"start": x, "stop": y} for x, y in cut])
            out["kept"].append(without(raw, cut))
        return out

    kind = rows.schema["key"].dataType.simpleString()
    return arrow_map(rows, run, f"key {kind}, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary").withColumnRenamed("key", key)


def clean(docs: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """The documents with later copies cut out, the first kept; a character cut in part goes whole; `length` counts characters anew."""
    rows = _spanned(docs, least, True, key, text, True)

    def run(batch: pa.RecordBatch) -> dict:
        at = batch.schema.get_field_index
        new = []
        for t, own in zip(text_bytes(batch), batch.column(at("spans")).to_pylist(), strict=True):
            new.append(None if t is None else without(t, merged(own)).decode("utf-8", "ignore"))
        return {"new": new, "rest": batch.column(at("rest"))}

    rest = rows.schema["rest"].dataType
    made = arrow_map(rows, run, f"new string, rest {rest.simpleString()}")
    out = {c: F.col(f"rest.`{c}`") for c in docs.columns if c != text} | {text: F.col("new")}
    if length in docs.columns:
        out[length] = F.length("new").cast(docs.schema[length].dataType)
    return made.select(*[out[c].alias(c) for c in docs.columns])

