"""Operator 10: near-duplicate components by circulant MinHash.

1. A text's set: distinct hashed word shingles (words between ASCII white space, A-Z lower-cased; fewer words than a shingle
   has: the whole sequence as one).  Rows with equal sets form one class; everything below works on classes, so exact copies cost nothing.
2. Circulant MinHash: a first permutation sigma spreads the shingles over 2^32 places, a second one, pi, is shifted circularly by k
   to give coordinate k: min over the set of pi(sigma(x) + k mod 2^32).  Two permutations make all 128 coordinates.
3. Banding: 32 bands of 4 coordinates.  A pair at similarity 0.8 shares no band with probability (1 - 0.8^4)^32 = 5e-8.
   Within a band's bucket pairs are screened by size and by two bits of each coordinate (6 sigma below what similarity 0.8 gives); a task keeps one
   spanning forest over all its buckets.  A bucket beyond BUCKET classes is tied to its least node by a join, unscreened, which only widens what is verified.
4. Components of those edges are supersets of the true ones.  Each is verified exactly: members' full sets meet in groups of bounded
   bytes and are linked by exact Jaccard similarity, skipping pairs already in one component.  A component too large for a group is
   cut into chunks; chunks are linked through one member of each part, and members then still outside the largest part visit every chunk
   with which they share a band.  No pair of a band that may link two parts is left out, and none is emitted that doesn't.
5. component_id is the least key of a component; rows without words link with nothing and are their own component.

Nulls: a null text is empty; a null key can't be a component's id unless it is alone.  Repeated rows share class and component and have equal results; an empty table gives no
rows; columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, durable, mix64, pick, text_bytes

BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
#: Classes of a bucket that are screened pair by pair, and nodes that a task's forest holds before it is given out.
BUCKET, FOREST = 8192, 200_000
#: Classes and shingles in one verified group, about.
GROUP, GROUP_SHINGLES = 1000, 4 << 20
_PAIRS = np.uint64(0x5555555555555555)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    code: dict[bytes, int] = {}
    out = []
    for t in texts:
        words = t.lower().split()  # of bytes: A-Z only, and ASCII white space only
        if not words:
            out.append(np.zeros(0, np.uint64))
            continue
        for w in set(words):
            if w not in code:
                code[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(code.__getitem__, words), np.uint64, len(words))
        m = min(width, len(words))
        acc = np.full(len(h) - m + 1, m, np.uint64)
        for j in range(m):
            acc = mix64(acc + h[j : len(h) - m + 1 + j])
        out.append(np.unique(acc))
    return out


def _mix32(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """COORDINATES minima of each non-empty set."""
    out = np.zeros((len(sets), COORDINATES), np.uint32)
    at = 0
    while at < len(sets):
        upto, size = at, 0
        while upto < len(sets) and (upto == at or size + len(sets[upto]) <= 1 << 16):
            size += len(sets[upto])
            upto += 1
        x = (mix64(np.concatenate(sets[at:upto])) >> np.uint64(32)).astype(np.uint32)  # sigma
        begin = np.cumsum([0, *map(len, sets[at : upto - 1])])
        for k in range(COORDINATES):
            out[at:upto, k] = np.minimum.reduceat(_mix32(x + np.uint32(k)), begin)  # pi, shifted by k
        at = upto
    return out


def describe(df: DataFrame, width: int) -> DataFrame:
    """Per row: key, text_hash, n_shingles, set_id, bands, sketch (null without words)."""

    def run(batch: pa.RecordBatch) -> dict:
        sets = shingle_sets([t or b"" for t in text_bytes(batch)], width)
        some = [i for i, s in enumerate(sets) if len(s)]
        ids, bands, sketch = [None] * len(sets), [None] * len(sets), [None] * len(sets)
        if some:
            sig = signatures([sets[i] for i in some])
            band = np.tile(np.arange(BANDS, dtype=np.uint64), (len(some), 1))
            for j in range(ROWS):
                band = mix64(band + sig[:, j::ROWS].astype(np.uint64))
            two = (sig & np.uint32(3)).astype(np.uint64).reshape(len(some), 4, 32) << np.arange(0, 64, 2, dtype=np.uint64)
            packed = np.bitwise_or.reduce(two, axis=2)
            for n, i in enumerate(some):
                ids[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                bands[i], sketch[i] = band[n].view(np.int64), packed[n].tobytes()
        return {"key": batch.column(0), "text_hash": batch.column(2), "n_shingles": [len(s) for s in sets], "set_id": ids, "bands": bands, "sketch": sketch}

    kind = df.schema["key"].dataType.simpleString()
    return arrow_map(df, run, f"key {kind}, text_hash long, n_shingles long, set_id binary, bands array<long>, sketch binary")


def _similar(sketch: np.ndarray, size: np.ndarray, one: np.ndarray, its_size: int, similarity: float) -> np.ndarray:
    """The places of those that may reach the similarity with one more, by size and by the coordinates' low bits."""
    x = sketch ^ one
    differ = np.bitwise_count((x | x >> np.uint64(1)) & _PAIRS).sum(axis=1, dtype=np.int64)
    p = similarity + (1 - similarity) / 4
    least = p - 6 * np.sqrt(p * (1 - p) / COORDINATES)
    return np.flatnonzero((COORDINATES - differ >= least * COORDINATES) & (np.minimum(size, its_size) >= similarity * np.maximum(size, its_size) - 1e-9))


def _forest(node: np.ndarray, size: np.ndarray, sketch: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Edges that connect a bucket's classes as the screened pairs do."""
    n = len(node)
    part, out = np.arange(n), []
    for i in range(1, n):
        near = _similar(sketch[:i], size[:i], sketch[i], size[i], similarity)
        if len(near):
            parts, first = np.unique(part[near], return_index=True)
            out += [(int(node[near[j]]), int(node[i])) for j in first]
            if len(parts) > 1:
                part[: i + 1][np.isin(part[: i + 1], parts)] = parts[0]
            part[i] = parts[0]
    return out


class Forest:
    """Union-find over node numbers; a tree's root is its least node."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (over := up.get(top, top)) != top:
            top = over
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, x: int, y: int) -> None:
        lo, hi = sorted((self.root(x), self.root(y)))
        self.up.setdefault(lo, lo)
        self.up[hi] = lo

    def stars(self) -> pa.RecordBatch:
        """(root, node) of every node that isn't a root: one edge less than a tree has nodes."""
        pairs = np.array([(self.root(x), x) for x in list(self.up)], np.int64).reshape(-1, 2)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def bucket_edges(classes: DataFrame, similarity: float) -> DataFrame:
    """Distinct (a, b) node pairs that connect what bands bring together.  classes: node, n_shingles, sketch, bands.

    A task joins all its buckets in one forest and gives one edge a node.  What several tasks say of a node (one edge for each of its
    bands at most) is then drawn to the least of its roots, so about one edge a node is left."""
    rows = classes.select(F.explode("bands").alias("band"), "node", F.col("n_shingles").cast("int").alias("size"), "sketch")
    counts = classes.select(F.explode("bands").alias("band"), "node").groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("first"))
    crowded = durable(counts.where(F.col("n") > BUCKET).select("band", "first"), "crowded")
    more = None
    if crowded.limit(1).count():  # dealt out by rows, not by bucket: the join needs no row of a bucket to meet another
        more = rows.select("band", "node").join(crowded, "band").where("first <> node").select(F.col("first").alias("a"), F.col("node").alias("b"))
        rows = rows.join(crowded.select("band"), "band", "left_anti")
    dealt = rows.repartition("band").sortWithinPartitions("band", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        forest = Forest()
        for batch in _with_end(batches):
            if batch is not None:
                band = batch.column(0).to_numpy(zero_copy_only=False)
                held.append((band, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False), np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(-1, 4)))
                if band[0] == band[-1] and held[0][0][0] == band[0]:
                    continue  # one bucket so far, of BUCKET classes at most
            if not held:
                break
            band, node, size, sketch = (np.concatenate(c) for c in zip(*held, strict=True))
            cuts = np.flatnonzero(np.r_[True, band[1:] != band[:-1], True])
            stop = len(cuts) - 1 if batch is None else len(cuts) - 2  # the last bucket may go on
            for k in np.flatnonzero(np.diff(cuts)[:stop] > 1).tolist():
                x, y = cuts[k], cuts[k + 1]
                for edge in _forest(node[x:y], size[x:y], sketch[x:y], similarity):
                    forest.join(*edge)
            rest = cuts[stop]
            held = [(band[rest:], node[rest:], size[rest:], sketch[rest:])] if rest < len(band) else []
            if len(forest.up) > FOREST:
                yield forest.stars()
                forest = Forest()
        if forest.up:
            yield forest.stars()

    stars = dealt.mapInArrow(run, "a long, b long")
    return drawn_in(stars if more is None else stars.unionByName(more))


def drawn_in(edges: DataFrame) -> DataFrame:
    """The same components by about one edge a node: each b's roots a are joined to the least of them.  edges: a < b; a b has few rows."""
    ends = edges.groupBy("b").agg(F.collect_set("a").alias("ends")).select(F.array_min("ends").alias("a"), F.explode(F.concat("ends", F.array("b"))).alias("b"))
    return ends.where("a <> b").distinct()


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    for b in batches:
        if b.num_rows:
            yield b
    yield None


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each component of (a, b).  Each round every node points at its least neighbour or itself,
    pointers are doubled until they reach their roots, and edges between roots are what the next round has left, so rows fall from
    round to round.  Every step is written to the shared folder; only whether rows are left reaches the driver."""
    left = durable(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    whole = None
    while True:
        ends = left.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(left.select(F.col("a").alias("node"), F.col("a").alias("label")))
        now = durable(ends.groupBy("node").agg(F.min("label").alias("label")), "labels")
        while True:
            # a pointer whose target is a root itself is done; the others go one step on, which doubles their reach
            next_ = now.where("node <> label").select(F.col("node").alias("label"), F.col("label").alias("far"))
            moved = durable(now.join(next_, "label", "left").select("node", F.coalesce("far", "label").alias("label"), F.col("far").isNotNull().alias("moved")), "labels")
            now = moved.select("node", "label")
            if not moved.where("moved").limit(1).count():
                break
        if whole is not None:
            now_ = now.select(F.col("node").alias("label"), F.col("label").alias("far"))
            whole = durable(whole.join(now_, "label", "left").select("node", F.coalesce("far", "label").alias("label")), "labels")
        else:
            whole = now
        to = now.where("node <> label")
        left = left.join(to.toDF("a", "la"), "a", "left").join(to.toDF("b", "lb"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        left = durable(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        if not left.limit(1).count():
            return whole


def _runs(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """Rows grouped by the key columns, a group at a time: rows are dealt and sorted by Spark, and a function from a group's table to a
    record batch or None runs in order.  Only one group is held."""
    dealt = df.repartition(*keys).sortWithinPartitions(*keys)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(names.index(k)).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for x, y in zip(cuts, cuts[1:], strict=False):
                key = tuple(c[x] for c in cols)
                if now is not None and key != now and (out := fn(pa.Table.from_batches(held))) is not None:
                    yield out
                if key != now:
                    held, now = [], key
                held.append(batch.slice(x, y - x))
        if held and (out := fn(pa.Table.from_batches(held))) is not None:
            yield out

    return dealt.mapInArrow(run, schema)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """100 * intersection >= 100 * similarity * union, in whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= round(100 * similarity) * (len(a) + len(b) - both)


def _columns(group: pa.Table) -> tuple[np.ndarray, ...]:
    node, size = group["node"].to_numpy(), group["size"].to_numpy()
    sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint64).reshape(-1, 4)
    return node, size, sketch, [np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()]


def _link(group: pa.Table, similarity: float) -> pa.RecordBatch:
    """(node, part): exact links within one group; part is the least node of those linked."""
    node, size, sketch, sets = _columns(group)
    order = np.argsort(node, kind="stable")
    node, size, sketch, sets = node[order], size[order], sketch[order], [sets[i] for i in order]
    part = np.arange(len(node))
    for i in range(1, len(node)):
        near = _similar(sketch[:i], size[:i], sketch[i], size[i], similarity)
        while len(near):
            j = near[0]
            if jaccard_at_least(sets[i], sets[j], similarity):
                lo, hi = sorted((part[i], part[j]))
                part[: i + 1][part[: i + 1] == hi] = lo
                near = near[part[near] != lo]
            else:
                near = near[1:]
                near = near[part[near] != part[i]]
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[part])], names=["node", "part"])


def _crossed(df: DataFrame, similarity: float) -> DataFrame:
    """(a, b) parts linked by a guest (a member outside its component's largest part) and any host of the chunk that it visits.  Rows of a
    chunk come hosts first; only the hosts are held, guests pass by."""
    dealt = df.select("label", "chunk", "guest", "node", "part", "size", "sketch", "shingles").repartition("label", "chunk").sortWithinPartitions("label", "chunk", "guest", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hosts, held, forest = None, [], None, Forest()
        for batch in batches:
            if not batch.num_rows:
                continue
            label, chunk, guest = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            cuts = [0, *(np.flatnonzero((label[1:] != label[:-1]) | (chunk[1:] != chunk[:-1]) | (guest[1:] != guest[:-1])) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if (label[x], chunk[x]) != now:
                    if forest.up:
                        yield forest.stars()
                    now, hosts, held, forest = (label[x], chunk[x]), [], None, Forest()
                rows = pa.Table.from_batches([batch.slice(x, y - x)])
                if not guest[x]:
                    hosts.append(rows)
                    continue
                if held is None:
                    whole = pa.concat_tables(hosts)
                    held, parts = _columns(whole), whole["part"].to_pylist()
                _, size, sketch, sets = held
                for part, its_size, its_sketch, its_set in zip(rows["part"].to_pylist(), *_columns(rows)[1:], strict=True):
                    for j in _similar(sketch, size, its_sketch, its_size, similarity).tolist():
                        if forest.root(parts[j]) != forest.root(part) and jaccard_at_least(sets[j], its_set, similarity):
                            forest.join(parts[j], part)
        if forest.up:
            yield forest.stars()

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, width: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, text_hash (xxhash64), n_shingles, component_id, kept.  `width` words a shingle."""
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    rows = durable(describe(docs, width), "signatures")
    found = rows.where("set_id IS NOT NULL").groupBy("set_id").agg(F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.min("key").alias("first_key"), F.min(F.struct("key", "text_hash")).alias("one"))
    classes = durable(found.withColumn("node", F.monotonically_increasing_id()), "classes")  # ids are fixed by being written
    label = components(bucket_edges(classes, similarity))
    part = durable(_verify(docs, classes, label, width, similarity), "parts")
    ids = part.join(classes.select("node", "first_key"), "node").groupBy("part").agg(F.min("first_key").alias("component_id"))
    named = part.join(ids, "part").join(classes.select("node", "set_id", "first_key"), "node").where(~F.col("component_id").eqNullSafe(F.col("first_key"))).select("set_id", "component_id")
    # classes that are their own component need no entry: their rows have the class's least key
    own = classes.select("set_id", "first_key").join(named, "set_id", "left").select("set_id", F.coalesce("component_id", "first_key").alias("component_id"))
    own = durable(own, "ids")  # a table, so that the partition of a set with very many rows can be split
    out = rows.where("set_id IS NOT NULL").select("key", "text_hash", "n_shingles", "set_id").join(own, "set_id", "left").drop("set_id")
    alone = rows.where("set_id IS NULL").select("key", "text_hash", "n_shingles", F.lit(None).cast(rows.schema["key"].dataType).alias("component_id"))
    whole = F.coalesce("component_id", "key")
    return out.unionByName(alone).select(F.col("key").alias(key), "text_hash", "n_shingles", whole.alias("component_id"), F.col("key").eqNullSafe(whole).alias("kept"))


def _verify(docs: DataFrame, classes: DataFrame, label: DataFrame, width: int, similarity: float) -> DataFrame:
    """(node, part) by exact links, for nodes of components of two or more."""
    members = classes.select("node", F.col("n_shingles").alias("size"), "sketch", F.col("one.key").alias("one_key"), F.col("one.text_hash").alias("one_hash")).join(label, "node")
    chunks = F.greatest(F.ceil(F.count("*") / F.lit(GROUP)), F.ceil(F.sum("size") / F.lit(GROUP_SHINGLES))).cast("int")
    sizes = members.groupBy("label").agg(chunks.alias("chunks"))
    planned = members.join(sizes, "label").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks").cast("long")).cast("int"))
    texts = docs.join(planned, (F.col("text_hash") == F.col("one_hash")) & F.col("key").eqNullSafe(F.col("one_key"))).select("node", "label", "chunk", "chunks", "size", "sketch", "text")

    def pack(batch: pa.RecordBatch) -> dict:
        cols = {c: batch.column(batch.schema.get_field_index(c)) for c in ("node", "label", "chunk", "chunks", "size", "sketch")}
        return cols | {"shingles": [s.tobytes() for s in shingle_sets([t or b"" for t in text_bytes(batch)], width)]}

    packed = arrow_map(texts, pack, "node long, label long, chunk int, chunks int, size long, sketch binary, shingles binary")
    sets = durable(packed, "sets")  # repeated rows repeat a node here; a node links with itself at no cost
    local = durable(_runs(sets, ["label", "chunk"], lambda g: _link(g, similarity), "node long, part long").groupBy("node").agg(F.min("part").alias("part")), "local")
    large = sets.where("chunks > 1").join(local, "node")
    if not large.limit(1).count():
        return local
    # one member of each part stands for it; linking those joins most parts of a component
    deputies = large.where("node = part")
    counts = deputies.groupBy("label").agg(chunks.alias("of"))
    dealt = deputies.join(counts, "label").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("of").cast("long")).cast("int")).drop("of", "part")
    joined = _runs(dealt, ["label", "chunk"], lambda g: _link(g, similarity), "node long, part long").where("node <> part")
    edges = durable(joined.select(F.col("node").alias("a"), F.col("part").alias("b")), "deputies")
    first = components(edges).withColumnRenamed("node", "part").withColumnRenamed("label", "joint")
    now = durable(large.join(first, "part", "left").withColumn("part", F.coalesce("joint", "part")).drop("joint"), "large")
    # members outside their component's largest part meet the chunks of it with which they share a band
    per = now.groupBy("label", "part").agg(F.count("*").alias("n"))
    largest = per.groupBy("label").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
    guests = durable(now.join(largest, "label").where("part <> main").drop("main"), "guests")
    visited = now.select("node", "label", "chunk").join(guests.select("label").distinct(), "label", "left_semi")
    banded = classes.select("node", F.explode("bands").alias("band"))
    places = visited.join(banded, "node").select("label", "band", "chunk").distinct()
    visits = guests.select("node", "label").join(banded, "node").join(places, ["label", "band"]).select("node", "chunk").distinct()
    spread = guests.drop("chunk").join(visits, "node").withColumn("guest", F.lit(True))
    hosts = now.join(guests.select("label").distinct(), "label", "left_semi").withColumn("guest", F.lit(False))
    more = _crossed(hosts.unionByName(spread), similarity).distinct()
    final = components(edges.unionByName(more)).withColumnRenamed("node", "part").withColumnRenamed("label", "joint")
    return local.join(final, "part", "left").select("node", F.coalesce("joint", "part").alias("part"))


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with all its columns: that of the least key, and one of rows that agree in key and text."""
    from pyspark.sql.window import Window

    found = near_duplicates(docs, width, similarity, key, text).where("kept").select(F.col(key).alias("_clausewright_key"), F.col("text_hash").alias("_clausewright_hash")).distinct()
    rows = docs.join(found, F.col(key).eqNullSafe(F.col("_clausewright_key")) & (F.xxhash64(F.col(text)) == F.col("_clausewright_hash")))
    first = Window.partitionBy("_clausewright_key", "_clausewright_hash").orderBy("_clausewright_hash")
    return rows.withColumn("_clausewright_n", F.row_number().over(first)).where("_clausewright_n = 1").select(*docs.columns)
