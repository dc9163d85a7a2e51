"""Operator 3: stupid-backoff language-model scores of a corpus by its own n-gram counts, computed relationally.

Counts of all n-grams (orders 1 to `order`) cover every document.  N-grams of order 2 and more with a corpus count under `least` are pruned; with
1, the default, none is.  A word's score is the count of the longest n-gram that ends at it and isn't pruned, over the
count of that n-gram without its last word, times `alpha` for each order given up; a lone word's is its count over all words.  A document's score is
the sum of log10 over its words; perplexity is 10 ** (-score / words).

The relations are held in packed blocks, so that a row isn't needed for each n-gram of each document:
1. Documents are dealt into batches of about BATCH bytes; a batch explodes into its distinct n-grams (64-bit hashes) of orders 1 and 2 with
   counts, cut by hash into parts: one row for each (part, batch).  A frequent n-gram is sent once for each batch.  Of each longer order only
   n-grams are sent whose two shorter parts reach `least` and 2: under `least` the n-gram can't reach it, and with a part that occurs once it occurs
   once itself, so nothing is lost.
2. The count table is partitioned by hash: a part's rows meet, are summed, and each batch's n-grams are joined to the sums.
   A batch gets back one number for each n-gram that it sent, in the order it sent them.
3. The batch explodes again (its documents come from the same exchange), looks up its n-grams and sums by document.

Words stand between ASCII white space, A-Z lower-cased.  A null or empty text has no words, score 0 and no perplexity; repeated rows are counted and
scored as often as they come; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, mix64, pick, text_bytes

ORDER, ALPHA, LEAST = 3, 0.4, 1  # an order of 2 or more
#: Bytes of text in a batch, about, and parts of the count table for each batch.
BATCH, PARTS = 12 << 20, 2


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def grams(texts: list[bytes | None], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of each text, and for each order the hash of the n-gram that ends at each word (0 where there is none)."""
    code: dict[bytes, int] = {}
    sizes, flat = [], []
    for t in texts:
        w = words(t)
        for x in set(w):
            if x not in code:
                code[x] = xxhash.xxh3_64_intdigest(x)
        sizes.append(len(w))
        flat.append(np.fromiter(map(code.__getitem__, w), np.uint64, len(w)))
    size = np.array(sizes, np.int64)
    one = mix64(np.concatenate([np.zeros(0, np.uint64), *flat])) | np.uint64(1)
    place = np.arange(len(one)) - np.repeat(np.cumsum(size) - size, size)
    out, last = [one], one
    for n in range(2, order + 1):  # the n-gram before, one word on
        longer = np.zeros(len(one), np.uint64)
        longer[1:] = mix64(last[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] + np.uint64(n)) | np.uint64(1)
        longer[place < n - 1] = 0
        out.append(longer)
        last = longer
    return size, out


def _distinct(hashes: list[np.ndarray], parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams ordered by part and hash, how often each occurs, and where each part begins.  A hash is part + parts * rest."""
    found, count = np.unique(np.concatenate(hashes), return_counts=True)
    if len(found) and found[0] == 0:
        found, count = found[1:], count[1:]
    part = found % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    return found[order], count[order], np.searchsorted(part[order], np.arange(parts + 1))


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte: all first bytes, then all second ones; high bytes are mostly alike and compress in the shuffle."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def _rows(batch: int, found: np.ndarray, count: np.ndarray, cuts: np.ndarray) -> pa.Table:
    """Distinct n-grams and counts, a row for each part; within a part only the rest of a hash is sent, as steps."""
    parts = len(cuts) - 1
    rows = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
    steps = [_planes(np.diff(found[cuts[p] : cuts[p + 1]] // np.uint64(parts), prepend=np.uint64(0))) for p in rows]
    return pa.table({"part": pa.array(rows, pa.int32()), "batch": pa.array([batch] * len(rows), pa.int32()), "grams": pa.array(steps, pa.binary()), "counts": pa.array([_planes(count[cuts[p] : cuts[p + 1]]) for p in rows], pa.binary())})


def _ask(group: pa.Table, parts: int) -> pa.Table:
    """A batch's n-grams of orders 1 and 2."""
    return _rows(group["batch"][0].as_py(), *_distinct(grams(_texts(group), 2)[1], parts))


def _counted(hashes: list[np.ndarray], answers: pa.Table, number: int, parts: int) -> list[np.ndarray]:
    """The corpus count of each n-gram of a batch, from the answers to one question; 0 where there is none."""
    each = [np.unique(h, return_inverse=True) for h in hashes]
    found, place = np.unique(np.concatenate([f for f, _ in each]), return_inverse=True)
    by = {p: t for p, t, n in zip(*(answers[c].to_pylist() for c in ("part", "totals", "question")), strict=True) if n == number}
    none = int(len(found) > 0 and found[0] == 0)
    order = np.argsort(found[none:] % np.uint64(parts), kind="stable")  # as they were asked
    count = np.zeros(len(found))
    count[none + order] = np.concatenate([np.zeros(0, np.uint64), *[_numbers(by[p]) for p in sorted(by)]])
    own = np.split(count[place], np.cumsum([len(f) for f, _ in each])[:-1])
    return [c[inverse] for c, (_, inverse) in zip(own, each, strict=True)]


def _longer(hashes: list[np.ndarray], counts: list[np.ndarray], n: int, least: int) -> np.ndarray:
    """The n-grams of order n whose count isn't known from their two parts of order n - 1: both reach `least`, and 2."""
    most = max(least, 2)
    ok = counts[n - 2] >= most
    ok[1:] &= counts[n - 2][:-1] >= most
    return np.where(ok, hashes[n - 1], 0).astype(np.uint64)


def _ask_longer(docs: pa.Table, answers: pa.Table, parts: int, n: int, least: int) -> pa.Table:
    """A batch's n-grams of order n that may reach `least`, given what was answered for the orders below."""
    if not docs.num_rows:
        return _rows(0, *_distinct([np.zeros(0, np.uint64)], parts))
    _, hashes, counts = _known(docs, answers, parts, n, n - 1, least)
    return _rows(docs["batch"][0].as_py(), *_distinct([_longer(hashes, counts, n, least)], parts))


def _known(docs: pa.Table, answers: pa.Table, parts: int, orders: int, counted: int, least: int) -> tuple[np.ndarray, list[np.ndarray | None], list[np.ndarray]]:
    """Words of each text, hashes of the orders above `counted` up to `orders` that end at each word, and counts of the others.  Hashes
    are let go as soon as they are counted."""
    size, hashes = grams(_texts(docs), orders)
    counts = _counted(hashes[:2], answers, 2, parts)
    hashes[0] = hashes[1] = None
    for k in range(3, counted + 1):
        own = _longer(hashes, counts, k, least)
        once = (own == 0) & (hashes[k - 1] != 0)  # not asked for: it occurs once, or is pruned anyway
        hashes[k - 1] = None
        counts += _counted([own], answers, k, parts)
        counts[-1][once] = 1
    return size, hashes, counts


def _answer(group: pa.Table, number: int) -> pa.Table:
    """Corpus counts of each batch's n-grams in one part of the count table."""
    asked = [np.cumsum(_numbers(x), dtype=np.uint64) for x in group["grams"].to_pylist()]
    counts = np.concatenate([_numbers(x) for x in group["counts"].to_pylist()])
    _, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.zeros(int(inverse.max()) + 1, np.uint64)
    np.add.at(total, inverse, counts)
    answer = np.split(total[inverse], np.cumsum([len(x) for x in asked])[:-1])
    return pa.table({"batch": group["batch"].cast(pa.int32()), "part": group["part"].cast(pa.int32()), "question": pa.array([number] * len(asked), pa.int32()), "totals": pa.array([_planes(x) for x in answer], pa.binary())})


def _asking(parts: int, n: int, least: int):
    return lambda docs, answers: _ask_longer(docs, answers, parts, n, least)


def _answering(number: int):
    return lambda group: _answer(group, number)


def _texts(group: pa.Table) -> list[bytes | None]:
    return group["text"].cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def _score(docs: pa.Table, answers: pa.Table, parts: int, order: int, alpha: float, least: int, n: int) -> pa.Table:
    size, _, counts = _known(docs, answers, parts, order, order, least)
    log = np.log10(np.maximum(counts[0], 1) / max(n, 1)) + (order - 1) * np.log10(alpha)
    place = np.arange(len(log)) - np.repeat(np.cumsum(size) - size, size)
    # words near a text's beginning have fewer orders to give up
    log -= np.log10(alpha) * np.maximum(0, order - 1 - place)
    for k in range(2, order + 1):
        context = np.ones(len(log))
        context[1:] = counts[k - 2][:-1]
        use = (counts[k - 1] >= least) & (place >= k - 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            given = np.log10(counts[k - 1] / context) + np.log10(alpha) * np.maximum(0, np.minimum(order - 1, place) - (k - 1))
        log = np.where(use, given, log)
    ends = np.cumsum(size)
    score = np.array([log[x:y].sum() for x, y in zip((ends - size).tolist(), ends.tolist(), strict=True)], np.float64)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        perplexity = np.where(size > 0, 10 ** (-score / np.maximum(size, 1)), np.nan)
    return pa.table({"key": docs["key"], "n_words": size, "score": score.astype(np.float64), "perplexity": pa.array(perplexity, pa.float64(), mask=size == 0)})


def score(df: DataFrame, order: int = ORDER, alpha: float = ALPHA, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, score (sum of log10), perplexity (null without words)."""
    rows = pick(df, key=key, text=text)
    kind = rows.schema["key"].dataType.simpleString()
    sums = arrow_map(rows, lambda b: {"bytes": [sum(len(t or b"") for t in text_bytes(b))], "words": [sum(len(words(t)) for t in text_bytes(b))]}, "bytes long, words long").agg(F.sum("bytes").alias("bytes"), F.sum("words").alias("words")).first()
    batches = int((sums["bytes"] or 0) // BATCH) + 1
    parts, n = PARTS * batches, int(sums["words"] or 0)
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("key", "text"), F.lit(batches)).cast("int"))
    asked_kind, answer_kind = "part int, batch int, grams binary, counts binary", "batch int, part int, question int, totals binary"
    asked = dealt.groupBy("batch").applyInArrow(lambda t: _ask(t, parts), asked_kind)
    answers = asked.groupBy("part").applyInArrow(_answering(2), answer_kind)
    for k in range(3, order + 1):
        more = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_asking(parts, k, least), asked_kind)
        answers = answers.unionByName(more.groupBy("part").applyInArrow(_answering(k), answer_kind))
    scored = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(lambda d, a: _score(d, a, parts, order, alpha, least, n), f"key {kind}, n_words long, score double, perplexity double")
    return scored.withColumnRenamed("key", key)
