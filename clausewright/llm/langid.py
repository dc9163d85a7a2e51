"""Operator 2: language identification by prediction by partial matching (PPM, escape method C with exclusion).

For every language a context tree over lower-cased UTF-8 bytes holds, for each context of 0 to `order` bytes, how often
each byte followed it in the training rows.  The statistics are then frozen, so the code length of a byte given its context is a
fixed number: the probability in the longest known context, or its escape probability times the probability in the
next shorter one without the bytes already ruled out, down to equal shares of the bytes never seen.
All of this is tabulated once: `state` maps any `order` bytes to the longest context that the tree holds, `cost` gives that
context's code lengths in bits.  A text is scored by two look-ups a byte, over the whole text, in any number of languages at once.
The language of least total code length wins; the score is its posterior probability under equal priors.

Training reads a bounded sample: at most about `rows_per_language` whole rows and `bytes_per_language` bytes of each language, chosen by a hash of
key and text, and keeps at most `max_contexts` contexts, of which every language names an equal share, its own most frequent ones.  Every language is
learned; the table of code lengths grows with their number.  Prediction covers every row.

A null text or one without a letter is `und` with score 0; nulls in the language column are not learned from; repeated rows are
learned from as often as they are drawn; equal code lengths (ties) go to the alphabetically first language; very long
texts are scored whole, STEP positions at a time; columns of other names are ignored.  Without any training row every prediction is
`und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fraction_column, pick, text_bytes

ORDER = 3
ROWS_PER_LANGUAGE, BYTES_PER_LANGUAGE = 400, 4 << 20
MAX_CONTEXTS = 40_000
PAD = b"\n" * ORDER
_LETTER = regex.compile(r"\p{L}")
#: Positions scored in one step.
STEP = 1 << 19


@dataclass(frozen=True)
class Model:
    languages: list[str]
    classes: np.ndarray  # byte -> class; bytes never seen in training share class 0
    state: np.ndarray  # class trigram -> context
    cost: np.ndarray  # (contexts * classes, languages) bits


def _grams(texts: list[bytes]) -> np.ndarray:
    """Each byte with its three predecessors, packed into 32 bits, over padded texts."""
    if not texts:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(b"".join(PAD + t for t in texts), np.uint8).astype(np.uint32)
    packed = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    lengths = np.array([len(t) + ORDER for t in texts])
    ends = np.cumsum(lengths)
    keep = np.ones(len(raw), bool)
    for k in range(ORDER):
        keep[ends - lengths + k] = False  # the padding itself isn't predicted
    return packed[keep[ORDER:]]


def _lower(raw: bytes) -> bytes:
    return raw.decode("utf-8", "replace").lower().encode()


def counts(sample: DataFrame) -> DataFrame:
    """(lang, gram, n) over the sample's whole texts; gram: a byte with its three predecessors."""

    def run(batch: pa.RecordBatch) -> dict:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        texts = [_lower(t or b"") for t in text_bytes(batch)]
        out: dict = {"lang": [], "gram": [], "n": []}
        for lang in sorted(set(langs)):
            gram, n = np.unique(_grams([t for t, x in zip(texts, langs, strict=True) if x == lang]), return_counts=True)
            out["lang"] += [lang] * len(gram)
            out["gram"] += gram.tolist()
            out["n"] += n.tolist()
        return out

    return arrow_map(sample, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def tabulate(rows: pa.Table, max_contexts: int = MAX_CONTEXTS) -> Model:
    """The frozen model from a table of lang, gram, n."""
    if not rows.num_rows:
        return Model([], np.zeros(256, np.int32), np.zeros(0, np.int32), np.zeros((0, 0), np.float32))
    languages, lang = np.unique(rows["lang"].to_numpy().astype(object), return_inverse=True)
    languages = languages.tolist()
    gram, n = rows["gram"].to_numpy().astype(np.int64), rows["n"].to_numpy().astype(np.float64)
    seen = np.unique(np.concatenate([gram >> s & 255 for s in (0, 8, 16, 24)]))
    classes = np.zeros(256, np.int32)
    classes[seen] = np.arange(1, len(seen) + 1)
    a = len(seen) + 1
    multiplicity = np.ones(a)
    multiplicity[0] = 256 - len(seen)
    g = [classes[gram >> s & 255].astype(np.int64) for s in (24, 16, 8, 0)]
    # contexts of each order by the classes of their bytes; id 0 is the empty context
    keys = {1: g[2], 2: g[1] * a + g[2], 3: (g[0] * a + g[1]) * a + g[2]}
    used, size, left = {}, {}, np.full(len(languages), max(1, max_contexts // len(languages)))
    for order in (1, 2, 3):
        chosen = []
        for k in range(len(languages)):
            key, inverse = np.unique(keys[order][lang == k], return_inverse=True)
            weight = np.bincount(inverse, n[lang == k])
            chosen.append(key[np.argsort(-weight, kind="stable")[: left[k]]])
            left[k] -= len(chosen[-1])
        used[order] = np.unique(np.concatenate(chosen))
        size[order] = len(used[order])
    first = {0: 0, 1: 1, 2: 1 + size[1], 3: 1 + size[1] + size[2]}
    n_states = 1 + sum(size.values())

    def place(order: int, key: np.ndarray) -> np.ndarray:
        if order == 0:
            return np.zeros(len(key), np.int64)
        at = np.searchsorted(used[order], key).clip(0, max(0, size[order] - 1))
        known = used[order][at] == key if size[order] else np.zeros(len(key), bool)
        return np.where(known, first[order] + at, -1)

    # longest known context of every class trigram: orders 1, 2 and 3 in turn overwrite
    state = np.zeros((a, a, a), np.int32)
    for order in (1, 2, 3):
        for width, base in ((order, first[order]),):
            key = used[order]
            ids = np.arange(base, base + len(key), dtype=np.int32)
            if width == 1:
                state[:, :, key] = ids
            elif width == 2:
                state[:, key // a, key % a] = ids
            else:
                state.reshape(-1)[key] = ids
    cost = np.zeros((n_states, a, len(languages)), np.float32)
    for k in range(len(languages)):
        own = lang == k
        tables = {}
        for order in range(4):
            ids = place(order, keys[order][own] if order else gram[own])
            ok = ids >= 0
            flat = np.bincount((ids[ok] - first[order]) * a + g[3][own][ok], n[own][ok], minlength=max(1, size.get(order, 1)) * a)
            tables[order] = flat.reshape(-1, a)
        for order in range(4):
            total = 1 if order == 0 else size[order]
            for lo in range(0, total, 4096):
                here = np.arange(lo, min(total, lo + 4096))
                bits = np.zeros((len(here), a))
                out = np.zeros((len(here), a), bool)  # bytes ruled out so far
                escaped = np.zeros(len(here))
                suffix = here
                for lower in range(order, -1, -1):
                    if lower < order:
                        if lower == 0:
                            suffix = np.zeros(len(here), np.int64)
                        else:
                            suffix = place(lower, used[order][here] % a**lower) - first[lower]
                    got = np.where((suffix >= 0)[:, None], tables[lower][np.maximum(suffix, 0)], 0.0)
                    got[out] = 0
                    kinds, mass = (got > 0).sum(1), got.sum(1)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        bits = np.where(got > 0, escaped[:, None] - np.log2(got / (mass + kinds)[:, None]), bits)
                        escaped = np.where(kinds > 0, escaped - np.log2(kinds / (mass + kinds)), escaped)
                    out |= got > 0
                left = ((~out) * multiplicity).sum(1)
                bits = np.where(out, bits, (escaped + np.log2(np.maximum(left, 1)))[:, None])
                cost[first[order] + here, :, k] = bits
    return Model(languages, classes, state.reshape(-1), cost.reshape(-1, len(languages)))


def fit(df: DataFrame, lang: str = "lang", text: str = "text", rows_per_language: int = ROWS_PER_LANGUAGE, bytes_per_language: int = BYTES_PER_LANGUAGE, max_contexts: int = MAX_CONTEXTS, key: str = "doc_id") -> Model:
    """Learn from rows with a language.  Only counts of the bounded sample reach the driver."""
    rows = pick(df, lang=lang, text=text, key=key).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()
    if not sizes:
        return tabulate(pa.table({"lang": [], "gram": [], "n": []}))
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, rows_per_language / r["n"], bytes_per_language / max(1, r["size"]))))])
    sample = rows.where(fraction_column(F.col("key"), F.col("text"), F.lit(5)) < F.element_at(share, F.col("lang"))).select("lang", "text")
    return tabulate(counts(sample).toArrow(), max_contexts)


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each whole text in each language."""
    total = np.zeros((len(texts), len(model.languages)))
    a = int(model.classes.max()) + 1

    def parts() -> Iterator[tuple[list[int], list[bytes]]]:
        ids, held, size = [], [], 0
        for i, t in enumerate(texts):
            for at in range(0, len(t), STEP):  # a long text goes on with the bytes before as its context
                piece = (t[at - ORDER : at] if at else PAD) + t[at : at + STEP]
                ids.append(i)
                held.append(piece)
                size += len(piece)
                if size >= STEP:
                    yield ids, held
                    ids, held, size = [], [], 0
        if held:
            yield ids, held

    for ids, held in parts():
        c = model.classes[np.frombuffer(b"".join(held), np.uint8)]
        at = model.state[(c[:-3] * a + c[1:-2]) * a + c[2:-1]].astype(np.int64) * a + c[3:]
        lengths = np.array([len(x) for x in held])
        ends = np.cumsum(lengths)
        bits = model.cost[at]
        begin = ends - lengths
        for k in range(1, ORDER):  # what predicts a later piece's padding
            bits[begin[1:] - ORDER + k] = 0
        bits[begin[1:] - ORDER] = 0
        sums = np.add.reduceat(bits, begin, axis=0, dtype=np.float64)
        np.add.at(total, ids, sums)
    return total


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, lang_pred, score."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # its size is bounded by max_contexts and 256 classes for each language

    def run(batch: pa.RecordBatch) -> dict:
        m = shared.value
        raw = [(t or b"").decode("utf-8", "replace") for t in text_bytes(batch)]
        some = [i for i, t in enumerate(raw) if m.languages and _LETTER.search(t)]
        lang, score = ["und"] * len(raw), [0.0] * len(raw)
        if some:
            bits = code_lengths(m, [raw[i].lower().encode() for i in some])
            best = bits.argmin(1)
            p = 1 / np.exp2(np.clip(bits.min(1, keepdims=True) - bits, -1000, 0)).sum(1)
            for i, k, x in zip(some, best.tolist(), p.tolist(), strict=True):
                lang[i], score[i] = m.languages[k], x
        return {"key": batch.column(0), "lang_pred": lang, "score": score}

    rows = pick(df, key=key, text=text)
    return arrow_map(rows, run, f"key {rows.schema['key'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("key", key)


def held_out(key: Column) -> Column:
    """A fixed quarter of the rows by CRC-32 of the key's text, never learned from."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
