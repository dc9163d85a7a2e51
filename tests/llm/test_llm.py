"""The ten operators against SQL, brute force and round trips, over small tables with nulls, empty and repeated rows and odd columns."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clausewright.llm import bpe, decontaminate, langid, licenses, lm_score, minhash, quality, registry, sharding, suffix_dedup, warc
from tests.conftest import SF, same

ODD = "doc_id long, text string, lang string, key string, _key string, text_hash long, spans string, band long, batch int, n_chars long, source string"


def odd(spark, rows):
    """Documents with columns that carry the operators' inner names."""
    return spark.createDataFrame([(k, t, "en", "k", "k", 1, "s", 2, 3, len(t or ""), None) for k, t in rows], ODD)


ROWS = [(1, "a b c d e f g h"), (2, None), (3, ""), (1, "a b c d e f g h"), (None, "x y"), (4, "é " * 3000), (5, "word " * 20000), (6, "\n \t")]


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    a, b = same(registry.QUERIES[name](spark, SF), duck, registry.ORACLE_SQL[name])
    assert a == b


@pytest.mark.parametrize("rows", [ROWS, []], ids=["odd", "empty"])
def test_odd_rows(spark, rows):
    df = odd(spark, rows)
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    items = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, ""), (3, "x y")], "item_id long, text string")
    n = len(rows)
    assert quality.cascade(df, quality.plan(quality.estimate(df)), ["n_words"]).count() == n
    assert langid.predict(df, langid.fit(df)).count() == n
    assert lm_score.score(df).count() == n
    assert licenses.scan(df).count() == n
    assert suffix_dedup.remove_repeats(df).count() == n
    assert bpe.digests(bpe.encode(df, path, pattern), path, pattern).count() == n
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(df, items).collect()} == ({(1, 1), (None, 3)} if n else set())
    assert sharding.number(sharding.shard(df, 7, grown=8), ["doc_id", "text_crc32", "size"]).count() == n
    assert minhash.near_duplicates(df, 2).count() == n
    pages = df.withColumnRenamed("doc_id", "page_id").withColumn("url", F.col("source")).withColumnRenamed("text", "html")
    assert warc.derive(warc.responses(pages), keep="page_id").count() == 2 * n
    for kept in (quality.filter_documents(df), minhash.keep_one(df), suffix_dedup.clean(df), decontaminate.clean(df, items)):
        assert kept.columns == df.columns and kept.count() <= n
    assert minhash.keep_one(df).count() == n - bool(n)


def test_values_of_odd_rows(spark):
    """What each operator gives for nulls, empty and repeated rows and a text of over 1 MB, worked out here."""
    import hashlib
    import zlib

    import tiktoken

    long = " ".join(f"w{i * i % 9973} v{i % 4999}" for i in range(100_000))
    assert len(long) > 1_000_000
    rows = [*ROWS, (7, long)]
    df, raw = odd(spark, rows), [(k, (t or "").encode()) for k, t in rows]
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN

    def base_failed(w):
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = Counter(tri)
        return len(w) < 50 or 100 * len({i + j for i, x in enumerate(tri) if often[x] > 1 for j in range(3)}) > 50 * len(w)

    seen = quality.cascade(df, quality.plan(quality.estimate(df)), ["n_words"]).collect()
    assert Counter((r.doc_id, r.n_words, r.base_failed) for r in seen) == Counter((k, len(t.split()), base_failed(t.split())) for k, t in raw)
    named = langid.predict(df, langid.fit(df)).collect()
    assert Counter((r.doc_id, r.lang_pred) for r in named) == Counter((k, "en" if t.strip() else "und") for k, t in raw)
    assert all(0 < r.score <= 1 if r.lang_pred == "en" else r.score == 0 for r in named)
    scored = lm_score.score(df).collect()
    assert Counter((r.doc_id, r.n_words, r.perplexity is None) for r in scored) == Counter((k, len(t.split()), not t.split()) for k, t in raw)
    assert len({r.score for r in scored if r.doc_id == 1}) == 1 and all(r.score == 0 for r in scored if not r.n_words)
    found = licenses.scan(df).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found) == Counter((k, len(re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())), 0, None, None, "") for k, t in raw)
    codec = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=bpe.ranks(path), special_tokens={})
    ids = [(k, t, np.array(codec.encode_ordinary(t.decode()), "<u4")) for k, t in raw]
    made = bpe.digests(bpe.encode(df, path, pattern, decoded=True), path, pattern).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in made) == Counter((k, len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256(t).hexdigest()) for k, t, x in ids)
    placed = sharding.number(sharding.shard(df, 7, grown=8), ["doc_id", "text_crc32", "size"]).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in placed) == Counter((k, len(t) + 16, zlib.crc32(t)) for k, t in raw)
    assert len({(r.shard, r.grown_shard) for r in placed if r.doc_id == 1}) == 1 and all(r.grown_shard in (r.shard, 7) for r in placed)
    slots = defaultdict(list)
    for r in placed:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    pairs = lambda w: len({tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))}) if w else 0
    near = minhash.near_duplicates(df, 2).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near) == Counter((k, pairs(t.lower().split()), k, True) for k, t in raw)


def test_order_of_rules_doesnt_change_verdicts(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    a = {r.doc_id: r.kept for r in quality.cascade(df, list(quality.RULES)).collect()}
    b = {r.doc_id: r.kept for r in quality.cascade(df, list(reversed(quality.RULES))).collect()}
    assert a == b and 0 < sum(a.values()) < len(a)


def test_rules_go_by_rejection_per_cost():
    rules = quality.RULES[:3]
    est = [{"rejection": 0.1, "cost": 1.0}, {"rejection": 0.5, "cost": 1.0}, {"rejection": 0.4, "cost": 0.1}]
    assert quality.plan(est, rules) == [rules[2], rules[1], rules[0]]


def test_ppm_code_lengths_are_probabilities_and_a_plain_ppm_agrees():
    texts = {"x": [b"abracadabra", b"abba"], "y": [b"zyxzyx", b"cab"]}
    rows = [(k, int(g), int(n)) for k, v in texts.items() for g, n in zip(*np.unique(langid._grams(v), return_counts=True), strict=True)]
    import pyarrow as pa

    model = langid.tabulate(pa.table({c: [r[i] for r in rows] for i, c in enumerate(("lang", "gram", "n"))}))
    a = int(model.classes.max()) + 1
    weight = np.array([256 - (a - 1)] + [1] * (a - 1))
    assert np.allclose((2.0 ** -model.cost.reshape(-1, a, 2).astype(float) * weight[None, :, None]).sum(1), 1, atol=1e-4)
    seen = [defaultdict(Counter) for _ in range(4)]
    for t in texts["x"]:
        p = langid.PAD + t
        for i in range(3, len(p)):
            for k in range(4):
                seen[k][p[i - k : i]][p[i]] += 1

    def bits(t):
        p, total = langid.PAD + t, 0.0
        for i in range(3, len(p)):
            out, prob = set(), 1.0
            for k in range(3, -1, -1):
                c = {s: n for s, n in seen[k][p[i - k : i]].items() if s not in out}
                if p[i] in c:
                    prob *= c[p[i]] / (sum(c.values()) + len(c))
                    break
                if c:
                    prob *= len(c) / (sum(c.values()) + len(c))
                    out |= set(c)
            else:
                prob /= 256 - len(out)
            total -= np.log2(prob)
        return total

    probe = [b"abracab", b"zebra\xff", b"q"]
    assert np.allclose(langid.code_lengths(model, probe)[:, 0], [bits(t) for t in probe], atol=1e-3)


def test_language_accuracy_on_rows_never_learned_from(spark):
    d = "/root/testdata/sf0.01"
    got = registry.QUERIES["op2_language_id"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()


def test_more_than_64_languages_are_learned(spark):
    letters = "abcdefghijkl"
    words = {f"l{a}{b}": f"{a}{b}{b}{a}{a}{b}" for a in letters for b in letters if a < b}  # 66 languages of one word each
    rows = [(k, f"{w} " * 12, x) for k, (x, w) in enumerate(words.items())]
    rows += [(1000 + k, f"{w} " * 12, x) for k, (x, w) in enumerate(words.items()) if k]  # the first is the rarest
    df = spark.createDataFrame([*rows, (5000, "no language", None)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert set(model.languages) == set(words) and len(words) > 64
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, model).collect()}
    assert all(got[k] == x for k, _, x in rows)


def test_licence_rules(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "CC-BY-NC 4.0 and the MIT License; MIT license", "GNU General Public License, version 3 or later", "mit der", "All Rights Reserved.", ("MIT License. " * 500)]
    got = {r.doc_id: r for r in licenses.scan(odd(spark, list(enumerate(texts)))).collect()}
    assert got[0].labels == "apache,apache-2.0" and got[0].n_base == 1 and got[0].first_word == 3
    assert got[1].labels == "cc-by,cc-by-nc-4.0,mit" and (got[1].n_base, got[1].first_word, got[1].last_word, got[1].n_words) == (3, 0, 9, 11)  # cc by nc 4 0 and the mit license mit license
    assert got[2].labels == "gpl,gpl-3.0-or-later" and got[3].labels == "" and got[4].labels == "all-rights-reserved" and got[5].n_base == 500


def test_base_phrases_by_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in registry.QUERIES["op4_license_scan"](spark, SF).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r.doc_id].translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
        at = sorted((i, label) for _, p, label in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))


def brute_licences(text):
    """All detections and those kept, from the rules as written: every rule over the words' line, containment tested pair by pair."""
    line = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(licenses.UPPER, licenses.LOWER))))
    found = []
    for n, r in enumerate(licenses.rules()):
        for m in re.finditer(f"(?<![^ ])(?:{r.regex})(?![^ ])", line):
            start = line[: m.start()].count(" ")
            found.append((start, start + m[0].count(" ") + 1, r.priority, n, r.label, r.score, r.base))
    better = lambda e, d: e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2] and (e[:3] != d[:3] or e[3] < d[3])
    return sorted(found), sorted(d for d in found if not any(better(e, d) for e in found if e is not d))


LICENCE_TEXTS = [
    "Licensed under the GNU General Public License, version 2 or (at your option) any later version; see the GPL. The MIT License, mit license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND. In no event shall the authors or copyright holders be liable for any claim",
    "Redistribution and use in source and binary forms, with or without modification, are permitted. BSD 3-Clause License, new BSD, BSD license",
    "SPDX-License-Identifier: GPL-2.0-or-later; SPDX-License-Identifier: Foo; Apache-2.0; Apache License; GPLv3 or later",
    "Creative Commons Attribution-ShareAlike 4.0 International, CC BY-SA 3.0, CC BY, CC0 1.0 Universal. Some rights reserved",
    "under the terms of the GNU Lesser General Public License version 2.1 as published; LGPL 2.1; This is free and unencumbered software released into the public domain",
    "Proprietary and confidential. All rights reserved. Mozilla Public License 2.0, MPL 2.0, Eclipse Public License 1.0 gnu general public license gnu general public licence v3",
    "mit der Lizenz license", "", "licence", "cc by cc by nc 4 0 cc by",
]


def test_licence_detections_by_brute_force(spark):
    rng = random.Random(3)
    pieces = [p for t in LICENCE_TEXTS for p in re.split(r"(?<=[.;,]) ", t)]
    texts = LICENCE_TEXTS + [" ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    got = {r.doc_id: r for r in licenses.detections(odd(spark, list(enumerate(texts)))).collect()}
    rows = lambda x: [(d.start, -d.neg_stop, d.priority, d.rule, d.label, d.score, d.base) for d in x or ()]
    for k, t in enumerate(texts):
        found, kept = brute_licences(t)
        assert (sorted(rows(got[k].found)), sorted(rows(got[k].kept))) == (found, kept), t
    by_scan = {r.doc_id: r for r in licenses.scan(odd(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        found, kept = brute_licences(t)
        assert by_scan[k].labels == ",".join(sorted({d[4] for d in kept} | {d[4] for d in found if d[6]})) and by_scan[k].score == max((d[5] for d in kept), default=0.0)


def test_licence_rules_hold_their_keywords():
    rules = licenses.rules()
    assert len(rules) > 300 and len({r.regex for r in rules if not r.base}) == len(rules) - len(licenses.BASE)
    for r in rules:  # a choice all of whose branches hold the keyword holds it
        own = re.sub(r"\(\?:([^()]*)\)(?!\?)", lambda m: f" {r.family} " if all(re.search(rf"\b{r.family}\b", x) for x in m[1].split("|")) else m[0], re.sub(r"\(\?:(2\|two|3\|three|4\|four|new\|revised\|modified|original\|old)\)", "x", r.regex))
        assert r.family in re.findall(r"[0-9a-z]+", licenses.certain(own).replace("licen[cs]e", "license")), r.regex


def test_licence_scan_of_long_texts(spark):
    import time

    texts = ["MIT License, " * 80_000, "cc by nc 4.0 " * 60_000, "gnu " * 250_000, "permission is hereby granted " * 40_000]
    begin = time.perf_counter()
    got = {r.doc_id: r for r in licenses.scan(odd(spark, list(enumerate(texts)))).collect()}
    assert time.perf_counter() - begin < 60
    assert got[0].n_base == 80_000 and got[0].last_word == 159_998 and got[0].n_kept == 80_000 and got[1].n_base == 60_000 and got[2].n_found == 0


def brute_repeats(docs, m, first):
    where = defaultdict(list)
    for k, t in docs:
        for i in range(len(t) - m + 1):
            where[t[i : i + m]].append((k, i))
    out = {}
    for k, t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - m + 1):
            own = where[t[i : i + m]]
            if len(own) > 1 and not (first and min(own) == (k, i)):
                gone[i : i + m] = b"\1" * m
        out[k] = bytes(b for b, g in zip(t, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_backoff_scores_use_every_count(spark, monkeypatch, order):
    monkeypatch.setattr(lm_score, "BATCH", 400)
    rng = random.Random(order)
    docs = [(k, " ".join(rng.choice("abcdefghijklmnopqrst"[: 4 + k // 3]) for _ in range(rng.randrange(30)))) for k in range(40)] + [(90, "only here once"), (91, None), (92, "a b c d"), (92, "a b c d")]
    own = [(k, (t or "").split()) for k, t in docs]
    count = Counter(tuple(w[i : i + n]) for _, w in own for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(len(w) for _, w in own)

    def one(w, i):
        longest = min(order, i + 1)
        n = next(n for n in range(longest, 0, -1) if count[tuple(w[i - n + 1 : i + 1])] > 0)
        return np.log10(count[tuple(w[i - n + 1 : i + 1])] / (count[tuple(w[i - n + 1 : i])] if n > 1 else total)) + np.log10(0.4) * (longest - n)

    expected = sorted((k, len(w), round(float(sum(one(w, i) for i in range(len(w)))), 6)) for k, w in own)
    got = sorted((r.doc_id, r.n_words, round(r.score, 6)) for r in lm_score.score(spark.createDataFrame(docs, "doc_id long, text string"), order=order).collect())
    assert [x[:2] for x in got] == [x[:2] for x in expected] and np.allclose([x[2] for x in got], [x[2] for x in expected], atol=1e-5)


@pytest.mark.parametrize("group", [256, 2])
@pytest.mark.parametrize("first", [False, True])
def test_repeats_by_brute_force(spark, monkeypatch, group, first):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    if group == 2:  # pieces and blocks of a few windows
        monkeypatch.setattr(suffix_dedup, "PIECE", 64)
        monkeypatch.setattr(suffix_dedup, "BLOCK", 200)
    rng = random.Random(group)
    pool = ["".join(rng.choice("abcdé \n") for _ in range(rng.randrange(5, 160))) for _ in range(12)]
    texts = ["".join(rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(8))) for _ in range(80)] + ["ab" * 200, "x" * 150]
    docs = list(enumerate(texts))
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(odd(spark, docs), 40, first).collect()}
    assert got == brute_repeats([(k, t.encode()) for k, t in docs], 40, first)


def test_suffix_query_on_planted_passages(spark, tmp_path):
    """The query itself at 400 bytes, on documents with passages that they share, repeated rows, nulls and long runs of one letter."""
    import hashlib

    rng = random.Random(9)
    own = lambda n: " ".join("".join(rng.choice("abcdefghijklé") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passages = [own(rng.randrange(70, 160)) for _ in range(6)]
    docs = [(k, f"{own(60)} {passages[k % 6]} {own(80)}") for k in range(30)] + [(100 + k, own(300)) for k in range(8)]
    docs += [(200, None), (201, ""), (202, "ab" * 700), (203, own(40) + "xyz" * 300), (204, docs[0][1]), (205, passages[0])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = brute_repeats([(k, (t or "").encode()) for k, t in docs], 400, False)
    got = {r.doc_id: r for r in registry.QUERIES["op5_suffix_dedup"](spark, str(tmp_path)).collect()}
    for k, t in docs:
        r, left = got[k], expected[k]
        assert (r.n_bytes, r.n_removed, r.n_kept, r.kept_sha256) == (len((t or "").encode()), len((t or "").encode()) - len(left), len(left), hashlib.sha256(left).hexdigest())
        assert 100 <= k < 200 or len(left) < len((t or "").encode()) or k in (200, 201)
        assert r.text == left.decode("utf-8", "replace")


def test_suffix_query_takes_strings_of_400_bytes_and_no_shorter_ones(spark, tmp_path):
    """A passage of over 50 words and 399 bytes stays in each copy, one of 400 goes from all; the operator at 200 bytes takes both."""
    rng = random.Random(10)
    own = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    short, long = own(99)[:398] + "k", own(99)[:399] + "k"
    assert len(short.split()) > 50
    docs = [(k, f"{own(40)}{'ABCD'[k]}{(short, long)[k % 2]}{'EFGH'[k]}{own(40)}") for k in range(4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.text) for r in registry.QUERIES["op5_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert got == {k: (0, t) if k % 2 == 0 else (400, t.replace(long, "")) for k, t in docs}
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(df, 200).collect()} == {0: 399, 1: 400, 2: 399, 3: 400}


def test_a_long_text_of_one_letter(spark):
    """A text of 2 MB of one letter is one run of two rows, not a row a window."""
    docs = [(1, "x" * 2_000_000), (2, "y" * 300), (3, "x" * 500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, len(r.spans), r.n_bytes) for r in suffix_dedup.remove_repeats(df, 400).collect()}
    assert got == {1: (2_000_000, 1, 2_000_000), 2: (0, 0, 300), 3: (500, 1, 500)}
    first = {r.doc_id: r.text for r in suffix_dedup.clean(df, 400).collect()}
    assert first == {1: "x", 2: "y" * 300, 3: ""}  # each window but the first starts later than an equal one


@pytest.mark.parametrize("group", [256, 2])
def test_first_copies_stay_where_rows_repeat(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = random.Random(8)
    own = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passages = [own(90) for _ in range(4)]
    docs = [(k, own(50) + passages[k % 4] + own(50)) for k in range(12)]
    expected = {k: t.decode() for k, t in brute_repeats([(k, t.encode()) for k, t in docs], 40, True).items()}
    assert all(passages[k] in expected[k] for k in range(4)) and not any(passages[k % 4] in expected[k] for k in range(4, 12))
    rows = docs + docs[:3] + docs[:1] + docs[6:8]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in suffix_dedup.clean(df, 40).collect()) == sorted((k, expected[k]) for k, _ in rows)


def test_suffix_classes_order_suffixes():
    raw = np.frombuffer(b"mississippi mississippi", np.uint8)
    rank = suffix_dedup.suffix_classes(raw, 9)
    key = [bytes(raw[i : i + 9]) for i in range(len(raw))]
    assert all((rank[i] < rank[j]) == (key[i].ljust(9, b"\0") < key[j].ljust(9, b"\0")) for i in range(len(key)) for j in range(len(key)))


def test_bpe_equals_tiktoken():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.codec(path, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    rng = random.Random(4)
    alphabet = list("aab're'sll'vedm é語1²\U0001f600\n\n  \t \xa0!?''\x1c\0") + ["<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["", "a" * 5000]
    ids = own.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [other.encode_ordinary(t) for t in texts]
    assert [own.decode(x) for x in ids] == [t.encode() for t in texts]
    assert own.offsets(ids[-1])[-1] == 5000


def brute_matches(docs, items):
    """(document, item) pairs at a weighted similarity of 0.8, written from the definition alone: tuples, Counters, every window."""
    import math

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
    five = lambda w: Counter(tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1))
    own = [(k, split(t)) for k, t in items if split(t)]
    held = Counter(g for _, w in own for g in five(w))
    weight = lambda g: math.log(1 + len(own) / max(1, held[g]))
    found = {}
    for d, t in docs:
        w = split(t)
        for k, item in own:
            b, n, m = five(item), min(len(item), len(w)), min(5, len(item))
            if not b.keys() & {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}:
                continue
            for i in range(len(w) - n + 1 if n else 0):
                a = five(w[i : i + n])
                if a.keys() & b.keys():
                    s = sum(v * weight(g) for g, v in (a & b).items()) / sum(v * weight(g) for g, v in (a | b).items())
                    if s >= 0.8 - 1e-9 and s > found.get((d, k), (0,))[0] + 1e-12:
                        found[d, k] = s, i, n
    return found


def test_decontamination_by_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rng = random.Random(5)
    for k, t in items[:8]:  # with a word changed, and with one more at the end
        w = t.split()
        docs += [(1000 + k, "front words here " + " ".join([*w[:-1], "changed"]) + " back"), (2000 + k, " ".join(rng.sample(w, len(w))))]
    docs += [(3000, f"{items[0][1]} and {items[1][1]} and {items[0][1]}"), (3001, None), (3002, "")]
    expected = brute_matches(docs, items)
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.first_word, r.n_words) for r in got} == {k: v[1:] for k, v in expected.items()} and expected
    assert all(abs(r.similarity - expected[r.doc_id, r.item_id][0]) < 1e-9 for r in got)
    assert all((1000 + k, k) in expected and (2000 + k, k) not in expected for k, t in items[:8] if len(t.split()) > 30)


def test_every_fingerprint_within_the_radius_is_found():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 256, (300, decontaminate.PARTS), dtype=np.uint8)
    asked = []
    for n in (0, 5, 46, 47, 48):
        for x in prints[:60]:
            bits = np.unpackbits(x)
            bits[rng.choice(decontaminate.BITS, n, replace=False)] ^= 1
            asked.append(np.packbits(bits))
    none = np.zeros(300, np.int64)
    got = set(zip(*(x.tolist() for x in decontaminate.Blocks(prints, none).near(np.array(asked), none)), strict=True))
    whole = lambda x: int.from_bytes(x.tobytes(), "big")
    assert got == {(i, k) for i, x in enumerate(asked) for k, y in enumerate(prints) if (whole(x) ^ whole(y)).bit_count() <= decontaminate.RADIUS} and len(got) >= 240


def test_decontamination_of_texts_shorter_than_the_item(spark):
    items = [(k, " ".join(f"w{k}x{i}" for i in range(39))) for k in range(4)] + [(9, "one two three four five six")]
    cuts = [(39 * k + n, k, t.split()[a : a + n]) for k, t in items[:4] for n in range(1, 39) for a in (0, 39 - n)[k % 2 :][:1]]
    docs = [(i, " ".join(w)) for i, _, w in cuts] + [(900, "one two three four five"), (901, ""), (902, None)]
    five = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    expected = set()  # every shingle is in one item, so all weigh the same
    for d, t in docs:
        for k, own in items:
            a, b = five((t or "").split()), five(own.split())
            if t and sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                expected.add((d, k))
    docs_, items_ = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(docs_, items_).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected and (38, 0) in expected
    assert all(r.first_word == 0 and r.n_words == len(dict(docs)[r.doc_id].split()) for r in got)
    assert {r.doc_id for r in decontaminate.clean(docs_, items_).collect()} == {d for d, _ in docs} - {d for d, _ in expected}


def test_decontamination_whatever_the_number_of_blocks(spark, monkeypatch):
    rng = random.Random(6)
    common = [f"c{i}" for i in range(24)]  # a passage that all items share, so its weight depends on how many are counted
    items = [(k, " ".join([*common, *(f"i{k}x{j}" for j in range(rng.randrange(8, 30)))])) for k in range(24)] + [(90, "three short words"), (91, None)]
    docs = []
    for k, t in items[:24]:
        w = t.split()
        docs += [(100 * k + n, " ".join(["front", *common[n:], *w[24:], "back"])) for n in range(1, 20)] + [(100 * k + 40 + n, " ".join(w[: len(w) - n])) for n in range(8)]
    docs_, items_ = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda: sorted((r.doc_id, r.item_id, r.similarity, r.first_word, r.n_words) for r in decontaminate.matches(docs_, items_).collect())
    whole = found()
    assert 0 < len(whole) < len(docs) and {x[:2] for x in whole} == set(brute_matches(docs, items))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", sum(len(t or "") for _, t in items) // 4)
    assert len(decontaminate._blocks(items_.where("text IS NOT NULL"))) > 3
    blocks = found()
    assert [x[:2] + x[3:] for x in blocks] == [x[:2] + x[3:] for x in whole] and np.allclose([x[2] for x in blocks], [x[2] for x in whole], atol=1e-12)
    assert {r.doc_id for r in decontaminate.clean(docs_, items_).collect()} == {d for d, _ in docs} - {x[0] for x in whole}


def test_warc_links_digests_and_round_trip(spark):
    page = "<html lang='fr'><head><title>A &amp; B</title><script>var x='</p>'</script></head><body><p>One<br>Two &lt;3</p><!-- gone --><a href=\"/x\">link</a></body></html>"
    src = warc.responses(spark.createDataFrame([(1, "http://a/b", page), (2, None, None)], "page_id long, url string, html string"))
    made = warc.derive(src, keep="page_id")
    rows = {(r.page_id, r.warc_type): r for r in made.collect()}
    conv, meta = rows[1, "conversion"], rows[1, "metadata"]
    assert bytes(conv.block).decode() == "One\nTwo <3\nlink" and conv.refers_to == meta.refers_to == src.where("page_id = 1").first().record_id
    assert b"title: A & B\r\n" in bytes(meta.block) and b"outlink: /x\r\n" in bytes(meta.block) and conv.payload_digest == warc.digest(page.encode())
    back = warc.parse(b"".join(bytes(r.member) for r in warc.serialise(made.where("page_id = 1")).collect()))
    assert {x["warc-record-id"] for x in back} == {conv.record_id, meta.record_id} and all(warc.digest(x["block"]) == x["warc-block-digest"] for x in back)


def test_warc_derivatives_keep_the_source_headers(spark):
    own = ["Content-Type: text/html; charset=utf-8", "Last-Modified: Tue, 02 Jan 2024 00:00:00 GMT", "Content-Language: fr", "Set-Cookie: a=1", "Set-Cookie: b=2"]
    head = "\r\n".join(["HTTP/1.1 203 Other", *own, "X-Folded: one", "\ttwo"])
    src = spark.createDataFrame([("<urn:a>", "http://a/", warc.DATE, head, b"<p>x"), ("<urn:b>", None, warc.DATE, None, None)], "record_id string, target_uri string, warc_date string, http_headers string, payload binary")
    made = warc.derive(src)
    back = [x for r in warc.serialise(made).collect() for x in warc.parse(bytes(r.member))]
    meta = {x["warc-refers-to"]: x["block"].decode().split("\r\n") for x in back if x["warc-type"] == "metadata"}
    assert [x.split(": ", 1)[1] for x in meta["<urn:a>"] if x.startswith("source-http-header: ")] == [*own, "X-Folded: one two"]
    assert "source-http-status: HTTP/1.1 203 Other" in meta["<urn:a>"] and not any(x.startswith("source-http") for x in meta["<urn:b>"])
    assert {r.http_headers for r in registry.QUERIES["op8_warc_derivatives"](spark, SF).collect()} == {warc.HTTP_HEADERS}


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>T</title><meta charset=utf-8><body><p>One</p>Two</body></html>", "One\nTwo"),
        ("<head><title>T</title><style>p{}</style><script>'</head>'</script><p>One</p>Two", "One\nTwo"),
        ("<head><title>T</title> One <b>two</b>", "One two"),
        ("<head><title>T</title><body>One <!-- </head> -->two", "One two"),
        ("<head><title>T</title><div>odd</div></head><body>One</body>", "One"),
        ("<head><meta a><link b>", ""),
        ("<head><body>One<head>two", "One two"),
        ("One <svg width=1/>two <svg><text>gone</text></svg>three", "One two three"),
        ("One <svg><path d=x/>two", "One two"),
        ("One <noscript>two <template>three", "One two three"),
        ("One <noscript>gone</noscript><template>gone</template>two", "One two"),
        ("One <!-- gone", "One"),
        ("One <script>gone <p>gone", "One"),
        ("One <style>gone", "One"),
        ("<header>One</header><p>two", "One\ntwo"),
    ],
)
def test_visible_text_of_unclosed_parts(page, text):
    assert warc.plain_text(page) == text


def test_pages_take_linear_time():
    import time

    begin = time.perf_counter()
    for x in ("<svg>", "<noscript>a", "<template>", "<head>a", "<head><p>", "<head><title>", "<a", "<a ", "<a href", "<a href=", "<p", "<title>", "<title ", "<html ", "<meta ", "<head><meta ", "&#9", "&#99999999", "<!", "<!--", "href="):
        page = x * (2_000_000 // len(x))
        assert warc.plain_text(page) is not None and warc.metadata_block(page, "", "") is not None
    assert warc.plain_text("a&#" + "9" * 6000 + ";b&#65;&#x000000042;") == "a\ufffdbAB"
    assert time.perf_counter() - begin < 120


def test_warc_query_by_another_parser(spark):
    """Every page's records against the standard library's HTML parser."""
    import base64
    import hashlib
    from html.parser import HTMLParser

    breaks = set("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article header footer nav aside main blockquote pre hr dl dt dd form body html title".split())

    class Shown(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.hidden, self.links = [], 0, []

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "noscript", "template", "head", "svg")
            if tag == "a" and dict(attrs).get("href"):
                self.links.append(" ".join(dict(attrs)["href"].split()))
            if tag in breaks and not self.hidden:
                self.out.append("\n")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "noscript", "template", "head", "svg")
            if tag in breaks and not self.hidden:
                self.out.append("\n")

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(data)

    digest = lambda raw: "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = registry.QUERIES["op8_warc_derivatives"](spark, "/root/testdata/sf0.01").collect()
    made = {(r.page_id, r.warc_type): r for r in warc.derive(warc.responses(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")), keep="page_id").collect()}
    assert len(rows) == 2 * len(pages) == len(made)
    for r in rows:
        page, block = pages[r.page_id], bytes(made[r.page_id, r.warc_type].block)
        assert (r.block_sha256, r.block_digest, r.payload_digest, r.n_bytes) == (hashlib.sha256(block).hexdigest(), digest(block), digest(page.html.encode()), len(block))
        assert r.target_uri == page.url and r.refers_to == made[r.page_id, "metadata"].refers_to == made[r.page_id, "conversion"].refers_to != r.record_id
        seen = Shown()
        seen.feed(page.html)
        seen.close()
        if r.warc_type == "conversion":
            lines = (re.sub(r"[^\S\n]+", " ", x).strip() for x in "".join(seen.out).split("\n"))
            assert block.decode() == "\n".join(x for x in lines if x)
        else:
            assert [x.split(": ", 1)[1] for x in block.decode().split("\r\n") if x.startswith("outlink: ")] == seen.links


def test_warc_files_are_read_member_by_member(spark, tmp_path):
    import gzip

    one = lambda k, body: (f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{k}>\r\nWARC-Target-URI: http://{k}/\r\nWARC-Date: {warc.DATE}\r\nContent-Length: {len(body) + 19}\r\n\r\n").encode() + b"HTTP/1.1 200 OK\r\n\r\n" + body + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(one(k, b"<p>x" * k)) for k in range(1, 30)))
    (tmp_path / "b.warc").write_bytes(one(90, b"plain") + one(91, b""))
    got = {r.record_id: bytes(r.payload) for r in warc.read(spark, str(tmp_path)).collect()}
    assert got == {f"<urn:{k}>": b"<p>x" * k for k in range(1, 30)} | {"<urn:90>": b"plain", "<urn:91>": b""}


def test_a_new_shard_takes_rows_only_into_itself(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = sharding.number(sharding.shard(df, 8, grown=9), ["doc_id"]).collect()
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    weighted = Counter(r.shard for r in sharding.shard(df, [1.0, 3.0]).collect())
    assert 0.70 < weighted[1] / 4000 < 0.80


def brute_components(docs, width):
    sets = {}
    for k, t in docs:
        w = t.encode().lower().split()
        m = min(width, len(w))
        sets[k] = frozenset(tuple(w[i : i + m]) for i in range(len(w) - m + 1)) if w else frozenset()
    part = {k: k for k in sets}
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and part[a] != part[b]:
                lo, hi = sorted((part[a], part[b]))
                part = {k: lo if p == hi else p for k, p in part.items()}
    return part


@pytest.mark.parametrize("group", [1000, 5])
def test_near_duplicates_by_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(minhash, "GROUP", group)
    rng = random.Random(6)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 80))] for _ in range(12)]
    docs = []
    for k in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(50)}"
        docs.append((k, " ".join(w)))
    docs += [(200, ""), (201, "One"), (202, "one")]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(odd(spark, docs), 2).collect()}
    assert got == brute_components(docs, 2)


def test_pipeline_by_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs = [(k, t) for k, t in docs if not any(r.rejects(quality.Features(t.encode())) for r in quality.RULES)]
    part = brute_components(docs, 5)
    docs = sorted((k, t) for k, t in docs if part[k] == k)
    cut = brute_repeats([(k, t.encode()) for k, t in docs], 200, True)
    index = decontaminate.Index([tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()])
    expected = {k: t.decode("utf-8", "ignore") for k, t in cut.items() if not index.search(t.decode("utf-8", "ignore").encode())}
    import hashlib

    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in expected.items()}
