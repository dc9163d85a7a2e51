from pyspark.sql import functions as F

from clausewright.functions import text as T
from clausewright.operators import chunk, dedup, extract, graph, metrics, sample, segment, validate
from clausewright.plans import pipeline
from clausewright.sources import sinks, tables
from clausewright.streaming import ingest

DOC = "document_id string, full_text string, regulator string, act_name string, effective_date string, local_path string"


def docs(spark, *texts):
    return spark.createDataFrame([(k, t, "R", k, None, None) for k, t in texts], DOC)


def test_two_spans_at_one_place(spark):
    got = chunk.chunks(docs(spark, ("X", "Section 1. A\n(a) b")), paths=True).orderBy("chunk_index").collect()
    assert [(r.chunk_id, r.level, r.text, r.section_number, r.clause_number, r.parent_path, r.total_chunks) for r in got] == [
        ("X_0", "section", "Section 1. A", "1", None, "Section 1", 3), ("X_1", "clause", "(no content)", "1", "a", "Section 1 > Clause a", 3), ("X_2", "subsection", "(a) b", "1", "a", "Section 1 > Clause a > Subsection a", 3)]


def test_graph_of_one_act(spark):
    d = docs(spark, ("X", "Section 1. A\n(a) b"))
    segs = segment.segments(d)
    assert sorted((r.id, r.type) for r in graph.nodes(d, segs).collect()) == [("X", "Act"), ("X/clause/1/a", "Clause"), ("X/clause/1/a", "Subsection"), ("X/section/1", "Section"), ("reg/r", "Regulator")]
    assert sorted(r.type for r in graph.edges(d, segs).collect()) == sorted(["ACT_ISSUED_BY_REGULATOR", "ACT_HAS_SECTION", "SECTION_HAS_CLAUSE", "SECTION_HAS_SUBSECTION", *["CONTAINS"] * 4])


def test_edges_end_in_nodes(spark):
    text = "PART I - One\nCHAPTER 1 - Gen\n\nSection 1. First shall.\nProviso. Unless\nExplanation. Words\nSCHEDULE I - Tab\n\nSection 2. Other\n(a) \"Firm\" means any\n"
    d = docs(spark, ("X", text), ("Y", ""), ("Z", "plain"))
    segs = segment.segments(d)
    ids = {r.id for r in graph.nodes(d, segs).collect()}
    edges = graph.edges(d, segs).collect()
    assert {r.source for r in edges} | {r.target for r in edges} <= ids
    assert {"PART_HAS_CHAPTER", "CHAPTER_HAS_SECTION", "ACT_HAS_SCHEDULE", "SECTION_HAS_PROVISO", "SECTION_HAS_EXPLANATION", "SECTION_CONTAINS_DEFINITION"} <= {r.type for r in edges}
    assert {r.type for r in graph.edges(d, segs, strict=True).collect()} >= {"SCHEDULE_HAS_SECTION"}


def test_numeric_subsection_after_a_blank_line():
    assert [(s[0], s[1], s[3]) for s in segment.find_spans("Section 1. A\n\n(1) b")] == [("section", "1", 0), ("subsection", "1", 13), ("subsection", "1", 14)]


def test_document_without_spans(spark):
    got = {r.document_id: r for r in chunk.chunks(docs(spark, ("X", "hello"), ("Y", " "))).collect()}
    assert (got["X"].chunk_id, got["X"].text, got["X"].semantic_role, got["X"].total_chunks) == ("X_0", "hello", "other", 1)
    assert got["Y"].text == "(no text)"


def test_pages(spark):
    rows = spark.createDataFrame([(o,) for o in (0, 1, 2, 3, 4, 9, -1)], "o int").withColumn("pages", tables.pages_of(F.lit("ab\fcd")))
    assert [r.p for r in rows.select("o", T.page_at(F.col("pages"), F.col("o")).alias("p")).collect()] == [1, 1, 1, 2, 2, 2, None]


def test_balance_is_a_permutation(spark):
    kinds = ["obligation"] * 2 + ["non_obligation"] * 2 + ["neutral"] * 6
    df = spark.createDataFrame(list(enumerate(kinds)), "seq int, classification string")
    got = sample.ratio_balance(df, {"obligation": 0.5, "non_obligation": 0.2, "neutral": 0.3}).orderBy("position").collect()
    assert [r.seq for r in got] == list(range(10)) and [r.position for r in got] == list(range(1, 11))


def test_anchor_targets():
    assert sample.anchor_targets({"obligation": 430, "non_obligation": 282, "neutral": 2235}) == {"obligation": 430, "non_obligation": 172, "neutral": 258}


def test_names(spark):
    row = spark.range(1).select(T.slug(F.lit(" Art. 5(1) ")).alias("a"), T.slug(F.lit("***")).alias("b"), T.safe_filename(F.lit("a/b\\c d#1")).alias("c"), T.safe_filename(F.lit("x/")).alias("d"), T.document_of(F.lit("abc")).alias("e")).first()
    assert tuple(row) == ("art_5_1", "unnamed", "c d_1.pdf", "document.pdf", "abc")


def test_greedy_matches_take_free_golds_in_turn(spark):
    kind = "g array<struct<s:int,e:int>>, p array<struct<s:int,e:int>>"
    df = spark.createDataFrame([([(0, 10), (0, 6)], [(0, 8), (0, 10)]), ([(0, 10), (0, 6)], [(0, 10), (0, 8)]), ([], [(0, 1)]), ([(0, 1)], [])], kind)
    got = [sorted((m.pred, m.gold) for m in r.m) for r in df.select(metrics.greedy_matches(F.col("g"), F.col("p")).alias("m")).collect()]
    assert got == [[(0, 0), (1, 1)], [(0, 0), (1, 1)], [], []]


def test_iou(spark):
    iou = lambda *x: spark.range(1).select(metrics.span_iou(*[F.lit(v) for v in x]).alias("v")).first().v
    assert abs(iou(0, 10, 5, 15) - 1 / 3) < 1e-12 and iou(0, 5, 5, 9) == 0 and iou(0, 0, 0, 0) == 0


def test_rouge_l_of_a_gap(spark):
    assert abs(spark.range(1).select(metrics.rouge_l(F.lit("a b d"), F.lit("a b c d")).alias("v")).first().v - 6 / 7) < 1e-12


def test_extractor_falls_back_and_is_overridden(spark):
    rows = spark.createDataFrame([("D_0", "You shall go."), ("D_1", "Plain.")], "chunk_id string, text string")
    payload = extract.inputs(rows)
    plug = lambda p: extract.records(p).where("chunk_id = 'D_1'").withColumn("input_text", F.lit("made up")).withColumn("section", F.lit("9"))
    got = {r.chunk_id: r for r in extract.extract(payload, plug).collect()}
    assert got["D_0"].classification == "obligation" and got["D_1"].input_text == "Plain." and got["D_1"].section == "9"
    assert validate.split_valid(extract.records(payload))[1].count() == 0


def test_pipeline_stages(spark, tmp_path):
    cfg = pipeline.Config(output=f"file://{tmp_path}", vectors=lambda df: df.withColumn("embedding", F.array(F.lit(1.0))))
    done = pipeline.run(spark, docs(spark, ("X", "CHAPTER 1 - G\n\nSection 1. You shall go.\nSection 2. It may be.")), cfg)
    assert spark.read.parquet(done["raw"]).count() == 2 and spark.read.json(done["report"]).first().total_chunks == 2
    assert spark.read.parquet(done["record_nodes"]).count() == 5 and spark.read.parquet(done["vectors"]).count() == 2


def test_stream_of_chunks(spark, tmp_path):
    spark.createDataFrame([("D_0", "You must go.")], "chunk_id string, text string").write.json(f"{tmp_path}/in")
    q = ingest.extract_stream(ingest.chunk_stream(spark, f"{tmp_path}/in", "chunk_id string, text string"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out/records").first().classification == "obligation"


def test_upsert_keeps_the_last(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "id string, seq int, v string")
    new = spark.createDataFrame([("a", 1, "n"), ("b", 4, "m")], "id string, seq int, v string")
    assert sorted((r.id, r.v) for r in sinks.upserted(old, new, ["id"], "seq").collect()) == [("a", "n"), ("b", "y")]


def test_near_pairs_and_members_link_every_copy(spark):
    near = " ".join(f"w{i}" for i in range(40))
    rows = [(5, near), (3, near), (9, near), (7, near + " more"), (8, near + " more"), (20, "only copies"), (21, "only copies"), (30, None), (31, None), (32, "")]
    docs = [(k, t, "s", None if k >= 30 else "en") for k, t in rows] + [(40, near, "other", "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    members = {r.doc_id: r.class_id for r in dedup.near_members(df, ("source", "lang")).collect()}
    assert members == {5: 3, 3: 3, 9: 3, 7: 7, 8: 7, 20: 20, 21: 20, 30: 30, 31: 30, 32: 32, 40: 40}
    pairs = [(r.a, r.b) for r in dedup.near_pairs(df, ("source", "lang")).collect()]
    assert {(x, y) for a, b in pairs for x in members if members[x] == a for y in members if members[y] == b} == {(x, y) for x in (3, 5, 9) for y in (7, 8)}


def test_ancestors_of_deep_chains_and_cycles(spark):
    from clausewright.operators import bridge

    rows = [("d", str(k), str(k - 1) if k else None) for k in range(200)] + [("e", "a", "b"), ("e", "b", "c"), ("e", "c", "a"), ("e", "x", "missing"), ("e", "y", "y")]
    got = {(r.document_id, r.id_path, r.ancestor): r.distance for r in bridge.ancestors(spark.createDataFrame(rows, "document_id string, id_path string, parent_id_path string")).collect()}
    chain = {("d", str(k), str(j)): k - j for k in range(200) for j in range(k)}
    assert got == chain | {("e", "a", "b"): 1, ("e", "a", "c"): 2, ("e", "b", "c"): 1, ("e", "b", "a"): 2, ("e", "c", "a"): 1, ("e", "c", "b"): 2}


def test_files_of_one_name_in_two_folders_dont_meet(spark):
    from clausewright.sources import tables

    records = spark.createDataFrame([("a/x.pdf", "A"), ("b/x.pdf", "B"), ("c/x.pdf", "C")], "s3_key string, regulator string")
    files = spark.createDataFrame([("/base/A/x.pdf",), ("/base/b/x.pdf",)], "path string")
    have, failed = tables.fetched(records, files)
    assert {(r.s3_key, r.local_path) for r in have.collect()} == {("a/x.pdf", "/base/A/x.pdf"), ("b/x.pdf", "/base/b/x.pdf")}
    assert [r.s3_key for r in failed.collect()] == ["c/x.pdf"]


def test_extractors_are_asked_again_and_their_errors_kept(spark):
    from pyspark.sql import functions as F

    from clausewright.operators import extract

    asked = []
    payload = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "chunk_id string")

    def flaky(rows):
        asked.append(rows.count())
        gone = F.when((F.col("chunk_id") == "c3") | (F.lit(len(asked)) == 1) & (F.col("chunk_id") == "c2"), "late")
        return rows.select("chunk_id", gone.alias("error"))

    got = {r.chunk_id: r.error for r in extract.asked(payload, flaky).collect()}
    assert got == {"c1": None, "c2": None, "c3": "late"} and asked == [3, 2, 1]


def test_providers_and_structure_prompts(spark):
    import pytest

    from clausewright.operators import extract

    known = {"Local": lambda df: df}
    assert extract.provider(" LOCAL ", known) is known["Local"]
    with pytest.raises(ValueError):
        extract.provider("other", known)
    row = extract.structure_prompt(spark.createDataFrame([("d", "Act", "text"), ("e", None, None)], "document_id string, title string, full_text string")).collect()
    assert row[0].prompt.endswith("Title: Act\nText:\ntext") and "Title: Unknown" in row[1].prompt


def test_mended_records_follow_the_schema(spark):
    import json

    from clausewright.operators import validate

    rows = [json.dumps(x) for x in ({"metadata": None, "context": "c", "output": [{"obligation_id": "o", "subject": None, "modality": "must not", "action": "a", "reference_anchor": "r", "more": [None, {"x": None}]}], "tool_use": {"tool_call": None, "note": None}}, {"context": "c"}, {"context": "c", "output": {"status": "incomplete", "message": "m", "reason": None}})] + ["{", None]
    made = validate.mend(spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, json string"))
    got = {r.k: (r.json, r.errors) for r in validate.schema_errors(made).collect()}
    assert all(got[k][1] == [] for k in range(3)) and got[3] == ("{", ["not a JSON object"]) and got[4][1] == ["not a JSON object"]
    first = json.loads(got[0][0])
    assert first["metadata"]["section"] == "UNKNOWN" and first["output"][0]["modality"] == "MUST_NOT" and first["output"][0]["subject"] == "" and first["output"][0]["more"] == ["", {"x": ""}]
    assert first["tool_use"] == {"tool_call": None, "note": ""} and json.loads(got[2][0])["output"] == {"status": "rejected", "message": "m", "reason": ""}
