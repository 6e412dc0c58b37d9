"""Operators on small tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import audit, chunk, clean, dedup, graph, layout, metadata, recommend, retrieval, split
from corpusloom.sources import blocks as B

COLUMNS = "block_id string, doc_id string, `order` int, page int, type string, text string, text_source string, reliable boolean, languages string, table_html string, category string, x0 double, top double, x1 double, bottom double"


def block(doc, n, text, kind="NarrativeText", page=1, box=(None, None, None, None), html=None, reliable=False):
    return (f"{doc}#{n}", doc, n, page, kind, text, "text_layer", reliable, "en", html, None, *box)


def test_prepare_marks_empty(spark):
    df = clean.prepare(spark.createDataFrame([block("d", 0, "x"), block("d", 1, None), block("d", 2, " ")], COLUMNS), unicode=False)
    assert [(r.keep, r.drop_reason) for r in df.orderBy("order").collect()] == [(True, ""), (False, "empty"), (False, "empty")]


def test_boilerplate_needs_pages(spark):
    rows = [block("d", i, "Journal of Ores", page=i + 1) for i in range(3)] + [block("d", 9, "once only here", page=4)]
    got = clean.drop_boilerplate(clean.prepare(spark.createDataFrame(rows, COLUMNS), unicode=False)).orderBy("order").collect()
    assert [r.drop_reason for r in got] == ["boilerplate"] * 3 + [""]


def test_merge_rules():
    a = {"block_id": "d#0", "doc_id": "d", "order": 0, "page": 1, "type": "NarrativeText", "text_out": "the fur-", "keep": True, "drop_reason": "", "reliable": True, "x0": None, "top": None, "x1": None, "bottom": None}
    b = a | {"block_id": "d#1", "order": 1, "page": 2, "text_out": "nace was hot and"}
    c = a | {"block_id": "d#2", "order": 2, "page": 3, "text_out": "glowing."}
    t = a | {"block_id": "d#3", "order": 3, "page": 3, "type": "Table", "text_out": "1"}
    d = a | {"block_id": "d#4", "order": 4, "page": 4, "text_out": "later on"}
    got = clean.merge_document([dict(x) for x in (d, c, b, a, t)])
    assert got[0]["text_out"] == "the furnace was hot and glowing." and got[0]["merged_ids"] == ["d#1", "d#2"] and got[0]["page_max"] == 3
    assert [r["merge_rule"] for r in got] == [None, "hyphen", "cross_page", None, None]


def test_whole_cleaning_keeps_every_row_once(spark):
    rows = [block("d", i, t) for i, t in enumerate(["A long enough sentence stands here, for all to see.", "A long enough sentence stands here, for all to see!", "xx", ""])]
    got = clean.clean(spark.createDataFrame(rows, COLUMNS)).orderBy("order").collect()
    assert [r.drop_reason for r in got] == ["", "duplicate", "", "empty"] and got[1].merged_into == "d#0"


def test_noise_score_bounds(spark):
    df = clean.with_noise(clean.prepare(spark.createDataFrame([block("d", 0, "aaaaaaaaaaaaaaaaaaaa"), block("d", 1, "A plain sentence of common words.")], COLUMNS), unicode=False))
    bad, good = df.orderBy("order").collect()
    assert bad.garbage_score >= 0.9 and good.garbage_score < 0.2


def test_minhash_agrees_with_numpy(spark):
    words = [f"w{i % 37}x{i % 11}" for i in range(300)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(words[:290] + ["odd"] * 10)), (4, "too short"), (5, None)], "doc_id int, text string")
    signed = {r.doc_id: r for r in dedup.signatures(docs, F.coalesce("text", F.lit(""))).collect()}
    import zlib

    crc = [zlib.crc32(w.encode()) for w in words]
    hashes = set()
    for i in range(len(crc) - 4):
        h = 0
        for w in crc[i : i + 5]:
            h = (h * 1000003 + w) % (1 << 32)
        if h % 8 == 0:
            hashes.add(h)
    a, b = dedup.coefficients()
    want = [min((s * x + y) % dedup.PRIME for s in hashes) for x, y in zip(a, b)]
    assert signed[1].signature == want and signed[1].n_shingles == len(hashes)
    assert signed[4].n_shingles == 0 and set(signed[4].signature) == {dedup.PRIME}
    pairs = {(r.doc_a, r.doc_b): r.similarity for r in dedup.similar_pairs(dedup.signatures(docs, F.coalesce("text", F.lit("")))).collect()}
    assert pairs[(1, 2)] == 1.0 and (1, 3) in pairs


def test_components_and_winner(spark):
    pairs = spark.createDataFrame([("a/b/x", "a/y", 1.0), ("a/y", "z", 1.0), ("q", "r", 0.98)], "doc_a string, doc_b string, similarity double")
    docs = spark.createDataFrame([("a/b/x", 9), ("a/y", 5), ("z", 1), ("q", 1), ("r", 1)], "doc_id string, kept int")
    assert {tuple(r) for r in dedup.duplicate_documents(pairs, docs).collect()} == {("a/b/x", "z"), ("a/y", "z")}


def test_long_chain_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a int, b int")
    assert {r.comp for r in dedup.connected(edges, "a", "b").collect()} == {0}


def test_entry_runs_the_whole_cleaning_job(spark, tmp_path, monkeypatch):
    import __spark_entry__ as entry

    words = " ".join(f"Word{chr(97 + i % 26)}{chr(97 + i // 26)} goes on" for i in range(90))
    pages = [f"Sentence {'abcdefghijklmnopqrstuvwxyz'[i % 26] * 2} of the long page says what it has to say." for i in range(39)]
    docs = [
        (1, f"{words}\nA closing line that only the first of the copies has not."),
        (2, f"{words}\nA closing line that only the first of the copies has not."),
        (3, f"{words.upper()}\nA closing line that only the first of the copies has not."),
        (4, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"),
        (5, "\n".join(pages) + "\nthe last line of the page is open and runs over to\nthe next one, where it comes to its end at last."),
        (6, "\ufb01ve of the f\u00edne ores were weighed, washed and dried.\nfive of the f\u00edne ores were weighed, washed and dried."),
    ]
    rows = [(i, t, "en", "s", len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(entry, "SMOKE_DIR", str(tmp_path))
    got = {r.drop_reason: r.blocks for r in entry.entry(spark).collect()}
    assert got["garbage"] == 1 and got["merged"] == 1 and got["duplicate_document"] == 4
    dropped = entry.queries()["corpus_block_duplicates"](spark, str(tmp_path)).where("block_id LIKE '6#%'").collect()
    assert [tuple(r) for r in dropped] == [("6#1", "6#0")]
    totals = entry.queries()["corpus_totals"](spark, str(tmp_path)).first()
    assert totals.blocks == sum(got.values()) and totals.kept == got[""] and totals.documents == 6


def test_quantiles_use_the_lower_index(spark):
    df = spark.createDataFrame([("k", float(v)) for v in range(10)], "k string, v double")
    r = audit.lower_quantiles(df, "k", "v", {"p25": 0.25, "median": 0.5}).first()
    assert (r.p25, r.median) == (2.0, 5.0)


def test_wilson_edges(spark):
    low, high = audit.wilson(F.col("h"), F.col("n"))
    assert [tuple(r) for r in spark.createDataFrame([(0, 0), (10, 10)], "h int, n int").select(low, high).collect()] == [(0.0, 1.0), (0.722, 1.0)]


def test_rrf_arithmetic(spark):
    hits = spark.createDataFrame([(1, "a", "x", 1), (1, "a", "x", 2), (1, "a", "y", 3), (1, "b", "y", 1)], "query_id int, channel string, unit_id string, rank int")
    got = {r.unit_id: r.score for r in retrieval.fuse(hits).collect()}
    assert got["x"] == pytest.approx(1 / 61) and got["y"] == pytest.approx(1 / 63 + 1 / 61)


def test_dense_ties_and_zero_vectors(spark):
    units = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)] + [(9, [0.0, 0.0])], "unit_id bigint, vector array<double>")
    got = retrieval.dense_top_k(units, spark.createDataFrame([(1, [2.0, 0.0])], "query_id bigint, vector array<double>"), 2).orderBy("rank").collect()
    assert [(r.unit_id, r.score) for r in got] == [(0, 1.0), (1, 1.0)]


@pytest.mark.parametrize("asked", [["text"], ["bm25"], ["graph"], ["bm25", "text"], ["graph", "text"], ["graph", "bm25"], ["graph", "bm25", "text"]])
def test_channels_in_order(asked):
    assert retrieval.channels(asked) == [c for c in retrieval.CHANNELS if c in asked]


def test_unknown_channel_is_refused():
    with pytest.raises(ValueError):
        retrieval.channels(["web"])


def test_judge_loop():
    scores = iter([0.3, 0.9])
    got = retrieval.answer("q", [{}, {}, {}], lambda q, e: f"a{len(e)}", lambda q, a, e: next(scores))
    assert got == {"mode": "hybrid", "answer": "a2", "score": 0.9, "used": 2}
    assert retrieval.answer("q", [], None, None)["mode"] == "no_evidence"
    assert retrieval.answer("q", [{}], lambda q, e: "a", lambda q, a, e: 0.1)["mode"] == "hybrid_partial"


def test_citations_and_verdict(spark):
    df = spark.createDataFrame([("see [E1] and [2, 3] [E1]", '{"score": 1.4}'), ("none", "no number")], "a string, v string")
    assert [tuple(r) for r in df.select(retrieval.citations(F.col("a")), retrieval.verdict_score(F.col("v"))).collect()] == [([1, 2, 3], 1.0), ([], 0.0)]


def test_paths_do_not_reuse_edges(spark):
    rel = spark.createDataFrame([("a", "r", "m", 3), ("b", "r", "m", 2), ("a", "s", "b", 1)], "src string, predicate string, dst string, count int")
    seeds = spark.createDataFrame([("a",), ("b",)], "term_id string")
    got = {(tuple(r.nodes), r.length, r.weight) for r in graph.paths(seeds, rel, 2).collect()}
    assert got == {(("a", "b"), 1, 1), (("a", "m", "b"), 2, 5)}


def test_every_relation_is_walked_whatever_its_count(spark, tmp_path):
    from corpusloom.plans import catalog

    orders = [(1, "1-URGENT"), (1, "2-HIGH"), (1, "2-HIGH"), (2, "1-URGENT"), (2, "3-MEDIUM"), (3, "2-HIGH")]
    spark.createDataFrame(orders, "o_custkey bigint, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {tuple(r) for r in catalog.QUERIES["graph_paths_2hop_all"](spark, str(tmp_path)).collect()}
    assert got == {("1-URGENT", "c1", "2-HIGH", 3), ("1-URGENT", "c2", "3-MEDIUM", 2)}


def test_single_linkage_history():
    m = [[0, 0.9, 0.2], [0.9, 0, 0.6], [0.2, 0.6, 0]]
    assert recommend.merge_history(m, 0.7) == {"groups": [[0, 1], [2]], "merges": [([0, 1], 0.9)], "next_similarity": 0.6}
    assert recommend.merge_history(m, 0.6)["groups"] == [[0, 1, 2]]
    with pytest.raises(ValueError):
        recommend.merge_history([[0, 2], [2, 0]], 0.1)


def test_chunks_lose_nothing_and_keep_budget(spark):
    rng = np.random.default_rng(0)
    rows = [block("d", i, " ".join(f"word{rng.integers(99)}" for _ in range(int(rng.integers(3, 90)))) + ".", kind=["NarrativeText", "ListItem", "NarrativeText"][i % 3]) for i in range(60)]
    rows.append(block("d", 60, "Table 1", "Table", html="<table><tr><th>n</th><th>v</th></tr>" + "".join(f"<tr><td>{i}</td><td>{i * 7} kg</td></tr>" for i in range(400)) + "</table>"))
    df = spark.createDataFrame(rows, COLUMNS)
    got = chunk.chunks(df).collect()
    held = {b for r in got for b in r.block_ids}
    assert held == {r[0] for r in rows}
    assert all(r.n_tokens <= 650 or "table" in r.atom_kinds for r in got) and sum(r.table_part > 0 for r in got) > 1
    units = chunk.search_units(spark.createDataFrame(got, chunk.CHUNKS), df)
    counts = {r.unit_type: r["count"] for r in units.groupBy("unit_type").count().collect()}
    assert counts["table_row"] == 400 and counts["table_cell"] == 400 and counts["chunk"] == len(got) and counts["quantity"] >= 400
    assert units.where("parent_chunk_id is null").count() == 0


def test_split_routes(spark):
    rows = [block("d", 0, "1 Introduction", "Title"), block("d", 1, "Plain text."), block("d", 2, "2H_{2} + O_{2} = 2H_{2}O", "Formula"), block("d", 3, r"\frac{a}{b} = c^{2}", "Formula"), block("d", 4, "(3.4)", "Formula"), block("d", 5, "12", "PageNumber"), block("d", 6, "t", "Table")]
    got = {r.order: (r.route, r.section) for r in split.route(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert [got[i][0] for i in range(7)] == ["text", "text", "formulas_chem", "formulas_math", "empty", "furniture", "tables"] and got[6][1] == "1 Introduction"


def test_metadata_votes(spark):
    rows = [block("steel__a", 0, "On Ores", "Title"), block("steel__a", 1, "A. B. Smith and Ivanov I. I."), block("steel__a", 2, "1999, 2001 and 1999")]
    r = metadata.describe(spark.createDataFrame(rows, COLUMNS)).first()
    assert (r.year, r.title, r.category, r.lang) == (1999, "On Ores", "steel", "en") and r.authors[0].endswith("Smith")


def test_owner_join(spark):
    chars = spark.createDataFrame([(1, "d", 1, 5.0, 5.0, 6.0, 6.0), (2, "d", 1, 101.0, 5.0, 102.0, 6.0), (3, "d", 1, 500.0, 500.0, 501.0, 501.0)], "char_id int, doc_id string, page int, x0 double, top double, x1 double, bottom double")
    boxes = spark.createDataFrame([("big", "d", 1, 0.0, 0.0, 100.0, 100.0), ("small", "d", 1, 4.0, 4.0, 8.0, 8.0)], "box_id string, doc_id string, page int, x0 double, top double, x1 double, bottom double")
    assert {tuple(r) for r in layout.owners(chars, boxes).collect()} == {(1, "small"), (2, "big")}


def test_jsonl_scan_skips_corrupt_lines(spark, tmp_path):
    (tmp_path / "a").mkdir()
    record = {"block_id": "d#0", "doc_id": "d", "order": 0, "page": 1, "bbox": {"x0": 1.0, "top": 2.0, "x1": 3.0, "bottom": 4.0}, "languages": ["ru", "en"]}
    (tmp_path / "a" / "blocks.jsonl").write_text(json.dumps(record) + "\n{broken\n\n")
    r = B.read_jsonl(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0].text == "" and r[0].languages == "ru,en" and r[0].x1 == 3.0 and r[0].reliable is False


def test_parser_output(spark):
    v2 = [[{"type": "title", "content": {"title_content": [{"type": "text", "content": "Ores"}], "level": 1}}, {"type": "list", "content": {"list_items": [{"item_content": "one"}, {"item_content": "two"}]}}], [{"type": "paragraph", "content": {"paragraph_content": [{"type": "text", "content": "where"}, {"type": "equation_inline", "content": "x"}]}}]]
    v1 = [{"type": "text", "text": "Head", "text_level": 1, "page_idx": 0}, {"type": "ref_text", "text": "[1] A", "page_idx": 1}]
    rows = B.read_parser_output(spark.createDataFrame([("a", json.dumps(v2)), ("b", json.dumps(v1)), ("c", "{")], "doc_id string, content string")).orderBy("doc_id", "order").collect()
    assert [(r.doc_id, r.type, r.page, r.text) for r in rows] == [("a", "Title", 1, "Ores"), ("a", "ListItem", 1, "one"), ("a", "ListItem", 1, "two"), ("a", "NarrativeText", 2, "where $x$"), ("b", "Title", 1, "Head"), ("b", "ListItem", 2, "[1] A")]


def test_swap_keeps_one_backup(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (1, 2, 3):
        B.swap_in(spark.range(n), path)
    assert spark.read.parquet(path).count() == 3 and spark.read.parquet(path + ".bak").count() == 1


def test_matrix_source(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1 2;3\n4,5\t6\n")
    assert B.read_matrix(spark, str(tmp_path / "m.txt")).agg(F.sum("value")).first()[0] == 21
    (tmp_path / "r.txt").write_text("1 2\n3\n")
    with pytest.raises(ValueError):
        B.read_matrix(spark, str(tmp_path / "r.txt"))


def test_catalog_oracles_have_queries():
    from corpusloom.plans import catalog

    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 50


def test_script_repair_and_symbols(spark):
    from corpusloom.functions import chem
    from corpusloom.functions import text as X

    df = spark.createDataFrame([("Нa2O и Feжук", "\uf061\uf044 x")], "t string, s string")
    got = df.select(X.one_script("t", chem.LOOKALIKES).alias("a"), X.decode_symbol_font("s").alias("b"), X.sentences(F.lit("One. Two?\nThree")).alias("c"), X.layer_text(F.lit("ﬁ x")).alias("d")).first()
    assert tuple(got) == ("Ha2O и Feжук", "αΔ x", ["One.", "Two?", "Three"], "fi x")


def test_formula_heuristics(spark):
    from corpusloom.functions import latex

    df = spark.createDataFrame([("E = mc^2 + 1",), ("A plain sentence of words",), ("One ..... 3\nTwo ..... 7",)], "t string")
    got = df.select(latex.looks_like_formula(F.col("t")), latex.looks_like_contents(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, True)]


def test_query_normalisation_payload_and_ablation(spark):
    df = spark.createDataFrame([("what is Н₂О like", 1, None)], "q string, year int, lang string")
    r = retrieval.payload(df.withColumn("q", retrieval.normalize_query("q")), ["year", "lang"]).first()
    assert r.q == "what is H2O like" and r.payload == {"year": "1"}
    assert len(retrieval.method_combinations()) == 7
    records = retrieval.ablation([(1, "q")], lambda q, m: {"n": 1 // (len(m) - 1)})
    assert len(records) == 7 and sum(x["error"] is not None for x in records) == 3


def test_seeds_frames_and_hits(spark):
    terms = spark.createDataFrame([(1, "iron ore", "term", 5), (2, "ore", "word", 9), (3, "copper ore", "term", 2)], "term_id int, label string, kind string, count int")
    q = spark.createDataFrame([(7, "ore"), (7, "iron")], "query_id int, term string")
    by_text = graph.text_seeds(q, terms)
    assert [r.term_id for r in by_text.orderBy(F.desc("score")).collect()] == [1, 3]
    exact = spark.createDataFrame([(7, 3, 2, 2.0)], "query_id int, term_id int, count int, score double")
    assert {(r.term_id, r.score) for r in graph.merged_seeds(exact, by_text).collect()} >= {(3, 2.0)}
    assert graph.frame_text(json.dumps({"text": "a", "frame": [{"mask": {"label": "b"}, "frame": [{"text": "c"}]}]})) == "a (b (c))" and graph.frame_text("{") == ""
    found = spark.createDataFrame([(7, "s", 2), (7, "t", 1), (7, "s", 3)], "query_id int, statement_id string, place int")
    assert [(r.unit_id, r["rank"]) for r in graph.graph_hits(found).orderBy("rank").collect()] == [("kg:t", 1), ("kg:s", 2)]


def test_document_types_and_years(spark):
    names = {"Книги__Metallurgy": "book", "ИТС 12-2019 copper": "standard", "ISO 9001": "standard", "reading notes": "article", "isolated cells": "article", "A book of slag": "book", "facebook": "article"}
    rows = spark.createDataFrame([(n,) for n in names], "doc_id string")
    assert {r.doc_id: r.t for r in rows.select("doc_id", metadata.document_type(F.col("doc_id")).alias("t")).collect()} == names
    blocks = [("ИТС 12-2019 copper", 1, 1, "Title", "of 1999"), ("x 1987 y 2001", 1, 1, "Title", ""), ("a", 1, 1, "Table", "1990 1990"), ("a", 3, 2, "Footer", "2004 and 2005"), ("a", 4, 3, "Title", "2005"), ("b", 1, 1, "Title", "2031 1850")]
    df = spark.createDataFrame(blocks, "doc_id string, page int, `order` int, type string, text string")
    assert {r.doc_id: r.year for r in metadata.year_vote(df).collect()} == {"ИТС 12-2019 copper": 2019, "x 1987 y 2001": 2001, "a": 2004}


def test_routes():
    kinds = lambda q: retrieval.route(q)["kinds"]
    assert kinds("a stable process") == ["text"] and kinds("the table of contents") == ["table", "text"] and kinds("slag of Fe2O3") == ["chemistry", "text"]
    assert kinds("x_i = 3") == ["math", "text"] and kinds("over 5 kg of matte") == ["chemistry", "unit", "text"] and kinds(None) == ["text"]
    assert retrieval.route("over 5 kg")["filters"] == {"numeric": {"canonical": "kg", "op": "gte", "value": 5.0}, "unit_type": "quantity"}


def test_merge_rules_of_the_contract():
    box = {"type": "NarrativeText", "x0": 0.0, "x1": 100.0, "top": 0.0, "bottom": 10.0}
    a = box | {"text_out": "an inter-", "page": 1, "page_max": 1}
    assert clean.merge_rule(a, box | {"text_out": "national one", "page": 9}, 10.0) == "hyphen"
    left, right = box | {"text_out": "x" * 10, "page_max": 1, "page": 1, "type": "UncategorizedText"}, box | {"text_out": "Y" * 20, "page": 1, "type": "UncategorizedText"}
    assert clean.merge_rule(left, right | {"x0": 120.0, "x1": 220.0}, 10.0) == "same_line" and clean.merge_rule(left, right | {"x0": 90.0, "x1": 190.0}, 10.0) is None


def test_lead_ins_and_legends():
    assert chunk.is_lead_in("see Table IV below") and chunk.is_lead_in("as shown in table") and chunk.is_lead_in("данные приведены в табл.") and not chunk.is_lead_in("a stable one") and not chunk.is_lead_in("table of contents")
    row = lambda t: {"text": t, "type": "NarrativeText"}
    assert chunk.is_legend(row("with n the count")) and chunk.is_legend(row("причём x")) and chunk.is_legend(row("rho = density of copper"))
    assert not chunk.is_legend(row("within it. all is. plain")) and not chunk.is_legend(row("a = b. And so on. More."))
