"""Operators whose work must not grow with the square of what repeats, and results that must equal their SQL on odd keys."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dedup, layout
from corpusloom.plans import catalog, derived  # noqa: F401


def against_sql(spark, folder, name, digits=6):
    """The rows of a query over a folder and those of its SQL, in order."""
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{f}/*.parquet')")
    df = catalog.QUERIES[name](spark, str(folder))
    want = c.sql(f"SELECT {', '.join(chr(34) + x + chr(34) for x in df.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    plain = lambda rows: sorted(tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in rows)
    return plain(map(tuple, df.collect())), plain(want)


def joined_rows(df):
    """The rows that the largest join of an executed plan gave."""
    df.collect()
    found, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if "Join" in p.nodeName() and p.metrics().contains("numOutputRows"):
            found.append(p.metrics().apply("numOutputRows").value())
        kids = [p.executedPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in p.nodeName() else []
        todo += kids + [p.children().apply(i) for i in range(p.children().size())]
    return max(found)


def test_a_key_that_looks_like_a_year_names_none(spark, tmp_path):
    orders = [(1995, 1, "1992-03-01"), (1995, 2, "1992-05-01"), (2003, 3, "1997-01-01"), (7, 4, "1994-01-01"), (7, 5, "1993-01-01")]
    spark.createDataFrame(orders, "o_custkey bigint, o_orderkey bigint, d string").withColumn("o_orderdate", F.col("d").cast("date")).drop("d").write.parquet(f"{tmp_path}/orders.parquet")
    got, want = against_sql(spark, tmp_path, "year_vote")
    assert got == want == [(7, 1994), (1995, 1992), (2003, 1997)]


def test_owners_of_repeated_boxes_and_places(spark):
    chars = spark.range(400).select(F.col("id").alias("char_id"), F.lit(1).alias("doc_id"), F.lit(1).alias("page"), (F.col("id") % 2 * 50.0 + 4).alias("x0"), (F.col("id") % 2 * 50.0 + 6).alias("x1"), F.lit(4.0).alias("top"), F.lit(6.0).alias("bottom"))
    boxes = spark.range(300).select(F.col("id").alias("box_id"), F.lit(1).alias("doc_id"), F.lit(1).alias("page"), F.lit(0.0).alias("x0"), (F.col("id") % 3 + 10.0).alias("x1"), F.lit(0.0).alias("top"), F.lit(10.0).alias("bottom"))
    owned = layout.owners(chars, boxes)
    assert joined_rows(owned) <= 400  # not a row for every character and box
    assert {tuple(r) for r in owned.collect()} == {(i, 0) for i in range(0, 400, 2)}


def test_equal_texts_are_measured_once(monkeypatch):
    import pyarrow as pa

    from corpusloom.functions import units

    read, whole = [], units.measurements
    monkeypatch.setattr(units, "measurements", lambda t: read.append(t) or whole(t))
    texts = ["5 kg, 7 mm of x3", None, "none", "5 kg, 7 mm of x3"] * 50
    got = units.extract_units.func(pa.array(texts)).to_pylist()
    assert got == [whole(t) for t in texts] and len(read) == 3 and [m["si_value"] for m in got[0]] == [5.0, 0.007]


def test_terms_that_hold_the_same_words_are_scored_once(spark, tmp_path):
    names = ["red bolt", "red nut", "old bolt", "old nut gear"]
    spark.createDataFrame([(i, names[i % 4], f"Brand#{i % 3}", "LARGE", i * 7 % 50) for i in range(600)], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i,) for i in range(90)], "s_suppkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    for name in ("text_seeds", "merged_seeds"):
        got, want = against_sql(spark, tmp_path, name)
        assert got == want and len(got) >= 90 * 12
    assert joined_rows(catalog.QUERIES["text_seeds"](spark, str(tmp_path))) <= 600 * 8  # not a row for every query, term and word


def test_similar_statements_of_a_group_are_ranked_without_a_row_for_every_pair(spark, tmp_path):
    from corpusloom.operators import graph

    rows = [(i, i % 3, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(400)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("facts_by_similarity", "graph_candidates"):
        got, want = against_sql(spark, tmp_path, name)
        assert got == want
        assert joined_rows(catalog.QUERIES[name](spark, str(tmp_path))) <= 400  # before: a row for every query and statement
    e = spark.createDataFrame([(1, 5, [0.0, 0.0]), (1, 3, [1.0, 1.0]), (1, 4, [2.0, 2.0])], "group int, statement_id bigint, vector array<double>")
    q = spark.createDataFrame([(1, 9, [3.0, 3.0])], "group int, query_id bigint, vector array<double>")
    assert [(r.statement_id, r.place, round(r.similarity, 9)) for r in graph.facts_by_similarity_within(e, q).collect()] == [(3, 1, 1.0), (4, 2, 1.0), (5, 3, 0.0)]


def test_signals_of_all_texts_at_once_are_those_of_each(spark):
    from corpusloom.functions import text as X

    texts = ["", "aa bb", "ПРИВЕТ Миру ёЁ", "Σίσυφος ΣΑΣ ΣΑΣΣ abc", "İstanbul İİ xx yy zz", "x\ty z   q\x0bw", "strength rhythm взгляд съезд", "!!!!!!! 1111 ....", "a b c d e", "𝒜𝒜𝒜 𝐱y\U0001f600\U0001f600", "KKKkk aaaaaaaa", None, "\n", "12,5 — ﬁﬁ ǅǅ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1)
    got = df.select("i", X.signal_values("t").alias("s")).select("i", "s.*").orderBy("i").collect()
    assert got == df.select("i", *X.signals("t")).orderBy("i").collect()
    plans = [clean_plan(spark, f) for f in ("garbage_score", "audit_score_bands")]
    assert all("regexp_count" not in p and "regexp_extract_all" not in p and "signal_values" in p for p in plans)


def clean_plan(spark, name):
    return catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_documents_pass_their_folds_one_behind_the_other(spark):
    from corpusloom.operators import clean
    from corpusloom.operators.storage import by_document

    df = spark.range(3000).select(F.concat(F.lit("d"), F.col("id") % 700).alias("doc_id"), F.col("id").cast("int").alias("order")).union(spark.sql("SELECT CAST(NULL AS STRING), 7"))
    got = by_document(df, lambda rows: [{"doc_id": rows[0]["doc_id"], "n": len(rows), "sorted": rows == sorted(rows, key=lambda r: r["order"])}], "doc_id string, n int, sorted boolean").collect()
    assert len(got) == 701 and sum(r.n for r in got) == 3001 and all(r.sorted for r in got)
    lines = catalog.lines(spark, "/root/testdata/sf0.001")
    plan = clean.merge_fragments(clean.prepare(lines, unicode=False))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan


def test_lexical_scores_without_postings(spark, tmp_path):
    from corpusloom.operators import retrieval

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{rng.integers(40) ** 2 % 37}" for _ in range(int(rng.integers(1, 30)))) for _ in range(300)] + ["w1 w2 w4"] * 60 + ["", None]
    spark.createDataFrame([(i, t, f"s{i % 9}") for i, t in enumerate(texts)], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"w{i} w{i + 1} W4 w{i}") for i in range(12)] + [(99, "nowhere")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("bm25_topk", "sparse_tfidf_topk", "rrf_fusion", "parent_child_dedup", "relevance_gate"):
        got, want = against_sql(spark, tmp_path, name, 5)
        assert got == want and got, name
    plan = catalog.QUERIES["bm25_topk"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # postings are not sent about to meet the queries' terms
    units = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "unit_id bigint, text string, parent_id bigint")
    queries = spark.createDataFrame([("a", "w1 w2"), ("b", "w30")], "query_id string, query string")
    q = retrieval.query_terms(queries.select("query_id", F.col("query").alias("text")), F.split("text", " "))
    blocks = [{tuple(r) for r in retrieval.lexical_top_k(units, F.split("text", " "), q, 5, block=n).collect()} for n in (1, 256)]
    assert blocks[0] == blocks[1] and {r[0] for r in blocks[0]} == {"a", "b"}
    evidence = retrieval.retrieve(units, queries).where("query_id = 'a' AND number = 1").first()
    assert evidence.score == 1.0 and evidence.context == texts[evidence.unit_id]


def test_trigrams_by_arrays_are_those_of_the_pattern(spark):
    from corpusloom.operators import language_model as lm

    texts = ["", "a", "Ab 12\t\n x", "İx İİ KKK", "Ёж, Ёлка\x0b\x0c\r..ÀÀ", "𝒜b c  d", "  ^^ ab", "ΣΑΣ Σ", "a#1 ##", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = [r.g for r in df.orderBy("i").select(lm.trigrams(F.col("t")).alias("g")).collect()]
    at, code = lm.coded_trigrams([t or "" for t in texts])
    got = [[lm.SIGNS[x >> 12] + lm.SIGNS[x >> 6 & 63] + lm.SIGNS[x & 63] for x in code[at == i].tolist()] for i in range(len(texts))]
    assert got == want
    plan = catalog.QUERIES["charlm_model"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.lower()
