"""Name -> query and name -> DuckDB oracle for the engine's own operators, over the driver's tables.

Every query runs over its whole tables. Where the operator folds, hashes or iterates in a way SQL has no
words for, there is no oracle, and tests hold the operator against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chem, tables, units
from ..functions import text as X
from ..operators import audit, chunk, clean, dedup, graph, language_model, learning, metadata, recommend, retrieval, split
from ..operators.storage import checkpointed
from ..sources import blocks as B

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.from_documents(table(spark, sf_dir, "documents"))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks after the stages that work wholly in the JVM: empty, captions and furniture, boilerplate, orphans, duplicates."""
    df = clean.drop_captions(clean.drop_furniture(clean.prepare(lines(spark, sf_dir), unicode=False)))
    return clean.drop_exact_duplicates(clean.drop_orphans(clean.drop_boilerplate(df)))


_BLOCKS = r"""
split AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, lang, source, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS o FROM split),
blocks AS (
  SELECT doc_id || '#' || o AS block_id, doc_id, o, CAST(floor(o / 40) + 1 AS INTEGER) AS page, text, source,
    CASE WHEN regexp_matches(text, '^\s*[-*•]\s') THEN 'ListItem' WHEN contains(text, ' | ') THEN 'Table'
         WHEN length(text) <= 40 AND NOT regexp_matches(text, '[:;,]\s*$') THEN 'Title'
         WHEN length(text) <= 15 THEN 'UncategorizedText' ELSE 'NarrativeText' END AS type,
    trim(text, ' ') AS text_out,
    trim(regexp_replace(lower(trim(text, ' ')), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') AS key
  FROM lines)
"""
_CLEAN = (
    _BLOCKS
    + r""",
kept0 AS (SELECT *, text_out <> '' AS k0 FROM blocks),
short AS (SELECT doc_id, key, count(DISTINCT page) AS pages FROM kept0 WHERE k0 AND length(text_out) <= 120 AND key <> '' GROUP BY ALL),
dp AS (SELECT doc_id, count(DISTINCT page) AS doc_pages FROM kept0 WHERE k0 GROUP BY ALL),
boiler AS (SELECT doc_id, key, TRUE AS b FROM short JOIN dp USING (doc_id) WHERE pages >= 3 AND pages >= 0.15 * doc_pages),
s1 AS (SELECT kept0.*, CASE WHEN NOT k0 THEN 'empty' WHEN length(text_out) <= 120 AND coalesce(b, FALSE) THEN 'boilerplate'
         WHEN type = 'UncategorizedText' AND length(text_out) <= 15 THEN 'orphan' ELSE '' END AS r
       FROM kept0 LEFT JOIN boiler USING (doc_id, key)),
final AS (SELECT block_id, doc_id, o, page, type, text, text_out, key,
         CASE WHEN r = '' AND length(text_out) >= 40 AND row_number() OVER (PARTITION BY doc_id, key, r = '' AND length(text_out) >= 40 ORDER BY o) > 1 THEN 'duplicate' ELSE r END AS drop_reason
       FROM s1),
c AS (SELECT *, drop_reason = '' AS keep FROM final)
"""
)


# Ingestion and audit.


@query(f"""WITH {_BLOCKS} SELECT block_id, page, type, CAST(length(text) AS INTEGER) AS n_chars,
  lag(block_id) OVER (PARTITION BY doc_id, page ORDER BY o) AS prev_id, lead(block_id) OVER (PARTITION BY doc_id, page ORDER BY o) AS next_id FROM blocks""")
def block_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_neighbours(lines(spark, sf_dir)).select("block_id", "page", "type", F.char_length("text").alias("n_chars"), "prev_id", "next_id")


@query(f"""WITH {_CLEAN} SELECT count(*) AS blocks, CAST(sum(CAST(keep AS INTEGER)) AS BIGINT) AS kept, count(DISTINCT doc_id) AS documents,
  CAST(sum(length(text)) AS BIGINT) AS chars_in, CAST(sum(CASE WHEN keep THEN length(text_out) ELSE 0 END) AS BIGINT) AS chars_kept FROM c""")
def audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.totals(cleaned(spark, sf_dir))


@query(f"WITH {_CLEAN} SELECT drop_reason, count(*) AS blocks, CAST(sum(length(text_out)) AS BIGINT) AS chars FROM c GROUP BY drop_reason")
def audit_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.by_reason(cleaned(spark, sf_dir))


@query(f"""WITH {_CLEAN} SELECT type, count(*) AS was, CAST(sum(CAST(keep AS INTEGER)) AS BIGINT) AS "left",
  CAST(sum(CASE WHEN keep THEN length(text_out) ELSE 0 END) AS BIGINT) AS chars FROM c GROUP BY type""")
def audit_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.by_type(cleaned(spark, sf_dir))


@query(f"WITH {_CLEAN} SELECT 'text_layer' AS text_source, count(*) AS blocks, CAST(sum(CAST(keep AS INTEGER)) AS BIGINT) AS kept FROM c")
def audit_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.by_source(cleaned(spark, sf_dir))


@query(f"""WITH {_CLEAN}, d AS (SELECT doc_id, count(*) AS blocks, CAST(sum(CAST(keep AS INTEGER)) AS BIGINT) AS kept FROM c GROUP BY doc_id HAVING count(*) >= 50)
  SELECT doc_id, blocks, kept, round(kept / blocks, 6) AS share FROM d ORDER BY share, doc_id LIMIT 20""")
def audit_worst_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.worst_documents(cleaned(spark, sf_dir))


@query(f"WITH {_CLEAN} SELECT CAST(coalesce(sum(len(regexp_extract_all(text_out, '[0-9]{{4,}}'))), 0) AS BIGINT) AS artifacts FROM c WHERE keep")
def audit_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.artifact_count(cleaned(spark, sf_dir), "[0-9]{4,}")


@query()
def audit_score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.score_bands(clean.drop_noise(clean.with_noise(clean.prepare(lines(spark, sf_dir), unicode=False))))


@query(f"WITH {_CLEAN} SELECT block_id, first_value(block_id) OVER (PARTITION BY doc_id, key ORDER BY o) AS merged_into FROM s1 WHERE r = '' AND length(text_out) >= 40 QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY o) > 1")
def exact_block_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).where("drop_reason = 'duplicate'").select("block_id", "merged_into")


@query(f"""WITH b AS (SELECT source AS doc_id, doc_id AS page, unnest(string_split(text, chr(10))) AS text FROM documents),
  k AS (SELECT doc_id, page, trim(text, ' ') AS t, trim(regexp_replace(lower(trim(text, ' ')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ') AS key FROM b),
  dp AS (SELECT doc_id, count(DISTINCT page) AS doc_pages FROM k WHERE t <> '' GROUP BY ALL)
  SELECT doc_id, key, count(DISTINCT page) AS pages, any_value(doc_pages) AS doc_pages, count(*) AS blocks FROM k JOIN dp USING (doc_id)
  WHERE t <> '' AND length(t) <= 120 AND key <> '' GROUP BY doc_id, key HAVING count(DISTINCT page) >= 3 AND count(DISTINCT page) >= 0.02 * any_value(doc_pages)""")
def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources stand for documents, documents for pages."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.explode(F.split("text", "\n")).alias("text"))
    rows = rows.select("*", F.lit("NarrativeText").alias("type"), F.lit(None).cast("string").alias("table_html"))
    cfg = clean.CleanConfig(boilerplate_min_share=0.02)
    return clean.boilerplate_lines(clean.prepare(rows, unicode=False), cfg).select("doc_id", "key", "pages", "doc_pages", "blocks")


# The same reports over the whole cleaning job: Unicode folding, noise, merging and document copies are in none of the SQL above.


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks after all stages, document copies included."""
    return dedup.without_copies(clean.clean(lines(spark, sf_dir)))


@query()
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.totals(corpus(spark, sf_dir))


@query()
def corpus_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.by_reason(corpus(spark, sf_dir))


@query()
def corpus_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.by_type(corpus(spark, sf_dir))


@query()
def corpus_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.by_source(corpus(spark, sf_dir))


@query()
def corpus_worst_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.worst_documents(corpus(spark, sf_dir))


@query()
def corpus_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.artifact_count(corpus(spark, sf_dir), "[0-9]{4,}")


@query()
def corpus_block_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).where("drop_reason = 'duplicate'").select("block_id", "merged_into")


# Text signals.


@query(r"""WITH s AS (SELECT doc_id, text, lower(regexp_replace(text, '[^\p{L}]', '', 'g')) AS l,
    list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), ' '), lambda x: x <> '') AS t, regexp_replace(text, '\s', '', 'g') AS solid,
    len(regexp_extract_all(text, '[а-яёА-ЯЁ]')) AS cyr, len(regexp_extract_all(text, '[A-Za-z]')) AS lat FROM documents)
  SELECT doc_id, CASE WHEN cyr + lat < 3 THEN 'none' WHEN cyr >= lat THEN 'cyr' ELSE 'lat' END AS script,
    CASE WHEN cyr + lat < 3 OR length(l) = 0 THEN NULL WHEN cyr >= lat THEN round(len(regexp_extract_all(l, '[аеёиоуыэюя]')) / length(l), 6) ELSE round(len(regexp_extract_all(l, '[aeiouy]')) / length(l), 6) END AS vowel_ratio,
    CASE WHEN len(t) < 5 THEN 0.0 ELSE round(len(list_filter(t, lambda x: length(x) = 1)) / len(t), 6) END AS short_token_ratio,
    CASE WHEN length(solid) = 0 THEN 0.0 ELSE round((length(solid) - length(l)) / length(solid), 6) END AS nonalpha_ratio FROM s""")
def text_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("vowel_ratio", "short_token_ratio", "nonalpha_ratio")
    return table(spark, sf_dir, "documents").select("doc_id", X.script("text").alias("script"), *[F.round(X.SIGNALS[n]("text"), 6).alias(n) for n in names])


@query(r"""WITH s AS (SELECT doc_id, string_split(lower(regexp_replace(text, '[^\p{L}]', '', 'g')), '') AS l FROM documents)
  SELECT doc_id, CASE WHEN len(l) < 8 THEN 0.0 ELSE round(len(list_filter(range(1, len(l)), lambda i: l[i] = l[i + 1])) / (len(l) - 1), 6) END AS doubling_ratio FROM s""")
def doubling_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(X.doubling_ratio("text"), 6).alias("doubling_ratio"))


@query()
def garbage_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.with_noise(clean.prepare(lines(spark, sf_dir), unicode=False)).select("block_id", *X.SIGNALS, "garbage_score", "garbage_reason")


@query()
def clean_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", X.content_hash(X.norm_key("text")).alias("content_hash"), F.char_length(X.clean_text("text")).alias("n_clean"))


# Duplicates, merging, metadata.


@query()
def minhash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.similar_pairs(dedup.signatures(table(spark, sf_dir, "documents"), X.plain_key("text")))


@query()
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pairs = dedup.copy_pairs(dedup.signatures(docs, X.plain_key("text")))
    return dedup.duplicate_documents(pairs, docs.select("doc_id", F.size(F.split("text", "\n")).alias("kept")))


@query()
def fragment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.merge_fragments(clean.prepare(lines(spark, sf_dir), unicode=False))


@query(r"""WITH t AS (SELECT o_custkey AS doc_id, o_orderkey AS o, year(o_orderdate) AS y FROM orders),
  n AS (SELECT doc_id, y, count(*) AS n, min(o) AS f FROM t GROUP BY ALL)
  SELECT doc_id, CAST(y AS INTEGER) AS year FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1""")
def year_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for documents, their orders for blocks that name a year."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page"), F.col("o_orderkey").alias("order"), F.concat(F.lit("of "), F.year("o_orderdate"), F.lit(".")).alias("text"))
    return metadata.year_vote(rows)


@query(f"""WITH {_BLOCKS}, p AS (SELECT block_id, doc_id, text, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM blocks WHERE type IN ('NarrativeText', 'ListItem')) SELECT block_id FROM p WHERE before < 1500""")
def language_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.language_sample(lines(spark, sf_dir)).select("block_id")


@query(r"""WITH n AS (SELECT doc_id, sum(list_sum(list_transform(regexp_extract_all(text, '[а-яёА-ЯЁ]{4,}'), lambda w: length(w)))) AS c, sum(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z]{4,}'), lambda w: length(w)))) AS l FROM documents GROUP BY doc_id)
  SELECT doc_id, CASE WHEN coalesce(c, 0) + coalesce(l, 0) < 200 THEN 'both' WHEN coalesce(c, 0) >= 0.9 * (coalesce(c, 0) + coalesce(l, 0)) THEN 'cyr' WHEN coalesce(l, 0) >= 0.9 * (coalesce(c, 0) + coalesce(l, 0)) THEN 'lat' ELSE 'both' END AS dominance FROM n""")
def language_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.dominance(table(spark, sf_dir, "documents"))


@query()
def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.describe(lines(spark, sf_dir)).select("doc_id", "n_blocks", "n_pages", "title", "year", "lang", "category", "doc_type", F.size("authors").alias("n_authors"))


# Sections, contexts, chunks, units.


@query("""SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section FROM conversations""")
def section_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn is the heading of what follows."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("order"), "text", F.when(F.col("role") == "user", "Title").otherwise("NarrativeText").alias("type"))
    return split.with_sections(rows).select(F.col("doc_id").alias("conv_id"), F.col("order").alias("turn"), "section")


@query(r"""WITH c AS (SELECT conv_id, turn, concat_ws(' ', lag(text, 2) OVER w, lag(text, 1) OVER w, lead(text, 1) OVER w, lead(text, 2) OVER w) AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id, turn, substr(trim(regexp_replace(t, '\s+', ' ', 'g'), ' '), 1, 400) AS context FROM c""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("order"), "text", F.lit("NarrativeText").alias("type"))
    return split.with_context(rows).select(F.col("doc_id").alias("conv_id"), F.col("order").alias("turn"), "context")


@query()
def split_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.manifest(split.route(lines(spark, sf_dir)))


@query()
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunks(lines(spark, sf_dir))


@query()
def search_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    return chunk.search_units(chunk.chunks(rows), rows)


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS o FROM documents),
  r AS (SELECT doc_id, o, list_transform(string_split(t, ' | '), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'), ' ')) AS cells FROM l WHERE contains(t, ' | '))
  SELECT doc_id, CAST(o AS INTEGER) AS line, CAST(len(cells) AS INTEGER) AS n_cells, cells[1] AS first_cell FROM r""")
def html_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with separated cells, set as HTML tables and read back."""
    ls = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).where(F.col("t").contains(" | "))
    safe = F.replace(F.replace(F.replace("t", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit("<table><thead><tr><th>"), F.replace(safe, F.lit(" | "), F.lit("</th><th>")), F.lit("</th></tr></thead></table>"))
    header = tables.parse_table_html(html).header
    return ls.withColumn("h", header).select("doc_id", "line", F.size("h").alias("n_cells"), F.get("h", F.lit(0)).alias("first_cell"))


_UNIT_CASES = "('t', 'kg', 1000.0), ('kg', 'kg', 1.0), ('mm', 'm', 0.001), ('кДж', 'J', 1000.0), ('MPa', 'Pa', 1000000.0), ('min', 's', 60.0), ('°C', 'degC', 1.0), ('kJ/mol', 'J/mol', NULL), ('м', 'm', 1.0)"


@query(f"""WITH u AS (SELECT * FROM (VALUES {_UNIT_CASES}) v(unit, canonical, factor)), n AS (SELECT *, row_number() OVER () - 1 AS k FROM u)
  SELECT l_orderkey, l_linenumber, unit, canonical, round(l_quantity * CASE WHEN l_linenumber % 2 = 0 THEN 100 ELSE 1 END * factor, 6) AS si_value, CAST(2 AS INTEGER) AS n_found
  FROM lineitem JOIN n ON k = CAST(l_orderkey % 9 AS BIGINT)""")
def measurement_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities in nine units, half of them with a power of ten, in a sentence with a second measurement and things that are none; read back in SI units."""
    li = table(spark, sf_dir, "lineitem")
    unit = F.get(F.array(*[F.lit(u) for u in ("t", "kg", "mm", "кДж", "MPa", "min", "°C", "kJ/mol", "м")]), (F.col("l_orderkey") % 9).cast("int"))
    power = F.when(F.col("l_linenumber") % 2 == 0, "·10^{2}").otherwise("")
    said = F.concat(F.lit("lot v12 m of "), F.regexp_replace(F.col("l_quantity").cast("decimal(12,2)").cast("string"), r"\.", ","), power, F.lit(" "), unit, F.lit(", item 7.5.1 m, then 5 kg of 3 mmm"))
    found = units.extract_units(said)
    li = li.withColumn("found", found).withColumn("m", F.get("found", F.lit(0)))
    return li.select("l_orderkey", "l_linenumber", "m.unit", "m.canonical", F.round("m.si_value", 6).alias("si_value"), F.size("found").alias("n_found"))


_FORMULA_CASES = "('Fe2O3', 'oxide'), ('H2SO4', 'acid'), ('O2', 'simple_substance'), ('Ca(OH)2', 'base_other'), ('NaCl', 'salt'), ('CuSO4', 'salt'), ('NH3', 'base_other'), ('SiO2', 'oxide'), ('HCl', 'acid'), ('Fe₃O₄', 'oxide'), ('Al2(SO4)3', 'salt')"


@query(f"""WITH c AS (SELECT * FROM (VALUES {_FORMULA_CASES}) v(formula, formula_class)), n AS (SELECT *, row_number() OVER () - 1 AS k FROM c)
  SELECT p_partkey, formula, formula_class FROM part JOIN n ON k = CAST(p_partkey % 11 AS BIGINT)""")
def chemistry_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven formulas among words, stop words and symbols that are none."""
    p = table(spark, sf_dir, "part")
    f = F.get(F.array(*[F.lit(x) for x in ("Fe2O3", "H2SO4", "O2", "Ca(OH)2", "NaCl", "CuSO4", "NH3", "SiO2", "HCl", "Fe₃O₄", "Al2(SO4)3")]), (F.col("p_partkey") % 11).cast("int"))
    said = F.concat(F.lit("IN the ore of lot "), F.col("p_size").cast("string"), F.lit(" OF "), f, F.lit(" was found, NO other, see II and 1200"))
    return p.select("p_partkey", F.explode(chem.formulas(said)).alias("f")).where("f.valid").select("p_partkey", "f.formula", F.col("f.kind").alias("formula_class"))


# Retrieval.


def _lexical(spark: SparkSession, sf_dir: str, k: int, *methods: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), "text", F.col("source").alias("parent_id"))
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return docs, retrieval.lexical_top_k(docs, X.lexical_terms("text"), retrieval.query_terms(bench, X.lexical_terms("text")), k, methods, digits=6)


_INDEX = r"""
t AS (SELECT doc_id AS unit_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS av FROM t),
tf AS (SELECT unit_id, len, term, count(*) AS tf FROM (SELECT unit_id, len(w) AS len, unnest(w) AS term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT query_id, term, count(*) AS q_tf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark) GROUP BY ALL),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
bm AS (SELECT query_id, unit_id, round(sum(q_tf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / av))), 6) AS score FROM tf JOIN q USING (term) JOIN idf USING (term), st GROUP BY ALL),
sp AS (SELECT query_id, unit_id, round(sum(q_tf * tf * ln(1 + (n - df + 0.5) / (df + 0.5))), 6) AS score FROM tf JOIN q USING (term) JOIN df USING (term), st GROUP BY ALL),
bmr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS INTEGER) AS rank FROM bm),
spr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS INTEGER) AS rank FROM sp),
hits AS (SELECT *, 'bm25' AS channel FROM bmr WHERE rank <= 40 UNION ALL SELECT *, 'sparse' AS channel FROM spr WHERE rank <= 40),
fus AS (SELECT query_id, unit_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM hits GROUP BY ALL),
fusr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS INTEGER) AS rank FROM fus)
"""


def _rounded(scored: DataFrame, digits: int = 6) -> DataFrame:
    return scored.withColumn("score", F.round("score", digits))


@query(f"WITH {_INDEX} SELECT query_id, unit_id, rank, score FROM bmr WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir, 10, "bm25")[1].select("query_id", "unit_id", "rank", "score")


@query(f"WITH {_INDEX} SELECT query_id, unit_id, rank, score FROM spr WHERE rank <= 10")
def sparse_tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir, 10, "sparse")[1].select("query_id", "unit_id", "rank", "score")


def _fused(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, hits = _lexical(spark, sf_dir, 40, "bm25", "sparse")
    return docs, retrieval.fuse(hits)


@query(f"WITH {_INDEX} SELECT query_id, unit_id, rank, round(score, 6) AS score FROM fusr WHERE rank <= 20")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, fused = _fused(spark, sf_dir)
    return fused.where("rank <= 20").select("query_id", "unit_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {_INDEX}, p AS (SELECT fusr.*, source FROM fusr JOIN documents ON doc_id = unit_id)
  SELECT query_id, unit_id, source AS parent_id, rank FROM p QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1""")
def parent_child_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fused = _fused(spark, sf_dir)
    found = docs.select("unit_id", "parent_id").join(F.broadcast(fused), "unit_id")  # hits are few against documents
    return retrieval.best_of_parent(found).select("query_id", "unit_id", "parent_id", "rank")


@query(f"""WITH {_INDEX}, c AS (SELECT query_id, unit_id FROM fusr WHERE rank <= 40),
  s AS (SELECT query_id, unit_id, round(len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[\\p{{L}}\\p{{N}}]+')), regexp_extract_all(lower(d.text), '[\\p{{L}}\\p{{N}}]+')))
      / len(list_distinct(regexp_extract_all(lower(b.text), '[\\p{{L}}\\p{{N}}]+'))), 6) AS score FROM c JOIN benchmark b ON item_id = query_id JOIN documents d ON doc_id = unit_id)
  SELECT query_id, unit_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS INTEGER) AS rank FROM s WHERE score >= 0.55
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) <= 8""")
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fused = _fused(spark, sf_dir)
    hits = docs.select("unit_id", "text").join(F.broadcast(fused.where("rank <= 40")), "unit_id")
    hits = hits.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")
    hits = hits.withColumn("rerank_score", F.round(retrieval.lexical_rerank(X.lexical_terms("query"), X.lexical_terms("text")), 6))
    return retrieval.gate(hits).select("query_id", "unit_id", F.col("rerank_score").alias("score"), "rank")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
  s AS (SELECT query_id, v.vec_id AS unit_id, round(list_cosine_similarity(q.e, v.embedding), 4) AS score FROM q, embeddings v WHERE v.vec_id <> query_id)
  SELECT query_id, unit_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) <= 5""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20, against all others."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("vector"))
    hits = retrieval.dense_top_k(e, e.where("unit_id % 20 = 0").select(F.col("unit_id").alias("query_id"), "vector"), 12).where("unit_id <> query_id")
    return retrieval.top_k(_rounded(hits.drop("rank"), 4), 5).select("query_id", "unit_id", "score")


@query()
def retrieve_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), "text", F.lit(None).cast("bigint").alias("parent_id"))
    return retrieval.retrieve(docs, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND source = 'src1'")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.metadata_filter(table(spark, sf_dir, "documents"), {"lang": ["en", "de"], "source": "src1"}).select("doc_id", "lang", "source")


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice <= 1200")
def numeric_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("canonical", F.lit("kg"))
    return retrieval.numeric_filter(parts, units.numeric_condition("not more than 1200 kg"), value="p_retailprice").select("p_partkey", "p_retailprice")


# Similarity of users and items.


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("row"), F.col("user_id").alias("col")).agg(F.count(F.lit(1)).cast("double").alias("value"))


@query("""WITH r AS (SELECT event_type AS i, user_id AS u, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY ALL), n AS (SELECT i, sqrt(sum(v * v)) AS n FROM r GROUP BY i)
  SELECT x.i AS a, y.i AS b, round(sum(x.v * y.v) / any_value(nx.n) / any_value(ny.n), 6) AS similarity FROM r x JOIN r y ON x.u = y.u AND x.i < y.i JOIN n nx ON nx.i = x.i JOIN n ny ON ny.i = y.i GROUP BY x.i, y.i""")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.cosine_pairs(_ratings(spark, sf_dir)).select("a", "b", F.round("similarity", 6).alias("similarity"))


_COSINE = """r AS (SELECT event_type AS i, user_id AS u, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY ALL), n AS (SELECT i, sqrt(sum(v * v)) AS n FROM r GROUP BY i),
  cos AS (SELECT x.i AS a, y.i AS b, sum(x.v * y.v) / any_value(nx.n) / any_value(ny.n) AS s FROM r x JOIN r y ON x.u = y.u AND x.i < y.i JOIN n nx ON nx.i = x.i JOIN n ny ON ny.i = y.i GROUP BY x.i, y.i)"""


@query(f"WITH {_COSINE} SELECT a, b, round(s, 9) AS similarity FROM cos ORDER BY round(s, 12) DESC, a, b LIMIT 2")
def cosine_top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.top_pairs(recommend.cosine_pairs(_ratings(spark, sf_dir))).select("a", "b", F.round("similarity", 9).alias("similarity"))


@query(f"""WITH RECURSIVE {_COSINE}, e AS (SELECT a AS x, b AS y FROM cos WHERE s >= 0.9 UNION ALL SELECT b, a FROM cos WHERE s >= 0.9),
  reach AS (SELECT DISTINCT i AS id, i AS c FROM r UNION SELECT e.y, reach.c FROM reach JOIN e ON e.x = reach.id) SELECT id, min(c) AS cluster FROM reach GROUP BY id""")
def single_linkage_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _ratings(spark, sf_dir).select(F.col("row"), "col", "value")
    pairs = recommend.cosine_pairs(cells)
    return recommend.linkage_clusters(pairs, 0.9, cells.select(F.col("row").alias("id")).distinct())


# Graph.


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and order priorities as terms, joined by how many orders say so."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.concat(F.lit("c"), "o_custkey").alias("src"), F.lit("orders").alias("predicate"), F.col("o_orderpriority").alias("dst")).agg(F.count(F.lit(1)).alias("count"))


@query("""WITH r AS (SELECT 'c' || o_custkey AS src, o_orderpriority AS dst, count(*) AS n FROM orders GROUP BY ALL)
  SELECT dst AS a, src AS b, n AS "count" FROM r QUALIFY row_number() OVER (PARTITION BY dst ORDER BY n DESC, src) <= 16""")
def graph_neighbours_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = _relations(spark, sf_dir)
    seeds = rel.select(F.col("dst").alias("term_id")).distinct()
    terms = rel.select(F.col("src").alias("term_id"), F.lit("person").alias("kind")).distinct()
    return graph.neighbours(seeds, rel, terms, n_seeds=5).select("a", "b", "count")


@query("""WITH r AS (SELECT 'c' || o_custkey AS src, o_orderpriority AS dst, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) >= 3)
  SELECT x.dst AS first, x.src AS middle, y.dst AS last, x.n + y.n AS weight FROM r x JOIN r y ON x.src = y.src AND x.dst < y.dst""")
def graph_paths_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = _relations(spark, sf_dir)
    seeds = rel.select(F.col("dst").alias("term_id")).distinct()
    found = graph.paths(seeds, rel, 2, min_count=3)
    return found.select(F.get("nodes", F.lit(0)).alias("first"), F.get("nodes", F.lit(1)).alias("middle"), F.get("nodes", F.lit(2)).alias("last"), "weight")


@query("""WITH r AS (SELECT 'c' || o_custkey AS src, o_orderpriority AS dst, count(*) AS n FROM orders GROUP BY ALL)
  SELECT x.dst AS first, x.src AS middle, y.dst AS last, x.n + y.n AS weight FROM r x JOIN r y ON x.src = y.src AND x.dst < y.dst""")
def graph_paths_2hop_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As graph_paths_2hop, which walks relations of three counts and more, but over every relation."""
    rel = _relations(spark, sf_dir)
    seeds = rel.select(F.col("dst").alias("term_id")).distinct()
    found = graph.paths(seeds, rel, 2)
    return found.select(F.get("nodes", F.lit(0)).alias("first"), F.get("nodes", F.lit(1)).alias("middle"), F.get("nodes", F.lit(2)).alias("last"), "weight")


@query("SELECT a.conv_id, a.turn, CAST(b.turn - a.turn AS INTEGER) AS \"offset\", b.turn AS near FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn - a.turn IN (-1, 1, 2)")
def seq_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sequence_neighbours(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "offset", "near")


# Evaluation and bookkeeping.


@query("""WITH n AS (SELECT lang, count(*) AS n, sum(quality) AS h FROM labels JOIN documents USING (doc_id) GROUP BY lang), p AS (SELECT *, h / n AS p, 1.959963984540054 AS z FROM n)
  SELECT lang, round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 3) AS low,
         round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 3) AS high FROM p""")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("h"))
    low, high = audit.wilson(F.col("h"), F.col("n"))
    return j.select("lang", low.alias("low"), high.alias("high"))


@query("""WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
  SELECT event_type, max(CASE WHEN i = floor(0.05 * n) THEN value END) AS p05, max(CASE WHEN i = floor(0.25 * n) THEN value END) AS p25, max(CASE WHEN i = floor(0.5 * n) THEN value END) AS median FROM o GROUP BY event_type""")
def confidence_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.lower_quantiles(table(spark, sf_dir, "events"), "event_type", "value", {"p05": 0.05, "p25": 0.25, "median": 0.5}).select("event_type", "p05", "p25", "median")


@query("""WITH j AS (SELECT lang, quality = 1 AS t, n_chars > 400 AS p FROM labels JOIN documents USING (doc_id)), s AS (SELECT lang, count(*) AS s FROM documents GROUP BY lang),
  r AS (SELECT lang, any_value(s) AS s, avg(CAST(t AND p AS INTEGER)) AS h, avg(CAST(p AS INTEGER)) AS p, avg(CAST(t AS INTEGER)) AS t FROM j JOIN s USING (lang) GROUP BY lang),
  w AS (SELECT sum(s * h) AS h, sum(s * p) AS p, sum(s * t) AS t FROM r)
  SELECT round(h / p, 3) AS "precision", round(h / t, 3) AS recall, round(2 * (h / p) * (h / t) / (h / p + h / t), 3) AS f1 FROM w""")
def weighted_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    j = table(spark, sf_dir, "labels").join(docs, "doc_id").join(sizes, "lang").withColumn("t", F.col("quality") == 1).withColumn("p", F.col("n_chars") > 400)
    return audit.weighted_scores(j, "lang", "size", "p", "t")


@query("SELECT lang, least(count(*), 100 // (SELECT count(DISTINCT lang) FROM documents)) AS n FROM documents GROUP BY lang")
def stratified_sample_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.stratified_sample(table(spark, sf_dir, "documents"), "lang", 100, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, count(*) AS runs, CAST(sum(CAST(value < 0.1 AS INTEGER)) AS BIGINT) AS errors, round(avg(CASE WHEN NOT value < 0.1 THEN value END), 6) AS seconds FROM events GROUP BY event_type""")
def experiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.run_summary(table(spark, sf_dir, "events"), "event_type", F.col("value") < 0.1, F.col("value"), F.col("value"))
    return out.select("event_type", "runs", "errors", F.round("seconds", 6).alias("seconds"))


@query("""SELECT event_type AS mode, count(*) AS n, round(avg(value), 6) AS mean_score, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY event_type""")
def answer_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), F.col("value").alias("score"))
    return audit.answer_modes(records).select("mode", "n", F.round("mean_score", 6).alias("mean_score"), F.round("share", 6).alias("share"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def scope_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.in_scope(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id", "n_chars")


@query("SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'item', item_id, text FROM benchmark UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations")
def unit_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    b = table(spark, sf_dir, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), "text")
    c = table(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return a.unionByName(b).unionByName(c)


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)
  SELECT doc_id, CAST(len(list_distinct(w)) AS INTEGER) AS n_terms, w[1] AS first_term FROM t""")
def distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array_distinct(X.lexical_terms("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(terms).alias("n_terms"), F.get(terms, F.lit(0)).alias("first_term"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.get(F.map_values(m), F.lit(0)).alias("first_value"))


# Character model.


@query(r"""WITH e AS (SELECT CASE WHEN cyr + lat < 3 THEN 'none' WHEN cyr >= lat THEN 'cyr' ELSE 'lat' END AS script, '^' || regexp_replace(regexp_replace(regexp_replace(lower(text), '[0-9]', '#', 'g'), '\s+', ' ', 'g'), '[^а-яёa-z# ]', '.', 'g') AS t
    FROM (SELECT text, len(regexp_extract_all(text, '[а-яёА-ЯЁ]')) AS cyr, len(regexp_extract_all(text, '[A-Za-z]')) AS lat FROM documents)),
  g AS (SELECT script, substr(t, i, 3) AS g FROM (SELECT script, t, unnest(range(1, length(t) - 1)) AS i FROM e)), n AS (SELECT script, g, count(*) AS n FROM g GROUP BY ALL),
  c AS (SELECT script, substr(g, 1, 2) AS ctx, sum(n) AS m FROM n GROUP BY ALL)
  SELECT script, g, round(ln((n + 0.1) / (m + 6.3)), 6) AS logp FROM n JOIN c USING (script) WHERE ctx = substr(g, 1, 2)""")
def charlm_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("text", X.script("text").alias("script"))
    return language_model.train(rows).select("script", "g", F.round("logp", 6).alias("logp"))


@query()
def charlm_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", X.script("text").alias("script"))
    held = language_model.is_held_out(F.col("doc_id"))
    model = language_model.train(rows.where(~held))
    scored = checkpointed(language_model.score(rows, model, "doc_id"))  # read twice
    base = language_model.baselines(scored.where(held))
    return language_model.deviations(scored, base).select("doc_id", F.round("deviation", 6).alias("deviation"))


# Vectors on the sphere.


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 4) > 0 AS solid, 1.0 AS length FROM embeddings")
def sphere_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    on = learning.on_sphere(e)
    return on.select("vec_id", (retrieval.dot(F.col("vector"), F.col("vector")) > 0).alias("solid"), F.round(F.sqrt(retrieval.dot(F.col("vector"), F.col("vector"))), 6).alias("length"))


@query("""WITH c AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL), v AS (SELECT label, list(x ORDER BY i) AS centre FROM c GROUP BY label),
  s AS (SELECT vec_id, label, round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), centre), 5) AS cosine FROM embeddings JOIN v USING (label))
  SELECT label, vec_id, cosine FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) <= 5""")
def cluster_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    return learning.representatives(e, "label", "vec_id").select("label", "vec_id", F.round("cosine", 5).alias("cosine"))


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) - 1 AS ordinal FROM documents")
def chunk_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).alias("ordinal"))
