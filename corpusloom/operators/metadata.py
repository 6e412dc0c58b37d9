"""Document metadata from its blocks: year, title, authors, language, type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

YEAR = r"(?<![\p{L}\p{N}_])((?:19|20)[0-9]{2})(?![\p{L}\p{N}_])"
AUTHOR = r"(?:[A-ZА-ЯЁ]\.\s?){1,2}[A-ZА-ЯЁ][a-zа-яё]+(?:-[A-ZА-ЯЁ][a-zа-яё]+)?|[A-ZА-ЯЁ][a-zа-яё]+\s(?:[A-ZА-ЯЁ]\.\s?){1,2}"


def years(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(X.text_or_empty(c), F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))


def category_of(doc_id: Column) -> Column:
    """The part before the first double underscore; the whole id without one."""
    return F.substring_index(doc_id, "__", 1)


def topic_of(doc_id: Column) -> Column:
    """The part before the first double underscore; '' without one."""
    return F.when(doc_id.contains("__"), F.substring_index(doc_id, "__", 1)).otherwise("")


#: Words of a document's name that make it a standard or a book, in any case (fixed values).
STANDARD_WORDS, BOOK_WORDS = ("итс", "гост", "iso"), ("book",)
#: Types of the blocks whose years count, and the last year that can be one (fixed values).
YEAR_TYPES, LAST_YEAR = ("Header", "Footer", "Title", "NarrativeText"), 2026


def document_type(doc_id: Column) -> Column:
    """standard, book or article, by whole words of the name; an underscore joins words."""
    words = F.split(F.lower(F.coalesce(doc_id, F.lit(""))), r"[^\p{L}\p{N}_]+")
    has = lambda names: F.arrays_overlap(words, F.array(*[F.lit(n) for n in names]))
    return F.when(has(STANDARD_WORDS), "standard").when(doc_id.contains("Книги") | has(BOOK_WORDS), "book").otherwise("article")


def name_year(doc_id: Column) -> Column:
    """The last year in a document's name; that of a standard's number (``ИТС 12-2019``) counts after the others."""
    of_standard = F.transform(F.regexp_extract_all(X.text_or_empty(doc_id), F.lit(r"(?i)ИТС\s+[0-9]+[-–]([0-9]{4})"), F.lit(1)), lambda y: y.cast("int"))
    return F.try_element_at(F.filter(F.concat(years(doc_id), of_standard), lambda y: y.between(1900, LAST_YEAR)), F.lit(-1))


def year_vote(blocks: DataFrame, first_pages: int = 3) -> DataFrame:
    """doc_id, year: the last year of the document's name; without one the most frequent year of the first pages, of equal counts the one seen first.

    A doc_id that is no text is a key and no name: key 1995 names no year.
    """
    kind = F.col("type").isin(*YEAR_TYPES) if "type" in blocks.columns else F.lit(True)
    of_name = name_year(F.col("doc_id")) if isinstance(blocks.schema["doc_id"].dataType, T.StringType) else F.lit(None).cast("int")
    rows = blocks.withColumn("_named", of_name)
    named = rows.where(F.col("_named").isNotNull()).groupBy("doc_id").agg(F.first("_named").alias("year"))
    seen = rows.where(F.col("_named").isNull() & (F.col("page") <= first_pages) & kind).select("doc_id", "order", F.posexplode(years(F.col("text"))).alias("at", "year"))
    counts = seen.where(F.col("year").between(1900, LAST_YEAR)).groupBy("doc_id", "year").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("order", "at")).alias("first"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")
    return counts.withColumn("r", F.row_number().over(w)).where("r = 1").select("doc_id", "year").unionByName(named)


def first_titles(blocks: DataFrame) -> DataFrame:
    """doc_id, title, title_page, title_order: the title on the lowest page, of the highest level, then the first."""
    level = F.col("text_level") if "text_level" in blocks.columns else F.lit(1)
    order = F.struct(F.col("page"), level.alias("level"), F.col("order"))
    return (
        blocks.where((F.col("type") == "Title") & (F.trim("text") != ""))
        .groupBy("doc_id")
        .agg(F.min_by(F.struct("text", "page", F.col("order")), order).alias("t"))
        .select("doc_id", F.trim("t.text").alias("title"), F.col("t.page").alias("title_page"), F.col("t.order").alias("title_order"))
    )


def authors(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """doc_id, authors: names in the first prose block after the title on its page."""
    after = blocks.join(titles, "doc_id").where((F.col("page") == F.col("title_page")) & (F.col("order") > F.col("title_order")) & F.col("type").isin("NarrativeText", "ListItem"))
    line = after.groupBy("doc_id").agg(F.min_by("text", "order").alias("line"))
    return line.select("doc_id", F.array_distinct(F.transform(F.regexp_extract_all("line", F.lit(f"({AUTHOR})"), F.lit(1)), lambda a: F.trim(a))).alias("authors"))


def language_sample(blocks: DataFrame, chars: int = 1500) -> DataFrame:
    """The leading prose blocks of each document until they hold ``chars`` characters (the one that fills it included)."""
    prose = blocks.where(F.col("type").isin("NarrativeText", "ListItem"))
    before = F.coalesce(F.sum(F.char_length("text")).over(Window.partitionBy("doc_id").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return prose.withColumn("before", before).where(F.col("before") < chars).drop("before")


def languages(blocks: DataFrame) -> DataFrame:
    """doc_id, lang: ru or en by the letters of the language sample, '' without letters."""
    n = language_sample(blocks).groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(f"[{X.CYRILLIC}]"))).alias("cyr"), F.sum(F.regexp_count("text", F.lit("[A-Za-z]"))).alias("lat"))
    return n.select("doc_id", F.when(F.col("cyr") + F.col("lat") == 0, "").when(F.col("cyr") >= F.col("lat"), "ru").otherwise("en").alias("lang"))


def dominance(blocks: DataFrame, share: float = 0.9, least_letters: int = 200) -> DataFrame:
    """doc_id, dominance: cyr, lat or both, by letters in words of 4 or more."""
    count = lambda p: F.sum(F.aggregate(F.regexp_extract_all("text", F.lit(p), F.lit(0)), F.lit(0), lambda a, w: a + F.char_length(w)))
    n = blocks.groupBy("doc_id").agg(count("[а-яёА-ЯЁ]{4,}").alias("cyr"), count("[A-Za-z]{4,}").alias("lat"))
    total = F.col("cyr") + F.col("lat")
    return n.select("doc_id", F.when(total < least_letters, "both").when(F.col("cyr") >= share * total, "cyr").when(F.col("lat") >= share * total, "lat").otherwise("both").alias("dominance"))


def describe(blocks: DataFrame) -> DataFrame:
    """One row per document: category, doc_type, title, authors, year, lang, n_blocks, n_pages."""
    titles = first_titles(blocks)
    docs = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.countDistinct("page").alias("n_pages"))
    rest = (titles.select("doc_id", "title"), authors(blocks, titles), year_vote(blocks), languages(blocks))
    for t in rest:
        docs = docs.join(t, "doc_id", "left")
    return docs.withColumn("category", category_of(F.col("doc_id"))).withColumn("doc_type", document_type(F.col("doc_id")))


def stamp(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """Blocks with their document's year, title, language and type; a category of their own stays."""
    d = documents.select("doc_id", "year", "title", "lang", "doc_type", F.col("category").alias("_category"))
    return blocks.join(d, "doc_id", "left").withColumn("category", F.coalesce("category", "_category")).drop("_category")


def coverage(documents: DataFrame) -> DataFrame:
    return documents.groupBy("doc_type", "lang").agg(F.count(F.lit(1)).alias("documents"), F.count("year").alias("with_year"), F.count("title").alias("with_title"))
