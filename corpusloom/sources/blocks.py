"""Sources and sinks of block tables: JSONL records, parser output, plain documents, Parquet."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import RAW_RECORD


def flatten(records: DataFrame) -> DataFrame:
    """Nested records as flat blocks: null text is '', flags default to false, lists are joined."""
    return records.select(
        "block_id",
        "doc_id",
        F.col("order"),
        "page",
        F.coalesce("type", F.lit("UncategorizedText")).alias("type"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("text_source", F.lit("")).alias("text_source"),
        F.coalesce("reliable", F.lit(False)).alias("reliable"),
        F.concat_ws(",", "languages").alias("languages"),
        "table_html",
        "category",
        F.col("bbox.x0").alias("x0"),
        F.col("bbox.top").alias("top"),
        F.col("bbox.x1").alias("x1"),
        F.col("bbox.bottom").alias("bottom"),
        F.col("page_size.width").alias("page_width"),
        F.col("page_size.height").alias("page_height"),
    )


def read_jsonl(spark: SparkSession, root: str, name: str = "blocks.jsonl") -> DataFrame:
    """All files of that name below root; blank and corrupt lines are skipped."""
    reader = spark.read.schema(RAW_RECORD).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").option("pathGlobFilter", name)
    return flatten(reader.json(root))


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Parquet with the blocks of a document together and in order."""
    blocks.repartition("doc_id").sortWithinPartitions("doc_id", "order").write.option("compression", "zstd").parquet(path)


def swap_in(df: DataFrame, path: str) -> None:
    """Replaces a table: the new one is written beside it and moved into its place; the old one stays as ``.bak`` once."""
    spark = df.sparkSession
    jvm = spark._jvm
    target, fresh, backup = (jvm.org.apache.hadoop.fs.Path(path + x) for x in ("", ".new", ".bak"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(path + ".new")
    if fs.exists(target):
        if fs.exists(backup):
            fs.delete(target, True)
        else:
            fs.rename(target, backup)
    fs.rename(fresh, target)


def line_type(text: Column) -> Column:
    """The block type of a plain line."""
    n = F.char_length(text)
    return (
        F.when(text.rlike(r"^\s*[-*•]\s"), "ListItem")
        .when(text.contains(" | "), "Table")
        .when((n <= 40) & ~text.rlike(r"[:;,]\s*$"), "Title")
        .when(n <= 15, "UncategorizedText")
        .otherwise("NarrativeText")
    )


def from_documents(documents: DataFrame, lines_per_page: int = 40) -> DataFrame:
    """Plain documents as blocks: one per line, pages of a fixed number of lines. Null text gives no block."""
    lines = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang"), F.col("source"), F.posexplode(F.split("text", "\n")).alias("order", "text"))
    return lines.select(
        F.concat_ws("#", "doc_id", F.col("order").cast("string")).alias("block_id"),
        "doc_id",
        "order",
        (F.floor(F.col("order") / lines_per_page) + 1).cast("int").alias("page"),
        line_type(F.col("text")).alias("type"),
        "text",
        F.lit("text_layer").alias("text_source"),
        F.lit(False).alias("reliable"),
        F.col("lang").alias("languages"),
        F.lit(None).cast("string").alias("table_html"),
        F.col("source").alias("category"),
        *[F.lit(None).cast("double").alias(c) for c in ("x0", "top", "x1", "bottom", "page_width", "page_height")],
    )


def with_neighbours(blocks: DataFrame) -> DataFrame:
    """prev_id and next_id: the neighbouring blocks on the same page."""
    w = Window.partitionBy("doc_id", "page").orderBy("order")
    return blocks.withColumn("prev_id", F.lag("block_id").over(w)).withColumn("next_id", F.lead("block_id").over(w))


# Layout-parser output: JSON lists of pages (version 2) or of flat items (version 1).

_V2 = {"title": "Title", "paragraph": "NarrativeText", "equation_interline": "Formula", "table": "Table", "image": "FigureCaption", "chart": "FigureCaption", "list": "ListItem"}
_V1 = {"text": "NarrativeText", "equation": "Formula", "table": "Table", "image": "FigureCaption", "ref_text": "ListItem", "list": "ListItem"}
_PAGE = {"page_header": "Header", "page_footer": "Footer", "header": "Header", "footer": "Footer", "page_number": "PageNumber", "page_footnote": "Footer", "aside_text": "Footer"}


def spans_text(content) -> str:
    """Text of nested spans; inline formulas stand between $."""
    if content is None:
        return ""
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        return " ".join(filter(None, map(spans_text, content)))
    if isinstance(content, dict):
        inner = next((spans_text(content[k]) for k in ("content", "spans", "children", "text", "paragraph_content", "title_content", "item_content", "list_items") if content.get(k)), "")
        return f"${inner.strip()}$" if content.get("type") in ("equation_inline", "inline_equation") and inner else inner
    return str(content)


def _block(kind, page, text="", html=None, level=None, caption="", latex=None, box=None):
    return {"type": kind, "page": page, "text": text.strip(), "table_html": html, "text_level": level, "caption": caption.strip(), "formula_latex": latex, "bbox": box}


def parser_blocks(document: str | None) -> list[dict]:
    """Blocks of one parser document, in reading order; a document that cannot be read gives none."""
    try:
        data = json.loads(document or "")
    except ValueError:
        return []
    out: list[dict] = []
    if isinstance(data, list) and data and all(isinstance(p, list) for p in data):
        items = [(n, x) for n, page in enumerate(data, 1) for x in page if isinstance(x, dict)]
    else:
        items = [(int(x.get("page_idx", 0)) + 1, x) for x in data if isinstance(x, dict)] if isinstance(data, list) else []
    for page, x in items:
        kind, box = str(x.get("type", "")), x.get("bbox")
        body = x.get("content") if isinstance(x.get("content"), dict) else x
        caption = spans_text(next((body[k] for k in (f"{kind}_caption", "caption", "image_caption", "table_caption", "img_caption") if body.get(k)), ""))
        if kind in _PAGE:
            out.append(_block(_PAGE[kind], page, spans_text(body.get("text") or body.get("content") or body.get(f"{kind}_content")), box=box))
        elif kind == "title" or (kind == "text" and x.get("text_level")):
            out.append(_block("Title", page, spans_text(body.get("title_content") or body.get("text") or body.get("content")), level=int(body.get("level") or x.get("text_level") or 1), box=box))
        elif kind in ("equation_interline", "equation"):
            latex = spans_text(body.get("math_content") or body.get("latex") or body.get("text") or body.get("content"))
            out.append(_block("Formula", page, latex, latex=latex, box=box))
        elif kind == "table":
            out.append(_block("Table", page, caption, html=body.get("html") or body.get("table_body") or None, caption=caption, box=box))
        elif kind in ("image", "chart"):
            if caption:
                out.append(_block("FigureCaption", page, caption, caption=caption, box=box))
        elif kind == "list":
            out += [_block("ListItem", page, t, box=box) for t in map(spans_text, body.get("list_items") or body.get("items") or []) if t.strip()]
        elif text := spans_text(body.get("paragraph_content") or body.get("text") or body.get("content")):
            out.append(_block(_V2.get(kind) or _V1.get(kind) or "UncategorizedText", page, text, box=box))
    return out


_PARSED = "array<struct<type:string,page:int,text:string,table_html:string,text_level:int,caption:string,formula_latex:string>>"


def read_parser_output(files: DataFrame) -> DataFrame:
    """files: doc_id, content (the JSON as text). Blocks with ids, order and neighbours."""

    @F.pandas_udf(_PARSED)
    def convert(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: [{k: v for k, v in b.items() if k != "bbox"} for b in parser_blocks(c)])

    rows = files.select("doc_id", F.posexplode(convert("content")).alias("order", "b")).select("doc_id", F.col("order"), "b.*")
    return with_neighbours(rows.withColumn("block_id", F.concat_ws("#", "doc_id", F.col("order").cast("string"))))


def find_parser_files(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, content of each document folder's content list; version 2 before version 1, ``hybrid_auto`` first."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*content_list*.json").select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("path"))
    doc = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"_content_list(?:_v2)?\.json$", "")
    order = F.struct((~F.col("path").contains("/hybrid_auto/")).alias("a"), (~F.col("path").endswith("_v2.json")).alias("b"), F.col("path").alias("c"))
    return raw.withColumn("doc_id", doc).groupBy("doc_id").agg(F.min_by("content", order).alias("content"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A text matrix (cells by blanks, tabs, commas or semicolons) as (row, col, value); ragged matrices are refused."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.trim("value"), r"\r?\n")).alias("row", "line")).where(F.trim("line") != "")
    cells = lines.select("row", F.posexplode(F.array_remove(F.split(F.trim("line"), r"[\s,;]+"), "")).alias("col", "cell")).select("row", "col", F.col("cell").cast("double").alias("value"))
    widths = cells.groupBy("row").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n"), F.max("n")).first()
    if widths[0] != widths[1]:
        raise ValueError("the rows of the matrix differ in length")
    return cells


def pending(manifest: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Manifest rows without a result."""
    return manifest.join(done.select(key).distinct(), key, "left_anti")


def in_scope(rows: DataFrame, manifest: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows that a manifest names; without one, all."""
    return rows if manifest is None else rows.join(manifest.select(*keys).distinct(), keys, "left_semi")


def read_questions(spark: SparkSession, path: str, column: str = "question") -> DataFrame:
    """Questions of a CSV or Excel table; blanks go, the row number stands in for a missing id."""
    table = pd.read_excel(path) if re.search(r"\.xlsx?$", path) else pd.read_csv(path)
    table = table.assign(id=table["id"] if "id" in table else range(1, len(table) + 1))
    table = table[table[column].notna() & (table[column].astype(str).str.strip().str.lower() != "nan") & (table[column].astype(str).str.strip() != "")]
    return spark.createDataFrame([(int(i), str(q).strip()) for i, q in zip(table["id"], table[column])], "id bigint, question string")


