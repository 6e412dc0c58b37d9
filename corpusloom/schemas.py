"""Explicit schemas, as DDL, of the tables that pass between operators."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_RECORD = (
    "block_id string, doc_id string, `order` int, page int, type string, text string, text_source string, reliable boolean, "
    "languages array<string>, table_html string, category string, "
    "bbox struct<x0:double,top:double,x1:double,bottom:double>, page_size struct<width:double,height:double>, "
    "layout struct<math_font_ratio:double,italic_ratio:double,n_subscript:int,n_superscript:int,n_fonts:int>"
)
BLOCKS = (
    "block_id string, doc_id string, `order` int, page int, type string, text string, text_source string, reliable boolean, languages string, "
    "table_html string, category string, x0 double, top double, x1 double, bottom double, page_width double, page_height double"
)
CHUNKS = (
    "doc_id string, chunk_id string, section string, section_path array<string>, pages array<int>, text string, parent_text string, "
    "block_ids array<string>, atom_kinds array<string>, n_tokens int, table_part int, table_parts int"
)
UNITS = (
    "unit_id string, parent_chunk_id string, unit_type string, vector_kind string, doc_id string, section string, text string, parent_text string, "
    "row_index int, cell_index int, column_name string, value double, unit string, canonical string, si_value double, formula string, eq_number string"
)

# Types of UDF results are objects: UDFs are made at import, when there may be no session to read DDL.
STRING, DOUBLE, INT, BOOLEAN = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()
STRINGS = T.ArrayType(STRING)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


MEASUREMENTS = T.ArrayType(struct(value=DOUBLE, unit=STRING, canonical=STRING, text=STRING, si_value=DOUBLE))
NOISE_SIGNALS = struct(doubling_ratio=DOUBLE, vowel_ratio=DOUBLE, consonant_run_max=INT, short_token_ratio=DOUBLE, nonalpha_ratio=DOUBLE, repeat_run_max=INT)
SPECIES = struct(elements=STRINGS, subscripted=BOOLEAN)
EQUATION = struct(species=STRINGS, elements=STRINGS, junk=INT, subscripted=BOOLEAN, is_equation=BOOLEAN)
LATEX = struct(latex=STRING, number=STRING)
DECISION = struct(decision=STRING, reason=STRING, text=STRING)
HTML_TABLE = struct(header=STRINGS, rows=T.ArrayType(STRINGS))
HITS = "query_id bigint, channel string, unit_id string, rank int, score double"


def names(ddl: str) -> list[str]:
    """Column names of a flat schema."""
    return [c.split()[0].strip("`") for c in ddl.split(", ")]
FORMULAS = T.ArrayType(struct(formula=STRING, valid=BOOLEAN, kind=STRING))
