"""Atoms, chunks and search units of documents.

Chunking is a left fold over a document's blocks in order and so runs per document; everything around it is relational.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHUNK, FURNITURE_TYPES, ChunkConfig
from ..functions.latex import flatten_formula
from ..functions.tables import parse as parse_table
from ..functions.tables import parse_table_html, row_sentence
from ..functions.units import extract_units
from ..schemas import CHUNKS
from .storage import by_document

#: Words that open a legend, and words that lead to a table when a number or Roman numeral follows (fixed values).
LEGEND_WORDS = ("where", "here", "with", "где", "здесь", "причём", "причем")
TABLE_WORDS, TABLE_NUMERALS = ("table", "табл", "таблица"), "ivxlлc0123456789"
SHOWN_IN = (("shown", "in", "table"), ("приведен", "в", "табл"))
_WORD4 = re.compile(r"[A-Za-zА-Яа-яЁё]{4,}")


def count(text: str) -> int:
    return max(1, len(text) // 3)


def is_heading(row: dict) -> bool:
    t = (row["text"] or "").strip()
    if row["type"] != "Title" or not t or len(t) > 120 or t[-1] in ":;,—–-" or "$" in t:
        return False
    letters = [c for c in t if c.isalpha()]
    capitals = sum(c.isupper() for c in letters) / len(letters) if letters else 0
    return bool(re.match(r"\d+(?:\.\d+)*\.?\s|(?:глава|раздел|chapter|section|введение|заключение|introduction|conclusion|references|abstract)\b", t, re.I)) or capitals >= 0.7 or row.get("text_level") is not None


def sentences(text: str, budget: int) -> list[str]:
    """Sentences; one beyond the budget is cut at words to four fifths of it."""
    out = []
    for s in filter(None, (x.strip() for x in re.split(r"(?<=[.!?;])\s+|\n+", text))):
        if count(s) <= budget:
            out.append(s)
            continue
        piece: list[str] = []
        size = 0  # of the piece, with the blank before the next word
        for w in s.split():
            if piece and max(1, (size + len(w)) // 3) > budget * 4 // 5:
                out.append(" ".join(piece))
                piece, size = [], 0
            piece.append(w)
            size += len(w) + 1
        out.append(" ".join(piece))
    return out


def is_lead_in(text: str | None) -> bool:
    """Prose that names a table: the word with its number, or a phrase that shows something in a table."""
    words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    for i, w in enumerate(words):
        number = w[len(word) :] if (word := max((x for x in TABLE_WORDS if w.startswith(x)), key=len, default="")) else ""
        if word and (number[:1] or (words[i + 1][:1] if not number and i + 1 < len(words) else " ")) in TABLE_NUMERALS:
            return True
        a, b, c = (words[i : i + 3] + ["", "", ""])[:3]
        if (a, b, c) == SHOWN_IN[0] or (a[:-1] == SHOWN_IN[1][0] and a[-1:] in ("а", "о", "ы") and b == SHOWN_IN[1][1] and c.startswith(SHOWN_IN[1][2])):
            return True
    return False


def is_long_prose(text: str) -> bool:
    return len(text) > 240 or sum(text.count(c) for c in ".!?") >= 2


def is_legend(row: dict) -> bool:
    """An explanation of symbols: it opens with a word of legends, holds text set in a formula, or is a short definition."""
    t = (row["text"] or "").strip()
    first = next(iter("".join(c if c.isalnum() or c == "_" else " " for c in t.lower()).split(" ")), "")
    if not t or row["type"].startswith("Formula"):
        return False
    return first in LEGEND_WORDS or "\\text{" in (row.get("formula_latex") or "") or ("=" in t and not is_long_prose(t))


def atoms(rows: list[dict]) -> list[dict]:
    """Indivisible pieces: a table takes the lead-in before it; a formula the prose before it and the formulas and legends after it."""
    out: list[dict] = []
    for row in rows:
        t, kind = (row["text"] or "").strip(), row["type"]
        if kind in FURNITURE_TYPES and not _WORD4.search(t):
            continue
        if not t and not row.get("table_html"):
            continue
        last = out[-1] if out else None
        if is_heading(row):
            out.append({"kind": "heading", "rows": [row]})
        elif kind == "Table":
            lead = out.pop()["rows"] if last and last["kind"] == "prose" and is_lead_in(last["rows"][-1]["text"]) else []
            out.append({"kind": "table", "rows": [*lead, row]})
        elif kind.startswith("Formula"):
            if last and last["kind"] == "formula":
                last["rows"].append(row)
            else:
                lead = out.pop()["rows"] if last and last["kind"] == "prose" else []
                out.append({"kind": "formula", "rows": [*lead, row]})
        elif last and last["kind"] == "formula" and is_legend(row):
            last["rows"].append(row)
        elif kind == "FigureCaption":
            out.append({"kind": "figure", "rows": [row]})
        else:
            out.append({"kind": "list" if kind == "ListItem" else "prose", "rows": [row]})
    return out


def chunk_document(rows: list[dict], cfg: ChunkConfig = CHUNK) -> list[dict]:
    """The chunks of one document's rows in order; every text row is in at least one chunk."""
    out: list[dict] = []
    path: list[str] = []
    held: list[tuple[str, dict]] = []
    kinds: list[str] = []
    size = 0  # characters held, line ends included
    room_chars = 3 * cfg.max_tokens + 2

    def emit(parts: list[tuple[str, dict]], atom_kinds: list[str], parent: str = "", part: int = 0, of: int = 0) -> None:
        text = "\n".join(t for t, _ in parts)
        ids = list(dict.fromkeys(r["block_id"] for _, r in parts))
        out.append(
            {
                "doc_id": rows[0]["doc_id"], "chunk_id": f"{rows[0]['doc_id']}#c{len(out)}", "section": " / ".join(path), "section_path": list(path),
                "pages": sorted({r["page"] for _, r in parts}), "text": text, "parent_text": parent or text, "block_ids": ids, "atom_kinds": sorted(set(atom_kinds)),
                "n_tokens": count(text), "table_part": part, "table_parts": of,
            }
        )

    def flush(overlap: bool = False) -> None:
        nonlocal held, kinds, size
        if not held:
            return
        emit(held, kinds)
        tail = []
        if overlap and held[-1][1]["type"] not in ("Table",):
            last = sentences(held[-1][0], cfg.max_tokens)[-cfg.overlap_sentences :]
            joined = " ".join(last)
            if last and count(joined) <= cfg.overlap_share * cfg.max_tokens and joined != held[-1][0]:
                tail = [(joined, held[-1][1])]
        held, kinds, size = tail, (["prose"] if tail else []), sum(len(t) + 1 for t, _ in tail)

    for atom in atoms(rows):
        if atom["kind"] == "heading":
            flush()
            row = atom["rows"][0]
            level = int(row["text_level"]) if row.get("text_level") and not pd.isna(row["text_level"]) else 1
            path = [*path[: level - 1], row["text"].strip()]
            held, kinds, size = [(row["text"].strip(), row)], ["heading"], len(row["text"].strip()) + 1
        elif atom["kind"] == "table":
            flush()
            lead, row = atom["rows"][:-1], atom["rows"][-1]
            header, body = parse_table(row.get("table_html"))
            line = lambda cells: "| " + " | ".join(cells) + " |"
            top = [r["text"] for r in lead] + ([row["text"]] if (row["text"] or "").strip() else []) + ([line(header)] if header else [])
            full = "\n".join([*top, *map(line, body)])
            room, parts, piece = max(1, cfg.max_tokens - count("\n".join(top))), [], []
            for cells in body:
                if piece and count("\n".join([*map(line, piece), line(cells)])) > room:
                    parts.append(piece)
                    piece = []
                piece.append(cells)
            parts.append(piece)
            for i, p in enumerate(parts, 1):
                note = [f"rows, part {i} of {len(parts)}"] if len(parts) > 1 else []
                emit([("\n".join([*top, *note, *map(line, p)]), r) for r in [*lead, row][:1]] + [("", r) for r in [*lead, row][1:]], ["table"], full, i, len(parts))
                out[-1]["text"] = out[-1]["text"].rstrip("\n")
        elif atom["kind"] == "formula":
            parts = [(r["text"].strip(), r) for r in atom["rows"]]
            if size + sum(len(t) + 1 for t, _ in parts) > room_chars:
                flush()
            held, kinds = [*held, *parts], [*kinds, "formula"]
            flush()
        else:
            row = atom["rows"][0]
            pieces = [row["text"].strip()] if count(row["text"]) <= cfg.max_tokens else sentences(row["text"], cfg.max_tokens)
            for p in pieces:
                if held and size + len(p) > room_chars:
                    flush(overlap=atom["kind"] == "prose")
                    if size + len(p) > room_chars:
                        held, kinds, size = [], [], 0
                held, kinds, size = [*held, (p, row)], [*kinds, atom["kind"]], size + len(p) + 1
    flush()
    return out


def chunks(blocks: DataFrame, cfg: ChunkConfig = CHUNK) -> DataFrame:
    wanted = ["block_id", "doc_id", "order", "page", "type", "table_html"]
    level = F.col("text_level") if "text_level" in blocks.columns else F.lit(None).cast("int")
    rows = blocks.select(*wanted, F.coalesce("text", F.lit("")).alias("text"), level.alias("text_level"))
    return by_document(rows, lambda rows: chunk_document(rows, cfg), CHUNKS)


def parents(chunked: DataFrame) -> DataFrame:
    """block_id, parent_chunk_id: the first chunk that holds a block."""
    number = F.regexp_extract("chunk_id", r"#c([0-9]+)$", 1).cast("int")
    return chunked.select("chunk_id", number.alias("n"), F.explode("block_ids").alias("block_id")).groupBy("block_id").agg(F.min_by("chunk_id", "n").alias("parent_chunk_id"))


def search_units(chunked: DataFrame, blocks: DataFrame) -> DataFrame:
    """Chunks, formulas, table rows, table cells and quantities as one table of units with their parent chunk."""
    texts = chunked.select(F.col("chunk_id").alias("parent_chunk_id"), F.col("text").alias("parent_text"), "section")
    owned = blocks.join(parents(chunked), "block_id").join(texts, "parent_chunk_id")
    chunk = chunked.select(F.col("chunk_id").alias("unit_id"), F.col("chunk_id").alias("parent_chunk_id"), F.lit("chunk").alias("unit_type"), F.lit("text").alias("vector_kind"), "doc_id", "section", "text", "parent_text")
    number = F.regexp_extract("text", r"\(\s*([0-9]+(?:[.\-–][0-9]+)*)\s*\)\s*$", 1)
    formula = owned.where(F.col("type").startswith("Formula")).select(
        F.concat("block_id", F.lit("#formula")).alias("unit_id"), "parent_chunk_id", F.lit("formula").alias("unit_type"),
        F.when(F.coalesce("category", F.lit("")) == "chemistry", "chemistry").otherwise("math").alias("vector_kind"), "doc_id", "section",
        flatten_formula("text").alias("text"), "parent_text", F.col("text").alias("formula"), F.when(number != "", number).alias("eq_number"),
    )
    table = owned.where((F.col("type") == "Table") & F.col("table_html").isNotNull()).withColumn("t", parse_table_html("table_html")).withColumn("header", F.col("t.header"))
    rows = table.select("block_id", "parent_chunk_id", "doc_id", "section", "parent_text", F.col("text").alias("caption"), "header", F.posexplode("t.rows").alias("i", "cells"))
    row = rows.select(
        F.concat("block_id", F.lit("#table#r"), "i").alias("unit_id"), "parent_chunk_id", F.lit("table_row").alias("unit_type"), F.lit("table").alias("vector_kind"), "doc_id", "section",
        F.concat_ws(" | ", F.when(F.col("caption") != "", F.col("caption")), row_sentence(F.col("header"), F.col("cells"))).alias("text"), "parent_text", F.col("i").alias("row_index"),
    )
    cells = rows.select("*", F.posexplode("cells").alias("j", "v")).where((F.col("v") != "") & (F.col("j") > 0))
    name = F.coalesce(F.get("header", F.col("j")), F.concat(F.lit("column "), F.col("j") + 1))
    cell = cells.select(
        F.concat("block_id", F.lit("#table#r"), "i", F.lit("#c"), "j").alias("unit_id"), "parent_chunk_id", F.lit("table_cell").alias("unit_type"), F.lit("table").alias("vector_kind"), "doc_id", "section",
        F.concat_ws(" | ", F.when(F.col("caption") != "", F.col("caption")), F.get("cells", F.lit(0)), name, "v").alias("text"), "parent_text", F.col("i").alias("row_index"), F.col("j").alias("cell_index"), name.alias("column_name"),
    )
    found = chunked.select("chunk_id", "doc_id", "section", "text", F.posexplode(extract_units("text")).alias("i", "m"))
    quantity = found.select(
        F.concat("chunk_id", F.lit("#quantity"), "i").alias("unit_id"), F.col("chunk_id").alias("parent_chunk_id"), F.lit("quantity").alias("unit_type"), F.lit("unit").alias("vector_kind"), "doc_id", "section",
        F.col("m.text").alias("text"), F.col("text").alias("parent_text"), "m.value", "m.unit", "m.canonical", "m.si_value",
    )
    out = chunk
    for other in (formula, row, cell, quantity):
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def element_names(symbols: Column, names: dict[str, tuple[str, ...]]) -> Column:
    """All names of the elements, for a text that is searched."""
    table = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.flatten(F.transform(symbols, lambda s: F.coalesce(F.element_at(table, s), F.array().cast("array<string>")))))
