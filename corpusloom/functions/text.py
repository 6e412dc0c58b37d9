"""Text normalisation, hashing and quality signals as Column expressions.

Unicode folding (NFKC, casefold) has no built-in function, so it is one Arrow-batched
UDF; everything after it stays in the JVM. Null text counts as empty.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import NOISE_SIGNALS, STRING

CYRILLIC = "а-яёА-ЯЁ"
#: Vowels by script (fixed values).
CYRILLIC_VOWELS = "аеёиоуыэюя"
LATIN_VOWELS = "aeiouy"
INVISIBLE = r"[​-‏‪-‮⁠﻿­]"
WIDE_SPACE = r"[ \t  -   ]+"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


@F.pandas_udf(STRING)
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(STRING)
def nfkc_casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def clean_text(c: Column | str) -> Column:
    """Readable text: compatibility forms folded, invisible marks and font placeholders dropped, hyphen breaks joined, white space collapsed."""
    t = nfkc(text_or_empty(c))
    t = F.regexp_replace(t, INVISIBLE, "")
    t = F.regexp_replace(t, r"\(cid:\d+\)", "")
    t = F.regexp_replace(t, r"(?U)(\w{2,})[-‐‑]\s+([а-яёa-z]\w*)", "$1$2")
    t = F.regexp_replace(t, WIDE_SPACE, " ")
    return F.trim(F.regexp_replace(t, r"\s*\n\s*", "\n"))


def norm_key(c: Column | str) -> Column:
    """Key under which repeats are recognised: folded, digits as #, punctuation as space."""
    t = F.regexp_replace(nfkc_casefold(text_or_empty(c)), r"(?U)\d", "#")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?U)[^\w\s#]", " "), r"(?U)\s+", " "))


def plain_key(c: Column | str) -> Column:
    """A key without Unicode folding, wholly in the JVM: lower case, runs of other characters as one space."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(c)), r"[^\p{L}\p{N}]+", " "))


def content_hash(key: Column) -> Column:
    """128 bits of SHA-256: equality of keys, whatever their length."""
    return F.left(F.sha2(key, 256), F.lit(32))


def letters(c: Column | str) -> Column:
    return F.regexp_replace(text_or_empty(c), r"[^\p{L}]", "")


def script(c: Column | str) -> Column:
    """cyr, lat or none (fewer than 3 letters of either); a tie is cyr."""
    t = text_or_empty(c)
    cyr, lat = F.regexp_count(t, F.lit(f"[{CYRILLIC}]")), F.regexp_count(t, F.lit("[A-Za-z]"))
    return F.when(cyr + lat < 3, "none").when(cyr >= lat, "cyr").otherwise("lat")


def doubling_ratio(c: Column | str) -> Column:
    """Equal neighbours among the letters over pairs of neighbours; fewer than 8 letters give 0."""
    s = F.lower(letters(c))
    n = F.char_length(s)
    # Look-ahead counts overlapping pairs.
    return F.when(n < 8, 0.0).otherwise(F.regexp_count(s, F.lit(r"(.)(?=\1)")) / F.greatest(n - 1, F.lit(1)))


def vowel_ratio(c: Column | str) -> Column:
    s, kind = F.lower(letters(c)), script(c)
    n = F.char_length(s)
    of = lambda v: F.regexp_count(s, F.lit(f"[{v}]")) / n
    return F.when((kind == "none") | (n == 0), F.lit(None).cast("double")).when(kind == "cyr", of(CYRILLIC_VOWELS)).otherwise(of(LATIN_VOWELS))


def consonant_run_max(c: Column | str) -> Column:
    """The longest run of letters that are no vowels, within a word."""
    t = F.lower(text_or_empty(c))
    runs = F.regexp_extract_all(t, F.lit(rf"[\p{{L}}&&[^{CYRILLIC_VOWELS}{LATIN_VOWELS}ьъ]]+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.char_length(r))), F.lit(0))


def tokens(c: Column | str) -> Column:
    return F.array_remove(F.split(F.trim(F.regexp_replace(text_or_empty(c), r"\s+", " ")), " "), "")


def short_token_ratio(c: Column | str) -> Column:
    """One-character tokens over tokens; fewer than 5 tokens give 0."""
    t = tokens(c)
    return F.when(F.size(t) < 5, 0.0).otherwise(F.size(F.filter(t, lambda x: F.char_length(x) == 1)) / F.size(t))


def nonalpha_ratio(c: Column | str) -> Column:
    """Characters that are neither letters nor white space over those that are no white space."""
    solid = F.regexp_replace(text_or_empty(c), r"\s", "")
    n = F.char_length(solid)
    return F.when(n == 0, 0.0).otherwise((n - F.char_length(letters(c))) / n)


def repeat_run_max(c: Column | str) -> Column:
    """The longest run of one character, white space apart."""
    runs = F.regexp_extract_all(text_or_empty(c), F.lit(r"(?s)(\S)\1*"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.char_length(r))), F.lit(0))


SIGNALS = {
    "doubling_ratio": doubling_ratio,
    "vowel_ratio": vowel_ratio,
    "consonant_run_max": consonant_run_max,
    "short_token_ratio": short_token_ratio,
    "nonalpha_ratio": nonalpha_ratio,
    "repeat_run_max": repeat_run_max,
}


#: Letters that end a run of consonants (fixed values).
NO_CONSONANTS = CYRILLIC_VOWELS + LATIN_VOWELS + "ьъ"


def signal_table(texts: list[str]) -> dict[str, np.ndarray]:
    """The SIGNALS of all texts at once, by passes over their characters."""
    n = len(texts)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(n), np.fromiter(map(len, texts), np.int64, n))
    top = int(codes.max(initial=0x500)) + 1
    seen = np.zeros(top, bool)
    seen[codes] = True
    lower, letter = np.arange(top, dtype=np.uint32), np.zeros(top, bool)
    for u in np.flatnonzero(seen).tolist():
        letter[u], lower[u] = unicodedata.category(chr(u))[0] == "L", ord(chr(u).lower()[0])
    among = lambda v, signs: np.isin(v, np.array([ord(c) for c in signs], np.uint32))
    count = lambda rows, mask: np.bincount(rows[mask], minlength=n)

    def longest(kept: np.ndarray, same: np.ndarray | None = None) -> np.ndarray:
        """Per row the longest run of kept characters, of equal ones if same is given."""
        at, out = np.flatnonzero(kept), np.zeros(n, np.int64)
        if len(at):
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(at) != 1) | (row[at[1:]] != row[at[:-1]])
            if same is not None:
                new[1:] |= same[at[1:]] != same[at[:-1]]
            starts = np.flatnonzero(new)
            np.maximum.at(out, row[at[starts]], np.diff(starts, append=len(at)))
        return out

    low, is_letter, solid = lower[codes], letter[codes], ~among(codes, " \t\n\x0b\f\r")
    of, folded = row[is_letter], low[is_letter]
    n_letters, n_solid = np.bincount(of, minlength=n), count(row, solid)
    size = n_letters.copy()
    doubled = count(of[1:], (folded[1:] == folded[:-1]) & (of[1:] == of[:-1]))
    vowels = {"cyr": count(of, among(folded, CYRILLIC_VOWELS)), "lat": count(of, among(folded, LATIN_VOWELS))}
    for i in [i for i, t in enumerate(texts) if "İ" in t or "Σ" in t]:  # their lower case takes two signs or depends on the place
        s = "".join(c for c in texts[i] if unicodedata.category(c)[0] == "L").lower()
        size[i], doubled[i] = len(s), sum(a == b for a, b in zip(s, s[1:]))
        vowels["cyr"][i], vowels["lat"][i] = sum(c in CYRILLIC_VOWELS for c in s), sum(c in LATIN_VOWELS for c in s)
    in_cyr = ((codes >= 0x410) & (codes <= 0x44F)) | (codes == 0x401) | (codes == 0x451)
    in_lat = ((codes >= 65) & (codes <= 90)) | ((codes >= 97) & (codes <= 122))
    cyr, lat = count(row, in_cyr), count(row, in_lat)
    first = solid.copy()
    first[1:] &= ~solid[:-1] | (row[1:] != row[:-1])
    last = solid.copy()
    last[:-1] &= ~solid[1:] | (row[1:] != row[:-1])
    n_tokens, single = count(row, first), count(row, first & last)
    part = lambda a, b: a / np.maximum(b, 1)
    return {
        "doubling_ratio": np.where(size < 8, 0.0, part(doubled, size - 1)),
        "vowel_ratio": np.where((cyr + lat < 3) | (size == 0), np.nan, np.where(cyr >= lat, part(vowels["cyr"], size), part(vowels["lat"], size))),
        "consonant_run_max": longest(is_letter & ~among(low, NO_CONSONANTS)),
        "short_token_ratio": np.where(n_tokens < 5, 0.0, part(single, n_tokens)),
        "nonalpha_ratio": np.where(n_solid == 0, 0.0, part(n_solid - n_letters, n_solid)),
        "repeat_run_max": longest(solid, codes),
    }


@F.arrow_udf(NOISE_SIGNALS)
def signal_values(texts: pa.Array) -> pa.Array:
    """The SIGNALS of a text as one struct."""
    found = signal_table(pc.fill_null(texts, "").to_pylist())
    whole = ("consonant_run_max", "repeat_run_max")
    arrays = [pa.array(v.astype(np.int32) if k in whole else v, from_pandas=k not in whole) for k, v in found.items()]
    return pa.StructArray.from_arrays(arrays, list(found))


def signals(c: Column | str) -> list[Column]:
    return [f(c).alias(name) for name, f in SIGNALS.items()]


#: (signal, weight, value of no badness, value of full badness); in order of precedence (fixed values).
NOISE = (
    ("deviation", 0.40, -2.0, -6.0),
    ("doubling_ratio", 0.20, 0.08, 0.35),
    ("short_token_ratio", 0.10, 0.35, 0.70),
    ("vowel_ratio", 0.10, 0.25, 0.55),
    ("consonant_run_max", 0.08, 5.0, 9.0),
    ("nonalpha_ratio", 0.07, 0.25, 0.60),
    ("repeat_run_max", 0.05, 4.0, 10.0),
)
VOWEL_SLOPE = 0.20


def ramp(value: Column, low: float, high: float) -> Column:
    """0 at low, 1 at high, clipped; the band may run downwards. Null is 0."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low))), F.lit(0.0))


def badness(name: str, low: float, high: float) -> Column:
    if name == "vowel_ratio":
        v = F.col(name)
        return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(low) - v, v - high, F.lit(0.0)) / VOWEL_SLOPE), F.lit(0.0))
    return ramp(F.col(name).cast("double"), low, high)


def noise_score(block_type: Column, n_chars: Column, min_lm_chars: int = 30) -> tuple[Column, Column]:
    """(score, reason) over the signal columns and ``deviation``: the weighted mean of enabled badness.

    Formulas enable nothing, tables the language model only, short texts everything but it. Heavy doubling
    or a long run of one character raise the score to a floor.
    """
    formula, is_table, short = block_type.startswith("Formula"), block_type == "Table", n_chars < min_lm_chars
    parts, weights = [], []
    for name, weight, low, high in NOISE:
        on = ~formula & (~short if name == "deviation" else ~is_table)
        if name == "deviation":
            on = on & F.col("deviation").isNotNull()
        weights.append(F.when(on, weight).otherwise(0.0))
        parts.append(F.when(on, weight * badness(name, low, high)).otherwise(0.0))
    total = sum(weights[1:], weights[0])
    mean = F.when(total > 0, sum(parts[1:], parts[0]) / total).otherwise(0.0)
    raised = F.greatest(
        mean,
        F.when(~formula & ~is_table & (F.col("doubling_ratio") >= 0.30), 0.90).otherwise(0.0),
        F.when(~formula & ~is_table & (F.col("repeat_run_max") >= 12), 0.85).otherwise(0.0),
    )
    top = F.greatest(*parts)
    reason = F.lit("")
    for (name, *_), part in reversed(list(zip(NOISE, parts))):
        reason = F.when((part == top) & (top > 0), name).otherwise(reason)
    return F.round(raised, 4), reason


#: Words before a figure's number, and units behind the number of an axis tick; a spaced percent counts as one (fixed values).
FIGURE_WORDS = ("fig", "figure", "рис", "рисунок")
TICK_UNITS = ("", "°c", "°с", "min", "мин", "h", "ч", "%", "wt%", "мас%", "мас.%")
SHARES = ("%", "wt%", "мас%", "мас.%")


def _only_panels(t: Column) -> Column:
    """Nothing but panel letters: in brackets, or with a bracket or point behind them."""
    solid = F.lower(F.regexp_replace(t, r"\s", ""))
    left = F.regexp_replace(F.regexp_replace(solid, r"[(\[][a-zа-яё][)\]]", ""), r"[a-zа-яё][)\].]", "")
    return (solid != "") & (left == "")


def _figure_number(t: Column) -> Column:
    """A word for figure, perhaps shortened, and a number of digits or Roman numerals with digits behind points."""
    word = F.regexp_extract(F.lower(t), r"^(\p{L}+)", 1)
    known = F.array_max(F.transform(F.array(*[F.lit(w) for w in FIGURE_WORDS]), lambda w: F.when(F.startswith(word, w), F.char_length(w)).otherwise(0)))
    rest = F.lower(F.regexp_replace(F.substr(t, known + 1), r"^\.?\s*", ""))
    return (known > 0) & rest.rlike(r"^[0-9ivxlc]+(\.[0-9]+)*$")


def _tick(t: Column) -> Column:
    """A number with or without a unit, or an element's share."""
    number, element = F.regexp_extract(t, r"^([0-9]+(?:[.,][0-9]+)?)", 1), F.regexp_extract(t, r"^([A-Za-z]{1,2})(?![A-Za-z]*[a-z]%)", 1)
    unit = lambda head: F.lower(F.regexp_replace(F.substr(t, F.char_length(head) + 1), r"\s", ""))
    return ((number != "") & unit(number).isin(*TICK_UNITS)) | ((element != "") & unit(element).isin(*SHARES))


def caption_only(c: Column | str, max_chars: int = 40) -> Column:
    """A caption without content: panel letters, a figure number, an axis tick, or a short text without a word of 4 letters."""
    t = F.trim(text_or_empty(c))
    n = F.char_length(t)
    return (n <= 2) | _only_panels(t) | _figure_number(t) | _tick(t) | ((n < max_chars) & ~t.rlike(r"[A-Za-zА-Яа-яЁё]{4,}"))


#: Endings that a search term loses, the first that fits (fixed values).
RUSSIAN_ENDINGS = "иями ями ами ией ой ий ый ое ее ие ов ев ей ом ем ах ях ию ью ия ья ть ти ла ли ло ся".split()
ENGLISH_ENDINGS = "ing ers ies ied ed es s".split()


def stem(word: str) -> str:
    """The word in lower case without one ending, if it has more than 4 letters and 4 stay."""
    w = word.lower()
    endings = RUSSIAN_ENDINGS if any("а" <= c <= "я" or c == "ё" for c in w) else ENGLISH_ENDINGS
    fitting = (e for e in endings if w.endswith(e) and len(w) - len(e) >= 4)
    return w.removesuffix(next(fitting, "")) if len(w) > 4 else w


def light_stem(word: Column) -> Column:
    """stem() as an expression."""
    w = F.lower(word)

    def cut(endings: list[str]) -> Column:
        out = w
        for e in reversed(endings):
            out = F.when(w.endswith(e) & (F.char_length(w) >= len(e) + 4), F.left(w, F.char_length(w) - len(e))).otherwise(out)
        return out

    return F.when(F.char_length(w) <= 4, w).when(w.rlike("[а-яё]"), cut(RUSSIAN_ENDINGS)).otherwise(cut(ENGLISH_ENDINGS))


def token_count(c: Column | str) -> Column:
    """Tokens where no tokenizer is at hand: a third of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.char_length(text_or_empty(c)) / 3).cast("int"))


def lexical_terms(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


#: Letters of the Symbol font by their Latin keys (fixed values).
SYMBOL_KEYS = ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "αβχδεφγηιϕκλμνοπθρστυϖωξψζΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ")


def decode_symbol_font(c: Column | str) -> Column:
    """Private-use characters of a Symbol font as the Greek letters they show."""
    private = "".join(chr(0xF000 + ord(k)) for k in SYMBOL_KEYS[0])
    return F.translate(text_or_empty(c), private, SYMBOL_KEYS[1])


def one_script(c: Column | str, lookalikes: tuple[str, str]) -> Column:
    """Words of up to 20 characters that mix both scripts become Latin, if every Cyrillic letter in them has a Latin twin."""
    mixed = lambda w: (F.char_length(w) <= 20) & w.rlike("[A-Za-z]") & w.rlike("[а-яёА-ЯЁ]") & ~F.translate(w, lookalikes[0], "").rlike("[а-яёА-ЯЁ]")
    return F.array_join(F.transform(F.split(text_or_empty(c), " "), lambda w: F.when(mixed(w), F.translate(w, *lookalikes)).otherwise(w)), " ")


def sentences(c: Column | str) -> Column:
    """Sentences, cut after end marks and at line ends."""
    return F.filter(F.transform(F.split(text_or_empty(c), r"(?<=[.!?;])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def layer_text(c: Column | str) -> Column:
    """Text of a PDF's text layer: ligatures and wide forms folded, hard blanks as blanks."""
    return F.translate(nfkc(text_or_empty(c)), "\u00a0", " ")
