"""Search terms of technical text: substances, units, standards and numbers stay whole, words are stemmed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..schemas import STRINGS
from .chem import SUBSCRIPTS, read_symbol, species_of
from .scan import Scanner, is_digit, is_word
from .text import stem

#: Units that stay whole, in any case; those of mass shares may be spaced before the percent sign (fixed values).
WHOLE_UNITS = "кДж/моль кДж·моль-1 kJ/mol kJ·mol-1 Н·м N·m т/ч t/h т/сут t/d м3/ч m3/h ppm MVA °C °С degC".split()
MASS_SHARES = "мас масс wt".split()
#: Bodies that issue standards, in any case (fixed values).
STANDARDS = "GOST ГОСТ ISO DIN ASTM ТУ".split()
_TIMES, _DASHES, _SPAN_DASHES = "·⋅×x", "–−-", "-–./"


def _symbols(s: Scanner, most: int | None = None) -> int:
    """Element symbols in a row, each with the index behind it."""
    n = 0
    while (most is None or n < most) and read_symbol(s):
        s.run(is_digit) or s.run(lambda c: c in SUBSCRIPTS[0])
        n += 1
    return n


def _ratio(s: Scanner) -> bool:
    """Two substances around a slash."""
    if not _symbols(s, 8):
        return False
    s.spaces()
    if not s.one_of("/"):
        return False
    s.spaces()
    return _symbols(s, 8) > 0


def _substance(s: Scanner) -> bool:
    """Two symbols or more that begin a word and end with no letter behind them; a symbol too many is given back."""
    if is_word(s.before() or " "):
        return False
    ends = []
    while read_symbol(s):
        s.run(is_digit) or s.run(lambda c: c in SUBSCRIPTS[0])
        ends.append(s.at)
    for n in range(len(ends), 1, -1):
        s.at = ends[n - 1]
        if not (s.peek().isascii() and s.peek().isalpha()):
            return True
    return False


def _unit(s: Scanner) -> bool:
    start = s.at
    if s.longest(WHOLE_UNITS, fold=True):
        return True
    if s.longest(MASS_SHARES, fold=True):
        s.one_of(".")
        s.spaces()
        if s.one_of("%"):
            return True
    s.at = start
    return False


def _standard(s: Scanner) -> bool:
    if not s.longest(STANDARDS, fold=True):
        return False
    s.spaces()
    return bool(s.run(lambda c: is_digit(c) or c in _SPAN_DASHES))


def _number(s: Scanner) -> bool:
    """A power of ten, a range of percents, or a decimal."""
    start = s.at
    if not s.run(is_digit):
        return False
    whole = s.at
    fraction = bool(s.one_of(".,") and s.run(is_digit))
    decimal = s.at if fraction else whole
    for mantissa in dict.fromkeys((decimal, whole)):
        s.at = mantissa
        s.spaces()
        if s.one_of(_TIMES):
            s.spaces()
            if s.longest(("10",)):
                s.one_of("^")
                s.one_of("-")
                if s.run(is_digit):
                    return True
    s.at = whole
    s.spaces()
    if s.one_of(_DASHES):
        s.spaces()
        if s.run(is_digit):
            s.spaces()
            if s.one_of("%"):
                return True
    s.at = decimal if fraction else start
    return fraction


def _equation_number(s: Scanner) -> bool:
    if not (s.one_of("[") and s.run(is_digit)):
        return False
    if s.one_of(".-"):
        if not s.run(is_digit):
            return False
    elif s.peek().isascii() and s.peek().isalpha():
        s.at += 1
    return bool(s.one_of("]"))


def spans(text: str) -> list[tuple[int, int]]:
    """[start, end) of what stays whole: of those that start at one place the longest, and none within another."""
    out, at = [], 0
    while at < len(text):
        ends = []
        for reads in (_ratio, _substance, _unit, _standard, _number, _equation_number):
            s = Scanner(text, at)
            if reads(s):
                ends.append(s.at)
        if ends:
            out.append((at, max(ends)))
            at = max(ends)
        elif is_digit(text[at]):  # a number is read from its first digit
            s = Scanner(text, at)
            s.run(is_digit)
            at = s.at
        else:
            at += 1
    return out


def flat(span: str) -> str:
    """The term of a protected span: lower case, no spaces, plain digits, one spelling of degrees and mass shares."""
    t = "".join(span.lower().split()).replace("°с", "°c").replace("мас.%", "мас%")
    return t.translate(str.maketrans(*SUBSCRIPTS))


def subterms(span: str) -> list[str]:
    """The elements of the substances of a span, each once, in order."""
    parts = "".join("/" if c in "·⋅" else c for c in span).split("/")
    found = (e.lower() for part in parts for e in (species_of(part.strip()) or ([], False))[0])
    return list(dict.fromkeys(found))


def plain_terms(piece: str) -> list[str]:
    """Stems of the words, then the numbers."""
    words = "".join(c if c.isalpha() else " " for c in piece).split()
    s, numbers = Scanner(piece), []
    while not s.done():
        if digits := s.run(is_digit):
            point = s.one_of(".,")
            numbers.append(digits + ("." + s.run(is_digit) if point else ""))
        else:
            s.at += 1
    return [stem(w) for w in words] + numbers


def terms(text: str | None) -> list[str]:
    """Terms in order; a substance is followed by its elements."""
    t, out, at = text or "", [], 0
    for start, end in spans(t):
        out += plain_terms(t[at:start]) + [flat(t[start:end])] + subterms(t[start:end])
        at = end
    return out + plain_terms(t[at:])


@F.pandas_udf(STRINGS)
def tokenize(texts: pd.Series) -> pd.Series:
    return texts.map(terms)
