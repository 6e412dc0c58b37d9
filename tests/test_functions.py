"""Scalar functions against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import chem, latex, tables, text as X, tokenizer, units


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr).collect()]


def test_clean_text_and_key(spark):
    got = column(spark, ["a­b  c", "пере- \nнос (cid:12)", None, "ﬁne  day \n\n x"], X.clean_text("t"))
    assert got == ["ab c", "перенос", "", "fine day\nx"]
    assert column(spark, ["Straße 12, ok!", "STRASSE 45 OK"], X.norm_key("t")) == ["strasse ## ok", "strasse ## ok"]


def test_signals_match_plain_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aabbcde  ..!1é\nЯж") for _ in range(rng.randrange(0, 60))) for _ in range(80)] + ["", None]

    def doubling(t):
        s = "".join(re.findall(r"[^\W\d_]", t or "")).lower()
        return sum(a == b for a, b in zip(s, s[1:])) / (len(s) - 1) if len(s) >= 8 else 0.0

    def run(t):
        return max((len(m.group()) for m in re.finditer(r"(\S)\1*", t or "")), default=0)

    assert column(spark, texts, X.doubling_ratio("t")) == pytest.approx([doubling(t) for t in texts])
    assert column(spark, texts, X.repeat_run_max("t")) == [run(t) for t in texts]


def test_script_and_captions(spark):
    assert column(spark, ["abc def", "абв где", "ab", "abаб", None], X.script("t")) == ["lat", "cyr", "none", "cyr", "none"]
    assert column(spark, ["(a)", "Fig. 2.5", "25 °C", "Fig. 2.5. Structure of ice", "xy", "12 ab"], X.caption_only("t")) == [True, True, True, False, True, True]


def test_chemistry():
    assert chem.species_of("Fe2O3") == (["Fe", "O"], True)
    assert chem.species_of("2NH_{4}VO_{3}") == (["N", "H", "V", "O"], True)
    assert chem.species_of("Н_{2}О") == (["H", "O"], True)
    assert chem.species_of("velocity") is None and chem.species_of("") is None and chem.species_of("e") == ([], False)
    assert chem.is_equation("2NH_{4}VO_{3} = V_{2}O_{5} + 2NH_{3} + H_{2}O")
    assert not chem.is_equation("P = IV") and not chem.is_equation("F = ma") and not chem.is_equation(None)


def test_formulas_in_text(spark):
    found = F.transform(F.filter(chem.formulas(F.col("t")), lambda x: x.valid), lambda x: x.formula)
    assert column(spark, ["ore of Fe2O3 and CuSO4", "IN THE END", ""], found) == [["Fe2O3", "CuSO4"], [], []]
    assert column(spark, ["Fe2O3", "H2SO4", "Ca(OH)2", "NaCl", "O2"], F.get(chem.formulas(F.col("t")), F.lit(0)).kind) == ["oxide", "acid", "base_other", "salt", "simple_substance"]
    assert column(spark, ["Fe2O3 + 3CO = 2Fe + 3CO2, 25 kJ", "no reaction here"], chem.reactions(F.col("t"))) == ["Fe₂O₃ + 3CO = 2Fe + 3CO₂", None]


def test_latex():
    assert latex.notation(r"\mathrm{\Delta H} \leq \alpha") == "Δ H ≤ α"
    assert latex.join_letters(r"W e i g h t\;l o s s") == "Weight loss"
    assert latex.flatten(r"\frac{a}{b_{2}}") == "(a)/(b2)"
    assert latex.canonical(r"$$a=b \tag{3.4}$$") == ("a=b", "3.4")
    assert latex.braces_balanced(r"a\{b{c}") and not latex.braces_balanced("}{") and latex.braces_balanced(None)
    assert latex.decide("(3.4)", r"\frac{a}{b}=c")[0] == "replace" and latex.decide("a=b", "{a")[:2] == ("keep", "braces")
    assert latex.invalid_reason("") == "empty"


def test_units():
    got = units.measurements("at 1200 °C, 2,5 кДж/моль, 3·10^{3} Pa and v12 m")
    assert [(m["value"], m["canonical"], m["si_value"]) for m in got] == [(1200.0, "degC", 1200.0), (2.5, "J/mol", None), (3000.0, "Pa", 3000.0)]
    assert units.numeric_condition("не более 1200 °C")["op"] == "lte" and units.numeric_condition("не более 1200 °C", strict_parity=True)["op"] == "gte"
    assert units.numeric_condition("at 5 kg") is None and units.numeric_condition(None) is None


def test_equations_tolerate_one_other_part_in_four():
    assert chem.is_equation("2Fe + 3CO2 = Fe2O3 + heat") and not chem.is_equation("Fe2O3 = heat") and not chem.is_equation("Fe2O3 + x1y = w + CO2")
    assert chem.parse_equation("Fe^{3+} + SO4^2- → q") == {"species": ["Fe", "SO4"], "elements": ["Fe", "S", "O"], "junk": 1, "subscripted": True}
    assert chem.species_of("Fe2O3(тв)") == (["Fe", "O"], True) and chem.species_of("Xx2") is None and chem.species_of("Co") == (["Co"], False)


def test_flat_formulas_keep_powers():
    assert latex.flatten("x^{2}+y_{i}") == "x^2+yi" and latex.flatten(r"\frac{m_{a}}{n^{2}}") == "(ma)/(n^2)"
    assert latex.flatten(r"\mathrm{H}_{2}\mathrm{O}") == "H2O" and latex.notation(r"\left( a \right) \quad \mathbf{\mathrm{b}}") == "( a ) b"


def test_units_in_every_form():
    got = [(m["unit"], m["canonical"], m["text"]) for m in units.measurements("5 кДж / моль2, 7,5·10^-3 мм; 3.1.2 m, 4 мкмоль 12кг 6 m/s²")]
    assert got == [("кДж / моль2", "J/mol2", "5 кДж / моль2"), ("мм", "m", "7,5·10^-3 мм"), ("кг", "kg", "12кг"), ("m", "m", "6 m")]


def test_cues_are_whole_words():
    assert units.numeric_condition("водород 1200 кг") is None and units.numeric_condition("mass over 5 kg")["op"] == "gte"
    assert units.numeric_condition("до 5 кг") == {"canonical": "kg", "op": "lte", "value": 5.0} and units.numeric_condition("coverage 5 kg") is None
    assert units.numeric_condition("exceeding 2 t")["value"] == 2000.0 and units.numeric_condition("at least 2 t")["op"] == "gte"


def test_terms():
    assert tokenizer.terms("Fe2O3 reductions at 2,5 kJ/mol") == ["fe2o3", "fe", "o", "reduction", "at", "2,5", "kj/mol"]
    assert tokenizer.terms("Fe2O3·FeO") == ["fe2o3", "fe", "o", "feo", "fe", "o"] and tokenizer.subterms("Fe2O3·FeO") == ["fe", "o"]
    assert tokenizer.terms("ГОСТ 12.1-2019, [3.4] 5 мас. %") == ["гост12.1-2019", "[3.4]", "5", "мас%"]
    assert tokenizer.terms("Fe/SiO2 3·10^-4") == ["fe/sio2", "fe", "si", "o", "3·10^-4"]
    assert tokenizer.terms(None) == []


def test_stems(spark):
    words = ["printing", "boxes", "bed", "реакциями", "печью", "cities", "столы", "Played"]
    assert [X.stem(w) for w in words] == ["print", "boxe", "bed", "реакц", "печью", "citi", "столы", "play"]
    assert column(spark, words, X.light_stem(F.col("t"))) == [X.stem(w) for w in words]


def test_tables(spark):
    html = "<table><thead><tr><th>a</th><th></th></tr></thead><tr><td>x</td><td> 1 <br>2</td><td>z</td></tr><tr><td></td></tr></table>"
    assert tables.parse(html) == (["a", "", ""], [["x", "1 2", "z"]])
    assert tables.parse(None) == ([], [])
    rows = spark.createDataFrame([(["m", "T", ""], ["iron", "1811", "K"])], "h array<string>, r array<string>")
    assert rows.select(tables.row_sentence(F.col("h"), F.col("r"))).first()[0] == "iron — T: 1811; K"
