"""Quality rules with risk-controlled cutoffs (DataFrame functions only).

Each rule is a per-document measurement where larger is worse, with a fixed grid of cutoffs. Step j of the grids together is
one configuration of all rules, and the configurations form a fixed path from lax to strict. Per stratum the
strictest configuration is taken for which an exact binomial test on labelled good documents shows that the rules
together reject at most ``alpha`` of them. Along the path the tests are a fixed sequence (a stricter configuration rejects no
fewer, so the first failure ends it), which needs no correction; across the strata each test runs at ``delta`` over their
number (Bonferroni). So with probability 1 - delta *every* stratum loses at most ``alpha`` of its good documents to the rules.
A stratum needs log(delta / strata) / log(1 - alpha) labelled good documents, 86 for four strata, before anything can be proven.

Null text has no words, no lines and zero counts. A null stratum is the stratum ''.
Strata with too few labelled documents prove nothing and so get no cutoff. Repeated rows
are judged each on its own; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, held_out, materialise, split_words, table

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A measurement as SQL over the columns of measure(), and its cutoffs from strict to lax; all rules have as many."""

    name: str
    measure: str
    grid: tuple[float, ...]


def _grid(low: float, high: float, steps: int = 16) -> tuple[float, ...]:
    return tuple(round(low * (high / low) ** (i / (steps - 1)), 6) for i in range(steps))


RULES = (
    Rule("symbols", "n_symbols / greatest(n_words, 1)", _grid(0.05, 3.0)),
    Rule("dup_lines", "n_dup_lines / greatest(n_lines, 1)", _grid(0.2, 0.95)),
    Rule("repeats", "n_repeat_words / greatest(n_words, 1)", _grid(0.15, 0.5)),
    Rule("upper", "n_upper / greatest(word_chars, 1)", _grid(0.15, 0.9)),
    Rule("shouts", "n_bangs / greatest(n_words, 1)", _grid(0.05, 2.0)),
    Rule("short_words", "1.0 - least(word_chars / greatest(n_words, 1) / 12.0, 1.0)", _grid(0.75, 0.95)),
    Rule("long_words", "word_chars / greatest(n_words, 1)", _grid(9.0, 60.0)),
)


def _without(text: Column, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, ""))


def measure(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts per document, in one narrow projection without a shuffle.

    Repeated 3-word windows: (hash of the window, position) pairs are sorted inside the row,
    so equal windows become neighbours; every word of a window with an equal neighbour counts once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    windows = F.when(
        F.size("w") >= 3,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size("w") - 3),
                lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("p")),
            )
        ),
    )
    repeated = F.filter(
        F.transform("s", lambda x, i: F.when((x.h == F.get("s", i - 1).h) | (x.h == F.get("s", i + 1).h), x.p)),
        lambda p: p.isNotNull(),
    )
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, SPACE) > 0)
    counted = documents.select(*keep, "text").select(
        *keep,
        split_words(F.col("text")).alias("w"),
        lines.alias("lines"),
        _without(text, SPACE).cast("long").alias("word_chars"),
        (F.char_length(text) - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.char_length(text) - _without(text, "!")).cast("long").alias("n_bangs"),
        (F.char_length(text) - _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_upper"),
    )
    return (
        counted.withColumn("s", windows)
        .withColumn("r", repeated)
        .select(
            *keep,
            F.size("w").cast("long").alias("n_words"),
            "word_chars",
            "n_symbols",
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.when(F.col("r").isNull(), 0)
            .otherwise(F.size(F.array_distinct(F.flatten(F.transform("r", lambda p: F.array(p, p + 1, p + 2))))))
            .cast("long")
            .alias("n_repeat_words"),
            F.size("lines").cast("long").alias("n_lines"),
            "n_bangs",
            "n_upper",
        )
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed term by term in logarithms.

    Only asked for k <= n * p, so the sum has at most n * p terms. A term too small
    for a double adds nothing that a comparison with delta could see.
    """
    first = n * F.log(F.lit(1.0 - p))
    ratio = F.log(F.lit(p / (1.0 - p)))
    steps = F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(first.alias("term"), F.exp(first).alias("sum")),
        lambda acc, i: F.struct(
            (acc.term + F.log((n - i + 1) / i.cast("double")) + ratio).alias("term"),
            (acc.sum + F.exp(acc.term + F.log((n - i + 1) / i.cast("double")) + ratio)).alias("sum"),
        ),
    )
    return steps.sum


def cutoffs(measured: DataFrame, good: DataFrame, stratum: str, alpha: float = 0.05, delta: float = 0.05, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(stratum, n, step, one column per rule): the strictest proven configuration, nulls where there is none.

    ``good`` holds the doc_id of labelled good documents. One pass counts, per stratum,
    how many of them each configuration would reject; only the number of strata comes to the driver.
    """
    steps = range(len(rules[0].grid))
    held = measured.where(~base_failed()).join(good.select("doc_id").distinct(), "doc_id", "left_semi")
    held = held.select(F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), *[F.expr(r.measure).alias(r.name) for r in rules])

    def rejects(j: int) -> Column:
        any_ = F.col(rules[0].name) > rules[0].grid[j]
        for r in rules[1:]:
            any_ = any_ | (F.col(r.name) > r.grid[j])
        return any_

    counts = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(rejects(j), 1)).alias(f"step_{j}") for j in steps])
    counts = materialise(counts, "quality-counts")  # one row a stratum
    level = F.lit(delta / max(1, counts.count()))
    proven = [F.when((F.col(f"step_{j}") <= F.col("n") * alpha) & (binomial_cdf(F.col(f"step_{j}"), F.col("n"), alpha) <= level), F.lit(j)) for j in steps]
    chosen = counts.select("stratum", "n", F.coalesce(*proven).alias("step"))
    return chosen.select("*", *[F.get(F.array(*[F.lit(c) for c in r.grid]), "step").alias(f"cut_{r.name}") for r in rules])


def apply_rules(documents: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every document with its counts, base_failed, the rules that fired and kept.

    The text is read once; the counts are written to the shared folder and used twice.
    labels: doc_id, quality (1 is good). Cutoffs never see the fold common.held_out keeps apart.
    """
    measured = materialise(measure(documents, ("doc_id", stratum)), "quality-rules")
    good = labels.where((F.col("quality") == 1) & ~held_out(F.col("doc_id")))
    proven = cutoffs(measured, good, stratum, alpha, delta, rules)
    # The rows are narrow by now; a stratum with a large share of them is a skewed key that adaptive execution can split or broadcast around.
    judged = measured.withColumn("_s", F.coalesce(F.col(stratum).cast("string"), F.lit(""))).join(proven.withColumnRenamed("stratum", "_s").drop("n", "step"), "_s", "left")
    fired = F.filter(
        F.array(*[F.when(F.expr(r.measure) > F.col(f"cut_{r.name}"), F.lit(r.name)) for r in rules]),
        lambda x: x.isNotNull(),
    )
    return judged.withColumn("base_failed", base_failed()).withColumn("fired", fired).withColumn("kept", ~F.col("base_failed") & (F.size("fired") == 0))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fired")


_SQL_RULES = {r.name: r.measure.replace("n_", "1.0 * n_", 1) if r.measure.startswith("n_") else r.measure for r in RULES}
_SQL_CRC32 = (
    "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),"
    " lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
)
_STEPS = range(len(RULES[0].grid))
OP10_SQL = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
g AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM grams),
again AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(regexp_extract_all(t, '!')) AS BIGINT) AS n_bangs, CAST(len(regexp_extract_all(t, '[A-Z]')) AS BIGINT) AS n_upper
  FROM l LEFT JOIN rep USING (doc_id)),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {', '.join(f"{x} AS r_{n}" for n, x in _SQL_RULES.items())} FROM m),
good AS (SELECT * FROM r WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND {_SQL_CRC32} % 4 <> 2)),
c AS (SELECT stratum, count(*) AS n, {', '.join(f"count(*) FILTER ({' OR '.join(f'r_{r.name} > CAST({r.grid[j]} AS DOUBLE)' for r in RULES)}) AS c_{j}" for j in _STEPS)} FROM good GROUP BY stratum),
tests AS (SELECT stratum, n, unnest([{', '.join(f'c_{j}' for j in _STEPS)}]) AS k, unnest(range({len(_STEPS)})) AS j, (SELECT count(*) FROM c) AS strata FROM c),
chosen AS (
  SELECT stratum, min(j) AS j FROM tests WHERE k <= n * 0.05
    AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05) + (n - i) * ln(0.95)))) <= 0.05 / strata
  GROUP BY stratum),
f AS (
  SELECT r.*, list_filter([{', '.join(f"CASE WHEN r_{r.name} > CAST([{', '.join(map(str, r.grid))}][j + 1] AS DOUBLE) THEN '{r.name}' END" for r in RULES)}], lambda x: x IS NOT NULL) AS fired
  FROM r LEFT JOIN chosen USING (stratum))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(fired) = 0 AS kept, fired FROM f
"""
