"""URL filters: explicit rules, and logistic regression on hashed character n-grams of host and path.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to
``?``, ``#`` or the end. A null url, or one without ``://``, has an empty host and path.
A rule (host, path, verdict) fits its host and that host's subdomains where the url's path
starts with the rule's; the longest fitting rule decides (of equally long ones the first in
the alphabet). Where none fits, the model does: block at a probability of ``threshold`` or more.

The model is trained on the driver from a small labelled url table, by default url_labels, written by hand (at most ``MAX_LABELLED`` rows, checked);
its weights have a fixed size. Pages are judged in one map, and by the model only where no rule decides. Repeated pages are judged each on their own; an
empty table gives no rows; without labelled urls of both classes the model allows everything.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import url_labels
from .common import table

BITS = 15
ORDERS = (2, 3, 4, 5)
MAX_LABELLED = 10_000

#: (rule as written, verdict); the part before the first / is the host.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def split(url: str | None) -> tuple[str, str]:
    """host() and path() of one url."""
    _, found, rest = (url or "").partition("://")
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[cut:]
    end = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    return (lower, tail[:end]) if found else ("", "")


def decide(host_: Column, path_: Column, rules: Iterable[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The deciding rule and its verdict, null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for written, says in reversed(ordered):
        name, slash, rest = written.partition("/")
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(written)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def features(host_: str, path_: str, bits: int = BITS) -> np.ndarray:
    """Distinct hashed character n-grams; those of host and path are told apart, digits count as one."""
    found = set()
    for kind, text in ((b"h", host_), (b"p", path_)):
        s = "".join("0" if c.isdigit() else c for c in f"^{text}$").encode("utf-8", "surrogatepass")
        for n in ORDERS:
            found.update(s[i : i + n] + kind for i in range(len(s) - n + 1))
    return np.array(sorted({xxhash.xxh32_intdigest(g) >> (32 - bits) for g in found}), np.int64)


def fit(labelled: list[tuple[str, int]], bits: int = BITS, penalty: float = 1e-4, rounds: int = 400, rate: float = 20.0) -> np.ndarray:
    """Weights with the bias last, by full-batch gradient steps on the L2-penalised log loss; classes weigh the same."""
    w = np.zeros((1 << bits) + 1)
    y = np.array([label for _, label in labelled], float)
    if not len(y) or y.min() == y.max():
        w[-1] = -10.0
        return w
    rows = [features(*split(url), bits) for url, _ in labelled]
    scale = np.array([1 / np.sqrt(max(1, len(r))) for r in rows])
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    momentum = np.zeros_like(w)
    for _ in range(rounds):
        margin = np.bincount(owner, w[flat], len(rows)) * scale + w[-1]
        error = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y) * share
        gradient = np.append(np.bincount(flat, (error * scale)[owner], 1 << bits) + penalty * w[:-1], error.sum())
        momentum = 0.9 * momentum - rate * gradient
        w = w + momentum
    return w


def probability(w: np.ndarray, host_: str, path_: str, bits: int = BITS) -> float:
    ids = features(host_, path_, bits)
    return float(1 / (1 + np.exp(-np.clip(w[ids].sum() / np.sqrt(max(1, len(ids))) + w[-1], -500, 500))))


def judge(pages: DataFrame, labelled: DataFrame | list[tuple[str, int]] | None = None, rules: Iterable[tuple[str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, probability (null where a rule decides). labelled: (url, label), 1 for block."""
    if labelled is None:
        labelled = url_labels.labelled()
    elif isinstance(labelled, DataFrame):
        got = labelled.select("url", "label").where(F.col("label").isin(0, 1)).limit(MAX_LABELLED + 1).collect()
        labelled = [(r["url"], int(r["label"])) for r in got]
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled urls: give a smaller table")
    sent = pages.sparkSession.sparkContext.broadcast(fit(sorted(labelled, key=lambda x: (x[0] or "", x[1]))).astype(np.float32))

    def run(hosts: pd.Series, paths: pd.Series, decided: pd.Series) -> pd.Series:
        return pd.Series([None if known else probability(sent.value, h, p) for h, p, known in zip(hosts, paths, decided)], dtype="float64")

    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = decide(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("by_rule", verdict)
    rows = rows.withColumn("probability", F.pandas_udf(run, "double")("host", "path", F.col("rule").isNotNull()))
    by_model = F.when(F.col("probability") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "probability")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
