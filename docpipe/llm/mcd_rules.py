"""Quality rules: fixed base rules, and robust outliers by the minimum covariance determinant.

Per language and source, the half of the documents whose statistic vectors have the covariance of least determinant is
sought by concentration steps from two starts (medians and quartiles; all rows). A step is one grouped sum: distances fall
in fine logarithmic bins, each with a count, sums and cross products, combined before they move; the closest bins that
hold the wanted share are the next half. So a source with a third of all rows costs no more per task than any other.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary, fresh, small, stage

SHARE = 0.6  # of a group's rows in the concentrated part
STEPS = 4
LEAST_GROUP = 200  # smaller groups are judged with their language, then with all documents
QUANTILE = 0.9999  # of the chi-square distribution: distances beyond it are rejected
#: Standard deviations that count as none at all, by dimension; a statistic that hardly varies rejects nobody.
FLOOR = (0.6, 0.12, 0.5, 0.6, 0.6)
P = len(FLOOR)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SYMBOLS = b"#*$%&|<>"


def text_statistics(data: bytes) -> tuple[int, int, int, int, int]:
    """Whole-text counts in the order of ``STATS``."""
    words = data.split()
    n = len(words)
    blanks = len(data) - sum(map(len, words))
    points = len(data) - sum(data.count(bytes([b])) for b in range(0x80, 0xC0)) if not data.isascii() else len(data)
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    return n, points - blanks, len(data) - len(data.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, total, covered_to = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            total += at + 3 - max(covered_to, at)
            covered_to = at + 3
    return total


def statistics(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with one struct column of ``STATS``, and its name."""

    @F.pandas_udf(STATS)
    def of_texts(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_statistics(t) for t in texts], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], dtype="int64")

    name = fresh(docs, "rule_stats")
    # Declared non-deterministic so that a filter on the counts stays above them: moved below, it would count twice.
    return docs.withColumn(name, of_texts.asNondeterministic()(binary("text"))), name


def base_failed(s: str) -> Column:
    return (F.col(f"{s}.n_words") < 50) | (100 * F.col(f"{s}.n_repeat_words") > 50 * F.col(f"{s}.n_words"))


def vector(s: str) -> list[Column]:
    """Transformed statistics: sizes in logarithms, shares by log(1 + percent)."""
    words = F.greatest(F.col(f"{s}.n_words"), F.lit(1)).cast("double")
    rate = lambda c: F.log1p(100.0 * F.col(f"{s}.{c}") / words)
    return [F.log(words), F.log(F.greatest(F.col(f"{s}.word_chars"), F.lit(1)) / words), rate("n_symbols"), rate("n_dup_lines"), rate("n_repeat_words")]


def _gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1.0 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi_square(quantile: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _gamma_p(freedom / 2, middle / 2) < quantile else (low, middle)
    return high


def consistency(share: float, freedom: int = P) -> float:
    """Factor that makes the covariance of the closest ``share`` of normal rows that of all of them."""
    return share / _gamma_p(freedom / 2 + 1, chi_square(share, freedom) / 2)


def _distance() -> Column:
    away = [F.col(f"x{i}") - F.col("mu")[i] for i in range(P)]
    return sum(((1 if i == j else 2) * F.col("inv")[i * P + j] * away[i] * away[j] for i, j in PAIRS), F.lit(0.0))


PARAMETERS = "grp string, start int, mu array<double>, inv array<double>, logdet double"


def _estimate(total: float, sums: np.ndarray, cross: np.ndarray, factor: float) -> tuple:
    mean = sums / total
    cov = np.zeros((P, P))
    for (i, j), c in zip(PAIRS, cross):
        cov[i, j] = cov[j, i] = c / total - mean[i] * mean[j]
    cov = factor * cov + np.diag(np.square(FLOOR))
    return mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])


def _sums() -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(P)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"c{i}{j}") for i, j in PAIRS]]


_SUM_COLUMNS, _CROSS_COLUMNS = [f"s{i}" for i in range(P)], [f"c{i}{j}" for i, j in PAIRS]


def _step(rows: DataFrame, params: DataFrame, share: float, limit: float | None) -> DataFrame:
    """Estimates from the closest ``share`` of each group, or from all rows within the squared distance ``limit``."""
    near = rows.join(small(params), "grp").withColumn("d", _distance())
    if limit is not None:
        near, part = near.where(F.col("d") <= limit).withColumn("bin", F.lit(0)), None
    else:
        near, part = near.withColumn("bin", F.floor(64 * F.log2(F.greatest("d", F.lit(1e-9)))).cast("int")), share
    summed = near.groupBy("grp", "start", "bin").agg(*_sums())
    factor = consistency(share) if limit is None else 1.0

    def concentrate(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bin")
        if part is not None:
            before = frame["n"].cumsum() - frame["n"]
            frame = frame[before < part * frame["n"].sum()]
        total = frame[["n", *_SUM_COLUMNS, *_CROSS_COLUMNS]].sum()
        mu, inv, logdet = _estimate(total["n"], total[_SUM_COLUMNS].to_numpy(float), total[_CROSS_COLUMNS].to_numpy(float), factor)
        first = frame.iloc[0]
        return pd.DataFrame([[first["grp"], first["start"], mu, inv, logdet]], columns=["grp", "start", "mu", "inv", "logdet"])

    return stage(summed.groupBy("grp", "start").applyInPandas(concentrate, PARAMETERS), "mcd")


def _key(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("\0"))


def fit(docs: DataFrame, least_group: int = LEAST_GROUP, share: float = SHARE, steps: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """(groups, params) over all documents that pass the base rules.

    ``groups``: lang, source -> grp; ``params``: grp -> mu, inv. Null languages and sources are values of their own.
    """
    counted, s = statistics(docs)
    named = counted.where(~base_failed(s)).select(_key("lang").alias("g_lang"), _key("source").alias("g_source"), *[x.alias(f"x{i}") for i, x in enumerate(vector(s))])
    rows = stage(named, "vectors")
    sizes = rows.groupBy("g_lang", "g_source").agg(F.count("*").alias("n"))
    by_lang = sizes.groupBy("g_lang").agg(F.sum("n").alias("lang_n"))
    grp = F.when(F.col("n") >= least_group, F.concat_ws("\1", "g_lang", "g_source")).when(F.col("lang_n") >= least_group, F.col("g_lang")).otherwise(F.lit("\2"))
    groups = stage(sizes.join(by_lang, "g_lang").select("g_lang", "g_source", grp.alias("grp")), "groups")
    rows = stage(rows.join(small(groups), ["g_lang", "g_source"]).drop("g_lang", "g_source"), "vectors")

    quartiles = rows.groupBy("grp").agg(*[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(P)])
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOOR[i])) for i in range(P)]
    inverse = F.array(*[1 / spread[i] ** 2 if i == j else F.lit(0.0) for i in range(P) for j in range(P)])
    by_quartiles = quartiles.select("grp", F.lit(0).alias("start"), F.array(*[F.col(f"q{i}")[1] for i in range(P)]).alias("mu"), inverse.alias("inv"), F.lit(0.0).alias("logdet"))
    whole = rows.select("grp").distinct().select("grp", F.lit(0).alias("start"), F.array(*[F.lit(0.0)] * P).alias("mu"), F.array(*[F.lit(0.0)] * (P * P)).alias("inv"), F.lit(0.0).alias("logdet"))
    by_all = _step(rows, stage(whole, "mcd"), 1.0 - 1e-9, math.inf).withColumn("start", F.lit(1))
    params = stage(by_quartiles.unionByName(by_all), "mcd")
    for _ in range(steps):
        params = _step(rows, params, share, None)
    best = params.groupBy("grp").agg(F.min(F.struct("logdet", "start")).alias("b"))
    params = stage(params.join(best, "grp").where("start = b.start").drop("b"), "mcd")
    return groups, _step(rows, params, share, chi_square(0.975, P))


def verdicts(docs: DataFrame, quantile: float = QUANTILE, least_group: int = LEAST_GROUP) -> tuple[DataFrame, str]:
    """``docs`` with one struct column (``STATS``, base_failed, distance, kept), and its name.

    Texts that are null, empty or below the base rules are not kept. Repeated rows count as often as they stand there. A
    group too small for its own estimate is judged with its language, or with all documents. An empty table gives no rows.
    """
    groups, params = fit(docs, least_group)
    model = stage(groups.join(params.select("grp", "mu", "inv"), "grp"), "mcd")
    counted, s = statistics(docs)
    lang, source = fresh(counted, "g_lang"), fresh(counted, "g_source")
    found = fresh(counted, "rule_model")
    model = model.select(F.col("g_lang").alias(lang), F.col("g_source").alias(source), F.struct("mu", "inv").alias(found))
    joined = counted.withColumns({lang: _key("lang"), source: _key("source")}).join(small(model), [lang, source], "left")
    x, m = vector(s), F.col(found)
    away = [x[i] - m["mu"][i] for i in range(P)]
    distance = sum(((1 if i == j else 2) * m["inv"][i * P + j] * away[i] * away[j] for i, j in PAIRS), F.lit(0.0))
    failed = base_failed(s)
    kept = ~failed & F.coalesce(distance <= chi_square(quantile, P), F.lit(True))
    verdict = F.struct(*[F.col(f"{s}.{c.split()[0]}") for c in STATS.split(", ")], failed.alias("base_failed"), distance.alias("distance"), kept.alias("kept"))
    name = fresh(docs, "verdict")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], verdict.alias(name)), name
