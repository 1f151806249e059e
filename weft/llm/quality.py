"""Quality rules and robust multivariate outliers.

Each text is measured once (an Arrow function, no shuffle). The transformed statistics are vectors of
whole thousandths. For every language and source, for every language and for all rows a minimum covariance
determinant is estimated from all rows. It starts from two places, medians with quartile ranges and means with
deviations; concentration steps keep the ``KEEP`` share of rows with the least Mahalanobis distance (by whole bins of 2 %
in distance, so a little more) and take their mean and covariance; the start whose last covariance has the lesser determinant wins. A step is
one aggregate by (group, start, distance bin) of counts, sums and sums of products in whole numbers, so it combines
before the shuffle, has no hot group, and gives the same figures whatever the partitions. A row is judged by
the finest group with at least ``LEAST`` rows; it is rejected if its squared distance exceeds ``CUT``. The statistics
are far from normal, so no quantile of a normal sample's distances is used: the cut is a fixed parameter.

Defined results: a null text is an empty one and fails the base rules; null languages and sources are groups of
their own; rows that fail the base rules are not measured against; repeated rows count as often as they
stand there; an empty table gives an empty result; columns other than doc_id, text, lang and source are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, dropped, pieces, shared_dir, table, text_hash, texts, unused, written

KEEP, LEAST, STEPS, CUT = 0.75, 30, 5, 100.0
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Statistic vectors in thousandths, with the least standard deviation that each is taken to have.
FEATURES = {"x_length": 60, "x_symbols": 150, "x_lines": 120, "x_repeats": 80, "x_upper": 60}
P = len(FEATURES)
BINS = 600

_STATS = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("t", pa.int64())] + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")])
STATS = "doc_id long, lang string, source string, t long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_letters long, n_upper long"


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a five-word window found twice or more."""
    n = len(words)
    if n < 6:
        return 0
    ids: dict[bytes, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    rank = lambda x: np.unique(x, return_inverse=True)[1]
    two = rank(a[:-1] * n + a[1:])
    four = rank(two[:-2] * n + two[2:])
    _, at, count = np.unique(four[:-1] * n + a[4:], return_inverse=True, return_counts=True)
    again = count[at] > 1
    if not again.any():
        return 0
    cover = np.zeros(n, bool)
    for j in range(5):
        cover[j : n - 4 + j] |= again
    return int(cover.sum())


def measures(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()  # bytes split at the six blanks of ASCII
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    bytes_ = np.frombuffer(raw, np.uint8)
    upper = int(((bytes_ >= 65) & (bytes_ <= 90)).sum())
    letters = upper + int(((bytes_ >= 97) & (bytes_ <= 122)).sum())
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines), letters, upper


def _measure(batches):
    for batch in pieces(batches, "text"):
        cols = list(zip(*map(measures, batch.column("text").to_pylist()), strict=True))
        yield batch_of(_STATS, {c: batch.column(c) for c in ("doc_id", "lang", "source", "t")} | dict(zip(_STATS.names[4:], cols, strict=True)))


def stats(docs: DataFrame) -> DataFrame:
    """The measured statistics with the base verdict and the transformed vector."""
    s = texts(docs, "lang", "source").withColumn("t", text_hash()).mapInArrow(_measure, STATS)
    n, lines, letters = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_lines", "n_letters"))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    whole = lambda c: F.round(c * 1000).cast("long")
    return s.select(
        *_STATS.names[:9],
        failed.alias("base_failed"),
        whole(F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n)).alias("x_length"),
        whole(F.log1p(F.col("n_symbols") * 10 / n)).alias("x_symbols"),
        whole(F.sqrt(F.col("n_dup_lines") / lines)).alias("x_lines"),
        whole(F.sqrt(F.col("n_repeat_words") / n)).alias("x_repeats"),
        whole(F.sqrt(F.col("n_upper") / letters)).alias("x_upper"),
    )


def _groups() -> Column:
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in ("lang", "source"))
    return F.array(F.concat_ws("\x1f", F.lit("2"), lang, source), F.concat_ws("\x1f", F.lit("1"), lang), F.lit("0"))


PARAMS = "grp string, start int, n long, mean array<double>, inverse array<double>, log_det double"


def _first(rows: DataFrame) -> DataFrame:
    """Both starts of each group: medians and quartile ranges (exact: values are whole numbers of a small range), means and deviations."""
    quartiles = [F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{x}") for x in FEATURES]
    per = rows.groupBy("grp").agg(F.count("*").alias("n"), *quartiles, *[F.avg(x).alias(f"a_{x}") for x in FEATURES], *[F.stddev_pop(x).alias(f"d_{x}") for x in FEATURES])

    def start(k: int, mean: list[Column], spread: list[Column]) -> Column:
        spread = [F.greatest(s, F.lit(float(least))) for s, least in zip(spread, FEATURES.values(), strict=True)]
        inverse = F.array(*[1 / (spread[i] * spread[i]) if i == j else F.lit(0.0) for i in range(P) for j in range(P)])
        return F.struct(F.lit(k).alias("start"), F.array(*[m.cast("double") for m in mean]).alias("mean"), inverse.alias("inverse"))

    of = lambda c, k: F.col(f"q_{c}")[k]
    starts = F.array(
        start(0, [of(x, 1) for x in FEATURES], [(of(x, 2) - of(x, 0)) / 1.349 for x in FEATURES]),
        start(1, [F.col(f"a_{x}") for x in FEATURES], [F.col(f"d_{x}") for x in FEATURES]),
    )
    return per.select("grp", "n", F.explode(starts).alias("s")).select("grp", "s.start", "n", "s.mean", "s.inverse", F.lit(0.0).alias("log_det"))


def distance() -> Column:
    """Squared Mahalanobis distance of a row from the mean beside it."""
    d = [F.col(x) - F.col("mean")[i] for i, x in enumerate(FEATURES)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(i, P):
            total = total + F.col("inverse")[i * P + j] * d[i] * d[j] * (1 if i == j else 2)
    return total


def _concentrate(key, bins: pd.DataFrame) -> pd.DataFrame:
    """One group's and start's bins of distance to the mean, inverse covariance and log determinant of its nearest rows."""
    bins = bins.sort_values("bin")
    n = bins["n"].to_numpy(np.int64)
    upto = np.searchsorted(np.cumsum(n), KEEP * n.sum()) + 1
    near = bins.iloc[:upto]
    m = int(near["n"].sum())
    sums = [sum(map(int, near[f"s{i}"])) for i in range(P)]
    mean = np.array([s / m for s in sums])
    cov = np.empty((P, P))
    for i in range(P):
        for j in range(i, P):
            cov[i, j] = cov[j, i] = (sum(map(int, near[f"p{i}_{j}"])) * m - sums[i] * sums[j]) / m / m
    cov += np.diag(np.square(np.array(list(FEATURES.values()), float)))
    return pd.DataFrame({"grp": [key[0]], "start": [int(key[1])], "n": [int(n.sum())], "mean": [mean.tolist()], "inverse": [np.linalg.inv(cov).ravel().tolist()], "log_det": [float(np.linalg.slogdet(cov)[1])]})


def _step(rows: DataFrame, params: DataFrame) -> DataFrame:
    far = rows.join(params.drop("n"), "grp").withColumn("bin", F.least(F.ceil(F.log1p(distance()) * 50), F.lit(BINS)).cast("int"))
    names = list(FEATURES)
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(names)]
    products = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i in range(P) for j in range(i, P)]
    return far.groupBy("grp", "start", "bin").agg(F.count("*").alias("n"), *sums, *products).groupBy("grp", "start").applyInPandas(_concentrate, PARAMS)


def estimate(measured: DataFrame, folder: str) -> DataFrame:
    """Robust mean and inverse covariance of each group of rows that passed the base rules."""
    rows = measured.where(~F.col("base_failed")).select(F.explode(_groups()).alias("grp"), *FEATURES)
    params = written(_first(rows), f"{folder}/mcd0")
    for k in range(STEPS):
        params = written(_step(rows, params), f"{folder}/mcd{k + 1}")
        dropped(measured.sparkSession, f"{folder}/mcd{k}")
    # Equal determinants, to a billionth, are one solution: the first start's.
    best = F.min(F.struct(F.round("log_det", 9).alias("det"), "start", "n", "mean", "inverse")).alias("b")
    return params.groupBy("grp").agg(best).select("grp", "b.n", "b.mean", "b.inverse")


def judge(docs: DataFrame) -> DataFrame:
    """Statistics, base_failed, distance (squared; null if no group is large enough) and kept."""
    folder = shared_dir(docs.sparkSession)
    measured = written(stats(docs), f"{folder}/stats")
    params = estimate(measured, folder).where(F.col("n") >= LEAST)
    # A row meets up to three groups; the finest one that is large enough has the greatest key.
    grps = [F.col("grp").alias(f"g{k}") for k in range(3)]
    out = measured.withColumn("_g", _groups())
    for k in range(3):
        at = params.select(grps[k], F.struct("mean", "inverse").alias(f"m{k}"))
        out = out.join(at, F.col("_g")[k] == F.col(f"g{k}"), "left")
    best = F.coalesce("m0", "m1", "m2")
    out = out.withColumn("mean", best["mean"]).withColumn("inverse", best["inverse"]).withColumn("distance", distance())
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUT)
    return out.select(*_STATS.names[:9], "base_failed", *FEATURES, "distance", kept.alias("kept"))


def kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns. A verdict is that of a text, language and source: rows that share a doc_id, or have none, stand each for itself."""
    ids = unused(docs, "_id", "_t", "_lang", "_source", "_row")
    good = judge(docs).where("kept").select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "t", "lang", "source"), ids, strict=False)]).distinct()
    rows = docs.withColumn(ids[4], text_hash())
    own = rows[ids[4]] == good[ids[1]]
    for c, n in (("doc_id", ids[0]), ("lang", ids[2]), ("source", ids[3])):
        own = own & rows[c].eqNullSafe(good[n])
    return rows.join(good, own, "left_semi").select(*docs.columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
