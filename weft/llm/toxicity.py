"""A convolutional text classifier for toxicity, trained in numpy.

Words are hashed into buckets; buckets have embeddings; filters of widths 1 to 3 run over the whole text, each
is pooled to its maximum, and a logistic layer scores the pooled features. Training uses a bounded sample of
labelled rows: those of least hash, ``SAMPLE`` at most, as many as hold ``SAMPLE_WORDS`` words in all; each text in
it is whole. Executors hash its words, so the driver gets bucket numbers, 4 bytes a word, and no text. A held-back part of the sample sets the score's scale and, by language, the thresholds.

Scoring is one Arrow function over all documents: filters are precomputed per bucket, so a text costs a few table
look-ups per word; there is no shuffle of texts. labels, lang, source and doc_id are no inputs of the score;
the thresholds by language give the extra column flagged_by_lang only.

Defined results: a null or empty text is scored as a text without known words; an empty table gives an empty result; without
any label of both kinds the score is 0 everywhere; repeated rows are scored alike, and train once; of texts that
share a doc_id the one of least hash trains; other columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, pieces, shared_dir, table, texts, written

SAMPLE, SAMPLE_WORDS, SEED = 6000, 6_000_000, 7
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 20, 8, 6, (1, 2, 3)
EPOCHS, RATE, BATCH, LEAST_DOCS, DECAY = 6, 0.05, 32, 3, 1e-4
PASS = 0.7
_WORDS = re.compile(r"[^\W_]+").findall


class Hasher(dict):
    """Words to bucket numbers; a cache that is emptied when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = k = zlib.crc32(word.encode()) & BUCKETS - 1
        return k

    def text(self, text: str) -> np.ndarray:
        return np.array([self[w] for w in _WORDS(text.lower())], np.int64)


class Net:
    """Embeddings of the buckets met in training (row 0: any other), filters, and the output layer."""

    def __init__(self, rows: np.ndarray, odds: np.ndarray, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.rows = rows  # sorted buckets
        self.e = rng.normal(0, 0.05, (len(rows) + 1, DIM)).astype(np.float32)
        self.e[0] = 0
        self.e[1:, 0] = odds
        self.w = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for w in self.w:
            w[:, 0, 0] = 1.0 / len(w)  # one filter of each width begins as the mean of the words' odds
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.v = np.full(FILTERS * len(WIDTHS), 0.1, np.float32)
        self.c = np.float32(0)
        self.a, self.shift = 1.0, 0.0  # calibration
        self.tables: list[list[np.ndarray]] | None = None

    def index(self, buckets: np.ndarray) -> np.ndarray:
        """Rows of the embedding; at least as many as the widest filter."""
        if not len(self.rows):
            at = np.zeros(len(buckets), np.int64)
        else:
            at = np.searchsorted(self.rows, buckets)
            at = np.where(self.rows[np.minimum(at, len(self.rows) - 1)] == buckets, at + 1, 0)
        return np.pad(at, (0, max(0, WIDTHS[-1] - len(at))))

    def freeze(self) -> Net:
        self.tables = [[self.e @ w[j] for j in range(len(w))] for w in self.w]
        return self

    def pooled(self, x: np.ndarray) -> np.ndarray:
        out = []
        for parts, b in zip(self.tables, self.b, strict=True):
            n = len(x) - len(parts) + 1
            # Places without any known word all give the bias; only the others are computed.
            known = np.zeros(n, bool)
            for j in range(len(parts)):
                known |= x[j : j + n] > 0
            at = np.flatnonzero(known)
            best = np.full(FILTERS, -np.inf, np.float32) if len(at) == n else np.zeros(FILTERS, np.float32)
            if len(at):
                r = parts[0][x[at]]
                for j in range(1, len(parts)):
                    r = r + parts[j][x[at + j]]
                best = np.maximum(best, r.max(axis=0))
            out.append(np.maximum(best + b, 0))
        return np.concatenate(out)

    def logit(self, x: np.ndarray) -> float:
        return float(self.pooled(x) @ self.v + self.c)

    def score(self, z: float) -> float:
        t = self.a * (z - self.shift) + np.log(PASS / (1 - PASS))
        return float(1 / (1 + np.exp(-np.clip(t, -60, 60))))

    def fit(self, xs: list[np.ndarray], y: np.ndarray) -> None:
        """Adagrad over the gradient that max pooling passes to one place of each filter."""
        rng = np.random.default_rng(SEED)
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        params = [self.e, *self.w, *self.b, self.v]
        past = [np.full_like(p, 0.1) for p in params]
        for _ in range(EPOCHS):
            order = rng.permutation(len(xs))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                grads = [np.zeros_like(p) for p in params[1:]]
                touched: list[np.ndarray] = []
                deltas: list[np.ndarray] = []
                gc = 0.0
                for i in rows:
                    x, feats, best = xs[i], [], []
                    for w, b in zip(self.w, self.b, strict=True):
                        n = len(x) - len(w) + 1
                        r = sum(self.e[x[j : j + n]] @ w[j] for j in range(len(w)))
                        k = r.argmax(axis=0)
                        best.append(k)
                        feats.append(np.maximum(r[k, np.arange(FILTERS)] + b, 0))
                    h = np.concatenate(feats)
                    err = (1 / (1 + np.exp(-np.clip(h @ self.v + self.c, -30, 30))) - y[i]) * weight[i] / len(rows)
                    grads[-1] += err * h
                    gc += err
                    for q, w in enumerate(self.w):
                        g = err * self.v[q * FILTERS : (q + 1) * FILTERS] * (feats[q] > 0)
                        grads[len(self.w) + q] += g
                        for j in range(len(w)):
                            words = x[best[q] + j]
                            grads[q][j] += self.e[words].T * g
                            touched.append(words)
                            deltas.append((w[j] * g).T)
                ids, inv = np.unique(np.concatenate(touched), return_inverse=True)
                ge = np.zeros((len(ids), DIM), np.float32)
                np.add.at(ge, inv, np.concatenate(deltas))
                ge[ids == 0] = 0
                past[0][ids] += ge * ge
                self.e[ids] -= RATE * ge / np.sqrt(past[0][ids])
                for p, g, s in zip(params[1:], grads, past[1:], strict=True):
                    g = g + DECAY * p
                    s += g * g
                    p -= RATE * g / np.sqrt(s)
                self.c -= np.float32(RATE * gc)


def best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap below the score at which F1 is greatest; above all scores if there is no positive."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    if not y.any():
        return float(z[0] + 1) if len(z) else 0.0
    hits = np.cumsum(y)
    f = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f[:-1][z[:-1] == z[1:]] = -1  # ties fall on one side
    k = int(f.argmax())
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k])


def train(rows: list[tuple[list[int], str | None, int]]) -> tuple[Net, dict[str, float]]:
    """The network and the scores at which each language's F1 is best; rows: (buckets of the words, lang, label)."""
    y = np.array([r[2] for r in rows], np.int64)
    xs = [np.array(r[0], np.int64) for r in rows]
    if not y.any() or y.all():
        net = Net(np.empty(0, np.int64), np.empty(0))
        net.a, net.shift = 0.0, 0.0
        net.freeze()
        net.score = None
        return net, {}
    rng = np.random.default_rng(SEED)
    back = rng.random(len(xs)) < 0.25
    if y[~back].sum() < 5 or y[back].sum() < 5 or (1 - y)[back].sum() < 5:
        back[:] = False
    # Buckets in enough training documents, with their smoothed log odds.
    fit = np.flatnonzero(~back)
    pos, neg = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for i in fit:
        (pos if y[i] else neg)[np.unique(xs[i])] += 1
    kept = np.flatnonzero(pos + neg >= LEAST_DOCS)
    n_pos, n_neg = y[fit].sum(), (1 - y[fit]).sum()
    odds = np.log((pos[kept] + 0.5) / (n_pos + 1)) - np.log((neg[kept] + 0.5) / (n_neg + 1))
    sure = (pos[kept] + neg[kept]) / (pos[kept] + neg[kept] + 5.0)
    net = Net(kept, np.clip(odds * sure, -3, 3) / 3)
    xs = [net.index(x) for x in xs]
    net.fit([xs[i] for i in fit], y[fit])
    net.freeze()
    z = np.array([net.logit(x) for x in xs])
    use = back if back.any() else np.ones(len(xs), bool)
    net.shift = best_threshold(z[use], y[use])
    spread = z[use][y[use] == 1].mean() - z[use][y[use] == 0].mean()
    net.a = 6.0 / max(1e-3, spread)
    langs = np.array([r[1] or "" for r in rows])
    by = {}
    for lang in sorted(set(langs)):
        at = use & (langs == lang)
        by[lang] = net.score(best_threshold(z[at], y[at])) if y[at].sum() >= 5 and (1 - y[at]).sum() >= 5 else PASS
    return net, by


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


_HASHED = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("lang", pa.string()), ("toxic", pa.int32()), ("n", pa.int64()), ("buckets", pa.list_(pa.int32()))])
HASHED = "doc_id long, t long, lang string, toxic int, n long, buckets array<int>"


def _hash(batches):
    hasher = Hasher()
    for batch in pieces(batches, "text"):
        found = [hasher.text(t).astype(np.int32) for t in batch.column("text").to_pylist()]
        yield batch_of(_HASHED, {c: batch.column(c) for c in ("doc_id", "t", "lang", "toxic")} | {"n": [len(x) for x in found], "buckets": found})


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, most_words: int = SAMPLE_WORDS) -> list[tuple[list[int], str | None, int]]:
    """Buckets, language and label of at most ``size`` labelled texts outside the held-out third, chosen by hash, with ``most_words`` words at most."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(*order).limit(size)
    # Up to ``size`` rows of two numbers: broadcast by a bound, not by an estimate.
    rows = texts(docs, "lang").withColumn("t", F.xxhash64("text")).join(F.broadcast(some), "doc_id").select("doc_id", "t", "lang", "toxic", "text").mapInArrow(_hash, HASHED)
    one = rows.groupBy("doc_id").agg(F.min(F.struct("t", "lang", "toxic", "n", "buckets")).alias("r")).select("doc_id", "r.*")
    one = written(one.withColumn("place", F.xxhash64("doc_id")), f"{shared_dir(docs.sparkSession)}/sample")
    total, last = 0, None
    for r in sorted(one.select("place", "doc_id", "n").collect()):
        total += r.n
        if total > most_words:
            break
        last = (r.place, r.doc_id)
    if last is None:
        return []
    upto = (F.col("place") < last[0]) | ((F.col("place") == last[0]) & (F.col("doc_id") <= last[1]))
    return [(r.buckets, r.lang, r.toxic) for r in sorted(one.where(upto).collect(), key=lambda r: r.doc_id)]


SCORED = "doc_id long, lang string, score double"
_SCORED = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("score", pa.float64())])


def classify(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    net, by = train(sample(docs, labels, size))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # bounded by the sample

    def run(batches):
        net, hasher = shared.value, Hasher()
        for batch in pieces(batches, "text"):
            scores = [0.0 if net.score is None else net.score(net.logit(net.index(hasher.text(t)))) for t in batch.column("text").to_pylist()]
            yield batch_of(_SCORED, {"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "score": scores})

    scored = texts(docs, "lang").mapInArrow(run, SCORED)
    limit = F.lit(PASS)
    for lang, t in by.items():
        limit = F.when(F.coalesce("lang", F.lit("")) == lang, t).otherwise(limit)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= PASS).cast("int").alias("predicted"), limit.alias("lang_threshold"), (F.col("score") >= limit).alias("flagged_by_lang"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
