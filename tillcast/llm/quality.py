"""Quality classifier: a factorisation machine over hashed words and structure statistics.

The score of a text x is ``w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``: all pairwise
interactions of the features through rank-``RANK`` factors, in time linear in the features present. Features are
hashed words and statistics of the text's own structure and length; labels, ids, language and source are none.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm.hashing import Remembered
from tillcast.llm.rows import table

WORDS = 4096
RANK = 8
STATS = 24
FEATURES = WORDS + STATS
# The classifier is fitted on at most so many labelled documents, those with the smallest hash of their id.
# A fitting task holds their sparse features: at most WORDS of 6 bytes each, far fewer in practice.
MOST_LABELLED = 12_000
THRESHOLD = 0.3
FOLDS = 5
BLOCK = 64

_KINDS = np.full(256, 5, np.int8)  # 0 lower, 1 upper, 2 digit, 3 space, 4 sentence marks, 5 other signs, 6 non-ASCII
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58], _KINDS[128:] = 0, 1, 2, 6
_KINDS[[9, 10, 11, 12, 13, 32]] = 3
_KINDS[[ord(c) for c in ".,;:'\"-"]] = 4


class _Buckets(Remembered):
    """Word to bucket."""

    def __missing__(self, word: bytes) -> int:
        self.make_room(word)
        bucket = self[word] = crc32(word) % WORDS
        return bucket


def _statistics(raw: bytes, ids: np.ndarray) -> np.ndarray:
    """Structure of a text in STATS numbers of about -3 to 3: kinds of characters over the whole and in its
    most extreme block, variety and repetition of words likewise, lengths."""
    out = np.zeros(STATS, np.float32)
    if not raw or not len(ids):
        out[0] = 3.0
        return out
    kinds = _KINDS[np.frombuffer(raw, np.uint8)]
    out[1:8] = 4 * np.bincount(kinds, minlength=7)[:7] / len(kinds)
    pad = -len(kinds) % BLOCK
    blocks = np.append(kinds, np.full(pad, 3, np.int8)).reshape(-1, BLOCK)
    for at, kind in ((8, 1), (9, 5), (10, 2)):
        share = (blocks == kind).mean(1)
        out[at], out[at + 3] = 3 * share.max(), 3 * (share > 0.1).mean()
    n = len(ids)
    same = ids[1:] == ids[:-1]
    out[14] = 3 * same.mean() if n > 1 else 0
    out[15] = 3 * len(np.unique(ids)) / n
    runs = np.sort(np.append(ids, np.arange(WORDS, WORDS + -n % 32)).reshape(-1, 32), 1)
    variety = (np.diff(runs, axis=1) != 0).mean(1)
    out[16], out[17] = 3 * variety.min(), 3 * (variety < 0.5).mean()
    if n > 16:
        again = max((ids[k:] == ids[:-k]).mean() for k in range(1, 17))
        out[18] = 3 * again
    out[19] = np.log(n) / 3
    out[20] = np.log(len(raw) / n) - 1.5
    out[21] = np.log1p(raw.count(b"\n")) / 2
    out[22] = 3 * raw.count(b"|") / n
    out[23] = min(3.0, 0.3 * n / (raw.count(b".") + 1) / 10)
    return np.clip(out, -3, 3)


def features(texts: list[str | None], buckets: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of texts: row starts, buckets and values of the words present, and the statistics."""
    starts, columns, values, stats = [0], [], [], []
    for text in texts:
        raw = (text or "").encode("utf-8", "replace")
        words = raw.lower().split()
        ids = np.fromiter(map(buckets.__getitem__, words), np.int32, len(words))
        counts = np.bincount(ids, minlength=WORDS)
        present = np.flatnonzero(counts)
        value = np.log1p(counts[present]).astype(np.float32)
        columns.append(present.astype(np.int32))
        values.append(value / max(np.sqrt((value * value).sum()), 1e-6))
        starts.append(starts[-1] + len(present))
        stats.append(_statistics(raw, ids))
    return np.array(starts), np.concatenate(columns), np.concatenate(values), np.array(stats, np.float32)


class Machine:
    """Parameters of a factorisation machine, and its scores."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    @classmethod
    def constant(cls, share: float) -> Machine:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return cls(float(np.log(share / (1 - share))), np.zeros(FEATURES, np.float32), np.zeros((FEATURES, RANK), np.float32))

    def raw(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = x @ self.factors
        pairs = 0.5 * ((sums * sums) - (x * x) @ (self.factors * self.factors)).sum(1)
        return self.bias + x @ self.weights + pairs, sums

    def scores(self, starts, columns, values, stats) -> np.ndarray:
        """Chance of label 1 for each text; only the features present are touched."""
        w, v = self.weights, self.factors
        edges = np.cumsum(np.vstack([np.zeros((1, 1 + 2 * RANK)), np.hstack([
            (w[columns] * values)[:, None], v[columns] * values[:, None], (v[columns] * values[:, None]) ** 2,
        ])]), axis=0)
        summed = edges[starts[1:]] - edges[starts[:-1]]
        sv, sw = v[WORDS:], w[WORDS:]
        sums = summed[:, 1 : 1 + RANK] + stats @ sv
        squares = summed[:, 1 + RANK :] + (stats * stats) @ (sv * sv)
        raw = self.bias + summed[:, 0] + stats @ sw + 0.5 * (sums * sums - squares).sum(1)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit_machine(starts, columns, values, stats, labels: np.ndarray, epochs: int = 12, batch: int = 128) -> Machine:
    """Adaptive gradient steps on the logistic loss, both labels weighing the same; seeded, hence repeatable."""
    share = float(labels.mean()) if len(labels) else 0.5
    if not 0 < share < 1:
        return Machine.constant(share)
    rng = np.random.default_rng(7)
    m = Machine(0.0, np.zeros(FEATURES, np.float32), rng.normal(0, 0.02, (FEATURES, RANK)).astype(np.float32))
    gw, gv, g0 = np.full(FEATURES, 1e-4, np.float32), np.full((FEATURES, RANK), 1e-4, np.float32), 1e-4
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x = np.zeros((len(rows), FEATURES), np.float32)
            for i, r in enumerate(rows):
                x[i, columns[starts[r] : starts[r + 1]]] = values[starts[r] : starts[r + 1]]
            x[:, WORDS:] = stats[rows]
            raw, sums = m.raw(x)
            error = weight[rows] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[rows]) / len(rows)
            dw = x.T @ error + 1e-6 * m.weights
            dv = x.T @ (error[:, None] * sums) - ((x * x).T @ error)[:, None] * m.factors + 1e-5 * m.factors
            d0 = float(error.sum())
            gw += dw * dw
            gv += dv * dv
            g0 += d0 * d0
            m.weights -= 0.1 * dw / np.sqrt(gw)
            m.factors -= 0.05 * dv / np.sqrt(gv)
            m.bias -= 0.1 * d0 / g0**0.5
    return m


def _fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Machine:
    """Fit on at most ``most`` labelled documents outside the held-out fold.

    Null labels teach nothing; a document labelled several times counts with its lowest label. Without labels
    of both kinds the score is the share of label 1, or a half. The chosen ids are broadcast: ``most`` bounds
    them. The features of the sample meet in one task, which returns the parameters only.
    """
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    sample = marked.where(_fold("doc_id") != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def prepared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = _Buckets()
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                starts, columns, values, stats = features(part["text"].tolist(), buckets)
                cut = [slice(starts[i], starts[i + 1]) for i in range(len(part))]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"], "q": part["q"],
                    "columns": [columns[c].astype(np.int16).tobytes() for c in cut],
                    "vals": [values[c].tobytes() for c in cut], "stats": [s.tobytes() for s in stats],
                })

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "columns", "vals"])
        columns = [np.frombuffer(x, np.int16).astype(np.int32) for x in rows["columns"]]
        starts = np.concatenate([[0], np.cumsum([len(c) for c in columns])]).astype(np.int64)
        values = np.concatenate([np.frombuffer(x, np.float32) for x in rows["vals"]])
        stats = np.array([np.frombuffer(x, np.float32) for x in rows["stats"]])
        m = fit_machine(starts, np.concatenate(columns), values, stats, rows["q"].to_numpy(np.float32))
        return pd.DataFrame([{"bias": m.bias, "w": m.weights.tobytes(), "v": m.factors.tobytes()}])

    ready = chosen.mapInPandas(prepared, "doc_id long, q int, columns binary, vals binary, stats binary")
    found = ready.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(fitted, "bias double, w binary, v binary").first()
    if found is None:
        return Machine.constant(0.5)
    return Machine(
        found["bias"], np.frombuffer(found["w"], np.float32), np.frombuffer(found["v"], np.float32).reshape(FEATURES, RANK)
    )


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) for every row.

    Each row is scored on its own text: null and empty texts alike, repeated rows alike. Columns already
    named score or predicted are replaced, all others are passed through. The parameters are broadcast;
    their size is fixed by the number of features and the rank.
    """
    rest = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weights, machine.factors))

    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets, m = _Buckets(), Machine(*shared.value)
        for column in texts:
            values = column.tolist()
            parts = [m.scores(*features(values[at : at + 256], buckets)) for at in range(0, len(values), 256)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    chance = F.pandas_udf(scored, "double", F.PandasUDFType.SCALAR_ITER)
    return rest.withColumn("score", chance(F.col("text"))).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, machine).select("doc_id", (_fold("doc_id") == 0).alias("held_out"), "score", "predicted")
