"""Scoring by a log-bilinear language model, learned from all training documents.

The model predicts a word from the two before it: each has a vector, a matrix per distance maps it, and the sum meets
the vector of the word and its bias. It knows the ``MODEL_WORDS`` most frequent words, the end of a text among them,
and one class for all others; inside that class a word has its smoothed share of the class's tokens, so that all words,
also those never seen, share a probability of one.

Learning is noise-contrastive: a word is told from words drawn by their frequency, so no sum over the vocabulary is
needed. Every round deals a part of the training documents; tasks go on from the same parameters, each over its own
documents, and their results are averaged row by row, weighted by how often a row was used. The rounds together read
every training document once. With two words of context the normaliser is a table over pairs of words, and as
exp(a + b) = exp(a) exp(b) one matrix product gives the whole of it; batches then look it up.

Counts cover the whole corpus. Words with at least ``HEAD_SHARE`` of all training tokens, of which there can be no more
than 1 / HEAD_SHARE, are broadcast; the others are joined by word, where none of them is frequent.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import compress, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm.rows import table
from tillcast.session import materialize

MODEL_WORDS = 2048
WIDTH = 20
CONTEXT = 2
HEAD_SHARE = 2e-6
ROUNDS = 4
NOISE = 64
BATCH = 512
RATE = 0.1
FOLDS = 10
SMOOTH = 0.1
# Different words a task counts before it hands them on, rows of a batch, and tokens scored at once.
COUNTED, ROWS, TOKENS = 200_000, 256, 32_768
# Rows of parameters that travel together, and how many partial sums of them there are.
BLOCK, SALTS = 256, 32

END, OTHER = 0, 1
END_WORD = b""


def split(text: bytes | None) -> list[bytes]:
    """Runs without ASCII white space, A to Z lower-cased."""
    return text.lower().split() if text else []


def _raw(text: str) -> Column:
    return F.col(text).cast("binary").alias("text")


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts, in UTF-8; the empty word stands for the ends of the texts.

    Tasks count before they hand over, so a word on every page is a few rows of each task.
    """

    def batch_of(seen: Counter) -> pa.RecordBatch:
        words, numbers = pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())
        return pa.RecordBatch.from_arrays([words, numbers], ["word", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in batches:
            seen[END_WORD] += batch.num_rows
            for at in range(0, batch.num_rows, ROWS):
                for text in batch.column(0).slice(at, ROWS).to_pylist():
                    seen.update(split(text))
                if len(seen) > COUNTED:
                    yield batch_of(seen)
                    seen = Counter()
        if seen:
            yield batch_of(seen)

    parts = docs.select(_raw(text)).mapInArrow(counted, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Parameters:
    """Vectors of the context words, of the predicted words with their bias, and the matrices of the distances.

    All are rows of one table: ``rows[:m]`` and ``rows[m:2m]`` belong to the words, the rest are the matrices. ``squares``
    adds up the mean squared gradient of each row and that of its bias, ``used`` how often a row took part since the
    last round.
    """

    rows: np.ndarray
    squares: np.ndarray
    log_noise: np.ndarray
    used: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def start(cls, shares: np.ndarray) -> Parameters:
        """Small random vectors and the words' frequencies as bias: at first the model is that of single words."""
        m, rng = len(shares), np.random.default_rng(13)
        rows = np.zeros((2 * m + CONTEXT * WIDTH, WIDTH + 1), np.float32)
        rows[: 2 * m, :WIDTH] = rng.normal(0, 0.1, (2 * m, WIDTH))
        for i in range(CONTEXT):
            rows[2 * m + i * WIDTH : 2 * m + (i + 1) * WIDTH, :WIDTH] = np.eye(WIDTH) / (i + 1)
        log_noise = np.log(shares).astype(np.float32)
        rows[m : 2 * m, WIDTH] = log_noise
        return cls(rows, np.ones((len(rows), 2), np.float32), log_noise)

    @property
    def m(self) -> int:
        return len(self.log_noise)

    @property
    def words(self) -> np.ndarray:
        return self.rows[self.m : 2 * self.m, :WIDTH]

    @property
    def bias(self) -> np.ndarray:
        return self.rows[self.m : 2 * self.m, WIDTH]

    def matrix(self, distance: int) -> np.ndarray:
        return self.rows[2 * self.m + distance * WIDTH :][:WIDTH, :WIDTH]

    def mapped(self) -> list[np.ndarray]:
        """What each context word adds at each distance."""
        return [self.rows[: self.m, :WIDTH] @ self.matrix(i) for i in range(CONTEXT)]

    def _descend(self, at: np.ndarray, gradient: np.ndarray, bias: np.ndarray | None = None) -> None:
        """One step for the rows ``at``, each listed once; the last column of ``gradient`` is the bias's, if any."""
        part = gradient[:, :WIDTH]
        squares = self.squares[at]
        squares[:, 0] += np.einsum("ij,ij->i", part, part) / WIDTH
        step = np.empty((len(at), WIDTH + 1), np.float32)
        step[:, :WIDTH] = part / np.sqrt(squares[:, :1])
        if bias is None:
            step[:, WIDTH] = 0
        else:
            squares[:, 1] += bias * bias
            step[:, WIDTH] = bias / np.sqrt(squares[:, 1])
        self.squares[at] = squares
        self.rows[at] -= RATE * step

    def learn(self, target: np.ndarray, before: list[np.ndarray], noise: np.ndarray, times: np.ndarray) -> None:
        """Tell each target, which stands ``times`` times after its context, from the noise words of the batch."""
        m, rows = self.m, self.rows
        seen = [rows[c][:, :WIDTH] for c in before]
        h = seen[0] @ self.matrix(0) + seen[1] @ self.matrix(1)
        right, wrong = rows[m + target], rows[m + noise]
        offset = np.log(np.float32(len(noise)))
        g = np.einsum("ij,ij->i", h, right[:, :WIDTH]) + right[:, WIDTH] - offset - self.log_noise[target]
        g = (_logistic(g) - 1) * times
        gn = _logistic(h @ wrong[:, :WIDTH].T + (wrong[:, WIDTH] - offset - self.log_noise[noise])) * times[:, None]
        dh = g[:, None] * right[:, :WIDTH] + gn @ wrong[:, :WIDTH]
        words = np.empty((len(target) + len(noise), WIDTH + 1), np.float32)
        words[: len(target), :WIDTH] = h * g[:, None]
        words[: len(target), WIDTH] = g
        words[len(target) :, :WIDTH] = gn.T @ h
        words[len(target) :, WIDTH] = gn.sum(0)
        at, gradient, used = _summed(np.concatenate([target, noise]), words)
        contexts = _summed(np.concatenate(before), np.concatenate([dh @ self.matrix(i).T for i in range(CONTEXT)]))
        matrices = [v.T @ dh for v in seen]
        self._descend(m + at, gradient, gradient[:, WIDTH])
        self.used[m + at] += used
        self._descend(contexts[0], contexts[1])
        self.used[contexts[0]] += contexts[2]
        for i, gradient in enumerate(matrices):
            at = np.arange(2 * m + i * WIDTH, 2 * m + (i + 1) * WIDTH)
            self._descend(at, gradient)
            self.used[at] += len(target)

    def log_normaliser(self) -> np.ndarray:
        """Logarithm of the sum over all words, for every pair (previous word, the one before it)."""
        parts = [(v @ self.words.T).astype(np.float64) for v in self.mapped()]
        tops = [p.max(1) for p in parts]
        near, far = (np.exp(p - t[:, None]) for p, t in zip(parts, tops))
        near *= np.exp(self.bias.astype(np.float64))
        return (np.log(near @ far.T) + tops[0][:, None] + tops[1]).astype(np.float32)


class Scorer:
    """Natural logarithms of the probabilities that a model gives to classes after their contexts."""

    def __init__(self, model: Parameters, normaliser: np.ndarray):
        self.near, self.far = model.mapped()
        self.words, self.bias = np.ascontiguousarray(model.words), np.ascontiguousarray(model.bias)
        self.normaliser = normaliser

    def logs(self, target: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(target))
        for at in range(0, len(target), TOKENS):
            part = slice(at, at + TOKENS)
            one, two, word = before[0][part], before[1][part], target[part]
            s = np.einsum("ij,ij->i", self.near[one] + self.far[two], self.words[word]) + self.bias[word]
            out[part] = s.astype(np.float64) - self.normaliser[one, two]
        return out


def _logistic(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _summed(at: np.ndarray, gradients: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different rows, the sum of their gradients, and how many gradients each had."""
    order = np.argsort(at, kind="stable")
    ranked = at[order]
    lasts = np.append(np.flatnonzero(ranked[1:] != ranked[:-1]), len(at) - 1)
    upto = np.cumsum(gradients[order], axis=0, dtype=np.float64)[lasts]
    upto[1:] -= upto[:-1].copy()
    return ranked[lasts], upto.astype(np.float32), np.diff(lasts, prepend=-1)


@dataclass(frozen=True)
class Vocabulary:
    """The frequent words and the totals of the training corpus.

    ``heads`` numbers the frequent words by falling count from 1, the end of a text is 0; ``counts`` are their counts.
    ``total`` tokens are of ``different`` kinds. Heads below ``known`` have a model class of their own.
    """

    heads: dict[bytes, int]
    counts: np.ndarray
    total: int
    different: int

    @classmethod
    def of(cls, counts: DataFrame) -> Vocabulary:
        sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        total, different = int(sums[0]), int(sums[1])
        frequent = counts.where((F.col("n") >= HEAD_SHARE * total) | (F.col("word") == F.lit(END_WORD))).collect()
        ranked = sorted(((-r["n"], bytes(r["word"])) for r in frequent if bytes(r["word"]) != END_WORD))
        ends = sum(r["n"] for r in frequent if bytes(r["word"]) == END_WORD)
        heads = {word: at for at, (_, word) in enumerate(ranked, 1)}
        return cls(heads, np.array([ends, *(-n for n, _ in ranked)], np.int64), total, different)

    @property
    def known(self) -> int:
        return min(len(self.counts), MODEL_WORDS - 1)

    def classes(self) -> np.ndarray:
        """Model class of each head, and last, for the index -1, that of words which are none."""
        out = np.full(len(self.counts) + 1, OTHER, np.int64)
        out[: self.known] = [END, *range(2, self.known + 1)]
        return out

    def shares(self) -> np.ndarray:
        """Smoothed share of every model class in the training tokens."""
        counts = np.zeros(self.known + 1)
        counts[self.classes()[: self.known]] = self.counts[: self.known]
        counts[OTHER] = self.total - counts.sum()
        return (counts + SMOOTH) / (counts.sum() + SMOOTH * len(counts))

    @property
    def base(self) -> float:
        """What smoothed counts are divided by, over all words and one never seen."""
        return self.total + SMOOTH * (self.different + 1)

    @property
    def rest(self) -> float:
        """The same for the words without a class of their own."""
        known = self.counts[: self.known]
        return self.total - int(known.sum()) + SMOOTH * (self.different - int((known > 0).sum()) + 1)


def _tokens(texts: list[bytes | None], heads: dict[bytes, int]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of the texts, the heads of all their tokens in a row (-1: none), and where each text starts."""
    words = [split(t) for t in texts]
    found, starts = [], np.cumsum([0, *(len(w) + 1 for w in words)])
    for part in words:
        found += map(heads.get, part, repeat(-1))
        found.append(END)
    return words, np.array(found, np.int32).astype(np.int64), starts


def _before(classes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The classes one and two tokens back; before a text stand ends."""
    one = np.concatenate([[END], classes[:-1]])
    two = np.concatenate([[END, END], classes[:-2]])[: len(classes)]
    two[starts[:-1]] = END
    return [one, two]


def train(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> Parameters:
    """Learn from the whole texts of ``docs`` in ``ROUNDS`` rounds, each over the documents of one hash of their id."""
    model = Parameters.start(vocabulary.shares())
    context = docs.sparkSession.sparkContext
    heads = context.broadcast(vocabulary.heads)
    classes = vocabulary.classes()
    if not vocabulary.total:
        return model
    for number in range(ROUNDS):
        shared = context.broadcast((model.rows, model.squares, model.log_noise))

        def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, squares, log_noise = shared.value
            mine = Parameters(rows.copy(), squares.copy(), log_noise, np.zeros(len(rows)))
            task = TaskContext.get().partitionId()
            rng = np.random.default_rng([number, task])
            limits = np.cumsum(np.exp(log_noise.astype(np.float64)))
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    _, found, starts = _tokens(batch.column(0).slice(at, ROWS).to_pylist(), heads.value)
                    target = classes[found]
                    one, two = _before(target, starts)
                    # Equal words in equal contexts are one step with their number as weight.
                    kinds, times = np.unique((two * mine.m + one) * mine.m + target, return_counts=True)
                    order = rng.permutation(len(kinds))
                    kinds, times = kinds[order], times[order].astype(np.float32)
                    for first in range(0, len(order), BATCH):
                        part = kinds[first : first + BATCH]
                        noise = np.minimum(np.searchsorted(limits, rng.random(NOISE) * limits[-1]), len(limits) - 1)
                        pair, word = np.divmod(part, mine.m)
                        mine.learn(word, [pair % mine.m, pair // mine.m], noise, times[first : first + BATCH])
            blocks = range(0, len(rows), BLOCK)
            moved = (mine.rows - rows) * mine.used[:, None].astype(np.float32)
            yield pa.RecordBatch.from_arrays([
                pa.array(list(range(len(blocks))), pa.int32()),
                pa.array([task % SALTS] * len(blocks), pa.int32()),
                pa.array([moved[b : b + BLOCK].tobytes() for b in blocks], pa.binary()),
                pa.array([(mine.squares - squares)[b : b + BLOCK].tobytes() for b in blocks], pa.binary()),
                pa.array([mine.used[b : b + BLOCK].tobytes() for b in blocks], pa.binary()),
            ], ["block", "salt", "moved", "squares", "used"])

        schema = "block int, salt int, moved binary, squares binary, used binary"
        part = docs.where(F.pmod(F.xxhash64(key), F.lit(ROUNDS)) == number).select(_raw(text))
        sums = part.mapInArrow(learned, schema)
        for keys in (["block", "salt"], ["block"]):
            sums = sums.groupBy(*keys).applyInPandas(_added, schema)
        width = model.rows.shape[1]
        for r in sums.collect():  # the parameters, whatever the number of tasks
            at = slice(r["block"] * BLOCK, (r["block"] + 1) * BLOCK)
            used = np.frombuffer(r["used"])
            moved = np.frombuffer(r["moved"], np.float32).reshape(-1, width)
            model.rows[at] += moved / np.maximum(used, 1)[:, None].astype(np.float32)
            model.squares[at] += np.frombuffer(r["squares"], np.float32).reshape(-1, 2)
    return model


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    first = rows.iloc[:1].copy()
    for name, kind in (("moved", np.float32), ("squares", np.float32), ("used", np.float64)):
        total = np.zeros(len(rows[name].iloc[0]) // np.dtype(kind).itemsize)
        for value in rows[name]:
            total += np.frombuffer(value, kind)
        first[name] = [total.astype(kind).tobytes()]
    return first


def score(
    docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, model: Parameters, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(key, n_tokens, n_known, base_score, score) for every row of ``docs``.

    ``score`` is the model's log10 probability of the whole text with its end, ``base_score`` that of single words by
    their smoothed counts. A null text is empty: one token, its end. Repeated rows are scored alike, each a row of
    its own; other columns are left behind. Without training tokens every word has the same share.

    Frequent words are looked up in the task. The others leave it as (text, word, number), meet their counts by word and
    are added up by text; as none of them is frequent, no word gathers many rows, and a text is a sum.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((model.rows, model.log_noise, model.log_normaliser()))
    heads = context.broadcast(vocabulary.heads)
    classes = vocabulary.classes()
    base = np.append(np.log10((vocabulary.counts + SMOOTH) / vocabulary.base), 0.0)
    inside = np.append(np.log10((vocabulary.counts + SMOOTH) / vocabulary.rest), 0.0)
    inside[: vocabulary.known] = 0.0
    seen = np.append(vocabulary.counts > 0, False).astype(np.int64)
    names = [key, "n_tokens", "n_known", "base_score", "score", "rare"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, log_noise, normaliser = shared.value
        scorer, numbers = Scorer(Parameters(rows, None, log_noise), normaliser), heads.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                words, found, starts = _tokens(part.column(1).to_pylist(), numbers)
                target = classes[found]
                logs = scorer.logs(target, _before(target, starts)) / np.log(10) + inside[found]
                none = found < 0
                rare = [Counter(compress(ws, none[s:e].tolist())) for ws, s, e in zip(words, starts, starts[1:])]
                ends = np.cumsum([0, *map(len, rare)])
                flat = pa.StructArray.from_arrays([
                    pa.array([w for r in rare for w in r], pa.binary()),
                    pa.array([n for r in rare for n in r.values()], pa.int64()),
                ], ["word", "n"])
                sums = [np.add.reduceat(v[found], starts[:-1]) for v in (seen, base)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(np.diff(starts), pa.int64()), pa.array(sums[0]), pa.array(sums[1]),
                    pa.array(np.add.reduceat(logs, starts[:-1])), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat),
                ], names)

    slim = docs.select(F.col(key).cast("long").alias(key), _raw(text))
    done = slim.mapInArrow(
        scored,
        f"`{key}` long, n_tokens long, n_known long, base_score double, score double, rare array<struct<word:binary,n:long>>",
    ).withColumn("row", F.monotonically_increasing_id())
    # A text's sums ride on its first rare word; a text without any has a word that cannot occur, one for each text.
    single = done.select("*", F.posexplode_outer("rare").alias("at", "one")).select(
        "row", *[F.when(F.coalesce("at", F.lit(0)) == 0, F.col(c)).alias(c) for c in names[:-1]],
        F.coalesce(F.col("one")["word"], F.concat(F.lit(" "), F.col("row").cast("string")).cast("binary")).alias("word"),
        F.coalesce(F.col("one")["n"], F.lit(0)).alias("times"),
    )
    rest = counts.where(F.col("n") < HEAD_SHARE * vocabulary.total).select("word", F.col("n").alias("count"))
    met = single.join(rest, "word", "left").select("row", *names[:-1], "times", F.coalesce("count", F.lit(0)).alias("count"))
    known = F.sum(F.when(F.col("count") > 0, F.col("times")).otherwise(0))
    logs = F.sum(F.col("times") * F.log10(F.col("count") + SMOOTH))
    return met.groupBy("row").agg(
        F.max(key).alias(key), F.max("n_tokens").alias("n_tokens"), (F.max("n_known") + known).alias("n_known"),
        (F.max("base_score") + logs - F.sum("times") * float(np.log10(vocabulary.base))).alias("base_score"),
        (F.max("score") + logs - F.sum("times") * float(np.log10(vocabulary.rest))).alias("score"),
    ).drop("row")


def held_out(key: str) -> Column:
    """The fold that is not learned from; a row without an id is in it."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(FOLDS)) == 0


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = docs.where(~held_out("doc_id"))
    counts = materialize(count_words(learned), "words")
    vocabulary = Vocabulary.of(counts)
    model = train(learned, vocabulary)
    return score(docs, counts, vocabulary, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known",
        F.lit(vocabulary.total).cast("bigint").alias("train_tokens"), "base_score", "score",
    )
