"""Importance resampling towards a target distribution, over hashed runs of words.

A 256-byte table lower-cases A to Z and blanks the separators in a text's UTF-8, ``bytes.split`` yields its words, and
CRC-32 extends a run of words by one more: the checksum of a run seeds that of the run with a blank and the next word,
so each of the three lengths costs one checksum a word. Counters reduce the runs to buckets within a task, and the
engine adds up the tasks' counters, one row per bucket and task. The logarithm of how much likelier a bucket is in the
target than in the corpus is its gain; a document's weight is the sum over its runs. Documents are drawn by weight plus
Gumbel noise from a hash of the id, which draws without replacement in proportion to the weights and is repeatable.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.functions.ranks import with_rows_before
from tillcast.llm.rows import SEPARATORS, UPPER, table
from tillcast.session import materialize

BUCKETS = 10_000
LONGEST_RUN = 3
LEAST_WORDS = 20
SHARE = 5  # in 100
SEED = 42
SCALE = 1000
# Words of a text that are hashed at once, and rows of a batch.
CHUNK, ROWS = 65_536, 256

_BYTES = bytes(ord(chr(c).lower()) if chr(c) in UPPER else 0x20 if chr(c) in SEPARATORS else c for c in range(256))


def split(text: bytes | None) -> list[bytes]:
    return text.translate(_BYTES).split() if text else []


def runs(words: list[bytes], longest: int = LONGEST_RUN) -> Iterator[list[int]]:
    """CRC-32 of all runs of 1 to ``longest`` words joined by blanks, some of them at a time."""
    blank = repeat(b" ")
    for at in range(0, len(words), CHUNK):
        part = words[at : at + CHUNK + longest - 1]
        sums = list(map(crc32, part))
        for more in range(longest):
            if more:
                sums = list(map(crc32, part[more:], map(crc32, blank, sums)))
            yield sums[:CHUNK]


def buckets(words: list[bytes], longest: int = LONGEST_RUN) -> np.ndarray:
    parts = [np.array(part, np.int64) for part in runs(words, longest)]
    return np.concatenate(parts) % BUCKETS if parts else np.zeros(0, np.int64)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        yield part, part.column(column).to_pylist()


def bucket_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How many runs of the whole table fall into each bucket. Null and empty texts have none."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in batches:
            for _, texts in _texts(batch, 0):
                for raw in texts:
                    seen.update(buckets(split(raw)).tolist())
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], ["bucket", "n"]
            )

    parts = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(counted, "bucket int, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the rounded logarithm of its smoothed share in the target over that in the corpus."""
    s_all, t_all = int(corpus.sum()), int(target.sum())
    return np.array([
        math.floor(SCALE * math.log(
            (float(t + 1) * float(s_all + BUCKETS)) / (float(s + 1) * float(t_all + BUCKETS))
        ))
        for s, t in zip(corpus.tolist(), target.tolist())
    ], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_features, weight) for every row: its words, its runs, and the sum of their buckets' gains.

    Texts without words have weight 0. Other columns are left behind; the gains are broadcast, one per bucket.
    """
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    names = [key, "n_words", "n_features", "weight"]

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for part, texts in _texts(batch, 1):
                rows = []
                for raw in texts:
                    words = split(raw)
                    found = buckets(words)
                    rows.append((len(words), len(found), int(gain[found].sum())))
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    slim = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("binary").alias("__text"))
    return slim.mapInArrow(weighed, f"`{key}` long, n_words long, n_features long, weight long")


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in steps of 1 / SCALE, from the first 32 bits of a digest of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def importance(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", share: int = SHARE,
    least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) for every row of ``docs``, drawn towards ``target``'s texts.

    Of the N rows with ``least_words`` words or more, the floor(share * N / 100) with the highest scores are drawn and
    numbered from 1; ties go to the smaller id, rows without an id come last, and rows equal in all of this have
    neighbouring numbers. Rows that are not drawn have no rank. Rows repeating an id are rows of their own with the
    same noise. An empty target gives every bucket a gain by the corpus alone; an empty table stays empty.

    Texts are read twice, to count and to weigh. The weights are stored in between, so later steps see one row of
    numbers per text; equal rows are counted before they are ranked.
    """
    gain = gains(bucket_counts(docs, text), bucket_counts(target, text))
    weights = materialize(weigh(docs, gain, key, text), "weights")
    scored = weights.withColumn("score", F.col("weight") + noise(F.col(key), seed))
    names = scored.columns
    same = scored.groupBy(*names).agg(F.count(F.lit(1)).alias("__copies"))
    fit = with_rows_before(
        same.where(F.col("n_words") >= least_words), "score", [F.col(key).asc_nulls_last(), "n_features", "n_words"],
        "__copies", "__before", descending=True,
    )
    drawn = scored.where(F.col("n_words") >= least_words).agg(F.floor(F.count(F.lit(1)) * share / 100)).scalar()
    places = F.sequence(F.col("__before") + 1, F.col("__before") + F.col("__copies"))
    ranked = fit.withColumn("__drawn", drawn).select(*names, "__drawn", F.explode(places).alias("rank"))
    ranked = ranked.select(*names, F.when(F.col("rank") <= F.col("__drawn"), F.col("rank")).alias("rank"))
    short = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(short)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def _crc_table() -> list[int]:
    """CRC-32 of each byte on its own, by the reversed polynomial."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


_WORDS = (
    rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
_RUNS = """
  select id, unnest(list_concat(w,
    list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as f"""
SQL = f"""
with recursive crc_table as materialized (select {_crc_table()}::bigint[] as t),
docs as materialized (select row_number() over () as id, doc_id, {_WORDS} as w from documents),
items as (select row_number() over () as id, {_WORDS} as w from benchmark),
corpus_runs as materialized ({_RUNS} from docs),
target_runs as materialized ({_RUNS} from items),
texts as (select distinct f from (select f from corpus_runs union all select f from target_runs)),
steps as (
  select f, hex(encode(f)) as h, 4294967295::bigint as crc, 0 as pos from texts
  union all
  select f, h, xor(crc >> 8, (select t from crc_table)[1 + (xor(crc & 255,
    16 * (instr('0123456789ABCDEF', h[2 * pos + 1]) - 1) + instr('0123456789ABCDEF', h[2 * pos + 2]) - 1))]), pos + 1
  from steps where 2 * pos < length(h)),
hashed as materialized (select f, xor(crc, 4294967295) % {BUCKETS} as bucket from steps where 2 * pos = length(h)),
corpus as (select bucket, count(*) as n from corpus_runs join hashed using (f) group by bucket),
target as (select bucket, count(*) as n from target_runs join hashed using (f) group by bucket),
gain as materialized (
  select b.bucket, floor({SCALE} * ln(
    ((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from corpus) + {BUCKETS})::double)
    / ((coalesce(c.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from target) + {BUCKETS})::double)))::bigint as gain
  from (select unnest(range({BUCKETS})) as bucket) b left join corpus c using (bucket) left join target t using (bucket)),
weights as (
  select id, count(*) as n_features, sum(gain)::bigint as weight
  from corpus_runs join hashed using (f) join gain using (bucket) group by id),
scored as (
  select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, len(w) as n_words,
    coalesce(weight, 0) + floor(-{SCALE} * ln(-ln(
      (('0x' || sha256('{SEED}:' || coalesce(doc_id::varchar, ''))[1:8])::bigint + 0.5::double) / 4294967296)))::bigint as score
  from docs left join weights using (id)),
ranked as (
  select *, case when n_words >= {LEAST_WORDS} then
    row_number() over (partition by n_words >= {LEAST_WORDS} order by score desc, doc_id asc nulls last) end as place
  from scored)
select doc_id, n_features, weight, score, n_words,
  case when place <= (select floor({SHARE} * count(*) / 100) from scored where n_words >= {LEAST_WORDS}) then place end as rank
from ranked
"""
