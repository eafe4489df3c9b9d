"""Importance resampling against brute force: whole strings hashed one by one, plain sorting."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tillcast.llm import resampling

LONG = " ".join(f"Word{i % 313}" for i in range(5_000))
TEXTS = [(i, " ".join(f"w{(i * j) % 41}" for j in range(15 + i % 12))) for i in range(60)]
TEXTS += [(61, None), (62, ""), (63, "-- !"), (64, "one"), (65, "A\x7fb É_É"), (66, LONG), (None, LONG[:400]), (3, LONG[:300])]
TEXTS += [(70, LONG[:500])] * 25
ITEMS = [(1, " ".join(f"w{i}" for i in range(41))), (2, None), (3, "w1 w2 w3")]


def features(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(texts, items, share=5):
    counts = [Counter(crc32(f.encode()) % 10_000 for _, t in rows for f in features(t)[1]) for rows in (texts, items)]
    s_all, t_all = (sum(c.values()) for c in counts)
    rows = []
    for i, t in texts:
        words, found = features(t)
        weight = 0
        for f in found:
            s, t_ = (c[crc32(f.encode()) % 10_000] for c in counts)
            weight += math.floor(1000 * math.log((t_ + 1) * (s_all + 10_000) / ((s + 1) * (t_all + 10_000))))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(words), len(found), weight, score, None])
    long = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for at, r in enumerate(long[: share * len(long) // 100], 1):
        r[5] = at
    return sorted(map(tuple, rows), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return df.withColumns({"weight": F.lit("x"), "rank": F.lit(9), "n_words": F.lit(0.5)}).repartition(6)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("share", [5, 60, 100])
def test_resampling_equals_brute_force(docs, items, share):
    got = resampling.importance(docs, items, share=share)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(TEXTS, ITEMS, share)


def test_empty_tables(docs, items):
    assert resampling.importance(docs.where("false"), items).count() == 0
    got = resampling.importance(docs, items.where("false"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(TEXTS, [])


def test_seeds_chain_over_chunks(monkeypatch):
    words = [f"w{i}".encode() for i in range(50)]
    whole = Counter(resampling.buckets(words).tolist())
    monkeypatch.setattr(resampling, "CHUNK", 7)
    assert Counter(resampling.buckets(words).tolist()) == whole
    assert whole == Counter(crc32(f.encode()) % 10_000 for f in features(" ".join(f"w{i}" for i in range(50)))[1])


def test_query_over_the_sample(spark):
    folder = "/root/testdata/sf0.001"
    tables = [
        [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(key, "text").collect()]
        for name, key in (("documents", "doc_id"), ("benchmark", "item_id"))
    ]
    got = resampling.op12_resampling(spark, folder).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=str) == brute(*tables)
