"""Benchmark decontamination with a distributed positional inverted index.

Training tokens are counted first, for the terms of the benchmark. Each window of a benchmark item is then looked
up from its rarest terms: their postings (term, document, positions) are shifted by the term's place in the item,
and where the shifted lists of both rarest terms of a window meet, the text is compared word by word. Whole windows are
exact phrase matches; windows with a few words exchanged are proximity matches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillcast.llm.hashing import Remembered
from tillcast.llm.rows import one_per_id, split_words, table
from tillcast.session import materialize

WINDOW = 10
RAREST = 2
NEAR = 8
# Terms that are no benchmark term are left out of the index early by a bit map of fixed size; it may let others
# through, which the join then drops.
MAP_BITS = 1 << 22
# Up to so many words the tasks get the benchmark's words themselves and ask a dict; a larger benchmark goes by the bit map.
VOCABULARY = 200_000
ROWS = 256


def _term(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - 2**63


class _Wanted(Remembered):
    """Word -> term hash where the bit map has it, else None."""

    def __init__(self, bits: bytes):
        super().__init__()
        self.bits = bits

    def __missing__(self, word: bytes) -> int | None:
        self.make_room(word)
        term = _term(word)
        at = term % MAP_BITS
        value = self[word] = term if self.bits[at >> 3] >> (at & 7) & 1 else None
        return value


def _bit_map(terms: DataFrame) -> bytes:
    """Bits of the terms present: the driver gets at most MAP_BITS numbers, whatever the benchmark's size."""
    bits = bytearray(MAP_BITS // 8)
    for (at,) in terms.select(F.pmod("term", F.lit(MAP_BITS)).cast("int")).distinct().toLocalIterator():
        bits[at >> 3] |= 1 << (at & 7)
    return bytes(bits)


def _lookup(terms: DataFrame) -> Callable[[], Callable[[bytes], int | None]]:
    """What a task calls for its function from a word to its term, None for words that are not in ``terms`` (word, term)."""
    spark = terms.sparkSession
    words = terms.select("word", "term").distinct().limit(VOCABULARY + 1).collect()
    if len(words) <= VOCABULARY:
        known = spark.sparkContext.broadcast({bytes(r.word): r.term for r in words})
        return lambda: known.value.get
    bits = spark.sparkContext.broadcast(_bit_map(terms))
    return lambda: _Wanted(bits.value).__getitem__


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, n, pos, word, term) for every word of every benchmark item."""

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (i, len(words), pos, w, _term(w))
                for i, words in zip(b["doc_id"], map(split_words, b["text"]))
                for pos, w in enumerate(words)
            ]
            yield pd.DataFrame(rows, columns=["item_id", "n", "pos", "word", "term"])

    return items.mapInPandas(placed, "item_id long, n int, pos int, word binary, term long")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often each of ``terms`` (word, term) occurs in ``docs``; counted per task, then summed."""
    lookup = _lookup(terms)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = lookup()
        for b in batches:
            found: Counter = Counter()
            for text in b["text"]:
                found.update(map(known, split_words(text)))
            found.pop(None, None)
            yield pd.DataFrame({"term": list(found), "n": list(found.values())}, dtype="int64")

    seen = docs.select("text").mapInPandas(counted, "term long, n long")
    return terms.select("term").distinct().join(seen.groupBy("term").agg(F.sum("n").alias("n")), "term", "left").fillna(0)


def anchors(placed: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, term, item_id, pos, needed): the places of the rarest terms of every window of every item.

    A window is WINDOW words, or the whole of a shorter item. ``needed`` is how many of its places a match must
    hit, one only for items of a single word.
    """
    windows = F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - WINDOW + 1), F.least(F.col("pos"), F.greatest(F.lit(0), F.col("n") - WINDOW))))
    rank = Window.partitionBy("item_id", "start").orderBy("seen", "term", "pos")
    return (
        placed.join(counts.withColumnRenamed("n", "seen"), "term")
        .withColumn("start", windows)
        .withColumn("nth", F.row_number().over(rank))
        .where(F.col("nth") <= RAREST)
        .select("word", "term", "item_id", "pos", F.least(F.col("n"), F.lit(RAREST)).alias("needed"))
        .distinct()
    )


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, positions): the positional index of ``docs`` for ``terms`` (word, term); by the bit map a few more."""
    lookup = _lookup(terms)

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = lookup()
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                b, rows = whole.iloc[at : at + ROWS], []
                for doc_id, text in zip(b["doc_id"].tolist(), b["text"]):
                    places: dict[int, list[int]] = {}
                    for pos, term in enumerate(map(known, split_words(text))):
                        if term is not None:
                            places.setdefault(term, []).append(pos)
                    rows += [(term, None if doc_id != doc_id else doc_id, found) for term, found in places.items()]
                yield pd.DataFrame(rows, columns=["term", "doc_id", "positions"]).astype({"doc_id": "Int64"})

    return docs.mapInPandas(indexed, "term long, doc_id long, positions array<int>")


def candidates(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, item_id, shift) where the shifted postings of a window's rarest terms meet."""
    met = postings(docs, places.select("word", "term").distinct()).join(places.drop("word"), "term")
    hits = met.select("doc_id", "item_id", "needed", F.explode(F.transform("positions", lambda p: p - F.col("pos"))).alias("shift"))
    return hits.groupBy("doc_id", "item_id", "needed", "shift").agg(F.count("*").alias("n")).where("n >= needed").drop("n", "needed")


def _runs(equal: np.ndarray, size: int) -> np.ndarray:
    """Marks the places of ``equal`` in some window of ``size`` equal words."""
    summed = np.concatenate([[0], np.cumsum(equal)])
    full = np.flatnonzero(summed[size:] - summed[:-size] == size)
    marks = np.zeros(len(equal) + 1, np.int32)
    np.add.at(marks, full, 1)
    np.add.at(marks, full + size, -1)
    return np.cumsum(marks[:-1]) > 0


def decontaminate(docs: DataFrame, items: DataFrame, item_key: str = "item_id") -> DataFrame:
    """Per document: n_words, hit (places of the words inside exact matches), items (ids with an exact match), near_items.

    Null and empty texts have no words; items without words match nothing. Rows repeating a doc_id or item_id,
    or without one, are treated as in ``rows.one_per_id``; items without an id count as hits but are not named.
    Other columns are ignored. ``near_items`` are items with a window of which at least NEAR of WINDOW words, the
    rarest two among them, stand at the right distance.
    """
    own, tests = one_per_id(docs), one_per_id(items, item_key)
    placed = materialize(item_terms(tests), "item-terms")
    counts = materialize(term_counts(own, placed), "term-counts")
    places = materialize(anchors(placed, counts), "anchors")
    found = candidates(own, places)
    asked = tests.select(F.col("doc_id").alias("test"), F.col("text").alias("item_text"))
    told = found.join(asked, F.col("item_id").eqNullSafe(F.col("test")))
    per_doc = told.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("item_id", "shift", "item_text")).alias("found"))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text, tried in zip(b["doc_id"].tolist(), b["text"], b["found"]):
                words = split_words(text)
                hit, exact, near = np.zeros(len(words), bool), set(), set()
                for match in tried if tried is not None else ():
                    test, shift = split_words(match["item_text"]), match["shift"]
                    lo, hi = max(0, -shift), min(len(test), len(words) - shift)
                    equal = np.array([test[i] == words[i + shift] for i in range(lo, hi)], bool)
                    size = min(WINDOW, len(test))
                    if len(equal) < size:
                        continue
                    inside = _runs(equal, size)
                    if inside.any():
                        hit[lo + shift : hi + shift] |= inside
                        exact.add(match["item_id"])
                    elif size == WINDOW and np.convolve(equal, np.ones(size), "valid").max() >= NEAR:
                        near.add(match["item_id"])
                names = [sorted(int(i) for i in s if i is not None and i == i) for s in (exact, near - exact)]
                rows.append((None if doc_id != doc_id else doc_id, len(words), np.flatnonzero(hit).tolist(), names[0], names[1], len(exact)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "hit", "items", "near_items", "n_items"]).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_words long, hit array<long>, items array<long>, near_items array<long>, n_items long"
    joined = own.join(per_doc, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "text", "found")
    return joined.mapInPandas(judged, schema)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    named = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), "n_items",
        F.sha2(named, 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"),
    )


_WORDS = r"""list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""
SQL = f"""
with doc as (select doc_id, {_WORDS} as w from documents),
item as (select item_id, {_WORDS} as w from benchmark),
test as (
  select item_id, least({WINDOW}, len(w)) as size, array_to_string(w[i + 1:i + least({WINDOW}, len(w))], ' ') as phrase
  from item, unnest(range(len(w) - least({WINDOW}, len(w)) + 1)) as u(i) where len(w) > 0),
gram as (
  select doc_id, size, i as pos, array_to_string(w[i + 1:i + size], ' ') as phrase
  from doc, (select distinct size from test) s, unnest(range(greatest(len(w) - size + 1, 0))) as u(i)),
met as (select distinct doc_id, item_id, pos, gram.size as size from gram join test on gram.phrase = test.phrase and gram.size = test.size),
hit as (select doc_id, count(distinct pos + k) as n_hit from met, unnest(range(size)) as u(k) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct doc_id, item_id::varchar as item_id from met) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join hit using (doc_id) left join named using (doc_id)
"""
