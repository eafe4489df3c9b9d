"""Near duplicates: MinHash bands, sequential Bayesian verification, exact verification.

Every distinct set of word shingles (pairs unless asked otherwise) gets a MinHash signature. Sets that share a band are candidates; their
signatures are compared batch by batch, and a pair is given up as soon as the posterior chance that its
similarity reaches the threshold falls under ``MISS``. Survivors are verified on their full sets.

Exact copies are one class from the start. In a band bucket every member is compared with one pivot only, the one that
meets most others over all bands. Where the links found so far leave a bucket in several components, its members meet across them at rare shared shingles, which
finds every similar pair and hardly any other, however large the bucket is.

A pair at similarity s shares no band with probability ``(1 - s^5)^32``: 3e-6 at 0.8, 7e-9 at 0.85.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm.graph import components
from tillcast.llm.hashing import WordHashes, blank_words, mixed, shingle_hashes
from tillcast.llm.rows import one_per_id, table
from tillcast.session import materialize

BANDS, DEPTH = 32, 5
HASHES = BANDS * DEPTH
PERCENT = 80
MISS = 1e-6
BATCH = 32
ROWS = 256
_RNG = np.random.default_rng(11)
_MULTIPLY = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_BAND = np.arange(BANDS, dtype=np.uint64)


def least_matches(compared: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Fewest equal hashes among ``compared`` with which a pair goes on.

    With a uniform prior the posterior of the similarity after m of n equal hashes is Beta(m + 1, n - m + 1),
    and its mass from t on is the chance of at most m successes in n + 1 trials of chance t.
    """
    t, mass = percent / 100, 0.0
    for m in range(compared + 1):
        mass += comb(compared + 1, m) * t**m * (1 - t) ** (compared + 1 - m)
        if mass >= miss:
            return m
    return compared


def shingles(text: str | None, width: int = 2) -> frozenset:
    """The exact set: runs of ``width`` words, or the whole sequence if there are fewer."""
    words = blank_words(text)
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*(words[i:] for i in range(width))))


def _minima(hashes: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(low, (hashes[at : at + 512, None] * _MULTIPLY + _ADD).min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, width: int = 2) -> DataFrame:
    """(doc_id, n, cls, sig, bands): set size, digest of the set, 16 bits of each minimum, hash of each band."""

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch, out = whole.iloc[at : at + ROWS], []
                for text in batch["text"]:
                    words = blank_words(text)
                    if not words:
                        out.append((0, b"", b"", []))
                        continue
                    hashes = np.unique(shingle_hashes(known.of(words), width))
                    low = _minima(hashes)
                    rows = low.reshape(BANDS, DEPTH).astype(np.uint64)
                    keys = _BAND
                    for i in range(DEPTH):
                        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
                    digest = blake2b(hashes.tobytes(), digest_size=16).digest()
                    out.append((len(hashes), digest, low.astype(np.uint16).tobytes(), keys.view(np.int64).tolist()))
                frame = pd.DataFrame(out, columns=["n", "cls", "sig", "bands"])
                frame.insert(0, "doc_id", batch["doc_id"].to_numpy())
                yield frame

    return docs.mapInPandas(signed, "doc_id long, n long, cls binary, sig binary, bands array<long>")


def likely(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures keep the posterior over the miss probability in every batch."""
    steps = list(range(BATCH, HASHES + 1, BATCH))
    need = np.array([least_matches(n) for n in steps])

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                left, right = (np.frombuffer(b"".join(b[c]), np.uint16).reshape(-1, HASHES) for c in ("sa", "sb"))
                alive = np.arange(len(b))
                found = np.zeros(len(b), np.int32)
                for step, least in zip(steps, need):
                    part = slice(step - BATCH, step)
                    found[alive] += (left[alive, part] == right[alive, part]).sum(1)
                    alive = alive[found[alive] >= least]
                yield b.iloc[alive][["a", "b"]]

    one = sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa"))
    two = sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInPandas(kept, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, width: int = 2, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, mine = None, frozenset()
        for b in batches:
            good = []
            for text_a, text_b in zip(b["ta"], b["tb"]):
                if text_b != last:
                    last, mine = text_b, shingles(text_b, width)
                other = shingles(text_a, width)
                shared = len(mine & other)
                good.append(shared > 0 and 100 * shared >= percent * (len(mine) + len(other) - shared))
            yield b.loc[good, ["a", "b"]]

    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInPandas(kept, "a long, b long")


def across_components(open_sets: DataFrame, texts: DataFrame, width: int = 2, percent: int = PERCENT) -> DataFrame:
    """(a, b) of ``open_sets`` (rep, component): every similar pair across components, and few others.

    A partner in another component shares only shingles that some other component has. So with the others first and the
    shared ones by the pairs they would make, a pair meets at a shingle from which on both sets still have the overlap
    that the similarity asks for. A set with more shingles of its own than that leaves is compared with nothing.
    """

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                b = whole.iloc[at : at + ROWS]
                sets = [np.unique(shingle_hashes(known.of(blank_words(x)), width)).view(np.int64) for x in b["text"]]
                yield pd.DataFrame({"rep": b["rep"], "component": b["component"], "sh": sets})

    own = texts.select(F.col("doc_id").alias("rep"), "text").join(open_sets, "rep")
    sets = materialize(own.mapInPandas(hashed, "rep long, component long, sh array<long>"), "open-sets")
    placed = sets.select("rep", "component", F.size("sh").alias("n"), F.explode("sh").alias("sh"))
    held = placed.groupBy("sh", "component").agg(F.count("*").alias("c"))
    met = held.groupBy("sh").agg((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("pairs")).where("pairs > 0")
    listed = placed.join(met, "sh").groupBy("rep", "component", "n").agg(
        F.array_sort(F.collect_list(F.struct("pairs", "sh"))).alias("rising")
    )
    # What is left of a set from its i-th shared shingle on; those of its own come before all of them.
    least = F.ceil(F.col("n") * percent / 100)
    ahead = listed.select("rep", "component", "n", F.posexplode("rising").alias("i", "s"), (F.size("rising") - F.col("i")).alias("left"))
    ahead = ahead.where(F.col("left") >= least).select("rep", "component", "n", "left", F.col("s.sh").alias("sh"))
    ahead = materialize(ahead, "prefixes")
    one, two = (
        ahead.select("sh", F.col("rep").alias(x), *(F.col(c).alias(c[0] + x) for c in ("n", "component", "left"))) for x in "ab"
    )
    # An overlap of at least this share of both sizes is what the similarity asks for.
    enough = (100 + percent) * F.least("la", "lb") >= percent * (F.col("na") + F.col("nb"))
    return _right_size(one.join(two, "sh").where("a < b and ca <> cb").where(enough), percent).distinct()


def classes(docs: DataFrame, width: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document; see ``near_duplicates`` for the edge cases."""
    own = one_per_id(docs)
    sigs = materialize(signatures(own, width), "signatures")
    reps = sigs.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"))
    lead = materialize(
        sigs.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "n", "sig", "bands"),
        "representatives",
    )
    banded = lead.select(F.col("doc_id").alias("rep"), "n", F.explode("bands").alias("band"))
    full = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    met = materialize(banded.join(full, "band"), "met")
    # The pivot is the set that meets most others over all bands: of near copies the one nearest to all, so that one
    # star links most of a group and its buckets share their pivot. It comes with the size of its set.
    crowd = met.groupBy("rep").agg(F.sum("size").alias("crowd"))
    first_of = F.max(F.struct("crowd", -F.col("rep"), F.col("rep").alias("pivot"), F.col("n").alias("pivot_n"))).alias("first")
    pivots = met.join(crowd, "rep").groupBy("band").agg(first_of).select("band", "first.pivot", "first.pivot_n")
    members = materialize(met.drop("size").join(pivots, "band"), "buckets")
    involved = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = materialize(own.join(involved, "doc_id", "left_semi"), "texts")

    star = members.where("rep <> pivot").select(
        F.col("pivot").alias("a"), F.col("rep").alias("b"), F.col("pivot_n").alias("na"), F.col("n").alias("nb")
    )
    star = _right_size(star).distinct()
    star_links = materialize(verified(likely(star, lead), texts, width), "star-links")
    first = components(star_links).select(F.col("node").alias("rep"), "component")

    placed = members.join(first, "rep", "left").select(
        "band", "rep", "n", "pivot", F.coalesce("component", "rep").alias("component")
    )
    mixed_up = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    open_rows = placed.where("rep <> pivot").join(mixed_up.select("band"), "band", "left_semi")
    across = across_components(open_rows.select("rep", "component").distinct(), texts, width)
    rest = verified(likely(across, lead), texts, width)
    found = components(star_links.unionByName(rest)).select(F.col("node").alias("rep"), "component")

    return (
        sigs.select("doc_id", "n", "cls")
        .join(reps, "cls", "left")
        .join(found, "rep", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
    )


def _right_size(pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Sets whose sizes alone rule the similarity out are no pair."""
    return pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per document, the smallest id of each component is kept.

    Null, empty and blank texts have an empty set and are linked with nothing. Rows repeating a doc_id, or
    without one, are treated as in ``rows.one_per_id``; a document without an id is a copy of a document with
    the same set or stands alone. Other columns are ignored.
    """
    return classes(docs, width).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
with word as (
  select doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
shingled as (
  select doc_id, list_distinct(case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else w end) as s
  from word),
item as (select doc_id, len(s) as n, unnest(s) as sh from shingled),
common as (
  select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as c
  from item a join item b on a.sh = b.sh and a.doc_id <> b.doc_id
    and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by all),
link as (select a, b from common where 100 * c >= 80 * (na + nb - c)),
reach as (
  with recursive r(node, seen) as (
    select doc_id, doc_id from documents union select r.node, link.b from r join link on link.a = r.seen)
  select node, min(seen) as component_id from r group by node)
select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept
from shingled join reach on node = doc_id
"""
