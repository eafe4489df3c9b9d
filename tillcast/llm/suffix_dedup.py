"""Removal of repeated byte strings: threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every string of LENGTH bytes has an anchor, the GRAM bytes in it with the smallest hash, so equal strings have equal
anchors. Neighbouring strings with the same anchor form a fragment. Fragments are dealt by anchor without their bytes;
identical ones are settled by their hashes, and one that shares neither side of its anchor with another is done. The
others are cut into the strings reaching far to the left of the anchor and those reaching far to the right, each part
dealt by the bytes that all its strings contain. Parts of a group go into a Burrows-Wheeler transform; a group of
too many parts is halved in the same way again, so no group grows with the data. Starting from the empty string,
intervals of suffixes are extended backwards breadth-first, which yields the lengths of common prefixes in increasing
order; it stops at LENGTH, and suffixes that were not told apart by then repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillcast.llm.hashing import mixed
from tillcast.llm.rows import one_per_id, table
from tillcast.session import materialize

LENGTH = 100
GRAM = 16
SPAN = LENGTH - GRAM + 1
CHUNK = 1 << 22
FLUSH = 8 << 20
# Bytes of parts in one transform, and parts of one group up to which they go into one; larger groups are halved.
BLOCK_BYTES = 192 << 10
TOGETHER = 256
# Rows of one anchor that a task holds to see which of them have company; beyond, all of them count as having it.
HELD = 1 << 16
# Over so many tasks the members of a group are spread while its size is looked up.
SPREAD = 16
# A string starts at most so far before its anchor; it starts MIDDLE + 1 or more before it, or ends as far behind as
# REACH - MIDDLE at least.
REACH = SPAN - 1
MIDDLE = REACH // 2
NO_ID = (1 << 63) - 1
_U = np.uint64


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place."""
    x = raw.astype(_U)
    for step in (1, 2, 4):
        x = x[:-step] | x[step:] << _U(8 * step)
    return mixed(x[:-8] * _U(0x9E3779B97F4A7C15) ^ mixed(x[8:]))


def _side(grams: np.ndarray, at: np.ndarray, offsets: tuple[int, ...], there: np.ndarray) -> np.ndarray:
    """32 bits of hash over the grams at these offsets from each anchor, never 0; 0 where the fragment ends before."""
    at = np.where(there, at, MIDDLE + 1)
    value = np.zeros(len(at), _U)
    for offset in offsets:
        value = mixed(value * _U(0x9E3779B97F4A7C15) + grams[np.minimum(at + offset, len(grams) - 1)])
    return np.where(there, value >> _U(32) | _U(1), _U(0))


def fragments(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, hash of both sides, start, end and the anchor's place of each fragment; together they cover all strings of LENGTH bytes.

    The anchor of a string depends on its bytes only: the smallest hash, the leftmost of equals. Long texts are cut
    into overlapping chunks; a fragment cut by a chunk's end is only shorter. The sides are the anchor with MIDDLE + 1
    bytes before it (upper half) and with REACH - MIDDLE bytes behind it: strings can be equal only where one of them is.
    """
    parts = []
    whole = np.frombuffer(raw, np.uint8)
    for base in range(0, max(0, len(raw) - LENGTH + 1), CHUNK):
        grams = _gram_hashes(whole[base : base + CHUNK + LENGTH - 1])
        n = len(grams)
        keys = (grams & ~_U((1 << 23) - 1)) | np.arange(n, dtype=_U)
        padded = np.append(keys, np.full(-n % SPAN, np.iinfo(_U).max, _U)).reshape(-1, SPAN)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        count = n - SPAN + 1
        at = (np.minimum(behind[:count], ahead[SPAN - 1 : SPAN - 1 + count]) & _U((1 << 23) - 1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        end = np.append(first[1:], count) - 1 + LENGTH
        at = at[first]
        left = _side(grams, at, (-MIDDLE - 1, -MIDDLE - 1 + GRAM, -MIDDLE - 1 + 2 * GRAM, 0), at - MIDDLE - 1 >= first)
        right = _side(grams, at, (0, GRAM, 2 * GRAM, REACH - MIDDLE), at + GRAM + REACH - MIDDLE <= end)
        parts.append((grams[at], left << _U(32) | right, first + base, end + base, at + base))
    if not parts:
        return np.zeros(0, _U), np.zeros(0, _U), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(p) for p in zip(*parts))


def union(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each document, overlapping and touching ones joined."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    number = np.cumsum(np.append(0, doc[1:] != doc[:-1]))
    reach = int(end.max()) + 2
    far = np.maximum.accumulate(end + number * reach)
    new = np.append(True, start[1:] + number[1:] * reach > far[:-1])
    firsts = np.flatnonzero(new)
    ends = far[np.append(firsts[1:], len(doc)) - 1] - number[firsts] * reach
    return doc[firsts], start[firsts], ends


def _covered(doc, start, end) -> pd.DataFrame:
    """Covered intervals as rows of the fragment table: a negative place marks them."""
    doc, start, end = union(np.asarray(doc, np.int64), np.asarray(start, np.int64), np.asarray(end, np.int64))
    spread = mixed(doc.view(_U) ^ start.view(_U)).view(np.int64)
    return pd.DataFrame({"anchor": spread, "body": end, "sides": 0, "doc": doc, "place": -start - 1})


_TABLE = "anchor long, body long, sides long, doc long, place long"


def fragment_table(docs: DataFrame) -> DataFrame:
    """(anchor, body, sides, doc, place): fragments with the hashes of their bytes, and what is already known as covered.

    ``place`` is start, length and anchor's offset, the last two being under 256. Identical fragments of a task's texts are one row,
    so a passage on a third of all documents leaves each task a few times only.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            for doc, text in zip(b["doc"], b["text"]):
                raw = text.encode("utf-8", "surrogatepass")
                anchor, sides, start, end, at = fragments(raw)
                body = np.fromiter((xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(start.tolist(), end.tolist())), _U, len(start))
                held.append((anchor, body, sides, np.full(len(start), doc, np.int64), start, end, at - start))
                size += len(raw)
                if size > FLUSH:
                    yield from _first_of_each(held)
                    held, size = [], 0
        if held:
            yield from _first_of_each(held)

    keyed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text").where(F.octet_length("text") >= LENGTH)
    return keyed.mapInPandas(cut, _TABLE)


def _other(*columns: np.ndarray) -> np.ndarray:
    """Rows that differ from the row before them."""
    change = np.zeros(max(0, len(columns[0]) - 1), bool)
    for x in columns:
        change |= x[1:] != x[:-1]
    return np.append(True, change)[: len(columns[0])]


def _first_of_each(held: list[tuple]) -> Iterator[pd.DataFrame]:
    anchor, body, sides, doc, start, end, off = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((start, doc, body, anchor))
    anchor, body, sides, doc, start, end, off = (x[order] for x in (anchor, body, sides, doc, start, end, off))
    new = _other(anchor, body, sides)
    yield pd.DataFrame({
        "anchor": anchor[new].view(np.int64), "body": body[new].view(np.int64), "sides": sides[new].view(np.int64),
        "doc": doc[new], "place": (start[new] << 16) + ((end - start)[new] << 8) + off[new],
    })
    yield _covered(doc[~new], start[~new], end[~new])


def _has_company(anchor: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Rows that share a side with another row of their anchor."""
    found = np.zeros(len(anchor), bool)
    for side in (sides >> 32 & 0xFFFFFFFF, sides & 0xFFFFFFFF):
        key = mixed(anchor.view(_U) ^ mixed(side.view(_U)))
        _, which, many = np.unique(key, return_inverse=True, return_counts=True)
        found |= (side != 0) & (many[which] > 1)
    return found


def settle_identical(rows: DataFrame) -> DataFrame:
    """(kind, doc, start, end, off): 1 covered, 2 a fragment that may share strings with another.

    Rows are dealt by anchor and read in sorted order, a batch at a time. Of identical fragments the earliest stays, the
    others are covered. The open group of an anchor is carried over up to HELD rows; rows of a larger one pass
    on as they come.
    """
    dealt = rows.repartition("anchor").sortWithinPartitions("anchor", "body", "doc", "place")

    def judged(frame: pd.DataFrame, whole: bool) -> pd.DataFrame:
        """Rows after the first, which is the one before them; groups are complete if ``whole``."""
        anchor, body, sides, doc, place = (frame[c].to_numpy() for c in ("anchor", "body", "sides", "doc", "place"))
        new, seen = _other(anchor, body, sides), place >= 0
        kind = np.where(new, 0, 1)
        fresh = np.flatnonzero(new & seen)
        kind[fresh] = np.where(_has_company(anchor[fresh], sides[fresh]), 2, 0) if whole else 2
        start, end = place >> 16, (place >> 16) + (place >> 8 & 255)
        out = pd.DataFrame({"kind": kind, "doc": doc, "start": start, "end": end, "off": place & 255})
        return out[(kind > 0) & seen]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry: list[pd.DataFrame] = []
        large = None  # last row passed on of an anchor with more than HELD rows
        for b in batches:
            known = b[b["place"] < 0]
            if len(known):
                yield pd.DataFrame({"kind": 1, "doc": known["doc"], "start": -known["place"] - 1, "end": known["body"], "off": 0})
            b = b[b["place"] >= 0]
            if large is not None and len(b):
                same = (b["anchor"] == large["anchor"].iloc[0]).to_numpy()
                if same.any():
                    # The row before is marked as no fragment, so that it is only compared with.
                    yield judged(pd.concat([large.assign(place=-1), b[same]]), False)
                    large, b = b[same].tail(1), b[~same]
            if not len(b):
                continue
            large, last = None, b["anchor"].iloc[-1]
            frame = pd.concat([*carry, b]) if carry else b
            if carry and frame["anchor"].iloc[0] == last:
                carry.append(b)
            else:
                ends = (frame["anchor"] == last).to_numpy()
                yield judged(frame[~ends], True)
                carry = [frame[ends]]
            if sum(map(len, carry)) > HELD:
                frame = pd.concat(carry)
                yield judged(frame, False)
                carry, large = [], frame.tail(1)
        if carry:
            yield judged(pd.concat(carry), True)

    return dealt.mapInPandas(stream, "kind int, doc long, start long, end long, off long")


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by at least their first ``depth`` symbols (0 to 16), by doubling the compared length."""
    n = len(symbols)
    x = symbols.astype(np.int64)
    key, h = x.copy(), 1
    padded = np.append(x, np.zeros(12, np.int64))
    for i in range(1, 12):
        key = key * 17 + padded[i : i + n]
    h = 12
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1])) + 1
        if h >= depth or rank[order[-1]] == n:
            return order
        key = rank * (n + 1) + np.append(rank[h:], np.zeros(min(h, n), np.int64))[:n]
        h *= 2


def repeated_strings(blocks: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, block and start of every string of ``length`` bytes that occurs at least twice in ``blocks``.

    Bytes are two symbols each, a block ends in a separator. ``lcp[i]`` stays -1 where two neighbouring suffixes agree
    in all symbols of ``length`` bytes: it is set when the interval of a string ends between them, and strings are taken
    by increasing length, each interval extended backwards by all 16 symbols at once. An interval whose end is set
    already needs no extension.
    """
    sizes = np.array([len(b) for b in blocks])
    raw = np.frombuffer(b"".join(blocks), np.uint8)
    block = np.repeat(np.arange(len(blocks)), 2 * sizes + 1)
    ends = np.cumsum(2 * sizes + 1)
    symbols = np.zeros(ends[-1], np.uint8)
    inner = np.ones(len(symbols), bool)
    inner[ends - 1] = False
    symbols[inner] = np.stack([raw >> 4, raw & 15], 1).ravel() + 1
    depth, n = 2 * length, len(symbols)
    order = suffix_order(symbols, depth)
    before = symbols[order - 1]  # the transform
    seen = np.zeros((n + 1, 17), np.int32)
    for c in range(1, 17):
        np.cumsum(before == c, out=seen[1:, c])
    lower = np.searchsorted(np.sort(symbols), np.arange(17))
    lcp = np.full(n + 1, -1, np.int16)
    lcp[0] = lcp[n] = 0
    lo, hi = np.array([0]), np.array([n])
    for common in range(depth):
        left, right = (seen[lo] + lower).ravel(), (seen[hi] + lower).ravel()
        some = np.flatnonzero(right > left)
        left, right = left[some], right[some]
        fresh = (lcp[right] < 0) | ((common == 0) & (right == n))
        left, right = left[fresh], right[fresh]
        if not len(left):
            break
        lcp[right] = common
        lo, hi = left, right
    start = order - (ends[block] - 2 * sizes[block] - 1)[order]
    owner = block[order]
    usable = (start % 2 == 0) & (start + depth <= 2 * sizes[owner])
    group = np.cumsum(lcp[:n] >= 0)
    group, owner, start = group[usable], owner[usable], start[usable] // 2
    many = np.bincount(group, minlength=1)[group] > 1
    return group[many], owner[many], start[many]


def later_in_group(group, doc, start, end) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All but the earliest member of each group."""
    order = np.lexsort((start, doc, group))
    group, doc, start, end = group[order], doc[order], start[order], end[order]
    later = np.append(False, group[1:] == group[:-1])[: len(group)]
    return doc[later], start[later], end[later]


def narrowed(lo: int, hi: int, start: int, off: int, piece: bytes) -> Iterator[tuple]:
    """(key, lo, hi, start, off, piece) of both halves of a part.

    A part has the strings that start ``lo`` to ``hi`` bytes before the anchor, which is at ``off`` in ``piece``. The key
    is a hash of the bytes that all strings of the half contain; it only deals, bytes decide.
    """
    middle = (lo + hi) // 2
    for a, b in ((lo, middle), (middle + 1, hi)):
        most, least = min(b, off), max(a, REACH - (len(piece) - off - GRAM))
        if least <= most:
            half = piece[off - most : off + GRAM + REACH - least]
            key = xxhash.xxh3_64_intdigest(half[most - a : most + GRAM + REACH - b], a << 8 | b) - 2**63
            yield key, a, b, start + off - most, most, half


_PARTS = "kind int, key long, lo int, hi int, doc long, start long, end long, off long, piece binary"


def _halved(parts: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """Halves (kind 2) of parts (lo, hi, doc, start, off, piece), and what identical ones among them cover (kind 1)."""

    def out(first: dict, later: list) -> pd.DataFrame:
        rows = [(2, key, lo, hi, doc, start, start + len(piece), off, piece) for (key, lo, hi, off, piece), (doc, start) in first.items()]
        if later:
            doc, start, end = (np.array(x, np.int64) for x in zip(*later))
            rows += [(1, 0, 0, 0, d, s, e, 0, b"") for d, s, e in zip(*(x.tolist() for x in union(doc, start, end)))]
        return pd.DataFrame(rows, columns=["kind", "key", "lo", "hi", "doc", "start", "end", "off", "piece"])

    first, later = {}, []
    for lo, hi, doc, start, off, piece in parts:
        for key, a, b, at, reach, half in narrowed(lo, hi, start, off, piece):
            name, mine = (key, a, b, reach, half), (doc, at)
            other = first.get(name)
            first[name] = mine if other is None else min(mine, other)
            if other is not None:
                doc_, at_ = max(mine, other)
                later.append((doc_, at_, at_ + len(half)))
        if len(first) + len(later) > 10000:
            yield out(first, later)
            first, later = {}, []
    if first:
        yield out(first, later)


def expand_parts(parts: DataFrame) -> DataFrame:
    """(doc, start, end): strings of ``parts`` (key, doc, start, piece) that also start earlier in a part of the same key."""
    dealt = parts.select("key", "doc", "start", "piece").repartition("key").sortWithinPartitions("key")

    def solved(held: list[tuple]) -> pd.DataFrame:
        _, doc, start, piece = zip(*held)
        group, owner, at = repeated_strings(list(piece))
        first = np.array(start, np.int64)[owner] + at
        found = union(*later_in_group(group, np.array(doc, np.int64)[owner], first, first + LENGTH))
        return pd.DataFrame(dict(zip(("doc", "start", "end"), found)))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        rows = (row for b in batches for row in zip(*(b[c].tolist() for c in b.columns)))
        for _, group in groupby(rows, key=lambda row: row[0]):
            for row in group:
                held.append(row)
                size += len(row[-1])
            if size > BLOCK_BYTES:
                yield solved(held)
                held, size = [], 0
        if held:
            yield solved(held)

    return dealt.mapInPandas(stream, "doc long, start long, end long")


def settle_parts(halves: DataFrame, level: int, together: int) -> tuple[list[DataFrame], DataFrame | None]:
    """What is covered by the parts of one level, and the parts of groups with more than ``together``, if any.

    Of parts with the same bytes the earliest stays. Group sizes come from counts combined before the shuffle and are
    looked up by (key, share of the group), so a very large group is never in one task.
    """
    earliest = Window.partitionBy("kind", "key", "lo", "hi", "off", "piece").orderBy("doc", "start")
    alike = halves.where("kind = 2").withColumn("nth", F.row_number().over(earliest))
    told = materialize(alike.unionByName(halves.where("kind = 1").withColumn("nth", F.lit(2))), f"parts-{level}")
    firsts = told.where("nth = 1").withColumn("share", F.pmod(F.xxhash64("doc", "start"), F.lit(SPREAD)).cast("int"))
    sizes = firsts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    grouped = materialize(firsts.join(sizes, ["key", "share"]).drop("share", "nth"), f"groups-{level}")
    large = grouped.where(F.col("n") > together)
    covered = [told.where("nth > 1").select("doc", "start", "end"), expand_parts(grouped.where(F.col("n") <= together))]
    return covered, None if large.isEmpty() else large


def repeated_spans(docs: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(doc, start, end) of bytes covered by strings that also start earlier; intervals may overlap.

    ``docs`` has one row per doc_id and no null text; ``doc`` is the id, or NO_ID for the row without one. A part is
    halved seven times at most: then it is one string.
    """
    settled = materialize(settle_identical(fragment_table(docs)), "fragments")
    wanted = settled.where("kind = 2").groupBy("doc").agg(F.collect_list(F.struct("start", "end", "off")).alias("wanted"))
    keyed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text")

    def sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def parts():
            for b in batches:
                for doc, text, wants in zip(b["doc"], b["text"], b["wanted"]):
                    raw = text.encode("utf-8", "surrogatepass")
                    for w in wants:
                        yield 0, REACH, doc, w["start"], w["off"], raw[w["start"] : w["end"]]

        yield from _halved(parts())

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ("lo", "hi", "doc", "start", "off", "piece")
        yield from _halved(row for b in batches for row in zip(*(b[c].tolist() for c in columns)))

    covered = [settled.where("kind = 1").select("doc", "start", "end")]
    halves, level = keyed.join(wanted, "doc").mapInPandas(sliced, _PARTS), 1
    while halves is not None:
        known, large = settle_parts(halves, level, together)
        covered += known
        halves = large.mapInPandas(again, _PARTS) if large is not None and level < REACH.bit_length() else None
        level += 1
    spans = covered[0]
    for more in covered[1:]:
        spans = spans.unionByName(more)
    return spans


def dedup_strings(docs: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): removed byte spans (start, end) and the remaining bytes of each document.

    A byte is removed when a string of LENGTH bytes that covers it also starts earlier, in a document with a smaller id
    or before it in the same one; all is judged on the input. Null, empty and short texts keep all their bytes. Rows
    repeating a doc_id, or without one, are treated as in ``rows.one_per_id``, and a document without id comes after
    all others; other columns are ignored. ``together`` bounds the parts of a group in one transform, not the result.
    """
    own = one_per_id(docs)
    spans = repeated_spans(own, together).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    keyed = own.withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID)))

    def cleared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                rows = []
                for doc, text, found in zip(*(b[c].iloc[at : at + 256] for c in ("doc", "text", "found"))):
                    raw, spans, kept, last = text.encode("utf-8", "surrogatepass"), [], [], 0
                    if found is not None and len(found):
                        start, end = (np.array([s[c] for s in found], np.int64) for c in ("start", "end"))
                        _, start, end = union(np.zeros(len(start), np.int64), start, end)
                        spans = [{"start": s, "end": e} for s, e in zip(start.tolist(), end.tolist())]
                    for span in spans:
                        kept.append(raw[last : span["start"]])
                        last = span["end"]
                    rows.append((doc, len(raw), spans, b"".join([*kept, raw[last:]])))
                yield pd.DataFrame(rows, columns=["doc", "n_bytes", "spans", "kept"])

    joined = keyed.join(spans, "doc", "left").select("doc", "text", "found")
    out = joined.mapInPandas(cleared, "doc long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "n_bytes", "spans", "kept")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_strings(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
