"""SimHash fingerprints of documents, and the search for close ones in block tables.

Each distinct pair of neighbouring words votes with the root of its count on the signed bits of its hash; the
signs of the sums are the fingerprint. For the search a fingerprint is cut into six blocks with a table each.
The radius and one more bit are dealt to the blocks: two fingerprints within a Hamming radius of 21 differ by at most
three bits in one of four blocks or by at most two in one of the others, so looking up those values finds all.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillcast.llm.hashing import WordHashes, blank_words, mixed, shingle_hashes
from tillcast.llm.rows import one_per_id, table
from tillcast.session import default_parallelism, materialize

BITS = 128
# The largest distance of near copies (five-word shingles alike to 0.8 or more) measured on the sample tables.
RADIUS = 21
# (half, lowest bit, bits) of each block; the key of a block has its number above KEY_BITS.
BLOCKS = [(0, 0, 21), (0, 21, 21), (1, 0, 21), (1, 21, 21), (0, 42, 22), (1, 42, 22)]
KEY_BITS = 22
QUERY_EVERY = 100


def simhash(text: str | None, known: WordHashes) -> str:
    """Fingerprint as BITS / 4 hexadecimal digits; a text without words has the fingerprint of no votes."""
    words = blank_words(text)
    if not words:
        return "0" * (BITS // 4)
    terms, counts = np.unique(shingle_hashes(known.of(words)), return_counts=True)
    votes = np.zeros(BITS, np.float64)
    weights = np.sqrt(counts)
    for at in range(0, len(terms), 4096):
        part = terms[at : at + 4096]
        wide = np.stack([part, mixed(part + np.uint64(0x9E3779B97F4A7C15))], 1)
        bits = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8).reshape(len(part), BITS // 8), axis=1)
        w = weights[at : at + 4096]
        votes += 2 * (w @ bits) - w.sum()
    return np.packbits(votes > 0).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal bits."""
    return 1 - (int(a, 16) ^ int(b, 16)).bit_count() / BITS


def edited_text(text: str, following: str) -> str:
    """The last third of the text replaced by as many characters from the start of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_ROW = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_COLUMNS = [c.split()[0] for c in _ROW.split(", ")]


def _row(doc_id, text: str, mine: str, following: str, theirs: str, known: WordHashes) -> tuple:
    edited = edited_text(text, following)
    changed = simhash(edited, known)
    digest = sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, mine, changed, likeness(mine, changed), likeness(mine, theirs)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its text edited with the next document's, and their likeness.

    The next document is the one with the next smaller id, the largest after the smallest; a document without
    id comes last. Texts are dealt into ranges of ids once and compared along each range; only the first and
    last text of a range are paired with their neighbours in a second step. Null and empty texts have no
    characters and the fingerprint of no votes; a single document follows itself. Rows repeating a doc_id are
    treated as in ``rows.one_per_id``; other columns are ignored.
    """
    order = F.col("doc_id").desc_nulls_last()
    ranged = one_per_id(docs).repartitionByRange(order).sortWithinPartitions(order)
    edge = f"{_ROW}, part int, is_first boolean, is_last boolean, text string"

    def along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, part, previous, first = WordHashes(), TaskContext.get().partitionId(), None, True
        for whole in batches:
            ids = whole["doc_id"].tolist()
            rows = []
            for doc_id, text in zip(ids, whole["text"]):
                mine = simhash(text, known)
                if previous is None:
                    head = (*[None] * len(_COLUMNS), part, True, False, text)
                    rows.append((None if doc_id != doc_id else doc_id, *head[1:]))
                else:
                    rows.append((*_row(*previous, text, mine, known), part, False, False, None))
                previous = (None if doc_id != doc_id else doc_id, text, mine)
                if len(rows) == 256:
                    yield _typed(rows)
                    rows = []
            yield _typed(rows)
        if previous is not None:
            yield _typed([(previous[0], *[None] * (len(_COLUMNS) - 1), part, False, True, previous[1])])

    done = materialize(ranged.mapInPandas(along, edge), "fingerprints")
    heads = done.where("is_first").select("part", F.col("text").alias("next_text"))
    # One row per range: whatever the size of the table, there are as many as partitions.
    order_of_parts = Window.orderBy("part")
    lowest = F.first("part").over(order_of_parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    parts = heads.select("part", F.coalesce(F.lead("part").over(order_of_parts), lowest).alias("next_part"))
    tails = done.where("is_last").select("doc_id", "text", "part").join(parts, "part")
    ends = tails.join(heads.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "text", "next_text")

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for b in batches:
            yield _typed([
                _row(None if i != i else i, t, simhash(t, known), n, simhash(n, known), known)
                for i, t, n in zip(b["doc_id"].tolist(), b["text"], b["next_text"])
            ], _COLUMNS)

    inner = done.where("not is_first and not is_last").select(*_COLUMNS)
    return inner.unionByName(ends.mapInPandas(across, _ROW))


def _typed(rows: list[tuple], columns=(*_COLUMNS, "part", "is_first", "is_last", "text")) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=list(columns))
    return frame.astype({"doc_id": "Int64", "n_chars": "Int64"})


def _halves(prefix: str) -> list[Column]:
    half = BITS // 8
    return [
        F.conv(F.substring("fingerprint", 1 + i * half, half), 16, -10).cast("long").alias(f"{prefix}{i}") for i in (0, 1)
    ]


def _allowances(radius: int) -> list[int]:
    """Bits that may differ in each block: one more in every block would be more than the radius; -1 leaves a block out."""
    each, more = divmod(radius + 1, len(BLOCKS))
    return [each - 1 + (i < more) for i in range(len(BLOCKS))]


def _masks(width: int, most: int) -> np.ndarray:
    """All numbers of ``width`` bits of which at most ``most`` are set."""
    chosen = [c for n in range(most + 1) for c in combinations(range(width), n)]
    return np.array([sum(1 << x for x in c) for c in chosen], np.int64)


def _close(prints: DataFrame, queries: DataFrame, radius: int) -> DataFrame:
    """(q0, q1, p0, p1, docs): each distinct query and print within the radius once, and the rows with that print.

    A print is filed once a block; a query is looked up under every block value within the block's allowance.
    A pair that meets in several blocks counts in the first one.
    """
    allowed = _allowances(radius)
    used = [(t, half, at, width, most) for t, ((half, at, width), most) in enumerate(zip(BLOCKS, allowed)) if most >= 0]
    masks = {t: _masks(width, most) for t, _, _, width, most in used}

    def looked_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q in zip(batch["q0"].tolist(), batch["q1"].tolist()):
                keys = np.concatenate([
                    t << KEY_BITS | ((q[half] >> at & (1 << width) - 1) ^ masks[t]) for t, half, at, width, _ in used
                ])
                yield pd.DataFrame({"q0": q[0], "q1": q[1], "key": keys})

    keys = [
        F.shiftrightunsigned(f"p{half}", at).bitwiseAND(F.lit((1 << width) - 1)) + F.lit(t << KEY_BITS)
        for t, half, at, width, _ in used
    ]
    # Dealt by number: there are few queries, but each makes thousands of rows.
    tasks = default_parallelism(prints.sparkSession)
    asked = queries.select("fingerprint").distinct().select(*_halves("q")).repartition(tasks, "q0", "q1")
    counted = prints.groupBy("fingerprint").agg(F.count("*").alias("docs")).select(*_halves("p"), "docs")
    filed = counted.select("p0", "p1", "docs", F.explode(F.array(*[k.cast("long") for k in keys])).alias("key"))
    differ = [F.col(f"q{i}").bitwiseXOR(F.col(f"p{i}")) for i in (0, 1)]
    first = F.lit(None).cast("long")
    for t, half, at, width, most in reversed(used):
        block = F.shiftrightunsigned(differ[half], at).bitwiseAND(F.lit((1 << width) - 1))
        first = F.when(F.bit_count(block) <= most, F.lit(t)).otherwise(first)
    near = (F.bit_count(differ[0]) + F.bit_count(differ[1]) <= radius) & (first == F.shiftright("key", KEY_BITS))
    # Spark takes the looked-up values for as few as the queries and would broadcast them.
    looked = asked.mapInPandas(looked_up, "q0 long, q1 long, key long").hint("merge")
    met = looked.join(filed, "key")
    return met.where(near).select("q0", "q1", "p0", "p1", "docs")


def _joined(a: str, b: str) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(c), BITS // 8, "0") for c in (a, b)]))


def close_fingerprints(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query, fingerprint) of all distinct fingerprints of ``prints`` within ``radius`` of those of ``queries``.

    Both have a column fingerprint; equal ones are one entry, so groups of copies stay small. All prints are
    filed, none is capped. The default radius is that of near copies, see RADIUS.
    """
    return _close(prints, queries, radius).select(_joined("q0", "q1").alias("query"), _joined("p0", "p1").alias("fingerprint"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_near`` is set for documents whose id is divisible by 100: how many other documents lie in the radius."""
    prints = materialize(fingerprints(table(spark, sf_dir, "documents")), "prints")
    asked = F.coalesce(F.col("doc_id") % QUERY_EVERY == 0, F.lit(False))
    near = _close(prints, prints.where(asked), RADIUS)
    counts = near.groupBy("q0", "q1").agg((F.sum("docs") - 1).alias("n_near"))
    counts = counts.select(_joined("q0", "q1").alias("query"), "n_near")
    answers = prints.where(asked).join(counts, F.col("fingerprint") == F.col("query")).select(*_COLUMNS, "n_near")
    others = prints.where(~asked).select(*_COLUMNS, F.lit(None).cast("long").alias("n_near"))
    return answers.unionByName(others)
