"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A word's symbols stand in a row; a tree over the ranks of its adjacent pairs holds in its root the lowest rank
and, among equals, the leftmost pair. Merging it changes at most three leaves, each updated in logarithmic time,
until no pair can be merged. The trees of all new words of a batch stand side by side in one array, so that a step
merges a pair in each of them. Words repeat, so each task remembers those it has encoded, in a bounded memory.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.llm.rows import table

TOKENIZER = "word_bpe_49k.json"
END = "</w>"
# Fixed value: how the vocabulary's public description splits a text into words.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
# The same for a text whose only letters beyond a to z are those of Latin-1, which is split several times faster.
_LETTERS = "a-zß-öø-ÿ"
PLAIN_TEXT = re.compile(rf"[\x00-\x7F{_LETTERS}]*")
PLAIN_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^ \t\n\x0B\f\r{_LETTERS}0-9]+")
NONE = 1 << 40
ROWS = 256
# Bytes that a task's memory of words may take, about, and what a word costs beside its own signs and ids.
REMEMBERED, ENTRY = 32_000_000, 200
# Nodes of the trees that are built side by side.
NODES = 1 << 20


def byte_symbols() -> list[str]:
    """The printable sign that stands for each byte: itself if printable, else the next free sign from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """ids of symbols, merges as (left, right) -> (rank, merged), and special tokens that are found in raw text."""

    ids: dict[str, int]
    merges: dict[tuple[int, int], tuple[int, int]]
    special: dict[str, int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        ids = data["model"]["vocab"]
        merges = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            merges.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
        return cls(ids, merges, {t["content"]: t["id"] for t in data["added_tokens"]})


class Merges:
    """The merges as arrays: keys of pairs in order with their ranks, and the merged symbol of every rank."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        self.symbols = 1 + max((max(*pair, merged) for pair, (_, merged) in merges.items()), default=0)
        keys = np.array([left * self.symbols + right for left, right in merges], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.array([rank for rank, _ in merges.values()], np.int64)[order], NONE)
        self.merged = np.zeros(1 + max((rank for rank, _ in merges.values()), default=0), np.int64)
        for rank, merged in merges.values():
            self.merged[rank] = merged

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it cannot be merged; symbols below zero are none."""
        wanted = left * self.symbols + right
        at = np.searchsorted(self.keys, wanted)
        fits = (self.keys[at] == wanted) & (left >= 0) & (right >= 0) & (left < self.symbols) & (right < self.symbols)
        return np.where(fits, self.ranks[at], NONE)


def merge_all(flat: np.ndarray, lengths: np.ndarray, merges: Merges) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Apply the merges to rows of symbols, lowest rank first and leftmost among equals.

    The rows follow each other in ``flat``. Yields some of them at a time: their numbers, the symbols that they became
    one row after the other, and how many each has. Rows of about the same length go together.
    """
    starts = np.cumsum(lengths) - lengths
    sizes = 1 << np.maximum(1, np.ceil(np.log2(np.maximum(lengths, 2)))).astype(np.int64)
    for size in np.unique(sizes).tolist():
        members = np.flatnonzero(sizes == size)
        step = max(1, NODES // (2 * size))
        for at in range(0, len(members), step):
            part = members[at : at + step]
            yield part, *_merged(flat, starts[part], lengths[part], size, merges)


def _merged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """``merge_all`` of rows of at most ``size`` symbols, a power of two."""
    count = len(starts)
    places = np.arange(size + 1)
    filled = places < lengths[:, None]
    symbols = np.where(filled, flat[np.minimum(starts[:, None] + places, len(flat) - 1)], -1)
    # Neighbours of each place; the place after the last holds no symbol.
    after = np.minimum(np.arange(1, size + 2), size) + np.zeros((count, 1), np.int64)
    before = np.arange(-1, size) + np.zeros((count, 1), np.int64)
    # Rank and place in one number: the lowest is the leftmost of the lowest rank. Leaf i is the pair from place i.
    worst = NONE * size
    tree = np.full((count, 2 * size), worst, np.int64)
    tree[:, size:] = merges.rank(symbols[:, :-1], symbols[:, 1:]) * size + np.arange(size)
    tree[:, size:][tree[:, size:] >= worst] = worst
    level = size
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    active = np.flatnonzero(tree[:, 1] < worst)
    while len(active):
        root = tree[active, 1]
        at = root % size
        gone = after[active, at]
        symbols[active, at] = merges.merged[root // size]
        symbols[active, gone] = -1
        follower, leader = after[active, gone], before[active, at]
        after[active, at] = follower
        before[active, follower] = at
        left = np.where(leader >= 0, symbols[active, leader], -1)
        here = symbols[active, at]
        for leaf, rank in (
            (gone, np.full(len(active), NONE)),
            (at, merges.rank(here, symbols[active, follower])),
            (leader, merges.rank(left, here)),
        ):
            rows_with = leaf >= 0
            tree_rows, node = (active, leaf + size) if rows_with.all() else (active[rows_with], leaf[rows_with] + size)
            known = rank if rows_with.all() else rank[rows_with]
            tree[tree_rows, node] = np.where(known < NONE, known * size + node - size, worst)
            for _ in range(size.bit_length() - 1):
                node = node >> 1
                tree[tree_rows, node] = np.minimum(tree[tree_rows, 2 * node], tree[tree_rows, 2 * node + 1])
        active = active[tree[active, 1] < worst]
    kept = symbols >= 0
    return symbols[kept], kept.sum(1)


class Encoder:
    """Encodes texts and remembers the ids of each word."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.merges = Merges(vocabulary.merges)
        # The symbol of each byte, and of each byte that ends a word.
        signs = byte_symbols()
        self.inner = np.array([vocabulary.ids[s] for s in signs], np.int64)
        self.last = np.array([vocabulary.ids[s + END] for s in signs], np.int64)
        special = "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))
        self.special = regex.compile(f"({special})") if special else None
        self.ids: dict[str, bytes] = {}
        self.size = 0

    def words(self, text: str) -> list[str]:
        """The words of a text: special tokens are cut out of the raw text; the rest is composed, lower-cased and split.

        A special token is marked by a leading blank, which no word has."""
        if self.special is None or not any(s in text for s in self.vocabulary.special):
            return self._plain(text)
        out = []
        for part in self.special.split(text):
            out += [" " + part] if part in self.vocabulary.special else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return PLAIN_WORD.findall(text) if PLAIN_TEXT.fullmatch(text) else WORD.findall(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as 32-bit numbers. Null and empty texts have none."""
        found = [self.words(t) if t else [] for t in texts]
        if self.size > REMEMBERED:
            self.ids, self.size = {}, 0
        new = set(chain.from_iterable(found)) - self.ids.keys()
        marked = [w for w in new if w[0] == " "]
        self.ids.update((w, np.array([self.vocabulary.special[w[1:]]], np.int32).tobytes()) for w in marked)
        new.difference_update(marked)
        if new:
            self._learn(list(new))
        return [b"".join(map(self.ids.__getitem__, words)) for words in found]

    def _learn(self, new: list[str]) -> None:
        raw = [w.encode("utf-8") for w in new]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        signs = np.frombuffer(b"".join(raw), np.uint8)
        flat = self.inner[signs]
        ends = np.cumsum(lengths) - 1
        flat[ends] = self.last[signs[ends]]
        for rows, merged, counts in merge_all(flat, lengths, self.merges):
            packed = merged.astype(np.int32).tobytes()
            upto = (4 * np.cumsum(counts)).tolist()
            self.ids.update(zip(map(new.__getitem__, rows.tolist()), map(packed.__getitem__, map(slice, [0, *upto], upto))))
            self.size += ENTRY * len(rows) + len(packed)
        self.size += 2 * len(signs)


class Decoder:
    """Names of ids in a row; what the vocabulary lacks has none."""

    def __init__(self, vocabulary: Vocabulary):
        known = {i: t for t, i in (vocabulary.ids | vocabulary.special).items()}
        self.names = [known.get(i) for i in range(1 + max(known, default=-1))]
        self.whole = None not in self.names

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by a blank, as a vocabulary without a decoder gives them."""
        if self.whole and (not ids or 0 <= min(ids) and max(ids) < len(self.names)):
            return " ".join(map(self.names.__getitem__, ids))
        shown = [self.names[i] for i in ids if i is not None and 0 <= i < len(self.names)]
        return " ".join(t for t in shown if t is not None)


def encode(docs: DataFrame, path: str, text: str = "text", decoded: str | None = None) -> DataFrame:
    """``docs`` with ``ids``, the token ids of each row's whole text, instead of its text.

    With ``decoded``, a column of that name holds the text that the ids decode to, from the same pass; it equals what
    ``decode`` gives. Null and empty texts have no ids and decode to an empty text. Every row is encoded on its own,
    repeated ones alike; other columns are passed through, and those named like the new ones are replaced. The
    vocabulary is read on the driver and broadcast; its size is that of the given file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    new = ["ids"] + ([decoded] if decoded else [])
    rest = [c for c in docs.columns if c not in (*new, text)]
    source = docs.select(*rest, F.col(text))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                packed = encoder.encode(batch.column(batch.num_columns - 1).to_pylist())
                ends = np.cumsum([0, *map(len, packed)]) // 4
                flat = np.frombuffer(b"".join(packed), np.int32)
                made = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]
                if decoded:
                    made.append(pa.array([decoder.decode(np.frombuffer(p, np.int32).tolist()) for p in packed], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*rest, *new])

    schema = T.StructType([docs.schema[c] for c in rest]).add("ids", T.ArrayType(T.IntegerType()))
    return source.mapInArrow(encoded, schema.add(decoded, T.StringType()) if decoded else schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``: the tokens of ``ids`` joined by a blank, as a vocabulary without a decoder
    gives them. No ids give an empty text; a null list counts as empty; ids that the vocabulary lacks are left out."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def texts(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(shared.value)
        for lists in columns:
            out = []
            for at in range(0, len(lists), ROWS):
                out += [decoder.decode([i for i in row or () if i is not None]) for row in lists.slice(at, ROWS).to_pylist()]
            yield pa.array(out, pa.string())

    decoded = F.arrow_udf(texts, "string", F.ArrowUDFType.SCALAR_ITER)
    return encoded.withColumn("decoded", decoded(F.col("ids")))


def public_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_path()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, path, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
