"""What the operators share: how a document table is read, and how a derived table is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# The ASCII characters that separate words, all but digits and letters.
SEPARATORS = "".join(chr(c) for c in [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_per_id(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with one row for each id; other columns, whatever their names, are left behind.

    A null text is empty. Where rows repeat an id, the one whose text sorts first is the document. A missing
    id is an id like any other, so all rows without one count as one document.
    """
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if slim.groupBy("doc_id").count().where("count > 1").isEmpty():
        return slim
    return slim.groupBy("doc_id").agg(F.min("text").alias("text"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else. Meant for short strings such as hosts."""
    return F.translate(text, UPPER, UPPER.lower())


def folded_words(text: Column) -> Column:
    """Array of the words of a text, to be compared with ASCII words: runs of digits, letters and non-ASCII.

    Letters beyond ASCII are lower-cased too, which no ASCII word can see: the one sign that would become an
    ASCII letter, the Kelvin sign, is replaced before. Word boundaries are those of the text.
    """
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u212b")))
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def split_words(text: str | None) -> list[bytes]:
    """The same words in a Python task, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


_WORD_BYTES = bytes(
    ord(chr(c).lower()) if chr(c) in UPPER else 0x20 if chr(c) in SEPARATORS else c for c in range(256)
)
