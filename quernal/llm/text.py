"""Column expressions shared by the operators: what a word is, and how rows are packed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separator of words.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """All words of a non-null text, in order; an empty array where it has none."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def n_words_of(text: Column) -> Column:
    """How many words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from; a null id is not held out, nor learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def packed(df: DataFrame) -> Column:
    """All columns of a row in one struct, so that no name of theirs can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def once(value: Column) -> Column:
    """The same value, but not to be computed anew further up or down.

    The optimizer pushes a filter below the projection that makes its column and writes the column's expression into
    it, lambdas included, so that one look at a text becomes one for each element.  It leaves expressions alone that
    aren't deterministic.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)
