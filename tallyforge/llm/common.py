"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.session import scratch_path

#: The ASCII white space ``[\x20\x09-\x0D]`` of the line and token rules.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder: cuts lineage, fixes row ids and gives the optimizer true sizes."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(name: str) -> Column:
    """The text column as a string; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def carried(docs: DataFrame, **beside: Column) -> DataFrame:
    """All columns of ``docs`` as the one column ``whole``, and others beside it: no name of theirs can meet one of the table's. ``select("whole.*")`` gives the rows back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), *[c.alias(name) for name, c in beside.items()])


def row_hash(*names: str) -> Column:
    """A hash of the row's content. With the id it names a row: rows equal in both behave alike, so sharing a name is harmless."""
    return F.xxhash64(*[F.col(n) for n in names])


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else. Pure ASCII takes the fast built-in; other text is translated."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def crc_mod(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus
