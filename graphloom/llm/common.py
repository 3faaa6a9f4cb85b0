"""What the corpus operators share: tables, the shared folder, folds, bounded samples and text slices."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import discard, shared_folder, store  # noqa: F401

#: Bytes of text that a Python operator takes out of an Arrow batch at a time.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds


def bounded_sample(df: DataFrame, key: str, most: int, seed: int = 17) -> DataFrame:
    """About `most` rows at most, chosen by a seeded hash of the key, which should be unique: the same rows at every run.

    A count sets the hash threshold: rows stay in the tasks that read them, and their number is `most` but for a few
    hundredths.
    """
    rows = df.count()
    if rows <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(2**31)) < int(most / rows * 2**31))


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """(first row, list of bytes or None) over an Arrow string column, about `most` bytes at a time."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    first, held, rows = 0, 0, []
    for at, value in enumerate(texts):
        data = value.as_py()
        rows.append(data)
        held += len(data or b"")
        if held >= most:
            yield first, rows
            first, held, rows = at + 1, 0, []
    if rows:
        yield first, rows


#: White space of the word rule `[^\x20\x09-\x0D]+`; bytes.split() parts words by the same six characters.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
