"""The split of labelled documents into learned and held-out ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """True where crc32 of the id as text is divisible by ``folds``; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def draw(id_col: str = "doc_id", salt: str = "") -> Column:
    """A fixed pseudo-random order of ids, for bounded samples that reruns repeat."""
    return F.xxhash64(F.lit(salt), F.col(id_col))
