"""Labels read once each, in tasks of even size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tallyforge.session import ensure_checkpoint_dir


def stored(df: DataFrame) -> DataFrame:
    """The rows in the checkpoint folder, so that what was read doesn't grow into the expressions that use it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def by_label(rows: DataFrame, text_col: str, read: Callable[[DataFrame], DataFrame], how: str = "inner") -> DataFrame:
    """Rows with the columns that ``read`` adds to a table of their different labels (one column, ``text_col``; no null).

    Labels are dealt to all tasks before they are read, as a table of few files would be read by few tasks, and a label that
    many rows have is read once. The join is never a broadcast: stored labels are far larger than their files tell.
    """
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    labels = rows.select(text_col).where(f"`{text_col}` IS NOT NULL").distinct().repartition(tasks, text_col)
    told = stored(read(labels))
    return rows.join(told.hint("merge"), text_col, how).select(*rows.columns, *(c for c in told.columns if c != text_col))
