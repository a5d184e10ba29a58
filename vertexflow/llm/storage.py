"""Where intermediate results go, and how rows keep their own columns on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import new_path, shared_folder, stored

__all__ = ["new_path", "own_row", "row_column", "shared_folder", "small_batches", "stored"]


def row_column(docs: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """All columns of `docs` in one struct, so that none clashes with what an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in without])


def own_row(rows: DataFrame, docs: DataFrame, row: str, new: dict[str, Column] | None = None) -> DataFrame:
    """The columns of `docs` that row_column packed in `row`, each under its own name, and the new ones in place of or after
    them. The new ones are made in a step of their own, where no name of a caller's column is about."""
    new = new or {}
    if new:
        rows = rows.select(F.col(row).alias("row"), F.struct(*[c.alias(n) for n, c in new.items()]).alias("new"))
        row = "row"
    names = [*docs.columns, *(n for n in new if n not in docs.columns)]
    return rows.select(*[(F.col("new") if c in new else F.col(row)).getField(c).alias(c) for c in names])


#: Rows that Python workers get at once; a batch of whole texts, and what is computed from it, then stays within some MB.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the session's Arrow batches to `rows` rows, for operators that hand whole texts to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
