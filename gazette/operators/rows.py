"""Row numbering and ranking that no single task has to do alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint


def assign_ids(df: DataFrame, order: list, start: Column | int = 0, out: str = "news_id") -> DataFrame:
    """Consecutive ids in a total order, beginning at ``start + 1``.

    The rows are range-partitioned and sorted, then written to the checkpoint
    folder so that partition contents are fixed even if executors are lost. The
    row's place inside its partition needs no shuffle; only one count per
    partition is summed up and broadcast: as many rows as there are partitions.
    ``order`` must end in a unique key.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    fixed = reliable_checkpoint(placed).withColumn("_place", F.monotonically_increasing_id())
    fixed = fixed.withColumns(
        {
            "_part": F.shiftright("_place", 33),
            "_index": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    counts = fixed.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    first = start if isinstance(start, Column) else F.lit(start)
    return (
        fixed.join(F.broadcast(offsets), "_part")
        .withColumn(out, (first + F.col("_offset") + F.col("_index") + 1).cast("bigint"))
        .drop("_place", "_part", "_index", "_rows", "_offset")
    )


def salts_of(df: DataFrame) -> int:
    """Number of slices a hot group is cut into: as many as shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Rows per group up to which every task hands on its own best rows alone; Spark limits ranks before a shuffle up to this number.
DEEP = 1000


def top_per_group(rows: DataFrame, groups: list[str], order: list, most: int, key: str, out: str = "position") -> DataFrame:
    """The first ``most`` rows of each group with their place, from 1.

    The limit stands on the rank itself, so every task keeps only its own best
    ``most`` rows of a group before anything is shuffled. Where ``most`` is large
    (deep pages), a group is ranked in slices first, salted by ``key``, so that no
    task meets the best rows of all tasks at once.
    """
    if most > DEEP:
        sliced = rows.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(salts_of(rows))))
        inner = Window.partitionBy(*groups, "_slice").orderBy(*order)
        rows = sliced.withColumn("_rank", F.row_number().over(inner)).where(F.col("_rank") <= most).drop("_slice", "_rank")
    outer = Window.partitionBy(*groups).orderBy(*order)
    placed = rows.withColumn("_rank", F.row_number().over(outer)).where(F.col("_rank") <= most)
    return placed.withColumn(out, F.col("_rank").cast("bigint")).drop("_rank")
