"""Global ordering without a single-partition sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.session import materialize

# monotonically_increasing_id keeps the row number in the low 33 bits.
_ROW_BITS = 33


def ranked(df: DataFrame, order: list[Column], label: str, id_col: str = "gid") -> DataFrame:
    """Add ``gid``, a 64-bit id increasing in ``order``; written once so ids stay fixed.

    Range partitioning samples the full sort key, so a corpus or parent holding a third
    of all rows is spread over many tasks.
    """
    sorted_df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(sorted_df.withColumn(id_col, F.monotonically_increasing_id()), label)


def with_ordinal(r: DataFrame, name: str, id_col: str = "gid") -> DataFrame:
    """Replace the id of a :func:`ranked` table by its dense 0-based position.

    Only one count per partition goes through a window; the rows themselves do not.
    """
    part = F.shiftright(id_col, _ROW_BITS)
    sizes = r.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.col(id_col).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    # offsets has one row per partition, so its size is bounded by the cluster, not the data
    return (
        r.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + local)
        .drop("_part", "_before", id_col)
    )


def prefix_sums(r: DataFrame, value: str, name: str, id_col: str = "gid") -> DataFrame:
    """Add to a :func:`ranked` table the sum of ``value`` over all earlier rows.

    Each range adds up its own rows; only one sum per range goes through a window of all.
    """
    ranged = r.withColumn("_part", F.shiftright(id_col, _ROW_BITS))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    # one row per range: bounded by the cluster, not the data
    offsets = F.broadcast(sums.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")))
    here = Window.partitionBy("_part").orderBy(id_col).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn(name, F.coalesce(F.sum(value).over(here), F.lit(0)))
    return within.join(offsets, "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")
