"""Rank helpers that keep every task's share of the data bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.session import materialize


SALTS = 64


def bucket_salt(col: str) -> Column:
    """A salt that is the same for all rows of a bucket of ``col`` (the bucket's number modulo ``SALTS``).

    That holds where the number of buckets is a multiple of ``SALTS``, as ``whole_buckets`` makes it.
    """
    return F.pmod(F.hash(col), F.lit(SALTS))


def whole_buckets(spark: SparkSession, wanted: int) -> int:
    """At least one bucket a slot and at least ``wanted``; many are a multiple of ``SALTS``."""
    n = max(spark.sparkContext.defaultParallelism, wanted)
    n = -(-n // SALTS) * SALTS if n > SALTS else n
    return min(n, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))


def top_per_group(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    n: int,
    rank_col: str = "rank",
    salt_on: list[str] | Column | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """First ``n`` rows per group, ranked from 1.

    Spark's group limit prunes each map partition to ``n`` rows per group. For
    a large ``n`` a hot group would still send tasks x n rows to one reducer,
    so ``salt_on`` first keeps ``n`` per (group, salt): at most salts x n rows
    are left for the last step. The result is the same either way. A column
    given as ``salt_on`` is the salt itself: one that follows the partitions of
    ``df`` leaves each of them ``n`` rows per group instead of salts x n.
    """
    if salt_on is not None:
        salt = salt_on if isinstance(salt_on, Column) else F.pmod(F.xxhash64(*salt_on), F.lit(salts))
        salted = df.withColumn("_salt", salt)
        w = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            salted.withColumn("_local", F.row_number().over(w))
            .filter(F.col("_local") <= n)
            .drop("_local", "_salt")
        )
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def hash_order(*cols: Column | str, seed: int) -> Column:
    """A reproducible shuffle key: hex md5 of the columns and the seed."""
    return F.md5(F.concat_ws("|", *[F.col(c) if isinstance(c, str) else c for c in cols], F.lit(str(seed))))


def global_position(
    df: DataFrame, key: Column, tie: list[str], out: str = "pos", total: str = "total", digits: int = 4
) -> DataFrame:
    """0-based position in the order of the hex hash ``key`` over all rows, and their number.

    No global window: rows are numbered inside their leading-hex-digit bucket
    and shifted by the number of rows in earlier buckets. The offset window
    runs over at most 16**digits counted rows, whatever the table size.
    """
    keyed = df.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, digits))
    counts = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(total),
    )
    inside = Window.partitionBy("_bucket").orderBy("_key", *tie)
    return (
        keyed.withColumn("_local", F.row_number().over(inside))
        .join(offsets, "_bucket")
        .withColumn(out, (F.col("_offset") + F.col("_local") - 1).cast("bigint"))
        .drop("_key", "_bucket", "_local", "_offset")
    )


def hash_edge(df: DataFrame, key: Column, tie: str, position: int | None = None, ratio: float = 1.0, digits: int = 4):
    """(key, tie) of the row at a position of the hash order, None past the end.

    The position is given or is floor(rows * ratio). One aggregation counts the
    leading-digit buckets (at most 16**digits numbers come to the driver); only
    the bucket that holds the position is ordered. No row is shuffled for it
    unless it is in that bucket.
    """
    keyed = df.select(F.col(tie).alias("_tie"), key.alias("_key")).withColumn("_bucket", F.substring("_key", 1, digits))
    counts = sorted((r["_bucket"], r["count"]) for r in keyed.groupBy("_bucket").count().collect())
    left = int(sum(c for _, c in counts) * ratio) if position is None else position
    for bucket, count in counts:
        if left < count:
            inside = Window.partitionBy("_bucket").orderBy("_key", "_tie")
            row = (
                keyed.filter(F.col("_bucket") == bucket)
                .withColumn("_n", F.row_number().over(inside))
                .filter(F.col("_n") == left + 1)
                .first()
            )
            return row["_key"], row["_tie"]
        left -= count
    return None


def value_at(df: DataFrame, col: str, position: int):
    """The ``position``-th smallest value (0-based) of a unique column, None past the end.

    Range-partitioned ids are stored with their partition number; the counts
    per partition lead to the one that holds the position, and only that one is
    numbered. Nothing but the value itself reaches the driver.
    """
    ranged = df.select(col).repartitionByRange(col).withColumn("_part", F.spark_partition_id())
    placed = materialize(ranged, "ranged")
    left = position
    for row in placed.groupBy("_part").count().orderBy("_part").collect():
        if left < row["count"]:
            inside = Window.partitionBy("_part").orderBy(col)
            one = placed.filter(F.col("_part") == row["_part"]).withColumn("_n", F.row_number().over(inside))
            return one.filter(F.col("_n") == left + 1).first()[col]
        left -= row["count"]
    return None


def previous_in_group(
    df: DataFrame, group: str, position: str, value: str, out: str, span: int = 4096
) -> DataFrame:
    """``lag(value)`` in position order per group, safe for one giant group.

    Positions are cut into spans; the lag runs inside (group, span) and only
    one row per span takes part in the second, per-group window.
    """
    cut = df.withColumn("_span", F.floor(F.col(position) / span))
    last = cut.groupBy(group, "_span").agg(F.max_by(value, position).alias("_last"))
    by_span = Window.partitionBy(group).orderBy("_span")
    carried = last.select(group, "_span", F.lag("_last").over(by_span).alias("_carried"))
    inside = Window.partitionBy(group, "_span").orderBy(position)
    return (
        cut.withColumn("_prev", F.lag(value).over(inside))
        .withColumn("_first", F.row_number().over(inside) == 1)
        .join(carried, [group, "_span"])
        .withColumn(out, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_prev")))
        .drop("_span", "_prev", "_first", "_carried")
    )
