"""Ordered operators that stay parallel when one key holds a large share of the rows.

A plain ``Window.partitionBy(key)`` sorts a key's rows in one task. The operators
here split a key into buckets first, work inside the buckets, and carry one small
row per bucket across them. ``bucket`` must be a deterministic, order-preserving
function of the order columns (a week of a timestamp, a block of line numbers).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repohealth.session import cut_lineage


def week(ts: str) -> Column:
    return F.date_trunc("week", F.col(ts)).cast("date")


def block(number: str, size: int = 10_000) -> Column:
    return F.floor(F.col(number) / F.lit(size))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, by aggregation: map-side combined, no sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The row with the smallest ``order`` per key, by aggregation."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of every key. Spark cuts to n per key before the shuffle (WindowGroupLimit)."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def lag_over(df: DataFrame, keys: list[str], order: list[str], bucket: Column, values: dict[str, str]) -> DataFrame:
    """Previous row's values within a key; ``values`` maps a column to the name of its lagged copy."""
    marked = df.withColumn("_bucket", bucket)
    vals = F.struct(*values)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = marked.withColumn("_prev", F.lag(vals).over(inner))
    tails = marked.groupBy(*keys, "_bucket").agg(F.max_by(vals, F.struct(*order)).alias("_tail"))
    outer = Window.partitionBy(*keys).orderBy("_bucket")
    carry = tails.select(*keys, "_bucket", F.lag("_tail").over(outer).alias("_carry"))
    joined = local.join(carry, [*keys, "_bucket"], "left").withColumn("_prev", F.coalesce("_prev", "_carry"))
    return joined.select(*df.columns, *[F.col(f"_prev.{c}").alias(name) for c, name in values.items()])


def running_sum(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, name: str, inclusive: bool = True
) -> DataFrame:
    """Sum of ``value`` over the rows of a key up to (or strictly before) the current one."""
    marked = df.withColumn("_bucket", bucket).withColumn("_value", value)
    end = Window.currentRow if inclusive else -1
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = marked.withColumn("_local", F.coalesce(F.sum("_value").over(inner), F.lit(0)))
    sums = marked.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_total"))
    outer = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*keys, "_bucket", F.coalesce(F.sum("_total").over(outer), F.lit(0)).alias("_carry"))
    joined = local.join(carry, [*keys, "_bucket"])
    return joined.select(*df.columns, (F.col("_local") + F.col("_carry")).alias(name))


def last_seen(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, name: str
) -> DataFrame:
    """Latest non-NULL ``value`` at or before the current row of a key."""
    marked = df.withColumn("_bucket", bucket).withColumn("_value", value)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumn("_local", F.last("_value", ignorenulls=True).over(inner))
    tails = marked.groupBy(*keys, "_bucket").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_tail")
    )
    outer = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(*keys, "_bucket", F.last("_tail", ignorenulls=True).over(outer).alias("_carry"))
    joined = local.join(carry, [*keys, "_bucket"])
    return joined.select(*df.columns, F.coalesce("_local", "_carry").alias(name))


def with_position(df: DataFrame, keys: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """1-based position of every row within its key, for order columns without a natural bucket.

    Rows are range-partitioned by key and order, the ranges are frozen with a
    checkpoint (they come from sampling), and every range gets the count of the
    ranges before it. At most one carry row per key and range crosses the network.
    """
    ranged = cut_lineage(
        df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    )
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    counts = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = local.join(carry, [*keys, "_part"])
    return joined.select(*df.columns, (F.col("_local") + F.col("_before")).alias(name))


def percent_rank_over(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """percent_rank of ``value`` within a key, from the histogram of its values instead of a sort of its rows."""
    hist = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    below = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = hist.withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0)))
    totals = hist.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    scored = ranks.join(totals, keys).select(
        *keys, value, F.when(F.col("_all") > 1, F.col("_below") / (F.col("_all") - 1)).otherwise(F.lit(0.0)).alias(name)
    )
    return df.join(scored, [*keys, value])


def with_total(df: DataFrame, name: str = "total") -> DataFrame:
    """Number of rows of ``df`` on every row, through a scalar subquery instead of an unpartitioned window."""
    return df.withColumn(name, df.agg(F.count(F.lit(1))).scalar())
