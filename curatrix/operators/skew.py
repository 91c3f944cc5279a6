"""Shared forms that stay balanced when one key owns a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curatrix.session import settled


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows per key.

    ``row_number() <= k`` lets Spark cut every map task down to ``k`` rows per key before the shuffle, so a hot key
    sends at most ``k`` rows per task.
    """
    rn = rank or "_rn"
    out = df.withColumn(rn, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rn) <= k)
    return out if rank else out.drop(rn)


def in_ranges(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """``df`` cut into ranges of (keys, ts, tie), numbered in order in ``_range``.

    Ranges follow the rows, so a key, a day or an instant that owns many of them lies in many ranges; rows equal in all three stay
    together. The frame is written once: everything that reads it sees the same ranges, also after an executor is lost.
    """
    return settled(df.repartitionByRange(*keys, ts, tie).withColumn("_range", F.spark_partition_id()), "ranges")


def previous_in_order(df: DataFrame, keys: list[str], ts: str, tie: str, cols: list[str]) -> DataFrame:
    """``prev_<col>`` of the row before, per key in (ts, tie) order, without one task per key.

    A segmented scan: rows are ordered inside (key, range of rows); the last row of a range is carried over to the key's next range
    through a small table with one row per key and range.
    """
    ranged = in_ranges(df, keys, ts, tie)
    part = [*keys, "_range"]
    packed = F.struct(*cols)
    inner = ranged.withColumn("_prev", F.lag(packed).over(W.partitionBy(*part).orderBy(ts, tie)))
    last = ranged.groupBy(*part).agg(F.max_by(packed, F.struct(ts, tie)).alias("_last"))
    carry = last.withColumn("_carry", F.lag("_last").over(W.partitionBy(*keys).orderBy("_range"))).filter("_carry IS NOT NULL")
    carry = carry.select(*[F.col(c).alias(f"_on_{i}") for i, c in enumerate(part)], "_carry")
    same = [F.col(c).eqNullSafe(F.col(f"_on_{i}")) for i, c in enumerate(part)]
    out = inner.join(carry, same, "left").withColumn("_prev", F.coalesce("_prev", "_carry"))
    return out.select(*df.columns, *[F.col(f"_prev.{c}").alias(f"prev_{c}") for c in cols])


# A frame of keys with at most this many rows is a few megabytes and may be broadcast.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a materialised frame whose counted ``rows`` allow it; larger ones join by shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


# A task holds about this many rows of a frame that is spread by its rows.
TASK_ROWS = 500_000


def spread_by_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hashed by ``keys`` into as many parts as the counted rows need, so that what a task holds does not follow the input.

    For frames whose rows are distinct but for a few: they need no summing up before the shuffle, where a map of them would fill the task.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, df.count() // TASK_ROWS), *keys)


def hot_keys(df: DataFrame, keys: list[str], share: float = 0.01) -> DataFrame:
    """Keys that own at least ``share`` of the rows: never more than 1/share of them, so small whatever the data."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.filter(F.col("_n") >= total * share).select(*keys)


def salt(df: DataFrame, salts: int | Column) -> Column:
    """Salt from the row's own content, so a task that runs again sends every row to the same place."""
    plain = [f.name for f in df.schema.fields if not f.dataType.simpleString().startswith(("map", "variant"))]
    return F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int")


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None, salts: int = 32) -> DataFrame:
    """Equi join that spreads the rows of the keys in ``hot`` over ``salts`` tasks; each side is read once.

    ``hot`` holds the key columns of a bounded number of keys, as ``hot_keys`` or knowledge of the data gives them; they are
    broadcast. Without it the join is a plain one, whose skewed partitions Spark splits at run time.

    Rows of a hot key get one of ``salts`` numbers on the left, and the right rows of that key are repeated for each number, so
    every left row meets every right row of its key exactly once. The join is by sort and merge: a broadcast of the right side would
    leave the left rows of a hot key where they lie.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salting does not keep a {how} join whole")
    if hot is None:
        return left.join(right, keys, how)
    hot = F.broadcast(hot.select(*keys).distinct().withColumn("_hot", F.lit(True)))
    own = F.when(F.col("_hot"), salt(left, salts)).otherwise(0)
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted = left.join(hot, keys, "left").withColumn("_number", own).drop("_hot")
    repeated = right.join(hot, keys, "left").withColumn("_number", F.explode(every)).drop("_hot")
    return salted.join(repeated.hint("merge"), [*keys, "_number"], how).drop("_number")


def left_join_parts(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None = None) -> DataFrame:
    """Left join whose right side may have hot keys; a plain one unless ``hot`` names them.

    A left join cannot split a skewed right side, an inner join can; so the rows of hot keys take an inner join, and those
    of them without any match an anti join.
    """
    if hot is None:
        return left.join(right, keys, "left")
    few = F.broadcast(hot.select(*keys).distinct())
    extra = [f for f in right.schema.fields if f.name not in keys]
    warm, cold = left.join(few, keys, "left_semi"), left.join(few, keys, "left_anti")
    rest = warm.join(right.select(*keys).join(few, keys, "left_semi"), keys, "left_anti").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in extra])
    out = cold.join(right, keys, "left")
    return out.unionByName(warm.join(right, keys)).unionByName(rest)
