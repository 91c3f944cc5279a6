"""Column profiles and rule suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.operators.skew import first_per_key
from curatrix.session import settled


def value_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column_name, value, n) for every non-null value, counted on the map side before the shuffle."""
    cols = cols or df.columns
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols])
    long = df.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("value").isNotNull())
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(counts: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most frequent values per column, ties by value; ``counts`` comes from ``value_counts``."""
    return first_per_key(counts, ["column_name"], [F.col("n").desc(), F.col("value")], k, "rank")


def frequent_values(df: DataFrame, cols: list[str] | None = None, k: int = 3, buckets: int = 8192) -> DataFrame:
    """(column_name, value, n, rank): the rows of ``top_values(value_counts(df, cols), k)``, without a shuffle of every cell.

    Cells are counted per hash bucket first: at most ``buckets`` rows per column and task travel. The values of a column's ``k`` fullest
    buckets are counted exactly; their k-th count is a floor, and a bucket that holds fewer cells has no value among the first ``k``.
    Only cells of the buckets that reach the floor are counted by value. A column without frequent values (nearly all its values
    differ) keeps all its buckets and costs what ``value_counts`` costs.
    """
    cols = cols or df.columns
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols])
    cells = df.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("value").isNotNull())
    cells = cells.withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(buckets)).cast("int"))
    totals = settled(cells.groupBy("column_name", "bucket").agg(F.count(F.lit(1)).alias("cells")), "buckets")

    def counted(wanted: DataFrame) -> DataFrame:
        kept = cells.join(F.broadcast(wanted.select("column_name", "bucket")), ["column_name", "bucket"], "left_semi")  # at most len(cols) * buckets rows
        return top_values(kept.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")), k)

    probe = counted(first_per_key(totals, ["column_name"], [F.col("cells").desc(), F.col("bucket")], k))
    floor = settled(probe.groupBy("column_name").agg(F.min("n").alias("floor")), "floors")
    return counted(totals.join(F.broadcast(floor), "column_name").filter("cells >= floor"))


def profile_columns(df: DataFrame, cols: list[str] | None = None, exact: bool = False) -> DataFrame:
    """Rows, nulls, null percentage and distinct count per column, in one aggregation with HyperLogLog estimates.

    ``exact=True`` counts distinct values by their hashes, balanced for any number of columns.
    """
    cols = cols or df.columns
    stats = [F.count(F.lit(1)).alias("_rows")] + [F.count(F.col(c)).alias(f"_nn_{i}") for i, c in enumerate(cols)]
    if not exact:
        stats += [F.approx_count_distinct(c).alias(f"_d_{i}") for i, c in enumerate(cols)]
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col("_rows").alias("row_count"),
            (F.col("_rows") - F.col(f"_nn_{i}")).alias("null_count"),
            *([] if exact else [F.col(f"_d_{i}").alias("distinct_count")]),
        )
        for i, c in enumerate(cols)
    ]
    out = df.agg(*stats).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    if exact:
        out = out.join(_distinct_values(df, cols), "column_name", "left").fillna({"distinct_count": 0})
    pct = F.when(F.col("row_count") == 0, 0.0).otherwise(F.round(100.0 * F.col("null_count") / F.col("row_count"), 2))
    return out.withColumn("null_pct", pct)


def _distinct_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """Exact distinct counts of ``cols``: 128-bit value hashes travel, not the values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.xxhash64(F.col(c).cast("string")).alias("h"), F.xxhash64(F.lit(1), F.col(c).cast("string")).alias("g"), F.col(c).isNotNull().alias("there")) for c in cols])
    seen = df.select(F.explode(pairs).alias("p")).select("p.*").filter("there").groupBy("column_name", "h", "g").agg(F.lit(1).alias("one"))
    return seen.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count"))


def suggest_rules(df: DataFrame, max_values: int = 20) -> DataFrame:
    """Rules that hold for the whole table, status ``pending``: not null, unique, allowed values, numeric bounds.

    One aggregation gives nulls, bounds and estimated distinct counts of every column. Only columns whose estimate leaves a
    rule possible are counted exactly: few values by value, about as many values as rows by value hash.
    """
    simple = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    stats = [F.count(F.lit(1)).alias("rows")] + [f(F.col(c)).alias(f"{n}_{i}") for i, c in enumerate(simple) for n, f in (("some", F.count), ("about", F.approx_count_distinct))]
    stats += [f(F.col(c).cast("double")).alias(f"{n}_{i}") for i, c in enumerate(numeric) for n, f in (("lo", F.min), ("hi", F.max))]
    seen = df.agg(*stats).first()  # one row
    found = [(c, "is_not_null", None) for i, c in enumerate(simple) if seen["rows"] and seen[f"some_{i}"] == seen["rows"]]
    found += [(c, "min_max", f"{seen[f'lo_{i}']},{seen[f'hi_{i}']}") for i, c in enumerate(numeric) if seen[f"lo_{i}"] is not None]
    shape = "column_name string, rule_function string, arguments string"
    out = df.sparkSession.createDataFrame(found, shape)
    few = [c for i, c in enumerate(simple) if 0 < seen[f"about_{i}"] <= 2 * max_values]
    many = [c for i, c in enumerate(simple) if 0 < seen[f"some_{i}"] == seen["rows"] and seen[f"about_{i}"] >= 0.8 * seen["rows"]]
    if few:
        values = value_counts(df, few)  # at most about 2 * max_values rows per column and task
        kept = values.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("value")), ",").alias("arguments"))
        out = out.unionByName(kept.filter(F.col("n") <= max_values).select("column_name", F.lit("is_in").alias("rule_function"), "arguments"))
    if many:
        alone = _distinct_values(df, many).filter(F.col("distinct_count") == seen["rows"])
        out = out.unionByName(alone.select("column_name", F.lit("is_unique").alias("rule_function"), F.lit(None).cast("string").alias("arguments")))
    return out.withColumn("status", F.lit("pending"))


def suggestion_counts(suggestions: DataFrame, run: str = "run_id") -> DataFrame:
    """pending, accepted and rejected suggestions per run."""
    states = ["pending", "accepted", "rejected"]
    return suggestions.groupBy(run).agg(*[F.count_if(F.col("status") == s).alias(s) for s in states])
