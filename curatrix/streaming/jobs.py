"""Structured Streaming over the batch operators.

Every sink writes a folder per batch id and overwrites it, so a batch that runs again after a failure leaves the same
rows.  Checkpoints and output live in the folder the caller names, which on a cluster is a shared one.
"""

from __future__ import annotations

from collections.abc import Callable
from heapq import nlargest

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DataType, DateType, IntegralType, StringType, StructField, TimestampNTZType, TimestampType

from curatrix.operators.linking import fan_out
from curatrix.operators.quality import RowRule, split_rows, volume_floor
from curatrix.operators.skew import first_per_key
from curatrix.sources.triples import COLUMNS


def read_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def run(stream: DataFrame, base: str, batch: Callable[[DataFrame, int], None], mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(batch)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def put(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(batch_folder(path, batch_id))


def read_sink(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")


def with_event_time(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarked stream; watermarks need an instant, so a wall-clock column is read in the session's time zone."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def stream_enforce(stream: DataFrame, rules: Callable[[], list[RowRule]], base: str, trigger: dict | None = None) -> StreamingQuery:
    """Continuous contract enforcement: good rows and quarantine, both per batch."""

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = df.persist()
        good, bad = split_rows(rows, rules())
        put(good.drop("_errors"), f"{base}/good", batch_id)
        put(bad.withColumn("_pipeline_id", F.lit(base.rsplit("/", 1)[-1])), f"{base}/quarantine", batch_id)
        rows.unpersist()

    return run(stream, base, batch, trigger=trigger)


def order_text(column: str, kind: DataType) -> Column:
    """Text that sorts like an integral, time, date or text column; NULL sorts first."""
    c = F.col(column)
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        c = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, DateType):
        c = F.unix_date(c)
    elif not isinstance(kind, (IntegralType, StringType)):
        raise TypeError(f"{column}: rows cannot be ordered by {kind.simpleString()}")
    shifted = c if isinstance(kind, StringType) else F.lpad((c.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0")
    return F.coalesce(shifted, F.lit(""))


def _packed(stream: DataFrame, key: str, order: list[str], cols: list[str]) -> DataFrame:
    """_key, _order and _row as text: state and Python never see, and never round, a value of another type."""
    kinds = {f.name: f.dataType for f in stream.schema}
    rank = F.concat_ws("\x1f", *[order_text(o, kinds[o]) for o in order])
    return stream.select(F.col(key).cast("string").alias("_key"), rank.alias("_order"), F.to_json(F.array(*[F.col(c).cast("string") for c in cols])).alias("_row"))


def _unpacked(column: str, fields: list[StructField], prefix: str = "") -> list[Column]:
    values = F.from_json(column, "array<string>")
    return [values[i].cast(f.dataType).alias(prefix + f.name) for i, f in enumerate(fields)]


def _fewest(packed: DataFrame, n: int, newest: bool) -> DataFrame:
    """At most ``n`` rows of a key from each Arrow batch go on, so that a hot key reaches its state as a few rows."""

    def run(batches):
        for pdf in batches:
            yield pdf.sort_values(["_order", "_row"], ascending=not newest).groupby("_key", dropna=False, sort=False).head(n)

    return packed.mapInPandas(run, "_key string, _order string, _row string")


def _earliest(packed: DataFrame) -> DataFrame:
    """The earliest row of every key of a batch, of equally early ones the first by its values, key by key in one place.

    A task holds the best row of the keys it has met, merged as Arrow batches come.
    """

    def run(batches):
        best, waiting, rows = None, [], 0
        for pdf in batches:
            waiting.append(pdf)
            rows += len(pdf)
            if best is None or rows >= len(best):
                best, waiting, rows = first(best, waiting), [], 0
        if waiting:
            best = first(best, waiting)
        if best is not None:
            yield from (best[i:i + 50_000] for i in range(0, len(best), 50_000))

    def first(best, more):
        return pd.concat([*([] if best is None else [best]), *more]).sort_values(["_order", "_row"]).drop_duplicates("_key")

    kind = "_key string, _order string, _row string"
    return _fewest(packed, 1, False).repartition("_key").mapInPandas(run, kind)


def stage_events(stream: DataFrame, key: str, ts: str, base: str, trigger: dict | None = None) -> StreamingQuery:
    """At-least-once input staged once per key, however late a first arrival or a repeat is; NULL is one key.

    That a key was staged is keyed state: a batch looks up the keys it holds and reads nothing of the history. Of a key's rows in its first batch the
    earliest is staged, of equally early ones the first by its values, also when the batch runs again. State of many keys belongs in a
    RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    once = _earliest(_packed(stream, key, [ts], stream.columns)).dropDuplicates(["_key"])
    return run(once.select(*_unpacked("_row", list(stream.schema))), base, lambda df, i: put(df, f"{base}/events", i), trigger=trigger)


def event_volume(stream: DataFrame, ts: str, kind: str, width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts per window and type; rows later than the watermark are dropped."""
    win = F.window(F.col(ts), width, slide) if slide else F.window(F.col(ts), width)
    counts = with_event_time(stream, ts, delay).groupBy(win.alias("w"), F.col(kind)).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), kind, "n")


def open_state(spark: SparkSession, base: str) -> DataFrame:
    """Key and value of every window or session that is still open, from the query's own state of its last batch."""
    return spark.read.format("statestore").load(f"{base}/checkpoint")


def open_windows(spark: SparkSession, base: str, kind: str) -> DataFrame:
    """Counts of the windows that the watermark has not closed yet, in the columns of ``event_volume``; together they hold every event."""
    w = "key.window"
    return open_state(spark, base).select(F.col(f"{w}.start").cast("timestamp_ntz").alias("window_start"), F.col(f"{w}.end").cast("timestamp_ntz").alias("window_end"), F.col(f"key.{kind}"), F.col("value.count").alias("n"))


def late_events(stream: DataFrame, ts: str, width: str, delay: str, base: str, trigger: dict | None = None) -> StreamingQuery:
    """Rows whose window was closed when they came, kept aside with the watermark they missed; ``event_volume`` does not count them.

    As in Spark's stateful operators a batch drops by the watermark of the batch before it: the newest time of all batches before that one, less
    ``delay``. Each batch reads two rows for it.
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, batch_id: int) -> None:
        newest, before = (spark.read.parquet(batch_folder(f"{base}/newest", i)).first()[0] if i >= 0 else None for i in (batch_id - 1, batch_id - 2))
        mark = F.lit(before).cast("timestamp") - F.expr(f"interval {delay}")
        late = df.withColumn("missed", mark).filter(F.window(F.col(ts), width)["end"] <= F.col("missed"))
        put(late, f"{base}/late", batch_id)
        put(df.agg(F.greatest(F.max(ts), F.lit(newest).cast("timestamp")).alias("newest")), f"{base}/newest", batch_id)

    return run(stream.withColumn(ts, F.col(ts).cast("timestamp")), base, batch, trigger=trigger)


def _judged(counts: DataFrame, start: DataFrame, kind: str, ratio: float, windows: int, width: str) -> DataFrame:
    """Floors of all windows since ``start`` (a row per type), those without any event counted 0."""
    rows = counts.select(kind, "window_start", "n").unionByName(start.select(kind, "window_start", F.lit(0).cast("long").alias("n")))
    return volume_floor(rows.groupBy(kind, "window_start").agg(F.sum("n").alias("n")), "window_start", "n", (kind,), ratio, windows, width)


def _closed_since(spark: SparkSession, base: str, batch_id: int, kind: str, windows: int, width: str) -> tuple[DataFrame, DataFrame, object]:
    """Stored windows up to a batch that later ones are judged by, each type's first window among them, and the last window judged before.

    The marks of the batch before hold the last window and each type's first one; of the windows only the days needed are read.
    """
    marks = spark.read.parquet(batch_folder(f"{base}/marks", batch_id))
    shape = f"`{kind}` {marks.schema[kind].dataType.simpleString()}, window_start timestamp_ntz, window_end timestamp_ntz, n long, batch int, day date"
    known = spark.read.schema(shape).parquet(f"{base}/volume").filter(F.col("batch") <= batch_id)
    judged_to = marks.agg(F.max("judged_to")).first()[0]
    start = marks.select(kind, F.col("first").alias("window_start"))
    if judged_to is not None:
        low = F.lit(judged_to) - F.expr(f"{windows} * interval {width}")
        known = known.filter((F.col("day") >= F.to_date(low)) & (F.col("window_start") >= low))
        start = start.withColumn("window_start", F.greatest("window_start", low))
    return known, start, judged_to


def volume_drop_alert(volume: DataFrame, kind: str, base: str, ratio: float = 0.6, windows: int = 7, width: str = "1 hour", trigger: dict | None = None) -> StreamingQuery:
    """Closed windows are stored; a window below ``ratio`` times the mean of the ``windows`` before it is an alert.

    Windows without any event count 0, from a type's first window to the last closed one of all types. Each batch judges the windows that closed since the
    one before, and reads only these, the ``windows`` before them (a partition per day) and a row of marks per type.
    """
    spark = volume.sparkSession

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = df.persist()
        rows.withColumn("day", F.to_date("window_start")).write.mode("overwrite").partitionBy("day").parquet(batch_folder(f"{base}/volume", batch_id))
        marks, judged_to = rows.groupBy(kind).agg(F.min("window_start").alias("first"), F.max("window_start").alias("last")), None
        if batch_id:
            before = spark.read.parquet(batch_folder(f"{base}/marks", batch_id - 1))
            judged_to = before.agg(F.max("last")).first()[0]
            marks = marks.unionByName(before.select(kind, "first", "last"))
        marks = marks.groupBy(kind).agg(F.min("first").alias("first"), F.max("last").alias("last"))
        put(marks.withColumn("judged_to", F.lit(judged_to).cast("timestamp_ntz")), f"{base}/marks", batch_id)
        rows.unpersist()
        known, start, _ = _closed_since(spark, base, batch_id, kind, windows, width)
        judged = _judged(known, start, kind, ratio, windows, width)
        fresh = judged if judged_to is None else judged.filter(F.col("window_start") > F.lit(judged_to))
        put(fresh.filter(~F.col("passed")), f"{base}/alerts", batch_id)

    return run(volume, base, batch, trigger=trigger)


def open_alerts(spark: SparkSession, base: str, kind: str, ratio: float = 0.6, windows: int = 7, width: str = "1 hour") -> DataFrame:
    """The same verdict on the windows that are still open, by what they hold so far."""
    last = spark.read.parquet(f"{base}/marks").agg(F.max("batch")).first()[0]
    closed_to = spark.read.parquet(batch_folder(f"{base}/marks", last)).agg(F.max("last")).first()[0]
    known, start, _ = _closed_since(spark, base, last, kind, windows, width)
    still = open_windows(spark, base, kind)
    counts = known.select(kind, "window_start", "n").unionByName(still.select(kind, "window_start", "n"))
    new = still.select(kind, "window_start").join(start.select(kind), kind, "left_anti").groupBy(kind).agg(F.min("window_start").alias("window_start"))
    judged = _judged(counts, start.unionByName(new), kind, ratio, windows, width)
    fresh = judged if closed_to is None else judged.filter(F.col("window_start") > F.lit(closed_to))
    return fresh.filter(~F.col("passed"))


def session_activity(stream: DataFrame, ts: str, key: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Sessions per key that end after ``gap`` without an event.

    With ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` a session merges them inside each input partition, before the shuffle,
    so that a hot key arrives as sessions, not as events (``build_session`` sets it).
    """
    sessions = with_event_time(stream, ts, delay).groupBy(F.session_window(F.col(ts), gap).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("events"))
    return sessions.select(key, F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "events")


def open_sessions(spark: SparkSession, base: str, key: str) -> DataFrame:
    """Sessions that may still grow, in the columns of ``session_activity``."""
    w = "value.session_window"
    return open_state(spark, base).select(F.col(f"value.{key}"), F.col(f"{w}.start").cast("timestamp_ntz").alias("session_start"), F.col(f"{w}.end").cast("timestamp_ntz").alias("session_end"), F.col("value.count").alias("events"))


def append_sink(stream: DataFrame, base: str, name: str, trigger: dict | None = None) -> StreamingQuery:
    return run(stream, base, lambda df, i: put(df, f"{base}/{name}", i), trigger=trigger)


def current_state(stream: DataFrame, key: str, order: list[str], cols: list[str], base: str, trigger: dict | None = None) -> StreamingQuery:
    """Latest row per subject and the one before it (columns ``before_``) as a log: every batch writes only the subjects it touched.

    The two newest rows of a subject are keyed state, so a batch reads nothing of the history.
    """
    kinds = {f.name: f for f in stream.schema}
    names = [key, *order, *cols]

    def newest(key, batches, state):
        top = [x for x in zip(state.get[0::2], state.get[1::2], strict=True) if x[0] is not None] if state.exists else []
        for pdf in batches:
            top = nlargest(2, [*top, *zip(pdf["_order"].tolist(), pdf["_row"].tolist(), strict=True)])  # a few rows of each upstream batch
        held = [*top, (None, None)][:2]
        state.update((*held[0], *held[1]))
        yield pd.DataFrame({"_now": [held[0][1]], "_before": [held[1][1]]}, dtype=object)

    packed = _fewest(_packed(stream, key, order, names), 2, True)
    states = packed.groupBy("_key").applyInPandasWithState(newest, "_now string, _before string", "o1 string, r1 string, o2 string, r2 string", "update", "NoTimeout")
    before = _unpacked("_before", [kinds[c] for c in names], "before_")[1:]
    return run(states.select(*_unpacked("_now", [kinds[c] for c in names]), *before), base, lambda df, i: put(df, f"{base}/state", i), mode="update", trigger=trigger)


def read_state(spark: SparkSession, base: str, key: str) -> DataFrame:
    """The newest entry of every subject in the log."""
    return first_per_key(spark.read.parquet(f"{base}/state"), [key], [F.col("batch").desc()]).drop("batch")


def incremental_sync(spark: SparkSession, stream: DataFrame, base: str, trigger: dict | None = None) -> StreamingQuery:
    """New triples appended batch by batch; those already stored are skipped. Which triples are stored is keyed state, no batch reads the store."""
    return append_sink(stream.dropDuplicates(list(COLUMNS)), base, "triples", trigger)


def stream_freshness(stream: DataFrame, key: str, ts: str, base: str, trigger: dict | None = None) -> StreamingQuery:
    """Newest time per key, kept as state; ``stale_keys`` reads it."""
    newest = stream.groupBy(key).agg(F.max(ts).alias("last_seen"))
    return run(newest, base, lambda df, i: put(df, f"{base}/seen", i), mode="update", trigger=trigger)


def stale_keys(spark: SparkSession, base: str, key: str, as_of, max_age_seconds: int) -> DataFrame:
    """Keys whose last event is older than allowed at ``as_of``."""
    seen = read_sink(spark, f"{base}/seen").groupBy(key).agg(F.max("last_seen").alias("last_seen"))
    return seen.filter(F.col("last_seen") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(max_age_seconds)} seconds"))


def stream_fan_out(stream: DataFrame, subscriptions: DataFrame, base: str, trigger: dict | None = None) -> StreamingQuery:
    """Stream-static join: one notification per subscriber, salted inside each batch."""
    return run(stream, base, lambda df, i: put(fan_out(df, subscriptions), f"{base}/notifications", i), trigger=trigger)
