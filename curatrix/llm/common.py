"""Helpers shared by the operators: text columns, byte buffers, and tables in the shared folder."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.session import new_shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as a long, the text (null: empty) and the named columns; nothing else reaches Python."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def remainder(modulus: int) -> Column:
    """crc32 of doc_id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: lineage ends there and no executor has to survive."""
    path = new_shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Shipped:
    """A broadcast of any object of this package, for workers that cannot import it.

    A worker process loads it once and keeps it for all its tasks, with what the object has learned meanwhile.
    """

    def __init__(self, spark: SparkSession, thing):
        self._sent = spark.sparkContext.broadcast({"packed": cloudpickle.dumps(thing)})

    @property
    def value(self):
        holder = self._sent.value
        if "thing" not in holder:
            holder["thing"] = pickle.loads(holder.pop("packed"))
        return holder["thing"]


class Remembered:
    """What was worked out for each key lately: two generations of at most ``room`` entries, the older dropped when the younger is full."""

    def __init__(self, room: int):
        self.room, self.young, self.old = room, {}, {}

    def missing(self, keys) -> list:
        """The distinct ``keys`` that have to be worked out and put in; the others are in ``young`` afterwards."""
        new = set(keys).difference(self.young)
        if len(self.young) + len(new) > self.room:
            self.young, self.old = {}, self.young
            new = set(keys)
        if self.old and new:
            known = {k for k in new if k in self.old}
            self.young.update(zip(known, map(self.old.__getitem__, known), strict=True))
            new -= known
        return list(new)


#: Bits of a bitmap of hashes, as a power of two: 8 MB, whatever the number of hashes.
BITMAP = 26


class Bitmap:
    """Marks of the low bits of 64-bit hashes. Without its mark a hash is not in the set; with it, it probably is.

    Its size is fixed. A very large set marks nearly everything: the bitmap then spares little work, with the same results.
    """

    def __init__(self, df: DataFrame, column: str):
        place = F.col(column).bitwiseAND((1 << BITMAP) - 1) + 1
        rows = df.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
        self.bits = np.zeros(1 << (BITMAP - 3), np.uint8)
        for r in rows:
            part = np.frombuffer(r["bits"], np.uint8)
            at = (r["b"] - 1) * len(part)
            self.bits[at : at + len(part)] = part

    def has(self, h: np.ndarray) -> np.ndarray:
        place = h.view(np.uint64) & np.uint64((1 << BITMAP) - 1)
        return (self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def byte_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column and the ``len + 1`` offsets of its rows; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
    column = pc.cast(pc.fill_null(column, empty), pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes; a longer row stands alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last
        first = last


def packed(column: np.ndarray, codec) -> bytes:
    """A column of numbers as bytes: those of equal weight side by side, then compressed."""
    return codec.compress(np.ascontiguousarray(np.ascontiguousarray(column).view(np.uint8).reshape(len(column), -1).T).tobytes())


def unpacked(data: bytes, n: int, dtype, codec) -> np.ndarray:
    raw = np.frombuffer(codec.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(-1, n).T).view(dtype).ravel()


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values over all their bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class RangeHash:
    """64-bit hashes of any substrings of a buffer from one running sum: sum of value(byte) * base**position."""

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.base = int(draw.integers(1 << 61, 1 << 62)) * 2 + 1
        self.back = pow(self.base, -1, 1 << 64)
        self.value = draw.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = np.full(n, self.base, np.uint64), np.full(n, self.back, np.uint64)
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end], elementwise."""
        self._powers(len(sums))
        return mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def all_of(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Hashes of every window of ``width`` bytes."""
        if len(sums) <= width:
            return np.zeros(0, np.uint64)
        return mixed((sums[width:] - sums[:-width]) * self.down[: len(sums) - width])
