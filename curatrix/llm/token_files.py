"""Operator 12: token ids as binary shards, with a minimal perfect hash index from document keys to shard offsets.

Files below one folder that every executor reaches:

* ``ids-*.bin``: the raw ids of a shard's documents, one after the other, little-endian unsigned integers of 2 bytes where the
  vocabulary allows it, else of 4. Shards follow one another in ascending key order.
* ``len-*.bin``: the length of each of its records, 4 bytes each.
* ``index-*.mph``: the index of the keys whose fingerprint falls into one bucket: bit arrays of a minimal perfect hash (a key takes
  the first level at which no other key has its position; the rank of that bit is its slot), then one slot per key: fingerprint,
  shard, first record, first id, number of records. The fingerprint of a document key is a bijection of the key, so a key that
  is not in the files is always told from one that is.
* ``manifest.json``: number width, shards with their numbers of records and ids, index files.

A key is found with one probe of its bucket and a few bit tests, whatever the number of documents.

Documents are range partitioned by key and sorted; each task tokenises its range and writes its shard. A task attempt writes
files of its own name, and only the names that Spark commits with the attempt's rows reach the manifest, so a lost executor
leaves an unreferenced file at most. Index entries are grouped by bucket, a bounded number of keys each.

Defined cases: a null text is empty and has the end id alone; a key that repeats is one index entry with all its records, in an
order that is the same for the same input files, and may run over several shards; a null key comes first, and is looked up
through the manifest; texts are read whole; an empty table gives no shards and an empty result; further columns are not read.
The strings of special tokens in a text become what the tokenizers library makes of them.
"""

from __future__ import annotations

import json
import uuid
import zlib
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.common import Shipped, id_and_text, mixed, stored
from curatrix.llm.units import UnitTokenizer
from curatrix.session import new_shared_path

#: Bytes of text for one shard, and keys for one index file, on average.
SHARD_BYTES = 64 << 20
BUCKET_KEYS = 1 << 17
#: Ids that a reader holds at once of a run of records of one key.
READ_IDS = 4 << 20

ENTRY = np.dtype([("fingerprint", "<u8"), ("shard", "<u4"), ("records", "<u4"), ("record", "<u8"), ("offset", "<u8")])


class MinimalPerfectHash:
    """Slots 0..n-1 for n distinct 64-bit fingerprints: a cascade of bit arrays with ranks."""

    GAMMA = 2

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int64)

    @staticmethod
    def _place(fingerprints: np.ndarray, level: int, size: int) -> np.ndarray:
        return mixed(fingerprints ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)

    @classmethod
    def of(cls, fingerprints: np.ndarray) -> MinimalPerfectHash:
        left, sizes, levels = fingerprints, [], []
        while len(left):
            size = -(-max(64, cls.GAMMA * len(left)) // 64) * 64
            place = cls._place(left, len(sizes), size)
            taken = np.bincount(place.astype(np.int64), minlength=size)
            levels.append(np.packbits(taken == 1, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[taken[place.astype(np.int64)] > 1]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, "<u8"))

    def slots(self, fingerprints: np.ndarray) -> np.ndarray:
        """A slot for every fingerprint, -1 where no level has its bit. Only the fingerprints of the set own theirs."""
        out = np.full(len(fingerprints), -1, np.int64)
        open_ = np.arange(len(fingerprints))
        for level, size in enumerate(self.sizes):
            place = self._place(fingerprints[open_], level, size).astype(np.int64) + self.first[level]
            word, bit = self.words[place >> 6], np.uint64(1) << (place & 63).astype(np.uint64)
            hit = word & bit != 0
            out[open_[hit]] = self.before[place[hit] >> 6] + np.bitwise_count(word[hit] & (bit[hit] - np.uint64(1)))
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


class IndexFile:
    """One bucket of the index."""

    def __init__(self, hash_: MinimalPerfectHash, entries: np.ndarray):
        self.hash, self.entries = hash_, entries

    @classmethod
    def of(cls, entries: np.ndarray) -> IndexFile:
        made = MinimalPerfectHash.of(entries["fingerprint"])
        placed = np.empty_like(entries)
        placed[made.slots(entries["fingerprint"])] = entries
        return cls(made, placed)

    def bytes(self) -> bytes:
        head = json.dumps({"keys": len(self.entries), "levels": self.hash.sizes}).encode()
        return len(head).to_bytes(4, "little") + head + self.hash.words.astype("<u8").tobytes() + self.entries.tobytes()

    @classmethod
    def read(cls, data: bytes) -> IndexFile:
        at = 4 + int.from_bytes(data[:4], "little")
        head = json.loads(data[4:at])
        words = np.frombuffer(data, "<u8", sum(head["levels"]) // 64, at)
        return cls(MinimalPerfectHash(head["levels"], words), np.frombuffer(data, ENTRY, head["keys"], at + words.nbytes))

    def find(self, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the fingerprints are keys, and the entries of those."""
        slot = self.hash.slots(fingerprints)
        found = slot >= 0
        found[found] = self.entries["fingerprint"][slot[found]] == fingerprints[found]
        return found, self.entries[slot[found]]


def fingerprint(keys: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit keys."""
    return mixed(keys.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019))


def bucket_of(fingerprints: np.ndarray, buckets: int) -> np.ndarray:
    return ((fingerprints >> np.uint64(32)) % np.uint64(max(1, buckets))).astype(np.int64)


@dataclass
class TokenFiles:
    """A folder of shards and index files, and what its manifest says."""

    path: str
    width: int = 2
    shards: list[dict] = field(default_factory=list)
    index: list[str | None] = field(default_factory=list)
    null_key: dict | None = None

    @cached_property
    def _at(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    @cached_property
    def starts(self) -> list[int]:
        return np.concatenate([[0], np.cumsum([s["ids"] for s in self.shards])]).astype(int).tolist()

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("path", "width", "shards", "index", "null_key")}

    def write(self, name: str, data: bytes) -> None:
        system, root = self._at
        with system.open_output_stream(f"{root}/{name}") as out:
            out.write(data)

    def read(self, name: str, first: int = 0, length: int | None = None) -> bytes:
        system, root = self._at
        with system.open_input_file(f"{root}/{name}") as data:
            return data.read_at(data.size() if length is None else length, first)

    def commit(self) -> None:
        self.write("manifest.json", json.dumps({k: getattr(self, k) for k in ("width", "shards", "index", "null_key")}).encode())

    @classmethod
    def open(cls, path: str) -> TokenFiles:
        return cls(path, **json.loads(cls(path).read("manifest.json")))

    def runs(self, shard: int, record: int, offset: int, records: int):
        """(shard, record, offset, records) in each shard that the records of a key run over."""
        while records:
            n = min(records, self.shards[shard]["records"] - record)
            if n:
                yield shard, record, offset, n
            shard, record, offset, records = shard + 1, 0, 0, records - n

    def records(self, shard: int, record: int, offset: int, records: int):
        """(first id within the shard, ids) of each record of a run, read in bounded slices."""
        name, dtype = self.shards[shard]["name"], np.dtype(f"<u{self.width}")
        step = 1 << 16
        for a in range(record, record + records, step):
            lengths = np.frombuffer(self.read(f"len-{name}", 4 * a, 4 * min(step, record + records - a)), "<u4").astype(np.int64)
            edges = np.concatenate([[0], np.cumsum(lengths)])
            i = 0
            while i < len(lengths):
                j = max(i + 1, int(np.searchsorted(edges, edges[i] + READ_IDS, "right")) - 1)
                ids = np.frombuffer(self.read(f"ids-{name}", (offset + int(edges[i])) * self.width, int(edges[j] - edges[i]) * self.width), dtype)
                for k in range(i, j):
                    yield offset + int(edges[k]), ids[edges[k] - edges[i] : edges[k + 1] - edges[i]]
                i = j
            offset += int(edges[-1])

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of every record of one key: one probe of its index bucket, then its payload alone."""
        if key is None:
            entry = self.null_key
        else:
            mark = fingerprint(np.array([key]))
            name = self.index[int(bucket_of(mark, len(self.index))[0])] if self.index else None
            entry = None
            if name:
                found, entries = IndexFile.read(self.read(name)).find(mark)
                entry = {k: int(entries[0][k]) for k in ("shard", "record", "offset", "records")} if found[0] else None
        return [] if entry is None else [ids for run in self.runs(**entry) for _, ids in self.records(*run)]


def write_token_files(docs: DataFrame, spec: str, end_id: int = 0, path: str | None = None, shard_bytes: int = SHARD_BYTES, bucket_keys: int = BUCKET_KEYS) -> TokenFiles:
    """Tokenise ``docs`` with the tokenizer of the JSON text ``spec``, append ``end_id`` and write all files."""
    spark = docs.sparkSession
    files = TokenFiles(path or new_shared_path(spark, "token-files"))
    made = UnitTokenizer(spec)
    files.width = made.dtype.itemsize
    system, root = fs.FileSystem.from_uri(files.path)
    system.create_dir(root, recursive=True)
    size = docs.agg(F.sum(F.octet_length("text") + 1).alias("n")).first()["n"] or 0
    tool, target = Shipped(spark, made), Shipped(spark, files)
    end = np.array([end_id], made.dtype).tobytes()

    def write(batches):
        one, out, width = tool.value, target.value, len(end)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        system, root = out._at
        sinks = None
        total, last, entry, rows = 0, 0, None, []
        for batch in batches:
            if batch.num_rows and sinks is None:
                sinks = system.open_output_stream(f"{root}/ids-{name}"), system.open_output_stream(f"{root}/len-{name}")
            lengths = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = one.payload(text.as_py()) + end
                sinks[0].write(ids)
                lengths.append(len(ids) // width)
                if entry is None or entry[0] != key:
                    entry = [key, last, total, 0]
                    rows.append(entry)
                entry[3] += 1
                total, last = total + lengths[-1], last + 1
            if lengths:
                sinks[1].write(np.array(lengths, "<u4").tobytes())
            while len(rows) > 1 << 14:  # the last entry may still grow
                yield _entries(rows[: 1 << 14])
                del rows[: 1 << 14]
        if sinks is not None:
            for sink in sinks:
                sink.close()
            yield _entries(rows)
            yield _entries([[None, last, total, 0]], name)

    chosen = id_and_text(docs).withColumn("__row", F.monotonically_increasing_id())
    ranged = chosen.repartitionByRange(max(1, -(-size // shard_bytes)), "doc_id", "__row").sortWithinPartitions("doc_id", "__row").select("doc_id", "text")
    entries = stored(ranged.mapInArrow(write, "doc_id long, part int, record long, offset long, records long, name string"), "token-entries")
    for n, r in enumerate(sorted(entries.where("name IS NOT NULL").collect(), key=lambda r: r["part"])):
        files.shards.append({"name": r["name"], "part": r["part"], "records": r["record"], "ids": r["offset"]})
    number = {s["part"]: n for n, s in enumerate(files.shards)}
    keys = entries.where("name IS NULL")
    nulls = sorted(keys.where("doc_id IS NULL").collect(), key=lambda r: r["part"])  # one row per shard at most
    if nulls:
        files.null_key = {"shard": number[nulls[0]["part"]], "record": nulls[0]["record"], "offset": nulls[0]["offset"], "records": sum(r["records"] for r in nulls)}
    buckets = -(-sum(s["records"] for s in files.shards) // bucket_keys)
    files.index = [None] * buckets
    known = Shipped(spark, (files, number))

    def build(group: pa.Table) -> pa.Table:
        out, number = known.value
        mark = group.column("mark").to_numpy().view(np.uint64)
        shard = np.array([number[p] for p in group.column("part").to_pylist()], np.int64)
        order = np.lexsort((shard, mark))
        mark, shard = mark[order], shard[order]
        first = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]])
        made = np.zeros(len(first), ENTRY)
        made["fingerprint"], made["shard"] = mark[first], shard[first]
        for c in ("record", "offset"):
            made[c] = group.column(c).to_numpy()[order][first]
        made["records"] = np.add.reduceat(group.column("records").to_numpy()[order], first)
        name = f"index-{uuid.uuid4().hex}.mph"
        out.write(name, IndexFile.of(made).bytes())
        return pa.table({"bucket": pa.array([group.column("bucket")[0].as_py()], pa.int64()), "name": pa.array([name], pa.string())})

    marked = _marked(keys.where("doc_id IS NOT NULL").select("doc_id", "part", "record", "offset", "records"), buckets)
    built = stored(marked.groupBy("bucket").applyInArrow(build, "bucket long, name string"), "token-index")
    for r in built.collect():  # one row per index file
        files.index[r["bucket"]] = r["name"]
    files.commit()
    return files


def _entries(rows: list[list], name: str | None = None) -> pa.RecordBatch:
    part = TaskContext.get().partitionId()
    key, record, offset, records = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [])
    columns = [pa.array(key, pa.int64()), pa.array([part] * len(rows), pa.int32()), *[pa.array(c, pa.int64()) for c in (record, offset, records)], pa.array([name] * len(rows), pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "record", "offset", "records", "name"])


def _marked(keys: DataFrame, buckets: int) -> DataFrame:
    """Adds the fingerprint ``mark`` and the index ``bucket`` of doc_id."""

    def run(batches):
        for batch in batches:
            mark = fingerprint(batch.column("doc_id").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mark.view(np.int64)), pa.array(bucket_of(mark, buckets))], [*batch.schema.names, "mark", "bucket"])

    return keys.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in keys.schema)}, mark long, bucket long")


def lookup(keys: DataFrame, files: TokenFiles, take: str = "ids") -> DataFrame:
    """The records of every key of ``keys`` (column doc_id; each distinct key once), read from the files: doc_id, start, n_tokens and ``ids`` (array of long) or their ``ids_crc32``.

    Keys go to the bucket that may hold them, the entries found go to their shard and are read there in file order.
    """
    spark = keys.sparkSession
    sent = Shipped(spark, files)
    shape = "doc_id long, shard int, record long, offset long, records long"

    def resolve(batches):
        out, at, index = sent.value, None, None
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            rows = []
            key, mark = batch.column("doc_id").to_numpy(), batch.column("mark").to_numpy().view(np.uint64)
            for b in np.unique(bucket).tolist():
                if b != at:
                    at, index = b, IndexFile.read(out.read(out.index[b])) if out.index and out.index[b] else None
                mine = np.flatnonzero(bucket == b)
                if index is not None:
                    found, entries = index.find(mark[mine])
                    for k, e in zip(key[mine[found]].tolist(), entries, strict=True):
                        rows += [(k, *run) for run in out.runs(*(int(e[c]) for c in ("shard", "record", "offset", "records")))]
            yield _batch(rows, shape)

    def fetch(batches):
        out = sent.value
        for batch in batches:
            done = [], [], [], []
            held = 0
            for key, *run in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "shard", "record", "offset", "records")), strict=True):
                for offset, ids in out.records(*run):
                    wide = ids.astype("<u4")
                    for column, v in zip(done, (key, out.starts[run[0]] + offset, len(ids), zlib.crc32(wide.tobytes()) if take == "ids_crc32" else wide), strict=True):
                        column.append(v)
                    held += len(ids) if take == "ids" else 1
                    if held >= READ_IDS:
                        yield _found(done, take)
                        done, held = ([], [], [], []), 0
            yield _found(done, take)

    plain = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    marked = _marked(plain.where("doc_id IS NOT NULL"), len(files.index))
    entries = marked.repartition(max(1, len(files.index)), "bucket").sortWithinPartitions("bucket").mapInArrow(resolve, shape)
    if files.null_key is not None:
        asked = bool(plain.where("doc_id IS NULL").head(1))
        entries = entries.unionByName(spark.createDataFrame([(None, *run) for run in files.runs(**files.null_key) if asked], shape))
    placed = entries.repartitionById(max(1, len(files.shards)), F.col("shard")).sortWithinPartitions("shard", "offset")
    return placed.mapInArrow(fetch, f"doc_id long, start long, n_tokens long, {take} {'long' if take == 'ids_crc32' else 'array<long>'}")


def _batch(rows: list[tuple], shape: str) -> pa.RecordBatch:
    fields = [f.split() for f in shape.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, {"long": pa.int64(), "int": pa.int32()}[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _found(done, take: str) -> pa.RecordBatch:
    last = pa.array(done[3], pa.int64()) if take == "ids_crc32" else pa.array(done[3], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in done[:3]], last], ["doc_id", "start", "n_tokens", take])


def file_report(docs: DataFrame, spec: str, end_id: int = 0) -> DataFrame:
    """Query columns: every document's place and the checksum of its ids, by key, from files written here."""
    return lookup(docs.select("doc_id"), write_token_files(docs, spec, end_id), "ids_crc32")


def read_token_files(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The ids of the asked keys from files that an earlier job wrote."""
    return lookup(keys, TokenFiles.open(path))
