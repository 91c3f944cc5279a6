"""Operator 9: removal of repeated substrings by a distributed suffix sort.

Every byte covered by a ``width``-byte string that also starts elsewhere in the corpus goes. Sorting the suffix at every
byte would move each text hundreds of times, so the sort gets only the suffixes whose fate is open:

1. *Runs.* Consecutive window starts with the same least ``gram``-byte hash form a run. Equal windows have the same least
   hash, so only runs whose hash occurs again (or which may repeat within themselves) can hold repeated windows; the
   others end here. Hash counts are pre-aggregated before their shuffle.
2. *Copies collapse.* Runs that are equal over their whole context (64-bit hash within one group of equal least hash) are
   repeated throughout. One of them stands for all in what follows. Both steps are done again inside the runs that differ
   from others of their group, with a longer gram, which settles most of the windows around an edit.
3. *Sorted runs.* Of the windows in runs that are still open, those whose 64-bit hash nothing else has are dropped: they are
   unique. The suffixes (``width`` bytes) of the others are sorted in each task and front-coded: length of the prefix shared
   with the one before, and the rest.
4. *Exchange and merge.* Splitters from a sample cut the sorted runs into ranges; each range is one task, which merges its
   runs with a loser tree. Every contender carries the length of the prefix it shares with the last winner; contenders
   with different lengths are ordered by them alone, equal ones compare only what follows. A winner whose shared prefix is
   the whole width equals the one before.

Defined cases: a null text is empty; texts shorter than ``width`` bytes lose nothing; a repeated row is another document,
so its text of ``width`` bytes or more goes in both; documents are told apart by doc_id and text; matches never cross
documents; further columns stay as they are; an empty table gives an empty result. A text is read in segments, so its
length is no matter. Where removal cuts a character, ``without_repeats`` drops its remaining bytes.

Memory: no stage runs two Python functions one after the other, since each would hold a worker of its own in every task. So joins
with texts that a Python function gave are never broadcast joins, which would leave both in one stage.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import Bitmap, RangeHash, Shipped, blocks, byte_view, packed, stored, unpacked

WIDTH = 200
GRAM, FINER = 40, 150
#: Window starts in one run, at most; windows in one sorted run, in one of its blocks, meant for one range, and in one bucket of hashes.
LONGEST, SORTED, BLOCK, RANGE, HASHES = 1024, 40_000, 1_000, 120_000, 1_000_000
#: Windows from which splitters are chosen. Only the balance of the ranges depends on it.
SAMPLE = 20_000
SEGMENT = 1 << 18  # bytes in one buffer; the hashes of a buffer and their minima take some 80 bytes for each


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every ``span`` neighbours, in log2(span) passes."""
    wide = 1
    while wide * 2 <= span:
        h = np.minimum(h[:-wide], h[wide:])
        wide *= 2
    return np.minimum(h[: len(h) - (span - wide)], h[span - wide :]) if span > wide else h


def runs_of(data: np.ndarray, offsets: np.ndarray, hashing: RangeHash, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, start, n, key, context, self) of the runs in a buffer of documents; ``start`` counts from the row's first byte."""
    if len(data) < width:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    span = width - gram + 1
    sums = hashing.sums(data)
    grams = hashing.all_of(sums, gram)
    least = _least(grams, span)
    flow = np.zeros(len(least) + 1, np.int8)
    has = np.diff(offsets) >= width
    np.add.at(flow, offsets[:-1][has], 1)
    np.add.at(flow, offsets[1:][has] - width + 1, -1)
    valid = np.cumsum(flow[:-1], dtype=np.int8).astype(bool)
    edge = np.ones(len(least), bool)
    edge[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    start = np.flatnonzero(edge & valid)
    stops = np.flatnonzero(np.concatenate([edge[1:] | ~valid[1:], [True]]) & valid) + 1
    parts = -(-(stops - start) // LONGEST)
    if len(parts) and parts.max() > 1:
        owner = np.repeat(np.arange(len(start)), parts)
        nth = np.arange(len(owner)) - (np.cumsum(parts) - parts)[owner]
        start = start[owner] + nth * LONGEST
        stops = np.minimum(stops[owner], start + LONGEST)
    opens, closes = np.flatnonzero(grams[: len(least)] == least), np.flatnonzero(grams[span - 1 : span - 1 + len(least)] == least)
    opens, closes = np.append(opens, len(grams)), np.concatenate([[-1], closes])
    first = opens[np.searchsorted(opens, start)]
    last = closes[np.searchsorted(closes, stops) - 1]
    own = (first < stops) & (last >= start) & (first < last + span - 1)
    row = np.searchsorted(offsets, start, "right") - 1
    context = hashing.of(sums, start, stops + width - 1)
    return row, start - offsets[row], stops - start, least[start].view(np.int64), context.view(np.int64), own


_RUN = "key long, context long, __key long, start long, n int, own boolean"


def _run_batch(runs: tuple[np.ndarray, ...], keys: np.ndarray, shift: np.ndarray | int, wanted: Bitmap | None, *more: tuple[str, np.ndarray]) -> pa.RecordBatch:
    row, start, n, key, context, own = runs
    columns = [("key", key), ("context", context), ("__key", keys[row]), ("start", start + (shift if np.isscalar(shift) else shift[row])), ("n", n.astype(np.int32)), ("own", own.astype(bool)), *[(name, v[row]) for name, v in more]]
    keep = wanted.has(key) if wanted is not None else slice(None)
    return pa.RecordBatch.from_arrays([pa.array(v[keep]) for _, v in columns], [name for name, _ in columns])


def _run_batches(width: int, gram: int, wanted: Shipped | None = None):
    """Runs of whole documents, or those of them whose key the bitmap marks."""

    def run(batches):
        hashing, marks = RangeHash(20), wanted.value if wanted is not None else None
        for batch in batches:
            data, offsets = byte_view(batch.column("text"))
            keys = batch.column("__key").to_numpy()
            for a, b in blocks(offsets, SEGMENT):
                lo, hi = int(offsets[a]), int(offsets[b])
                if b == a + 1:
                    for base in range(0, max(1, hi - lo), SEGMENT):
                        piece = data[lo + base : min(hi, lo + base + SEGMENT + width - 1)]
                        yield _run_batch(runs_of(piece, np.array([0, len(piece)]), hashing, width, gram), keys[a:b], base, marks)
                else:
                    yield _run_batch(runs_of(data[lo:hi], offsets[a : b + 1] - lo, hashing, width, gram), keys[a:b], 0, marks)

    return run


def _finer_batches(width: int, gram: int):
    """Runs by a longer gram inside open runs; they keep what is known of the run."""

    def run(batches):
        hashing, unpack = RangeHash(21), zstandard.ZstdDecompressor()
        slices, keys, starts, known, held = [], [], [], [], 0

        def flush():
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in slices])])
            found = runs_of(np.concatenate(slices), offsets, hashing, width, gram)
            return _run_batch(found, np.array(keys, np.int64), np.array(starts, np.int64), None, ("known", np.array(known, bool)))

        for batch in batches:
            for key, squeezed, runs in zip(batch.column("__key").to_pylist(), batch.column("packed"), batch.column("runs"), strict=True):
                text = np.frombuffer(unpack.decompress(squeezed.as_buffer()), np.uint8)
                for r in runs.as_py():
                    slices.append(text[r["start"] : r["start"] + r["n"] + width - 1])
                    keys.append(key)
                    starts.append(r["start"])
                    known.append(r["known"])
                    held += len(slices[-1])
                    if held > SEGMENT:
                        yield flush()
                        slices, keys, starts, known, held = [], [], [], [], 0
        if held:
            yield flush()

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("text", text).withColumn("__key", F.xxhash64("doc_id", text))


def _marked_by(wanted: Shipped):
    """Whether a bitmap marks a hash, as a column function."""

    @F.pandas_udf("boolean")
    def has(h: pd.Series) -> pd.Series:
        return pd.Series(wanted.value.has(h.to_numpy(np.int64)))

    return has


def _texts(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """__key, the zstd-packed text and the runs of every document that has some in ``runs`` (__key, start, n, known).

    A bitmap keeps most other documents from travelling.
    """
    wanted = Shipped(docs.sparkSession, Bitmap(runs, "__key"))

    def squeeze(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            keys = batch.column("__key")
            rows = np.flatnonzero(wanted.value.has(keys.to_numpy()))
            texts = batch.column("text")
            out = [pack.compress(texts[i].as_buffer()) for i in rows.tolist()]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.array(out, pa.binary())], ["__key", "packed"])

    per_doc = runs.groupBy("__key").agg(F.collect_list(F.struct("start", "n", "known")).alias("runs"))  # bounded by the document
    return docs.select("__key", "text").mapInArrow(squeeze, "__key long, packed binary").join(per_doc.hint("merge"), "__key")


def front_coded(strings: np.ndarray, shared: np.ndarray) -> bytes:
    """The bytes of each row of ``strings`` after its first ``shared`` ones, joined."""
    keep = np.arange(strings.shape[1]) >= shared[:, None]
    return strings[keep].tobytes()


def decoded(shared: np.ndarray, rest: bytes, width: int) -> np.ndarray:
    """Back to one row of bytes per suffix."""
    out = np.zeros((len(shared), width), np.uint8)
    at = 0
    for i, s in enumerate(shared.tolist()):
        if s:
            out[i, :s] = out[i - 1, :s]
        out[i, s:] = np.frombuffer(rest, np.uint8, width - s, at)
        at += width - s
    return out


def _shared_with_previous(strings: np.ndarray) -> np.ndarray:
    out = np.zeros(len(strings), np.int64)
    if len(strings) > 1:
        differ = strings[1:] != strings[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), strings.shape[1])
    return out


class LoserTree:
    """Merges sorted streams of (string, shared with its predecessor in the stream, payload).

    A match compares the lengths shared with the last winner first; only equal lengths lead to a look at the bytes, and
    that starts after the shared ones.
    """

    def __init__(self, streams: list[Iterator[tuple[bytes, int, object]]], width: int):
        self.width, self.streams = width, streams
        self.size = 1
        while self.size < len(streams):
            self.size *= 2
        self.head: list[tuple[bytes, object] | None] = [None] * self.size
        self.shared = [-1] * self.size  # -1: exhausted
        self.lost = [0] * self.size
        for i, s in enumerate(streams):
            self._advance(i, first=True, stream=s)
        level = list(range(self.size))
        nodes = self.size
        while len(level) > 1:
            nodes //= 2
            level = [self._match(nodes + j, level[2 * j], level[2 * j + 1]) for j in range(nodes)]
        self.winner = level[0]

    def _advance(self, i: int, first: bool, stream) -> None:
        found = next(stream, None)
        if found is None:
            self.head[i], self.shared[i] = None, -1
        else:
            self.head[i] = (found[0], found[2])
            self.shared[i] = 0 if first else found[1]

    def _match(self, node: int, a: int, b: int) -> int:
        """Notes the loser at ``node`` with what it shares with the winner, and returns the winner."""
        x, y = self.shared[a], self.shared[b]
        if x == y and x >= 0:
            p, q = self.head[a][0], self.head[b][0]
            if x < self.width:
                d = int.from_bytes(p[x:]) ^ int.from_bytes(q[x:])
                same = self.width - (d.bit_length() + 7) // 8
                if same < self.width and p[same] > q[same]:
                    a, b = b, a
                self.shared[b] = same
        elif x < y:
            a, b = b, a
        self.lost[node] = b
        return a

    def __iter__(self):
        """(string, shared with the string before, payload) in order."""
        while self.shared[self.winner] >= 0:
            w = self.winner
            string, payload = self.head[w]
            yield string, self.shared[w], payload
            self._advance(w, False, self.streams[w])
            node = (self.size + w) // 2
            while node:
                w = self._match(node, w, self.lost[node])
                node //= 2
            self.winner = w


SPANS = "__key long, lo long, hi long"
_BLOCK_TYPES = pa.schema([("range", pa.int32()), ("shared", pa.binary()), ("rest", pa.binary()), ("docs", pa.binary()), ("at", pa.binary()), ("known", pa.binary()), ("size", pa.int32())])
_BLOCKS = "range int, shared binary, rest binary, docs binary, at binary, known binary, size int"


def _block(part: int, strings, shared, docs, at, known, codec) -> dict:
    shared = shared.copy()
    shared[0] = 0
    return {"range": part, "shared": packed(shared.astype(np.uint16), codec), "rest": codec.compress(front_coded(strings, shared)), "docs": packed(docs, codec), "at": packed(at, codec), "known": packed(known, codec), "size": len(strings)}


def _unblock(row: dict, width: int, codec):
    n = row["size"]
    shared = unpacked(row["shared"], n, np.uint16, codec).astype(np.int64)
    return decoded(shared, codec.decompress(row["rest"]), width), shared, unpacked(row["docs"], n, np.int64, codec), unpacked(row["at"], n, np.int64, codec), unpacked(row["known"], n, bool, codec)


def _joined(docs: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that start at ``at``, as spans (document, lo, hi) that join windows which touch."""
    order = np.lexsort((at, docs))
    docs, at = docs[order], at[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (at[1:] > at[:-1] + width)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(docs)) - 1 if len(docs) else first
    return docs[first], at[first], at[last] + width


def _open_windows(batches, width: int):
    """(windows, document, start, known, hash) of all windows of the open runs, about SORTED at a time."""
    hashing, unpack = RangeHash(22), zstandard.ZstdDecompressor()
    slices, docs, at, known, held, size = [], [], [], [], 0, 0

    def flush():
        data, sizes = np.concatenate(slices), np.array([len(s) for s in slices])
        first = np.cumsum(sizes) - sizes
        n = sizes - width + 1
        start = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        h = hashing.all_of(hashing.sums(data), width)[start]
        return np.lib.stride_tricks.sliding_window_view(data, width)[start], np.repeat(docs, n), np.repeat(at, n) + start - np.repeat(first, n), np.repeat(known, n), h

    for batch in batches:
        for key, text, runs in zip(batch.column("__key").to_pylist(), batch.column("packed"), batch.column("runs"), strict=True):
            data = np.frombuffer(unpack.decompress(text.as_buffer()), np.uint8)
            for r in runs.as_py():
                slices.append(data[r["start"] : r["start"] + r["n"] + width - 1])
                docs.append(key)
                at.append(r["start"])
                known.append(r["known"])
                held, size = held + r["n"], size + len(slices[-1])
                if held >= SORTED or size >= 4 * SEGMENT:
                    yield flush()
                    slices, docs, at, known, held, size = [], [], [], [], 0, 0
    if held:
        yield flush()


_HASHES = pa.schema([("bucket", pa.int32()), ("codes", pa.binary()), ("states", pa.binary()), ("size", pa.int32()), ("head", pa.binary())])


def _hash_batches(width: int, prefix: int, share: float):
    """Distinct hashes of the open windows, sorted and delta-coded, by hash prefix, and a sample of the windows themselves.

    The state of a hash is the number of unknown windows (2 at most), plus 4 if a known one has it.
    """

    def run(batches):
        codec = zstandard.ZstdCompressor(level=1)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            code, state = merged_states(held)
            edges = np.searchsorted(code >> np.uint64(64 - prefix), np.arange((1 << prefix) + 1, dtype=np.uint64)) if prefix else [0, len(code)]
            rows = [{"bucket": b, "codes": packed(np.diff(code[i:j], prepend=np.uint64(0)), codec), "states": packed(state[i:j], codec), "size": int(j - i), "head": None} for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if j > i]
            return pa.RecordBatch.from_pylist(rows, _HASHES)

        for windows, _, _, known, h in _open_windows(batches, width):
            drawn = np.flatnonzero((h >> np.uint64(11)) < np.uint64(int(share * 2**53)))
            if len(drawn):
                yield pa.RecordBatch.from_pylist([{"bucket": -1 - k % 64, "codes": None, "states": None, "size": 0, "head": windows[i].tobytes()} for k, i in enumerate(drawn.tolist())], _HASHES)
            held.append(merged_states([(h, np.where(known, 4, 1).astype(np.uint8))]))
            size += len(held[-1][0])
            if size > 1_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def merged_states(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and their joint states."""
    code, state = np.concatenate([c for c, _ in parts]), np.concatenate([s for _, s in parts])
    order = np.argsort(code, kind="stable")
    code, state = code[order], state[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    if not len(first):
        return code, state
    unknown = np.minimum(np.add.reduceat((state & 3).astype(np.int64), first), 2)
    return code[first], (unknown + np.maximum.reduceat(state & 4, first)).astype(np.uint8)


def _repeated_hashes(group: pa.Table) -> pa.Table:
    """Hashes of windows that something unknown shares with another window; sampled windows pass."""
    codec, heads, parts = zstandard.ZstdDecompressor(), [], []
    for row in group.to_pylist():
        if row["head"] is not None:
            heads.append(row["head"])
        else:
            parts.append((np.cumsum(unpacked(row["codes"], row["size"], np.uint64, codec), dtype=np.uint64), unpacked(row["states"], row["size"], np.uint8, codec)))
    if heads:
        return pa.table({"h": pa.nulls(len(heads), pa.int64()), "head": pa.array(heads, pa.binary())})
    code, state = merged_states(parts)
    code = code[((state & 3) >= 2) | (state >= 5)]
    return pa.table({"h": pa.array(code.view(np.int64)), "head": pa.nulls(len(code), pa.binary())})


def _sorted_batches(width: int, marks: Shipped, splitters: list[bytes]):
    """Front-coded sorted runs of the open suffixes whose hash repeats, cut into ranges; repeats found on the way as spans.

    Blocks with a range below 0 hold such spans: documents, first and last bytes.
    """

    def run(batches):
        codec, spread = zstandard.ZstdCompressor(level=1), 0
        for windows, docs, at, known, h in _open_windows(batches, width):
            keep = np.flatnonzero(marks.value.has(h))
            if not len(keep):
                continue
            raw, docs, at, known = windows[keep], docs[keep], at[keep], known[keep]
            data = raw.tobytes()
            strings = [data[i : i + width] for i in range(0, len(data), width)]
            order = np.array(sorted(range(len(strings)), key=strings.__getitem__))
            m, docs, at, known = raw[order], docs[order], at[order], known[order]
            shared = _shared_with_previous(m)
            group = np.cumsum(shared < width) - 1
            many = np.bincount(group) > 1
            found = many[group] & ~known
            first = np.flatnonzero(shared < width)
            any_known = many | (np.bincount(group, known) > 0)
            reps = [strings[i] for i in order[first].tolist()]
            cuts = [0, *[bisect.bisect_left(reps, s) for s in splitters], len(reps)]
            rows = []
            for part, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                for i in range(lo, hi, BLOCK):
                    j = min(i + BLOCK, hi)
                    at_ = first[i:j]
                    rows.append(_block(part, m[at_], shared[at_], docs[at_], at[at_], any_known[i:j], codec))
            if found.any():
                d, lo, hi = _joined(docs[found], at[found], width)
                spread += 1
                rows.append({"range": -1 - spread % 64, "shared": None, "rest": packed(hi, codec), "docs": packed(d, codec), "at": packed(lo, codec), "known": None, "size": len(d)})
            yield pa.RecordBatch.from_pylist(rows, _BLOCK_TYPES)

    return run


def _merged(width: int):
    def stream(row: dict, codec):
        strings, shared, d, p, k = _unblock(row, width, codec)
        raw = strings.tobytes()
        del strings  # all blocks of a range are open at once
        for i, (s, doc, at, known) in enumerate(zip(shared.tolist(), d.tolist(), p.tolist(), k.tolist(), strict=True)):
            yield raw[i * width : (i + 1) * width], s, (doc, at, known)

    def merge(group: pa.Table) -> pa.Table:
        codec, rows = zstandard.ZstdDecompressor(), group.to_pylist()
        if rows[0]["range"] < 0:
            columns = [np.concatenate([unpacked(r[c], r["size"], np.int64, codec) for r in rows]) for c in ("docs", "at", "rest")]
            return pa.table(dict(zip(("__key", "lo", "hi"), map(pa.array, columns), strict=True)))
        found: list[tuple[int, int]] = []
        before, size = None, 0
        for _, shared, item in LoserTree([stream(row, codec) for row in rows], width):
            if size and shared >= width:
                size += 1
                if size == 2 and not before[2]:
                    found.append(before[:2])
                if not item[2]:
                    found.append(item[:2])
            else:
                before, size = item, 1
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table(dict(zip(("__key", "lo", "hi"), map(pa.array, _joined(pairs[:, 0], pairs[:, 1], width)), strict=True)))

    return merge


def _judged(runs: DataFrame, width: int, label: str) -> tuple[DataFrame, DataFrame]:
    """What the contexts of a stored table of runs decide: (spans that repeat, one run for each context that stays open)."""
    contexts = runs.groupBy("key", "context").agg(F.count("*").alias("times"), F.max("known").alias("known"), F.max("own").alias("own"), F.min(F.struct("__key", "start", "n")).alias("one"))
    contexts = stored(contexts.select("key", "context", "times", (F.col("known") | (F.col("times") > 1)).alias("known"), "own", "one"), f"{label}-contexts")
    twice = contexts.where("times > 1").select("key", "context")
    sure = runs.where("not known").join(twice, ["key", "context"], "left_semi").select("__key", F.col("start").alias("lo"), (F.col("start") + F.col("n") + (width - 1)).alias("hi"))
    # a context is open if its group has another one, or if it may repeat within itself, and something is unknown in the group
    groups = contexts.groupBy("key").agg(F.count("*").alias("contexts"), F.min("known").alias("all_known"), F.max("own").alias("own"))
    groups = groups.where("(contexts > 1 or own) and not all_known").select("key")
    return sure, stored(contexts.join(groups, "key", "left_semi").select("one.*", "known"), f"{label}-open")


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, finer: int = FINER) -> DataFrame:
    """(__key, lo, hi): byte ranges whose union is what repeats, for documents as ``_keyed`` gives them."""
    spark = docs.sparkSession
    long = docs.where(F.octet_length("text") >= width).select("__key", "text")
    counts = long.mapInArrow(_run_batches(width, gram), _RUN).groupBy("key").agg(F.count("*").alias("times"), F.max("own").alias("own"))
    again = stored(counts.where("times > 1 or own").select("key"), "repeat-keys")
    marks = Shipped(spark, Bitmap(again, "key"))
    seen = stored(long.mapInArrow(_run_batches(width, gram, marks), _RUN).join(again, "key").withColumn("known", F.lit(False)), "repeat-runs")
    sure, open_runs = _judged(seen, width, "repeat")

    seen = stored(_texts(long, open_runs).mapInArrow(_finer_batches(width, finer), _RUN + ", known boolean"), "finer-runs")
    more, open_runs = _judged(seen, width, "finer")
    sure = sure.union(more)

    total = open_runs.agg(F.sum("n")).first()[0] or 0
    if not total:
        return sure
    prefix = max(0, math.ceil(math.log2(total / HASHES))) if total > HASHES else 0
    hashes = _texts(long, open_runs).mapInArrow(_hash_batches(width, prefix, min(1.0, SAMPLE / total)), "bucket int, codes binary, states binary, size int, head binary")
    repeated = stored(hashes.groupBy("bucket").applyInArrow(_repeated_hashes, "h long, head binary"), "repeat-hashes")
    marks = Shipped(spark, Bitmap(repeated.where("head is null"), "h"))
    heads = sorted(bytes(r["head"]) for r in repeated.where("head is not null").select("head").collect())  # about SAMPLE
    ranges = max(1, min(-(-total // RANGE), len(heads)))
    splitters = sorted({heads[len(heads) * j // ranges] for j in range(1, ranges)})
    blocks_ = _texts(long, open_runs).mapInArrow(_sorted_batches(width, marks, splitters), _BLOCKS)
    return sure.union(blocks_.groupBy("range").applyInArrow(_merged(width), SPANS))


def _covered(spans, size: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, min(hi, size)) for lo, hi in out]


def _with_spans(docs: DataFrame, width: int, gram: int, finer: int) -> tuple[DataFrame, DataFrame]:
    """(rows without repeats, rows that may have some with their ``__spans``), both with the columns of ``docs`` and __key."""
    keyed = _keyed(docs)
    spans = stored(repeated_spans(keyed.select("text", "__key"), width, gram, finer), "repeat-spans")
    per_doc = spans.groupBy("__key").agg(F.collect_list(F.struct("lo", "hi")).alias("__spans"))  # bounded by the document
    marked = _marked_by(Shipped(docs.sparkSession, Bitmap(spans, "__key")))
    return keyed.where(~marked("__key")), keyed.where(marked("__key")).join(per_doc.hint("merge"), "__key", "left")


def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, finer: int = FINER) -> DataFrame:
    """``docs`` with the repeated bytes taken out of text; all other columns as they are."""

    @F.pandas_udf("string")
    def rest(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, spans, strict=True):
            if found is not None and len(found):
                raw, at, parts = text.encode(), 0, []
                for lo, hi in _covered([(s["lo"], s["hi"]) for s in found], len(raw)):
                    parts.append(raw[at:lo])
                    at = hi
                text = b"".join([*parts, raw[at:]]).decode(errors="ignore")
            out.append(text)
        return pd.Series(out)

    clean, touched = _with_spans(docs, width, gram, finer)
    return clean.select(*docs.columns).union(touched.withColumn("text", rest("text", "__spans")).select(*docs.columns))


def removal_report(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, finer: int = FINER) -> DataFrame:
    """Query columns: bytes, removed bytes, removed runs, and the digest of what stays."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = [], [], [], []
            for squeezed, found in zip(batch.column("packed"), batch.column("__spans"), strict=True):
                raw, at, digest, gone = unpack.decompress(squeezed.as_buffer()), 0, hashlib.sha256(), 0
                runs = _covered([(s["lo"], s["hi"]) for s in found.as_py() or ()], len(raw))
                for lo, hi in runs:
                    digest.update(raw[at:lo])
                    gone, at = gone + hi - lo, hi
                digest.update(raw[at:])
                for column, v in zip(out, (len(raw), gone, len(runs), digest.hexdigest()), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    def squeeze(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows = np.flatnonzero(wanted.value.has(batch.column("__key").to_numpy()))
            texts, at = batch.column("text"), pa.array(rows)
            out = [pack.compress(texts[i].as_buffer()) for i in rows.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("__key").take(at), pa.array(out, pa.binary())], ["doc_id", "__key", "packed"])

    keyed = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    spans = stored(repeated_spans(keyed.select("text", "__key"), width, gram, finer), "repeat-spans")
    wanted = Shipped(docs.sparkSession, Bitmap(spans, "__key"))
    marked = _marked_by(wanted)
    per_doc = spans.groupBy("__key").agg(F.collect_list(F.struct("lo", "hi")).alias("__spans"))  # bounded by the document
    touched = keyed.select("doc_id", "__key", "text").mapInArrow(squeeze, "doc_id long, __key long, packed binary").join(per_doc.hint("merge"), "__key", "left")
    none = F.lit(0).cast("long")
    clean = keyed.where(~marked("__key")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return clean.union(touched.select("doc_id", "packed", "__spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
