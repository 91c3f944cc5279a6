"""Operator 3: byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary (as many slots as tokens, one stored displacement per bucket) finds
pre-tokens that are whole tokens. Tier two: the other pre-tokens are merged pair by pair, lowest rank first, with a heap
over linked byte ranges. Each worker keeps the ids of the pre-tokens it has met, in a store of bounded size.

The vocabulary file is read once on the driver; its tables have the size of that file and are broadcast.

Defined cases: a null text is empty and has no ids; texts are read whole, whatever their length; repeated rows are encoded
alike; an empty table gives an empty result; further columns are not read. Text that looks like a special token is text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from curatrix.llm.common import Remembered, Shipped, id_and_text, mixed

#: Pre-tokens of one generation whose ids a worker keeps.
KEPT = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())}


class PerfectHash:
    """Slots 0..n-1 for n byte strings. Large buckets look for a displacement, single keys name a free slot."""

    def __init__(self, keys: list[bytes]):
        self.size = n = len(keys)
        self.buckets = max(1, n // 3)
        h = self.hashes(keys)
        bucket = (h >> np.uint64(32)) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1, dtype=np.uint64))
        groups = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.shift = np.zeros(self.buckets, np.int64)
        taken, slot_of = np.zeros(n, bool), np.zeros(n, np.int64)
        for b in sorted((b for b in range(self.buckets) if len(groups[b]) > 1), key=lambda b: -len(groups[b])):
            first, mine = 1, h[groups[b]][None, :]
            while True:  # 64 displacements at a time
                slots = np.sort(self._displaced(mine, np.arange(first, first + 64)[:, None]), axis=1)
                fits = ~taken[slots].any(1) & (slots[:, 1:] != slots[:, :-1]).all(1)
                if fits.any():
                    break
                first += 64
            d = first + int(fits.argmax())
            slots = self._displaced(mine[0], np.int64(d))
            taken[slots], slot_of[groups[b]], self.shift[b] = True, slots, d
        free = iter(np.flatnonzero(~taken).tolist())
        for b in (b for b in range(self.buckets) if len(groups[b]) == 1):
            slot = next(free)
            slot_of[groups[b]], self.shift[b] = slot, -slot - 1
        self.slot_of = slot_of

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def _displaced(self, h: np.ndarray, d) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mixed(h + np.asarray(d).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.size)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """A slot for every key; only keys of the set own theirs."""
        h = self.hashes(keys)
        d = self.shift[((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(d < 0, -d - 1, self._displaced(h, np.maximum(d, 0)))


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        words = list(ranks)
        self.pattern, self.ranks = pattern, ranks
        self.hash = PerfectHash(words)
        self.word_at: list[bytes] = [b""] * len(words)
        self.id_at: list[int] = [0] * len(words)
        for word, slot in zip(words, self.hash.slot_of.tolist(), strict=True):
            self.word_at[slot], self.id_at[slot] = word, ranks[word]
        self.bytes_of = {i: w for w, i in ranks.items()}
        self.kept = Remembered(KEPT)
        self.find = None

    def __getstate__(self):
        return self.__dict__ | {"kept": Remembered(KEPT), "find": None}

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: the adjacent pair of lowest rank merges first, the leftmost of equals."""
        ranks, n = self.ranks, len(piece)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop or not alive[j]:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                rank = ranks.get(piece[i : end[stop]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, end[stop]))
            k = before[i]
            if k >= 0:
                rank = ranks.get(piece[k:stop])
                if rank is not None:
                    heapq.heappush(heap, (rank, k, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text. New pre-tokens go through the perfect hash at once, those that are no tokens are merged one by one."""
        if self.find is None:
            self.find = regex.compile(self.pattern).findall
        pieces = self.find(text)
        new = self.kept.missing(pieces)
        if new:
            raw = [p.encode() for p in new]
            for p, b, slot in zip(new, raw, self.hash.slots(raw).tolist(), strict=True):
                ids = (self.id_at[slot],) if self.word_at[slot] == b else self.merged(b)
                self.kept.young[p] = array("i", ids).tobytes()
        return np.frombuffer(b"".join(map(self.kept.young.__getitem__, pieces)), np.int32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encoded(docs: DataFrame, made: Codec) -> DataFrame:
    """doc_id and ids (array of int) for every document."""
    tables = Shipped(docs.sparkSession, made)

    def run(batches):
        one = tables.value
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                ids = [one.encode(t.as_py()) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, made: Codec) -> DataFrame:
    """doc_id and the bytes of ``ids``; a null list is empty."""
    tables = Shipped(ids.sparkSession, made)

    def run(batches):
        one = tables.value
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                data = [one.decode(x.as_py() or ()) for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip_report(docs: DataFrame, made: Codec) -> DataFrame:
    """Query columns: the number of ids, the digest of the ids as text, and the digest of the bytes they decode to."""
    tables = Shipped(docs.sparkSession, made)

    def run(batches):
        one = tables.value
        written = {i: str(i) for i in one.bytes_of}
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part, count, a, b = batch.slice(first, 256), [], [], []
                for t in part.column("text"):
                    ids = one.encode(t.as_py()).tolist()
                    count.append(len(ids))
                    a.append(hashlib.sha256(",".join(map(written.__getitem__, ids)).encode()).hexdigest())
                    b.append(hashlib.sha256(one.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
