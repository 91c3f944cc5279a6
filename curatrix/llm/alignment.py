"""Operator 11: alignment of the tokens of a byte-level tokenizer (A) and a piece tokenizer (B) over the same texts.

A space and the text are encoded by both. Byte offsets at which tokens of both end cut the tokens into groups, and the two
tokens that end there are a link. How often each id pair is linked in the whole corpus comes from inverted bitmaps:

* documents are numbered within containers of 2**14. For every linked id pair, a container has a compressed bitmap of its
  documents (plane 0) and multiplicity planes: plane 1 + k holds bit k of (links of the pair in the document - 1). A sparse
  bitmap is a sorted array of 16-bit numbers, a dense one a bit array, the smaller of both;
* tasks write partial bitmaps, as often as their buffer is full; partial bitmaps of one pair, plane and container are OR-merged
  and popcounted. Documents of a pair: the popcounts of plane 0. Links: those, and each plane's popcount times its weight;
* the postings return the scores: they are joined with their pair's count and walked container by container, so that every
  document sums over its links without a row per link.

A posting has at most one row per pair, plane and container, however frequent the pair; no list of all documents is held anywhere.

Defined cases: null and empty texts, and texts whose joined tokens differ from a space and the text (A or B normalises or lacks
something), have no tokens: zeros and an empty digest; repeated rows are documents of their own; texts are read whole; ties for
the highest count of a B id all count as best; an empty table gives an empty result; further columns are not read. Strings
of special tokens are plain text.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import Shipped, id_and_text, stored
from curatrix.llm.units import Memo, UnitTokenizer, byte_values, units

#: Documents of one container, as a power of two: their numbers fit 16 bits.
CONTAINER = 14
DOCS = 1 << CONTAINER
#: A bitmap of at least this many documents is a bit array, a smaller one an array of numbers.
DENSE = DOCS // 16
#: Links that a task holds before it writes partial bitmaps.
HELD = 4 << 20
#: Units of one generation whose alignment a worker keeps.
KEPT = 400_000
#: Bits of a B id in a pair's key.
B_BITS = 20


#: The alignment of a text that its tokens do not spell.
NONE = (b"", "", 0, 0)


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Aligner:
    """Both tokenizers, and the alignment of every unit met lately."""

    def __init__(self, spec: str, model: bytes):
        self.a, self.model, self.b = UnitTokenizer(spec, special=False, room=KEPT // 4), model, None

    def __getstate__(self):
        return {"a": self.a, "model": self.model, "b": None}

    def _load(self) -> None:
        import sentencepiece

        self.a._load()
        self.b = b = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        value = byte_values()
        words = map(self.a.tool.id_to_token, range(self.a.tool.get_vocab_size(with_added_tokens=True)))
        self.a_bytes = [bytes(value[c] for c in w) if w and all(c in value for c in w) else (w or "").encode() for w in words]
        self.b_bytes = [piece_bytes(b.id_to_piece(i)) for i in range(b.get_piece_size())]
        #: A piece with a space behind another character could merge across the cut of two units.
        self.cuts = self.a.cuts and not any(b" " in p.lstrip(b" ") for p in self.b_bytes)
        self.name = list(map(str, range(max(len(self.a_bytes), len(self.b_bytes)))))
        self.kept, self.ready = Memo(KEPT, self._unit), {}

    def _unit(self, part: str) -> tuple[bytes, str, int, int]:
        """The alignment of a space and ``part``; B adds that space itself."""
        a_ids = np.frombuffer(self.a.spaced[part] if self.cuts else self.a.payload(" " + part), self.a.dtype).tolist()
        b_ids = self.ready.pop(part, None)
        return self.align(" " + part, a_ids, self.b.encode(part) if b_ids is None else b_ids)

    def align(self, part: str, a_ids: list[int], b_ids: list[int]) -> tuple[bytes, str, int, int]:
        """Links (pair keys), groups as text and the numbers of tokens; NONE where the tokens do not spell the text."""
        a_bytes, b_bytes, name = self.a_bytes, self.b_bytes, self.name
        raw = part.encode()
        if b"".join([a_bytes[x] for x in a_ids]) != raw or b"".join([b_bytes[y] for y in b_ids]) != raw:
            return NONE
        if len(a_ids) == 1 or len(b_ids) == 1:
            return ((a_ids[-1] << B_BITS) + b_ids[-1]).to_bytes(8, "little"), f"{','.join([name[x] for x in a_ids])}|{','.join([name[y] for y in b_ids])}", len(a_ids), len(b_ids)
        links, groups, some_a, some_b = array("q"), [], [], []
        end_a = end_b = 0
        next_b = iter(b_ids)
        for x in a_ids:
            end_a += len(a_bytes[x])
            some_a.append(name[x])
            while end_b < end_a:
                y = next(next_b)
                end_b += len(b_bytes[y])
                some_b.append(name[y])
            if end_a == end_b:
                links.append((x << B_BITS) + y)
                groups.append(f"{','.join(some_a)}|{','.join(some_b)}")
                some_a, some_b = [], []
        return links.tobytes(), ";".join(groups), len(a_ids), len(b_ids)

    @staticmethod
    def parts(text: str) -> list[str]:
        """The units of a space and ``text``, each without the space that it starts with."""
        first, rest = units(" " + text)
        return [first[1:], *rest] if first else rest

    def meet(self, texts: list[str]) -> None:
        """B ids of the new units of some texts at once: one call of the library costs as much as many units."""
        if self.b is None:
            self._load()
        if self.cuts:
            kept, old = self.kept, self.kept.old
            new = {p for t in texts if t for p in self.parts(t) if p not in kept and p not in old}
            self.ready = dict(zip(new, self.b.encode(list(new), num_threads=1) if new else (), strict=True))

    def text(self, text: str) -> tuple[np.ndarray, str, int, int] | None:
        """Links, groups and numbers of tokens of a whole text."""
        if not text:
            return None
        if self.b is None:
            self._load()
        found = list(map(self.kept.__getitem__, self.parts(text))) if self.cuts else [self._unit(text)]
        if NONE in found:  # a unit that is not spelled out is not spelled out in the text either
            return None
        links, groups, a, b = zip(*found, strict=True)
        return np.frombuffer(b"".join(links), "<i8"), ";".join(groups), sum(a), sum(b)


def planes(keys: np.ndarray, docs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(plane, sorted entries): entries are pair key and document number in one integer."""
    entry, links = np.unique((keys << CONTAINER) | docs, return_counts=True)
    yield 0, entry
    more = links - 1
    for k in range(int(more.max(initial=0)).bit_length()):
        yield k + 1, entry[more >> k & 1 == 1]


def compressed(entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Distinct pair keys of sorted entries, the popcount and the bitmap of each."""
    key = entry >> CONTAINER
    low = (entry & (DOCS - 1)).astype("<u2")
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    ends = np.append(first[1:], len(key))[: len(first)]
    raw = low.tobytes()
    out = [raw[2 * a : 2 * b] if b - a < DENSE else dense(low[a:b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
    return key[first], ends - first, out


def dense(low: np.ndarray) -> bytes:
    bits = np.zeros(DOCS, np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def members(bitmap: bytes) -> np.ndarray:
    """The document numbers of a bitmap of either form."""
    if len(bitmap) < 2 * DENSE:
        return np.frombuffer(bitmap, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")).astype("<u2")


def popcount(bitmap: bytes) -> int:
    return len(bitmap) // 2 if len(bitmap) < 2 * DENSE else int.from_bytes(bitmap, "little").bit_count()


def merged(some: list[bytes]) -> bytes:
    """The OR of bitmaps of one container."""
    if any(len(x) >= 2 * DENSE for x in some) or sum(map(len, some)) >= 2 * DENSE:
        bits = np.zeros(DOCS // 8, np.uint8)
        for x in some:
            bits |= np.frombuffer(x if len(x) >= 2 * DENSE else dense(np.frombuffer(x, "<u2")), np.uint8)
        out = bits.tobytes()
        return out if popcount(out) >= DENSE else members(out).tobytes()
    return np.unique(np.concatenate([np.frombuffer(x, "<u2") for x in some])).astype("<u2").tobytes()


PARTS = "container long, low int, doc_id long, n_a long, n_b long, n_links long, groups_sha256 string, a int, b int, plane int, bits binary"


def aligned_parts(docs: DataFrame, spec: str, model: bytes) -> DataFrame:
    """One row per document (``low`` is set) and the partial bitmaps of its container (``plane`` is set)."""
    sent = Shipped(docs.sparkSession, Aligner(spec, model))

    def run(batches):
        one, task = sent.value, TaskContext.get().partitionId() << 32
        container, used, held, keys, lows = 0, 0, 0, [], []

        def flush():
            nonlocal held, keys, lows
            if keys:
                yield from _posting_batches(task + container, np.concatenate(keys), np.concatenate(lows))
            held, keys, lows = 0, [], []

        for batch in batches:
            rows = []
            met = 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if met % 64 == 0:
                    one.meet(batch.column("text").slice(met, 64).to_pylist())
                met += 1
                if used == DOCS:
                    yield from flush()
                    container, used = container + 1, 0
                found = one.text(text.as_py())
                if found is None:
                    rows.append((task + container, used, doc, 0, 0, 0, ""))
                else:
                    links, groups, a, b = found
                    rows.append((task + container, used, doc, a, b, len(links), hashlib.sha256(groups.encode()).hexdigest()))
                    keys.append(links)
                    lows.append(np.full(len(links), used, np.int64))
                    held += len(links)
                used += 1
                if held >= HELD:
                    yield from flush()
            if rows:
                container_, low, ident, a, b, n, digest = zip(*rows, strict=True)
                none = pa.nulls(len(rows), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(container_, pa.int64()), pa.array(low, pa.int32()), *[pa.array(c, pa.int64()) for c in (ident, a, b, n)], pa.array(digest, pa.string()), none, none, none, pa.nulls(len(rows), pa.binary())],
                    [f.split()[0] for f in PARTS.split(", ")])
        yield from flush()

    return id_and_text(docs).mapInArrow(run, PARTS)


def _posting_batches(container: int, keys: np.ndarray, lows: np.ndarray) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in PARTS.split(", ")]
    for plane, entry in planes(keys, lows):
        key, _, bits = compressed(entry)
        for i in range(0, len(key), 1 << 15):
            k = key[i : i + (1 << 15)]
            n = len(k)
            long, text = pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, container)), pa.nulls(n, pa.int32()), long, long, long, long, text, pa.array((k >> B_BITS).astype(np.int32)), pa.array((k & ((1 << B_BITS) - 1)).astype(np.int32)), pa.array(np.full(n, plane, np.int32)), pa.array(bits[i : i + n], pa.binary())],
                names)


def postings(parts: DataFrame) -> DataFrame:
    """One bitmap per pair, plane and container with its popcount: partial ones are OR-merged."""
    key = ["a", "b", "plane", "container"]

    def run(batches):
        last, some = None, []
        for batch in batches:
            out = []
            for *k, bits in zip(*(batch.column(c).to_pylist() for c in (*key, "bits")), strict=True):
                if k == last:
                    some.append(bits)
                    if len(some) == 64:
                        some = [merged(some)]
                    continue
                if last is not None:
                    out.append((*last, merged(some) if len(some) > 1 else some[0]))
                last, some = k, [bits]
            yield _posting_rows(out)
        if last is not None:
            yield _posting_rows([(*last, merged(some) if len(some) > 1 else some[0])])

    spread = parts.where("plane IS NOT NULL").select(*key, "bits").repartition(*key).sortWithinPartitions(*key)
    return spread.mapInArrow(run, "a int, b int, plane int, container long, bits binary, n long")


def _posting_rows(rows: list[tuple]) -> pa.RecordBatch:
    a, b, plane, container, bits = zip(*rows, strict=True) if rows else ([],) * 5
    return pa.RecordBatch.from_arrays(
        [*[pa.array(c, pa.int32()) for c in (a, b, plane)], pa.array(container, pa.int64()), pa.array(bits, pa.binary()), pa.array(list(map(popcount, bits)), pa.int64())],
        ["a", "b", "plane", "container", "bits", "n"])


def links_of(plane: str = "plane"):
    """How many links a document of a plane stands for."""
    return F.when(F.col(plane) == 0, F.lit(1).cast("long")).otherwise(F.expr(f"shiftleft(1L, {plane} - 1)"))


def pair_counts(found: DataFrame) -> DataFrame:
    """a, b, docs (documents that link the pair), links (its links in the corpus), best (no A id has more links with b)."""
    counted = found.groupBy("a", "b").agg(F.sum(F.when(F.col("plane") == 0, F.col("n")).otherwise(0)).alias("docs"), F.sum(F.col("n") * links_of()).alias("links"))
    most = counted.groupBy("b").agg(F.max("links").alias("most"))
    return counted.join(most, "b").select("a", "b", "docs", "links", (F.col("links") == F.col("most")).alias("best"))


def returned(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """container, low, n_best, count_sum of every document with links, summed over the bitmaps of its container."""

    def run(batches):
        at, best, total, seen = None, None, None, None

        def row_batch():
            low = np.flatnonzero(seen)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(low), at)), pa.array(low.astype(np.int32)), pa.array(best[low]), pa.array(total[low])], ["container", "low", "n_best", "count_sum"])

        for batch in batches:
            container = batch.column("container").to_numpy()
            weight, count, top = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("weight", "links", "best"))
            bits = batch.column("bits").to_pylist()
            edges = np.flatnonzero(np.r_[True, container[1:] != container[:-1]]).tolist() if len(container) else []
            for i, j in zip(edges, [*edges[1:], len(container)], strict=True):
                if container[i] != at:
                    if at is not None:
                        yield row_batch()
                    at, best, total, seen = int(container[i]), np.zeros(DOCS, np.int64), np.zeros(DOCS, np.int64), np.zeros(DOCS, bool)
                low = [members(x) for x in bits[i:j]]
                size = list(map(len, low))
                low = np.concatenate(low)
                seen[low] = True
                np.add.at(total, low, np.repeat(weight[i:j] * count[i:j], size))
                np.add.at(best, low, np.repeat(weight[i:j] * top[i:j], size))
        if at is not None:
            yield row_batch()

    scored = found.join(pairs.select("a", "b", "links", "best"), ["a", "b"]).select("container", "bits", links_of().alias("weight"), "links", F.col("best").cast("long").alias("best"))
    return scored.repartition("container").sortWithinPartitions("container").mapInArrow(run, "container long, low int, n_best long, count_sum long")


def alignment_report(docs: DataFrame, spec: str, model: bytes) -> DataFrame:
    """Query columns: numbers of tokens, groups and links of every document, what its links score in the corpus, and the digest of its groups."""
    parts = stored(aligned_parts(docs, spec, model), "alignment-parts")
    found = stored(postings(parts), "alignment-postings")
    scores = returned(found, stored(pair_counts(found), "alignment-pairs"))
    rows = parts.where("low IS NOT NULL").select("container", "low", "doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "groups_sha256")
    zero = F.lit(0).cast("long")
    return rows.join(scores, ["container", "low"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def aligned_groups(docs: DataFrame, spec: str, model: bytes) -> DataFrame:
    """doc_id and ``groups``: the A and B ids of every group, as ``a1,a2|b1;a3|b2,b3`` (empty without tokens)."""
    sent = Shipped(docs.sparkSession, Aligner(spec, model))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [sent.value.text(t.as_py()) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(["" if f is None else f[1] for f in found], pa.string())], ["doc_id", "groups"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, groups string")
