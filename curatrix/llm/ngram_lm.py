"""Operator 2: language-model scoring with a log-frequency Bloom filter.

Tokens are the A-Z-lowered words of a text (between ASCII white space) and one end. Counts of words are exact, by string; counts
of word pairs and triples live in a Bloom filter: a count c has the level 1 + floor(log2 c), and a key is inserted once per
level up to its own, so that its level is found by probing level after level until one is missing.

How it runs:

1. One pass cuts the corpus into chunks of documents. A chunk keeps its distinct words and its tokens as their numbers (packed),
   so that no text is split again, and, for every bucket of words, its words with how often its training documents use them.
2. Each bucket of words adds up the counts of all chunks and answers every chunk in the order of its own words. So every
   chunk gets exact counts for just the words it has; no vocabulary is broadcast.
3. Pairs and triples travel as sorted, delta-coded hash blocks, one bucket per hash prefix; the buckets grow in number with
   the corpus. A bucket adds up its counts and builds its own segment of the filter, with as many bits as its keys need, so
   every level of every n-gram is kept whatever the size of the corpus.
4. Where the training tokens leave the filter below ``most_bits``, it is broadcast. Otherwise no task ever holds the
   whole filter: the blocks of step 3 name their chunk and hold the n-grams of all its documents, and a bucket answers each
   block with the levels that its segment gives. Both ways probe the same segments and give the same scores.
5. A chunk meets its counts (and levels) and is scored.

Probabilities: unknown words share the mass u = (n1 + 1) / (N + n1 + 2) (n1: words seen once); a known word has
(1 - u)(c + 1) / (N + V). A history that was seen mixes in count(history, word) / count(history) with the weight ``mix``, for one word
of history and then for two. Level counts use their lower edge, so probabilities over all words sum to at most one, but for
the filter's false positives (about 0.1 % of absent keys per level).

Defined cases: a null text is empty and is the end alone; without any training token u is 1; texts repeated in training
count each time; a null doc_id counts as the empty text in crc32; an empty table gives an empty result; a long document
is a chunk of its own; further columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import Shipped, id_and_text, mixed, packed, remainder, stored, unpacked

PROBES = 10
MOST_BITS = 1 << 28  # of a broadcast filter
MIX = 0.1
CHUNK = 4 << 20  # bytes of text in a chunk
HELD = 2_000_000  # n-grams that a task sums up before it sends them
START = np.uint64(0x5851F42D4C957F2D)
END = b" "  # no word holds white space
EDGES = np.concatenate([[0.0], 2.0 ** np.arange(64)])  # lower edge of the counts of each level


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def pair_codes(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + word * np.uint64(0xD1B54A32D192ED03) + np.uint64(2))


def triple_codes(first: np.ndarray, second: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(first * np.uint64(0x8CB92BA72F3D8DD7) + second * np.uint64(0x9E3779B97F4A7C15) + word * np.uint64(0xD1B54A32D192ED03) + np.uint64(3))


def numbers() -> dict[bytes, int]:
    """Numbers words in the order in which they are first looked up."""
    return defaultdict(itertools.count().__next__)


class Numbered:
    """The tokens of a chunk's documents in a row, as numbers of its distinct words, and the number of tokens of each document."""

    def __init__(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray):
        self.words, self.ids, self.sizes, self.hashes = words, ids, sizes, word_hashes(words)

    @classmethod
    def of(cls, texts: list[bytes]) -> Numbered:
        index, ids = numbers(), []
        for text in texts:
            words = tokens(text)
            ids.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
        return cls(list(index), np.concatenate(ids), np.array([len(d) for d in ids], np.int64))

    @classmethod
    def read(cls, row: dict, codec) -> Numbered:
        sizes = np.array(row["sizes"], np.int64)
        return cls(codec.decompress(row["words"]).split(b"\n"), unpacked(row["tokens"], int(sizes.sum()), np.uint32, codec), sizes)

    def buckets(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The words in the order of their buckets, and where each bucket begins."""
        bucket = (self.hashes % np.uint64(n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(n + 1))

    def sequence(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of start, words and end of all documents, and where the starts are."""
        out = np.empty(len(self.ids) + len(self.sizes), np.uint64)
        is_start = np.zeros(len(out), bool)
        is_start[np.cumsum(self.sizes + 1) - (self.sizes + 1)] = True
        out[is_start] = START
        out[~is_start] = self.hashes[self.ids]
        return out, is_start


def _chunks(batches) -> Iterator[tuple[list, list[bool], list[bytes]]]:
    ids, train, texts, held = [], [], [], 0
    for batch in batches:
        for doc, learn, text in zip(batch.column("doc_id").to_pylist(), batch.column("train").to_pylist(), batch.column("text"), strict=True):
            raw = text.as_buffer().to_pybytes()
            if held and held + len(raw) > CHUNK:
                yield ids, train, texts
                ids, train, texts, held = [], [], [], 0
            ids.append(doc)
            train.append(learn)
            texts.append(raw)
            held += len(raw)
    if ids:
        yield ids, train, texts


_CHUNK_SCHEMA = "chunk long, bucket int, ids array<long>, train array<boolean>, sizes array<long>, tokens binary, words binary, counts binary, n int"
_CHUNK_TYPES = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("tokens", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("n", pa.int32())])


def _cut(buckets: int):
    """Rows of two kinds: a chunk's documents (bucket -1), and its words in one bucket with their counts in training."""

    def run(batches):
        codec = zstandard.ZstdCompressor(level=1)
        first = TaskContext.get().partitionId() << 32
        for k, (ids, train, texts) in enumerate(_chunks(batches)):
            nothing = {"ids": None, "train": None, "sizes": None, "tokens": None, "words": None, "counts": None, "n": None}
            made = Numbered.of(texts)
            rows = [{**nothing, "chunk": first + k, "bucket": -1, "ids": ids, "train": train, "sizes": made.sizes.tolist(), "tokens": packed(made.ids, codec), "words": codec.compress(b"\n".join(made.words))}]
            counts = np.bincount(made.ids[np.repeat(np.array(train, bool), made.sizes)], minlength=len(made.words))
            order, edges = made.buckets(buckets)
            for b in range(buckets):
                mine = order[edges[b] : edges[b + 1]]
                if len(mine):
                    rows.append({**nothing, "chunk": first + k, "bucket": b, "words": codec.compress(b"\n".join(made.words[i] for i in mine.tolist())), "counts": packed(counts[mine].astype(np.uint32), codec), "n": len(mine)})
            yield pa.RecordBatch.from_pylist(rows, _CHUNK_TYPES)

    return run


def _answers(group: pa.Table) -> pa.Table:
    """Adds up the counts of a bucket's words, answers every chunk in its order, and tells the bucket's totals (chunk -1)."""
    codec, back = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    index = numbers()
    asked, parts = [], []
    for row in group.select(["chunk", "words", "counts", "n"]).to_pylist():
        asked.append((row["chunk"], np.fromiter(map(index.__getitem__, codec.decompress(row["words"]).split(b"\n")), np.int64, row["n"])))
        parts.append(unpacked(row["counts"], row["n"], np.uint32, codec))
    total = np.zeros(len(index), np.int64)
    for (_, at), n in zip(asked, parts, strict=True):
        total[at] += n  # the words of a chunk are distinct
    bucket = group.column("bucket")[0].as_py()
    rows = [{"chunk": c, "bucket": bucket, "counts": packed(total[at], back), "n": len(at), "tokens": None, "types": None, "once": None} for c, at in asked]
    rows.append({"chunk": -1, "bucket": bucket, "counts": None, "n": None, "tokens": int(total.sum()), "types": int((total > 0).sum()), "once": int((total == 1).sum())})
    return pa.Table.from_pylist(rows, pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("n", pa.int32()), ("tokens", pa.int64()), ("types", pa.int64()), ("once", pa.int64())]))


_BLOCK_TYPES = pa.schema([("bucket", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary()), ("n", pa.int32())])


def _blocks(code: np.ndarray, n: np.ndarray, bits: int, prefix: int, codec) -> list[dict]:
    """Sorted distinct codes and their counts, cut by hash prefix."""
    edges = np.searchsorted(code >> np.uint64(bits - prefix), np.arange((1 << prefix) + 1, dtype=np.uint64))
    rows = []
    for b in range(1 << prefix):
        c = code[edges[b] : edges[b + 1]]
        if len(c):
            rows.append({"bucket": b, "codes": packed(np.diff(c, prepend=np.uint64(0)), codec), "counts": packed(n[edges[b] : edges[b + 1]], codec), "n": len(c)})
    return rows


def summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and the sums of their counts."""
    order = np.argsort(code)
    code, n = code[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[first], np.add.reduceat(n, first).astype(np.uint32)


def ngram_codes(seq: np.ndarray, is_start: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all pairs, then of all triples, of a chunk's ``sequence``, and the places where the pairs and the triples end."""
    two, three = np.flatnonzero(~is_start[1:]) + 1, np.flatnonzero(~(is_start[1:-1] | is_start[2:])) + 2
    pairs, triples = pair_codes(seq[two - 1], seq[two]), triple_codes(seq[three - 2], seq[three - 1], seq[three])
    return np.concatenate([pairs, triples]) >> np.uint64(64 - bits), two, three


def _chunk_blocks(bits: int, prefix: int):
    """Blocks of the pairs and triples of each chunk; held-out documents add theirs with the count 0."""

    def run(batches):
        codec, back = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                made = Numbered.read(row, back)
                code, two, three = ngram_codes(*made.sequence(), bits)
                learn = np.repeat(np.array(row["train"], np.uint32), made.sizes + 1)
                code, n = summed(code, np.concatenate([learn[two], learn[three]]))
                rows = [{"chunk": row["chunk"], **r} for r in _blocks(code, n, bits, prefix, codec)]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("chunk", pa.int64()), *_BLOCK_TYPES]))

    return run


def _ngram_blocks(bits: int, prefix: int):
    """Sorted hash blocks of the pairs and triples of training documents, by hash prefix."""

    def run(batches):
        codec = zstandard.ZstdCompressor(level=1)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            code, n = summed(np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held]))
            yield pa.RecordBatch.from_pylist(_blocks(code, n, bits, prefix, codec), _BLOCK_TYPES)

        for _, _, texts in _chunks(batches):
            code, n = np.unique(ngram_codes(*Numbered.of(texts).sequence(), bits)[0], return_counts=True)
            held.append((code, n))
            size += len(code)
            if size > HELD:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


def bit_places(code: np.ndarray, level: np.ndarray | int, bits: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The bit of each code's first probe, and the step to the next one (``next_places``)."""
    a = mixed(code * np.uint64(0xA0761D6478BD642F) + np.asarray(level, np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    bits = np.asarray(bits, np.uint64)
    return (a & np.uint64(0xFFFFFFFF)) % bits, ((a >> np.uint64(32)) | np.uint64(1)) % bits


def next_places(place: np.ndarray, step: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    """(place + step) modulo bits; below ``bits`` the difference wraps around and is the larger."""
    place = place + step
    return np.minimum(place, place - np.asarray(bits, np.uint64))


def count_segment(code: np.ndarray, n: np.ndarray) -> dict:
    """A bucket's part of the filter, of distinct codes and their counts: its bits, its first level, and the number of n-grams."""
    level = 1 + np.floor(np.log2(n)).astype(np.int64)
    size = max(64, math.ceil(int(level.sum()) * PROBES / math.log(2)))
    bitmap = np.zeros(size, bool)
    for at in range(1, int(level.max(initial=0)) + 1):
        place, step = bit_places(code[level >= at], at, size)
        for _ in range(PROBES):
            bitmap[place] = True
            place = next_places(place, step, size)
    return {"bits": size, "lowest": 1, "n": len(code), "data": np.packbits(bitmap).tobytes()}


def _unpacked_blocks(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct codes of a bucket, their counts, and where each code of the blocks stands among them, block by block."""
    codec = zstandard.ZstdDecompressor()
    codes, counts = [], []
    for row in group.select(["codes", "counts", "n"]).to_pylist():
        codes.append(np.cumsum(unpacked(row["codes"], row["n"], np.uint64, codec), dtype=np.uint64))
        counts.append(unpacked(row["counts"], row["n"], np.uint32, codec))
    code, place = np.unique(np.concatenate(codes), return_inverse=True)
    n = np.bincount(place, np.concatenate(counts), len(code)).astype(np.int64)  # exact: far below 2**53
    return code, n, place


def _segment(most: int):
    """A bucket's segment for a filter that is broadcast, which must not exceed ``most`` bits."""

    def run(group: pa.Table) -> pa.Table:
        code, n, _ = _unpacked_blocks(group)
        made = count_segment(code, n)
        if made["bits"] > most:
            raise ValueError(f"a segment of {made['bits']} bits is too large to be broadcast")
        return pa.Table.from_pylist([{"bucket": group.column("bucket")[0].as_py(), **made}], pa.schema([("bucket", pa.int32()), ("bits", pa.int64()), ("lowest", pa.int32()), ("n", pa.int64()), ("data", pa.binary())]))

    return run


def _levels(bits: int):
    """Builds a bucket's segment and answers every block of every chunk with the levels of its codes, in its order."""

    def run(group: pa.Table) -> pa.Table:
        codec = zstandard.ZstdCompressor(level=1)
        code, n, place = _unpacked_blocks(group)
        learned = n > 0
        lm = CountFilter([{"bucket": 0, **count_segment(code[learned], n[learned])}], bits, 0)
        level = lm.levels(code).astype(np.uint8)[place]
        sizes = group.column("n").to_pylist()
        parts = np.split(level, np.cumsum(sizes)[:-1])
        bucket = group.column("bucket")[0].as_py()
        rows = [{"chunk": c, "bucket": bucket, "counts": packed(part, codec), "n": len(part)} for c, part in zip(group.column("chunk").to_pylist(), parts, strict=True)]
        return pa.Table.from_pylist(rows, pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("n", pa.int32())]))

    return run


class CountFilter:
    """The filter's segments side by side. ``levels`` finds the level of each code, 0 where the first probe fails."""

    def __init__(self, segments: list[dict], bits: int, prefix: int):
        self.code_bits, self.prefix = bits, prefix
        self.bits, self.lowest, self.start = np.full(1 << prefix, 64, np.int64), np.ones(1 << prefix, np.int64), np.zeros(1 << prefix, np.int64)
        parts, at = [bytes(8)], 8
        for s in segments:
            self.bits[s["bucket"]], self.lowest[s["bucket"]], self.start[s["bucket"]] = s["bits"], s["lowest"], at
            parts.append(s["data"])
            at += len(s["data"])
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def levels(self, code: np.ndarray) -> np.ndarray:
        bucket = (code >> np.uint64(self.code_bits - self.prefix)).astype(np.int64)
        out = np.zeros(len(code), np.int64)
        level = self.lowest[bucket].copy()
        open_ = np.arange(len(code))
        while len(open_):
            b = bucket[open_]
            size, start = self.bits[b].astype(np.uint64), self.start[b].astype(np.uint64)
            place, step = bit_places(code[open_], level[open_], size)
            for _ in range(PROBES):
                hit = (self.data[start + (place >> np.uint64(3))] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8)) & 1 > 0
                if not hit.all():
                    open_, place, step, size, start = open_[hit], place[hit], step[hit], size[hit], start[hit]
                place = next_places(place, step, size)
            out[open_] = level[open_]
            level[open_] += 1
        return out

    def counts(self, code: np.ndarray) -> np.ndarray:
        """Lower edges of the counts."""
        unique, back = np.unique(code, return_inverse=True)
        return EDGES[self.levels(unique)][back]


def answered_counts(seq: np.ndarray, is_start: np.ndarray, level: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower edges of the counts of the pair and of the triple that end at each place, by the levels of the chunk's sorted distinct codes."""
    code, two, three = ngram_codes(seq, is_start, bits)
    order = np.argsort(code)
    code = code[order]
    found = np.empty(len(code), np.uint8)
    found[order] = level[np.cumsum(np.concatenate([[False], code[1:] != code[:-1]]))]
    pairs, triples = np.zeros(len(seq)), np.zeros(len(seq))
    pairs[two], triples[three] = EDGES[found[: len(two)]], EDGES[found[len(two) :]]
    return pairs, triples


def token_probabilities(seq: np.ndarray, is_start: np.ndarray, pairs: Callable, triples: Callable, c: np.ndarray, total: tuple[int, int, int, int], mix: float) -> np.ndarray:
    """Of every token of a ``sequence``; ``pairs`` and ``triples`` give the counts of those that end at some places, ``c`` has the tokens' own.

    ``total``: training tokens, types, types seen once, documents.
    """
    n, types, once, documents = total
    unknown = (once + 1) / (n + once + 2) if types else 1.0
    p = np.where(c > 0, (1 - unknown) * (c + 1) / max(1, n + types), unknown)
    known = np.zeros(len(seq), bool)
    known[~is_start] = c > 0
    before = np.zeros(len(seq))  # exact count of the word before
    full = np.zeros(len(seq))
    full[~is_start], full[is_start] = c, documents
    before[1:] = full[:-1]
    both = np.zeros(len(seq))
    at = np.flatnonzero(~is_start & known & (before > 0))
    both[at] = pairs(at)
    wide = np.zeros(len(seq))
    wide[~is_start] = p
    p = np.where(before > 0, (1 - mix) * wide + mix * np.minimum(1, both / np.maximum(before, 1)), wide)
    history = np.zeros(len(seq))  # level count of the two words before
    history[1:] = both[:-1]
    history[is_start] = 0
    three = np.zeros(len(seq))
    at = np.flatnonzero(~is_start & known & (history > 0) & (both > 0))
    three[at] = triples(at)
    p = np.where(history > 0, (1 - mix) * p + mix * np.minimum(1, three / np.maximum(2 * history, 1)), p)
    return p[~is_start]


def _score(lm: Shipped | None, total: tuple[int, int, int, int], buckets: int, bits: int, mix: float):
    """Scores of a chunk by the broadcast filter or, without one, by the levels among its answers."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        codec = zstandard.ZstdDecompressor()
        row = chunk.to_pylist()[0]
        made = Numbered.read(row, codec)
        order, edges = made.buckets(buckets)
        counts = np.zeros(len(made.words), np.int64)
        said = answers.to_pylist()
        for a in said:
            if not a["ngrams"]:
                counts[order[edges[a["bucket"]] : edges[a["bucket"] + 1]]] = unpacked(a["counts"], a["n"], np.int64, codec)
        seq, is_start = made.sequence()
        if lm:
            one, shift = lm.value, np.uint64(64 - bits)
            pairs = lambda at: one.counts(pair_codes(seq[at - 1], seq[at]) >> shift)
            triples = lambda at: one.counts(triple_codes(seq[at - 2], seq[at - 1], seq[at]) >> shift)
        else:  # codes are in the order of their buckets
            level = [unpacked(a["counts"], a["n"], np.uint8, codec) for a in sorted((a for a in said if a["ngrams"]), key=lambda a: a["bucket"])]
            pairs, triples = (found.__getitem__ for found in answered_counts(seq, is_start, np.concatenate(level), bits))
        c, sizes = counts[made.ids], made.sizes
        p = np.log10(token_probabilities(seq, is_start, pairs, triples, c, total, mix))
        first = np.cumsum(sizes) - sizes
        base = np.log10((c + 1) / (total[0] + total[1] + 1))
        k = len(sizes)
        return pa.table({
            "doc_id": pa.array(row["ids"], pa.int64()), "n_tokens": pa.array(sizes), "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), first)),
            "train_tokens": pa.array(np.full(k, total[0], np.int64)), "base_score": pa.array(np.add.reduceat(base, first)), "score": pa.array(np.add.reduceat(p, first)),
        })

    return run


def scores(docs: DataFrame, train, mix: float = MIX, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score; ``train`` is the condition of the documents learned from."""
    spark = docs.sparkSession
    rows = id_and_text(docs, train.alias("train"))
    about = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n"), F.sum(F.col("train").cast("long")).alias("train")).first()
    words = int(about["bytes"] or 0) // 5 + int(about["n"]) + 1  # tokens, at most about
    buckets = max(1, -(-words // 2_000_000))
    prefix = max(0, math.ceil(math.log2(max(1, 2 * words / 1_000_000))))
    bits = min(62, max(40, math.ceil(math.log2(2 * words)) + 13))  # shared codes: one in 8,000

    chunks = stored(rows.mapInArrow(_cut(buckets), _CHUNK_SCHEMA), "lm-chunks")
    answers = chunks.where("bucket >= 0").select("chunk", "bucket", "words", "counts", "n").groupBy("bucket").applyInArrow(_answers, "chunk long, bucket int, counts binary, n int, tokens long, types long, once long")
    answers = stored(answers, "lm-counts")
    t = answers.where("chunk = -1").agg(F.sum("tokens"), F.sum("types"), F.sum("once")).first()
    total = (int(t[0] or 0), int(t[1] or 0), int(t[2] or 0), int(about["train"] or 0))

    read = chunks.where("bucket = -1")
    said = answers.where("chunk >= 0").select("chunk", "bucket", "counts", "n", F.lit(False).alias("ngrams"))
    if 2 * total[0] * PROBES / math.log(2) + (64 << prefix) <= most_bits:  # a token ends two n-grams, and no count has more levels than its number
        blocks = rows.where("train").mapInArrow(_ngram_blocks(bits, prefix), "bucket int, codes binary, counts binary, n int")
        segments = blocks.groupBy("bucket").applyInArrow(_segment(most_bits), "bucket int, bits long, lowest int, n long, data binary").toArrow().sort_by("bucket")
        lm = Shipped(spark, CountFilter(segments.to_pylist(), bits, prefix))
    else:
        blocks = read.select("chunk", "train", "sizes", "tokens", "words").mapInArrow(_chunk_blocks(bits, prefix), "chunk long, bucket int, codes binary, counts binary, n int")
        levels = blocks.groupBy("bucket").applyInArrow(_levels(bits), "chunk long, bucket int, counts binary, n int")
        said, lm = said.unionByName(levels.withColumn("ngrams", F.lit(True))), None

    read = read.select("chunk", "ids", "sizes", "tokens", "words")
    return read.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(_score(lm, total, buckets, bits, mix), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_report(docs: DataFrame) -> DataFrame:
    """Query columns; documents whose crc32(doc_id) mod 7 is 2 are held out."""
    found = scores(docs, remainder(7) != 2)
    return found.select("doc_id", (remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
