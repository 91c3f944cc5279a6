"""Operator 6: near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five consecutive words (runs of letters and digits, A-Z lowered; a text of fewer words is one shingle). Its
weight is its number of occurrences times the mean idf of its words. The idf of a word runs from 1 (in every document) to
2 (in at most ``RARE`` of them): 1 + log(N / df) / log(1 / RARE), df counted over all documents. Only words above RARE need
a table: there are at most (mean distinct words of a document) / RARE of them, which bounds what is broadcast.

Each of bands * rows samples picks one (shingle, level) per text, so that two texts agree with the probability of their
weighted Jaccard similarity. The gamma and uniform draws of a sample come from a table indexed by the shingle's hash;
shingles with equal draws are told apart by a second hash. Texts that agree in all rows of a band are candidates.

Equal texts are one node. Within a bucket every node is compared with the least node (a star, not all pairs). Where a
bucket still holds different components, the nodes outside the largest are compared with one of its members, in each band with
another one, and what stays apart then with all of the bucket, block by block inside tasks, so that no candidate pair stays
open. Links are pairs with weighted Jaccard similarity of
at least the threshold, computed from the whole texts; classes are the connected components.

Defined cases: a null text is empty; texts without a word are in one class only with equal texts; nodes are told apart by the
64-bit hash of the text; rows that repeat a doc_id and its text are one document and share its decision; ties go to the
smallest doc_id, null ids last; an empty table gives an empty result; further columns stay as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import Bitmap, RangeHash, Shipped, blocks, byte_view, mixed, stored
from curatrix.llm.components import components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
RARE = 1 / 1000
DRAWS = 14  # bits of the index into the table of draws
SIDE = 256  # nodes in a block of an open bucket
BINS = 1024  # of a text's shingles, for a bound of its similarity
ROUNDS = 1  # of comparisons with one member of the largest component of each bucket, before whole buckets are compared
SEGMENT = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray, hashing: RangeHash) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word of a buffer of documents; words do not cross documents."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = _WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begins[heads] |= inside[heads]
    start = np.flatnonzero(begins)
    stops = np.flatnonzero(np.concatenate([~inside[1:] | begins[1:], [True]]) & inside) + 1
    sums = hashing.sums(_FOLD[data])
    return np.searchsorted(offsets, start, "right") - 1, hashing.of(sums, start, stops)


def _by_owner(owner: np.ndarray, code: np.ndarray, rows: int) -> np.ndarray:
    """The order by owner, then code. Owners below 1 << 16 are put in order by counting."""
    order = np.argsort(code)
    return order[np.argsort(owner[order].astype(np.uint16 if rows <= 1 << 16 else np.int64), kind="stable")] if rows > 1 else order


class Weights:
    """idf of frequent words; all others have 2."""

    def __init__(self, words: np.ndarray, df: np.ndarray, documents: int):
        order = np.argsort(words)
        self.words = np.append(words[order], np.uint64(2**64 - 1))
        self.idf = np.append(1 + np.log(documents / np.maximum(df[order], RARE * documents)) / math.log(1 / RARE), 2.0)
        self.slots = None

    def __getstate__(self):
        return self.__dict__ | {"slots": None}

    def _places(self) -> None:
        """The place of a word by the low bits of its hash: the last place for none, -1 where words share the bits."""
        self.mask = np.uint64((1 << max(10, (8 * len(self.words)).bit_length())) - 1)
        low = (self.words[:-1] & self.mask).astype(np.intp)
        self.slots = np.full(int(self.mask) + 1, len(self.words) - 1, np.int32)
        self.slots[low] = np.arange(len(low))
        self.slots[np.bincount(low, minlength=len(self.slots)) > 1] = -1

    def of(self, h: np.ndarray) -> np.ndarray:
        if self.slots is None:
            self._places()
        at = self.slots[(h & self.mask).astype(np.intp)]
        shared = np.flatnonzero(at < 0)
        at[shared] = np.minimum(np.searchsorted(self.words, h[shared]), len(self.words) - 1)
        return np.where(self.words[at] == h, self.idf[at], 2.0)

    def shingles(self, row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shingle, weight), distinct, by row."""
        count = np.bincount(row, minlength=rows)
        first = np.cumsum(count) - count
        made = np.where(count == 0, 0, np.maximum(count - WORDS + 1, 1))
        owner = np.repeat(np.arange(rows), made)
        start = np.arange(len(owner)) + np.repeat(first - (np.cumsum(made) - made), made)
        idf = self.of(h)
        code, weight = np.zeros(len(owner), np.uint64), np.zeros(len(owner))
        # a shingle at every place of the buffer, of which those are taken that lie in one text; texts of fewer words after that
        for size in range(1, WORDS + 1):
            texts = count >= WORDS if size == WORDS else count == size
            if not texts.any():
                continue
            at = np.flatnonzero(np.repeat(texts, made))
            places = start[at]
            if size == WORDS:
                ends = len(h) - size + 1
                parts, given = [h[k : ends + k] for k in range(size)], [idf[k : ends + k] for k in range(size)]
            else:
                parts, given = [h[places + k] for k in range(size)], [idf[places + k] for k in range(size)]
                places = slice(None)
            made_code, made_weight = np.zeros(len(parts[0]), np.uint64), np.zeros(len(parts[0]))
            for k in range(size):
                made_code = mixed(made_code * np.uint64(0x9E3779B97F4A7C15) + parts[k] + np.uint64(k + 1))
                made_weight += given[k]
            made_weight /= size
            code[at], weight[at] = made_code[places], made_weight[places]
        order = _by_owner(owner, code, rows)
        owner, code, weight = owner[order], code[order], weight[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(owner)))
        return owner[at], code[at], weight[at] * times


class Sampler:
    """The draws of every sample: r and c from Gamma(2, 1), beta uniform, by the index of a shingle."""

    def __init__(self, samples: int, seed: int = 6):
        rng = np.random.default_rng(seed)
        shape = (samples, 1 << DRAWS)
        self.r = rng.gamma(2, 1, shape).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, shape)).astype(np.float32)
        self.beta = rng.random(shape, np.float32)
        self.turn = rng.integers(1, 1 << 63, (samples, 2), dtype=np.uint64) | np.uint64(1)

    def picks(self, owner: np.ndarray, code: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """(rows, samples) of picked (shingle, level), hashed; ``owner`` is sorted and every row has a shingle."""
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        local = np.cumsum(np.concatenate([[0], owner[1:] != owner[:-1]]))
        log_w = np.log(weight).astype(np.float32)
        made = np.diff(np.append(first, len(owner)))
        out = np.empty((len(first), len(self.r)), np.uint64)
        for k in range(len(self.r)):
            at = ((code * self.turn[k, 0]) >> np.uint64(64 - DRAWS)).astype(np.intp)
            r, beta = self.r[k][at], self.beta[k][at]
            level = log_w / r
            level += beta
            np.floor(level, out=level)
            value = level + 1
            value -= beta
            value *= r
            np.subtract(self.log_c[k][at], value, out=value)
            best = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, first), made))
            tie = mixed(code[best] * self.turn[k, 1])
            order = np.lexsort((tie, local[best]))
            best = best[order]
            best = best[np.concatenate([[True], local[best][1:] != local[best][:-1]])]
            out[:, k] = mixed(code[best] ^ (level[best].astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted shingles, weights)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = np.flatnonzero(b[0][at] == a[0]) if len(a[0]) else at
    least = np.minimum(a[1][same], b[1][at[same]]).sum()
    whole = a[1].sum() + b[1].sum() - least
    return float(least / whole) if whole else 0.0


def alike(a: tuple[np.ndarray, np.ndarray, float], b: tuple[np.ndarray, np.ndarray, float], threshold: float) -> bool:
    """Whether the similarity of two (shingles, weights, sum of weights) reaches the threshold; the share of the sums is never below it."""
    least, most = min(a[2], b[2]), max(a[2], b[2])
    return least >= (threshold - 1e-9) * most and similarity(a, b) >= threshold


def _counted(batches):
    """Words and in how many documents of this task they are."""
    hashing = RangeHash(61)
    words, counts, held = [], [], 0
    for batch in batches:
        data, offsets = byte_view(batch.column("text"))
        for a, b in blocks(offsets, SEGMENT >> 2):
            lo, hi = offsets[a], offsets[b]
            row, h = word_hashes(data[lo:hi], offsets[a : b + 1] - lo, hashing)
            order = _by_owner(row, h, b - a)
            row, h = row[order], h[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
            w, n = np.unique(h[new], return_counts=True)
            words.append(w)
            counts.append(n)
            held += len(w)
            if held > 2_000_000:
                w, at = np.unique(np.concatenate(words), return_inverse=True)
                words, counts = [w], [np.bincount(at, np.concatenate(counts)).astype(np.int64)]
                held = len(w)
                if held > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(words[0].view(np.int64)), pa.array(counts[0])], ["word", "n"])
                    words, counts, held = [], [], 0
    if held:
        w, at = np.unique(np.concatenate(words), return_inverse=True)
        n = np.bincount(at, np.concatenate(counts)).astype(np.int64)
        for i in range(0, len(w), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(w[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000])], ["word", "n"])


def corpus_weights(texts: DataFrame) -> Weights:
    documents = texts.count()
    df = texts.select("text").mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = df.where(F.col("n") > RARE * documents).collect()  # at most mean distinct words / RARE
    return Weights(np.array([r["word"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.float64), max(1, documents))


def _with_node(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__text", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("__node", F.xxhash64("__text"))


def _band_batches(weights, sampler, bands: int, rows: int):
    def run(batches):
        hashing, w, draw = RangeHash(61), weights.value, sampler.value
        for batch in batches:
            data, offsets = byte_view(batch.column("text"))
            nodes = batch.column("node").to_numpy()
            for a, b in blocks(offsets, SEGMENT):
                lo, hi = offsets[a], offsets[b]
                row, h = word_hashes(data[lo:hi], offsets[a : b + 1] - lo, hashing)
                if not len(row):
                    continue
                owner, code, weight = w.shingles(row, h, b - a)
                picks = draw.picks(owner, code, weight)
                mine = nodes[a + np.unique(owner)]
                band = np.zeros((len(mine), bands), np.uint64)
                for k in range(bands):
                    for j in range(rows):
                        band[:, k] = mixed(band[:, k] * np.uint64(0x9E3779B97F4A7C15) + picks[:, k * rows + j] + np.uint64(k))
                yield pa.RecordBatch.from_arrays([pa.array(band.ravel().view(np.int64)), pa.array(np.repeat(mine, bands))], ["band", "node"])

    return run


def _vectors(packed: list, weights: Weights, hashing: RangeHash, unpack) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(shingles, weights, sum of weights) of each packed text, worked out for many texts at a time."""
    out, texts, held = [], [], 0
    for i, one in enumerate(packed):
        texts.append(unpack.decompress(one.as_buffer()))
        held += len(texts[-1])
        if held < SEGMENT and i + 1 < len(packed):
            continue
        row, h = word_hashes(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]), hashing)
        owner, code, weight = weights.shingles(row, h, len(texts))
        edges = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
        out += [(code[lo:hi], weight[lo:hi], float(weight[lo:hi].sum())) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        texts, held = [], 0
    return out


def _bins(code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums of the weights of a text by the low bits of its shingles."""
    return np.bincount((code & np.uint64(BINS - 1)).astype(np.intp), weight, BINS).astype(np.float32)


def _verify_batches(weights, threshold: float):
    def run(batches):
        hashing, w, unpack, kept = RangeHash(61), weights.value, zstandard.ZstdDecompressor(), {}

        def vector(node, packed):
            if node not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[node] = _vectors([packed], w, hashing, unpack)[0]
            return kept[node]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = [alike(vector(x, p), vector(y, q), threshold) for x, p, y, q in zip(a, batch.column("pa"), b, batch.column("pb"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _open_group(weights, threshold: float):
    """Links across components in one pair of blocks; what a link already joins is not compared again."""

    def run(group: pa.Table) -> pa.Table:
        hashing, w, unpack = RangeHash(61), weights.value, zstandard.ZstdDecompressor()
        root = {x: x for x in group.column("root").to_pylist()}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        packed = dict(zip(group.column("node").to_pylist(), group.column("packed"), strict=True))
        vectors = dict(zip(packed, _vectors(list(packed.values()), w, hashing, unpack), strict=True))
        node, roots, left = (group.column(c).to_numpy() for c in ("node", "root", "left"))
        total = np.array([vectors[n][2] for n in node.tolist()])
        sums = {n: _bins(code, weight) for n, (code, weight, _) in vectors.items()}
        sums = np.array([sums[n] for n in node.tolist()])
        out = []
        for i in np.flatnonzero(left).tolist():
            n, r = int(node[i]), int(roots[i])
            apart = np.flatnonzero((roots != r) & (node != n) & (~left | (node > n)))
            # two texts share no more than the smaller sums of their bins; the margin is for the sums' rounding
            most = np.minimum(sums[apart], sums[i]).sum(1, dtype=np.float64) * 1.001
            for j in apart[most >= threshold / (1 + threshold) * (total[apart] + total[i])].tolist():
                m, q = int(node[j]), int(roots[j])
                if find(r) != find(q) and similarity(vectors[n], vectors[m]) >= threshold:
                    root[find(r)] = find(q)
                    out.append((n, m))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return run


def _open_buckets(members: DataFrame, label: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(members with their root, buckets of different components with their largest one and a member of it drawn by hash).

    A bucket of two nodes is left out: its one pair has been compared.
    """
    rooted = members.join(label, "node", "left").select("band", "centre", "node", F.coalesce("root", "node").alias("root"))
    parts = rooted.groupBy("band", "root").agg(F.count("*").alias("k"), F.min_by("node", F.xxhash64("node", "band", F.lit(turn))).alias("pick"))
    still = parts.groupBy("band").agg(F.sum("k").alias("n"), F.count("*").alias("parts"), F.max(F.struct("k", "root", "pick")).alias("m")).where("n > 2 and parts > 1")
    return rooted, stored(still.select("band", "n", F.col("m.root").alias("main"), F.col("m.pick").alias("pick")), "open-bands")


def classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(node, class_id) of the texts that have a near copy, and (node, doc_id, copies) of all texts; ``docs`` as ``_with_node`` gives them."""
    spark = docs.sparkSession
    texts = docs.select(F.col("__node").alias("node"), F.col("__text").alias("text"))
    weights = Shipped(spark, corpus_weights(texts))
    sampler = Shipped(spark, Sampler(bands * rows))
    banded = stored(texts.mapInArrow(_band_batches(weights, sampler, bands, rows), "band long, node long"), "bands")
    live = stored(banded.groupBy("band").agg(F.min("node").alias("centre"), F.max("node").alias("most")).where("centre <> most").select("band", "centre"), "live-bands")
    members = stored(banded.join(live, "band").select("band", "centre", "node").distinct(), "members")
    stars = members.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()

    asked_for = Shipped(spark, Bitmap(members, "node"))  # keeps the other texts from travelling

    def squeezed(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts, marked = batch.column("__text"), np.flatnonzero(asked_for.value.has(batch.column("__node").to_numpy()))
            out = [pack.compress(texts[i].as_buffer()) for i in marked.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(marked)), batch.column("__node").take(pa.array(marked)), pa.array(out, pa.binary())], ["doc_id", "node", "packed"])

    nodes = stored(docs.groupBy(F.col("__node").alias("node")).agg(F.min(F.col("doc_id").cast("long")).alias("doc_id"), F.count("*").alias("copies")), "nodes")
    asked = nodes.join(members.select("node").distinct(), "node").select(F.col("node").alias("__n"), F.col("doc_id").alias("__d"))
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "__node", "__text").mapInArrow(squeezed, "doc_id long, node long, packed binary")
    packed = stored(packed.join(asked, (F.col("node") == F.col("__n")) & F.col("doc_id").eqNullSafe(F.col("__d"))).select("node", "packed"), "candidates")

    side = lambda n, p: packed.select(F.col("node").alias(n), F.col("packed").alias(p))
    def verified(pairs: DataFrame, name: str) -> DataFrame:
        both = pairs.join(side("a", "pa"), "a").join(side("b", "pb"), "b").coalesce(4 * spark.sparkContext.defaultParallelism)  # skewed joins leave many small parts
        return stored(both.mapInArrow(_verify_batches(weights, threshold), "a long, b long"), name)

    links = verified(stars, "links")
    label = components(links)
    for turn in range(ROUNDS):
        rooted, still = _open_buckets(members, label, turn)
        # nodes outside a bucket's largest component against one of its members, another one in every bucket and round
        pairs = rooted.join(still.select("band", "main", "pick"), "band").where("root <> main").select(F.col("node").alias("a"), F.col("pick").alias("b")).distinct()
        found = verified(pairs, "links")
        if not found.limit(1).count():
            break
        links = links.union(found)
        label = components(links)

    # what is still apart is compared with the whole bucket
    rooted, still = _open_buckets(members, label, ROUNDS)
    rooted = stored(rooted.join(still.select("band", "n", "main"), "band").withColumn("left", F.col("root") != F.col("main")), "open")
    sizes = rooted.groupBy("band").agg(F.sum(F.col("left").cast("long")).alias("lefts"))
    dealt = rooted.join(sizes, "band").withColumn("l_blocks", F.ceil(F.col("lefts") / SIDE).cast("int")).withColumn("r_blocks", F.ceil(F.col("n") / SIDE).cast("int"))
    spot = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    mine = F.pmod(spot, F.col("l_blocks")).cast("int"), F.pmod(spot, F.col("r_blocks")).cast("int")
    # a left node meets every block of the bucket, a node of the main component every left block
    as_left = dealt.where("left").select("band", "node", "root", F.lit(True).alias("left"), mine[0].alias("i"), F.explode(F.sequence(F.lit(0), F.col("r_blocks") - 1)).alias("j"))
    as_right = dealt.select("band", "node", "root", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("l_blocks") - 1)).alias("i"), mine[1].alias("j"))
    sides = as_left.union(as_right).join(packed, "node")
    more = stored(sides.groupBy("band", "i", "j").applyInArrow(_open_group(weights, threshold), "a long, b long"), "more-links")
    label = components(links.union(more)) if more.limit(1).count() else label

    rooted = nodes.join(label, "node").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return label.join(rooted, "root").select("node", "class_id"), nodes


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, names: tuple[str, str, str] = ("class_id", "class_size", "kept")) -> DataFrame:
    """``docs`` with, under ``names``, the smallest doc_id of the class, its number of documents, and whether the row stays.

    Columns of ``docs`` with these names are replaced.
    """
    keyed = _with_node(docs)
    found, nodes = classes(keyed, threshold, bands, rows)
    named = nodes.join(found, "node", "left").select(F.col("node").alias("__node"), F.coalesce("class_id", "doc_id").alias("__class"), F.col("doc_id").alias("__first"), "copies")
    sizes = named.groupBy(F.col("__class").alias("__c")).agg(F.sum("copies").alias("__size"))
    named = stored(named.join(sizes, F.col("__class").eqNullSafe(F.col("__c"))).select("__node", "__class", "__size", F.col("__first").eqNullSafe(F.col("__class")).alias("__leads")), "classes")
    out = keyed.drop("__text").join(named, "__node")
    stays = F.col("__leads") & F.col("doc_id").cast("long").eqNullSafe(F.col("__class"))
    new = dict(zip(names, (F.col("__class"), F.col("__size"), stays), strict=True))
    return out.select(*[c for c in docs.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def class_report(docs: DataFrame) -> DataFrame:
    """Query columns: doc_id, class_id, class_size, kept."""
    return near_duplicates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text")
