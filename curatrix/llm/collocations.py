"""Operator 13: collocations by top-order marginalisation.

Every word starts exactly one longest window: itself and the words that lead after it, up to ``most`` in all, padded at the end of
its piece. Only these windows are counted; Spark's ROLLUP over the lead columns sums them into the counts of all shorter
prefixes, and as each occurrence of a phrase is the prefix of one window, these are the counts of all phrases.

Windows are padded earlier where no phrase with enough occurrences can go on: a first pass adds the pairs and triples of
words up in hashed counters, and a window ends where a pair or triple of it has a counter below the support. A
counter is never below the count of a phrase it holds, so no phrase with the support is cut short, and prefixes keep their
exact counts. The counters grow with the corpus up to 2**30, whose marks are 128 MB; a far larger corpus only sends more
windows through the rollup, with the same result.

The score floor(1000 * f(phrase) * n / (f(left) * f(right))) is computed in decimals of 38 digits, exactly.

Defined cases: null text is empty and null lang ``und``; pieces end at ``.,;:!?`` and line ends, words at spaces and tabs; texts are
read whole; repeated rows count again; ties order by count, then by the bytes of the phrase; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import Shipped, blocks, byte_view, mixed, stored

MOST = 5
SUPPORT = 100
TOP = 2000
#: Bytes of text that a task looks at together.
BLOCK = 4 << 20
#: Windows that are spelled out at a time.
SPELLED = 1 << 15
#: Hashed counters as powers of two: one for about 8 words, within these bounds.
LEAST_BITS, MOST_BITS = 16, 30
SALTS = 64
RANGE = 16

BREAK = b"\xff"  # in no UTF-8 text
FOLD = bytes.maketrans(bytes(range(0x41, 0x5B)) + b".,;:!?\n\x0b\x0c\r", bytes(range(0x61, 0x7B)) + BREAK * 10)


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased words in order; BREAK where a piece ends."""
    return raw.translate(FOLD).replace(BREAK, b" \xff ").split()


class Words:
    """The words of one block of texts of one language as numbers: 0 is a break."""

    def __init__(self, lang: str, raws: list[bytes]):
        number: dict[bytes, int] = {BREAK: 0}
        ids = []
        for raw in raws:
            ids += [number.setdefault(w, len(number)) for w in words_of(raw)]
            ids.append(0)
        self.lang, self.words = lang, list(number)
        self.ids = np.zeros(len(ids) + MOST, np.int32)
        self.ids[: len(ids)] = ids
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        self.hash = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))

    def chains(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places where a pair starts and its hash, places where a triple starts and its hash."""
        word = self.ids > 0
        two = np.flatnonzero(word[:-1] & word[1:])
        h = self.hash[self.ids]
        pair = mixed(h[two] * np.uint64(0x9E3779B97F4A7C15) + h[two + 1])
        goes_on = word[two + 2]
        three = two[goes_on]
        return two, pair, three, mixed(pair[goes_on] * np.uint64(0xC2B2AE3D27D4EB4F) + h[three + 2])


def _langs(batch: pa.RecordBatch):
    """(language, texts as bytes) of blocks of a batch."""
    langs = np.array(batch.column("lang").to_pylist(), object)
    for lang in sorted(set(langs.tolist())):
        mine = batch.filter(pa.array(langs == lang))
        data, offsets = byte_view(mine.column("text"))
        for a, b in blocks(offsets, BLOCK):
            yield lang, [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)]


def by_language(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


class Marks:
    """Which hashed counters of pairs and triples reach the support."""

    def __init__(self, bits: int, marks: np.ndarray):
        self.bits, self.marks = bits, marks

    def frequent(self, h: np.ndarray) -> np.ndarray:
        place = h >> np.uint64(64 - self.bits)
        return (self.marks[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def frequent_chains(texts: DataFrame, support: int, bits: int) -> Marks:
    """Counters of all pairs and triples: tasks add theirs up by range of counters, a counter needs no more than ``support``."""
    cap = min(support, 255)

    def count(batches):
        for batch in batches:
            for lang, raws in _langs(batch):
                _, pair, _, triple = Words(lang, raws).chains()
                place, n = np.unique(np.concatenate([pair, triple]) >> np.uint64(64 - bits), return_counts=True)
                which = (place >> np.uint64(RANGE)).astype(np.int64)
                edges = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else np.zeros(0, np.int64)
                low, some = place.astype("<u2"), np.minimum(n, cap).astype(np.uint8)
                ends = [*edges[1:].tolist(), len(which)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(which[edges]), pa.array([low[a:b].tobytes() for a, b in zip(edges.tolist(), ends, strict=False)], pa.binary()), pa.array([some[a:b].tobytes() for a, b in zip(edges.tolist(), ends, strict=False)], pa.binary())],
                    ["part", "low", "n"])

    def add(batches):
        at, total = None, None
        for batch in batches:
            for part, low, n in zip(*(batch.column(c).to_pylist() for c in ("part", "low", "n")), strict=True):
                if part != at:
                    if at is not None:
                        yield _range_marks(at, total, cap)
                    at, total = part, np.zeros(1 << RANGE, np.int64)
                total[np.frombuffer(low, "<u2")] += np.frombuffer(n, np.uint8)
        if at is not None:
            yield _range_marks(at, total, cap)

    counted = texts.mapInArrow(count, "part long, low binary, n binary")
    ranges = counted.repartition("part").sortWithinPartitions("part").mapInArrow(add, "part long, marks binary")
    marks = np.zeros(max(1, 1 << bits >> 3), np.uint8)
    for r in ranges.toLocalIterator():  # 2 ** bits bits in all, whatever the corpus
        some = np.frombuffer(r["marks"], np.uint8)
        at = r["part"] << RANGE >> 3
        marks[at : at + len(some)] = some[: len(marks) - at]
    return Marks(bits, marks)


def _range_marks(part: int, total: np.ndarray, cap: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.packbits(total >= cap, bitorder="little").tobytes()], pa.binary())], ["part", "marks"])


def lead_windows(texts: DataFrame, marks: Marks) -> DataFrame:
    """lang, w1 .. w5 (null: padded) and how often: the longest windows of every block, each word starting one."""
    sent = Shipped(texts.sparkSession, marks)
    names = [f"w{k}" for k in range(1, MOST + 1)]

    def run(batches):
        for batch in batches:
            for lang, raws in _langs(batch):
                some = Words(lang, raws)
                two, pair, three, triple = some.chains()
                goes2, goes3 = np.zeros(len(some.ids), bool), np.zeros(len(some.ids), bool)
                goes2[two] = sent.value.frequent(pair)
                goes3[three] = sent.value.frequent(triple)
                del two, pair, three, triple
                words = pa.array([None, *[w.decode() for w in some.words[1:]]], pa.string())
                for size, places, counts in _counted_windows(some.ids, goes2, goes3):
                    for i in range(0, len(places), SPELLED):
                        at, n = places[i : i + SPELLED], counts[i : i + SPELLED]
                        part = [words.take(pa.array(some.ids[at + k])) if k < size else pa.nulls(len(at), pa.string()) for k in range(MOST)]
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), *part, pa.array(n)], ["lang", *names, "n"])

    return texts.mapInArrow(run, f"lang string, {', '.join(f'{c} string' for c in names)}, n long")


def _counted_windows(ids: np.ndarray, goes2: np.ndarray, goes3: np.ndarray):
    """(words, places where such a window starts, how often it is there), by length: a window grows while its last pair and its last triple may be frequent."""
    at = np.flatnonzero(ids)
    group = ids[at].astype(np.int64)
    for k in range(1, MOST + 1):
        more = (goes2[at + k - 1] & (goes3[at + k - 2] if k > 1 else True)) if k < MOST else np.zeros(len(at), bool)
        _, first, n = np.unique(group[~more], return_index=True, return_counts=True)
        yield k, at[~more][first], n.astype(np.int64)
        at, group = at[more], group[more]
        if not len(at):
            return
        _, group = np.unique(group * len(ids) + ids[at + k], return_inverse=True)


def phrase_counts(windows: DataFrame, support: int) -> DataFrame:
    """lang, m (words), phrase, f: every phrase of 1 to 5 words with the support; m = 0: all words of the language."""
    names = [f"w{k}" for k in range(1, MOST + 1)]
    sums = windows.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("rolled"))
    m = F.when(F.col("rolled") >= (1 << MOST), F.lit(-1))
    for k in range(MOST + 1):
        whole = F.col(f"w{k}").isNotNull() if k else F.lit(True)
        m = m.when((F.col("rolled") == (1 << (MOST - k)) - 1) & whole, F.lit(k))
    return sums.withColumn("m", m).where(f"m = 0 OR m > 0 AND f >= {support}").select("lang", "m", F.concat_ws(" ", *names).alias("phrase"), "f")


def cuts(phrases: DataFrame) -> DataFrame:
    """Every candidate's lowest-scoring cut: lang, phrase, m, a, l, r, n, score."""
    words = F.split("phrase", " ")
    f = phrases.where("m > 0").select("lang", "phrase", "f")
    n = phrases.where("m = 0").select("lang", F.col("f").alias("n"))
    candidates = phrases.where("m > 1").select("lang", "m", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cut = candidates.withColumns({"left": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "), "right": F.array_join(F.slice(words, F.col("k") + 1, F.col("m") - F.col("k")), " ")})
    sides = cut.join(f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    big = "decimal(19,0)"
    score = F.expr(f"(cast(1000 * a AS {big}) * cast(n AS {big})) div (cast(l AS {big}) * cast(r AS {big}))")
    # a language may hold most phrases: its total waits in SALTS places
    salted = sides.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    scored = salted.join(n.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["lang", "salt"]).withColumn("score", score)
    lowest = scored.groupBy("lang", "phrase", "m", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("lowest"))
    return lowest.select("lang", "phrase", "m", "a", "lowest.l", "lowest.r", "n", "lowest.score")


def without_parts(found: DataFrame) -> DataFrame:
    """Drops phrases inside a longer one that occurs (nearly) as often: 100 * f(longer) >= 100 * a."""
    longer = found.where("m > 2").select("lang", "m", F.split("phrase", " ").alias("words"), F.col("a").alias("f"))
    spans = longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("m") - 1))).withColumn("first", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("size") + 1)))
    inside = spans.groupBy("lang", F.array_join(F.slice("words", F.col("first"), F.col("size")), " ").alias("phrase")).agg(F.max("f").alias("f"))
    return found.join(inside, ["lang", "phrase"], "left").where("f IS NULL OR 100 * f < 100 * a").drop("f")


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    texts = by_language(docs)
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (size // 48).bit_length()))
    windows = lead_windows(texts, frequent_chains(texts, support, bits))
    found = stored(cuts(stored(phrase_counts(windows, support), "phrase-counts")), "phrase-cuts")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = without_parts(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
