"""Operator 4: best-fit packing of tokenised documents into sequences of a fixed length.

Every document becomes pieces of at most ``limit`` tokens. Only the number of pieces of each length matters for the plan,
and there are at most ``limit`` lengths, so the plan is made from that histogram, whatever the number of documents:

* exact complements: for the longest length left, its gap is looked up among the lengths, the sums of two and the sums of
  three lengths that are still available; the combination is used as often as its counts allow;
* the rest goes, longest first, into the open sequence with the smallest gap that fits (best fit), whole groups of equal
  sequences at a time.

The plan is a list of (lengths of a sequence, how often). Pieces of one length are then numbered, in salted groups so that
a frequent length is not one task, and number and plan give each piece its sequence and offset.

Defined cases: a null text is empty and is the end id alone; a document of exactly ``limit`` tokens is one piece; equal
lengths and repeated rows are told apart by doc_id, piece and row number; null ids are kept as null; an empty table
gives no pieces; further columns are not read.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import Shipped, id_and_text, stored
from curatrix.llm.units import Memo, byte_values

LIMIT = 4096
#: Space-separated strings of one generation whose ids a worker keeps: about 65 MB, just below the number at which a dict of Python doubles its table.
KEPT = 349_000
#: Characters on which str.split and the tokenizer's white space differ, and those that might join across a space.
ODD = re.compile("[\x1c-\x1f]")

#: The pattern of the tokenizer's words, as its file has it (a fixed value), and what it finds in lower-case printable ASCII without apostrophes.
WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PIECES = re.compile("[a-z]+|[0-9]|[^a-z0-9 ]+").findall
#: What the tokenizer does to a text before it splits it (a fixed value). Latin-1 letters become lower case one by one, so such letters, and ASCII marks behind them, are a word each.
NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
LETTERS, MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"[!-&(-/:-@\[-`{-~]"
MARKED = re.compile(f"({LETTERS}+)({MARKS}*)").fullmatch
#: What can stand inside such a string.
INSIDE = re.compile(f"{LETTERS}*{MARKS}*").fullmatch


class ChunkTokenizer:
    """The tokenizer, asked once per distinct space-separated string: it drops white space and never joins across it.

    The string of a special token has no white space and becomes that token, as the library has it.
    """

    def __init__(self, spec: str):
        self.spec, self.tool = spec, None
        read = json.loads(spec)
        self.special = [t["content"].lower() for t in read.get("added_tokens", [])]
        split = ((read.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        #: Whether printable ASCII strings fall into PIECES, which the model can be given one by one.
        self.plain = split.get("pattern") == {"Regex": WORDS} and split.get("behavior") == "Removed"
        #: Whether strings of MARKED do too, special tokens being none of them.
        self.simple = self.plain and read.get("normalizer") == NORMAL and not any(map(INSIDE, self.special))

    def __getstate__(self):
        return {"spec": self.spec, "special": self.special, "plain": self.plain, "simple": self.simple, "tool": None}

    def _load(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for one task
        from tokenizers import Tokenizer

        self.tool, self.kept = Tokenizer.from_str(self.spec), Memo(KEPT, self._ids)
        self.letters = {b: c for c, b in byte_values().items()}

    def _piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.tool.model.tokenize(piece)]).tobytes()

    def _ids(self, word: str) -> bytes:
        found = MARKED(word) if self.simple else None
        if found:
            head, tail = found.groups()
            if tail:
                return self.kept[head.lower()] + self.kept[tail]
            head = head.lower()
            return self._piece(head if head.isascii() else head.encode().decode("latin-1").translate(self.letters))
        if self.plain and word.isascii() and word.isprintable() and "'" not in word and not any(map(word.__contains__, self.special)):
            pieces = [word] if word.isalpha() and word.islower() else PIECES(word.lower())
            if len(pieces) == 1:
                return self._piece(pieces[0])
            return b"".join(map(self.kept.__getitem__, pieces))
        return array("I", self.tool.encode_batch_fast([word], add_special_tokens=False)[0].ids).tobytes()

    def ids(self, text: str) -> bytes:
        """The ids of a text, 4 bytes each."""
        if self.tool is None:
            self._load()
        if ODD.search(text):
            return self._ids(text)
        low = text.lower() if text.isascii() else text  # the tokenizer lowers too: fewer strings to remember
        if any(map(low.__contains__, self.special)):
            low = text  # it does not lower before it looks for special tokens
        return b"".join(map(self.kept.__getitem__, low.split()))


def pieces(docs: DataFrame, spec: str, end_id: int = 1, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and ``row`` (tells repeated rows apart) of every piece; ``spec`` is the tokenizer's JSON text."""
    tool, end = Shipped(docs.sparkSession, ChunkTokenizer(spec)), end_id.to_bytes(4, "little")

    def run(batches):
        one = tool.value
        for batch in batches:
            out = [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = one.ids(text.as_py()) + end
                for k, lo in enumerate(range(0, len(ids) // 4, limit)):
                    part = ids[4 * lo : 4 * (lo + limit)]
                    for column, v in zip(out, (doc, k, lo, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *[pa.array(x, pa.int64()) for x in out[2:]]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Stock:
    """How many pieces of each length are left, and the lookups by exact length sums."""

    def __init__(self, counts: dict[int, int], limit: int):
        self.left = np.zeros(limit + 1, np.int64)
        for length, n in counts.items():
            self.left[length] += n

    def pair(self, gap: int) -> tuple[int, int] | None:
        """Two available lengths with the sum ``gap``, the longest first."""
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        fits = (self.left[a] > 0) & (self.left[gap - a] > (a * 2 == gap))
        return (int(a[fits.argmax()]), gap - int(a[fits.argmax()])) if len(a) and fits.any() else None

    def filling(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that sum to ``gap``."""
        if self.left[gap]:
            return (gap,)
        found = self.pair(gap)
        if found:
            return found
        for c in np.flatnonzero(self.left[:gap])[::-1].tolist():
            if c * 3 < gap:
                break
            self.left[c] -= 1
            found = self.pair(gap - c) if gap > c else None
            self.left[c] += 1
            if found:
                return (c, *found)
        return None


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how often) for all pieces of ``counts`` (length: number)."""
    stock = _Stock(counts, limit)
    out = [((limit,), int(stock.left[limit]))] if stock.left[limit] else []
    stock.left[limit] = 0
    open_by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rest: dict[int, int] = {}
    for length in range(limit - 1, 0, -1):
        while stock.left[length]:
            stock.left[length] -= 1
            more = stock.filling(limit - length)
            stock.left[length] += 1
            if more is None:
                rest[length] = int(stock.left[length])
                stock.left[length] = 0
                break
            used = (length, *more)
            times = min(int(stock.left[x]) // used.count(x) for x in set(used))
            for x in used:
                stock.left[x] -= times
            out.append((used, times))
    gaps: list[int] = []
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            i = bisect.bisect_left(gaps, length)
            if i == len(gaps):
                # no open sequence has room: new ones, each with as many of this length as fit
                per = min(limit // length, n)
                used, times = (length,) * per, n // per
                _open(open_by_gap, gaps, limit - per * length, used, times)
                n -= per * times
                continue
            gap = gaps[i]
            used, times = open_by_gap[gap].pop()
            if not open_by_gap[gap]:
                gaps.pop(i)
            take = min(times, n)
            if times > take:
                _open(open_by_gap, gaps, gap, used, times - take)
            _open(open_by_gap, gaps, gap - length, (*used, length), take)
            n -= take
    return out + [x for group in open_by_gap.values() for x in group]


def _open(open_by_gap, gaps: list[int], gap: int, used: tuple[int, ...], times: int) -> None:
    if not open_by_gap[gap] and gap:
        bisect.insort(gaps, gap)
    open_by_gap[gap].append((used, times))


def slots(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, numbers, first sequence, offset, of equal slots) of each slot: the pieces of a length are numbered from 0, and a slot takes a range of numbers."""
    taken: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for used, times in planned:
        offset = 0
        for length in used:
            out.append((length, taken[length], times, sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return out


def packed(cut: DataFrame, limit: int = LIMIT, salts: int = 64) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces (it is read several times)."""
    spark = cut.sparkSession
    salted = cut.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    groups = salted.groupBy("length", "__salt").agg(F.count("*").alias("n")).collect()  # at most limit * salts small rows
    counts: dict[int, int] = defaultdict(int)
    before = []
    for r in sorted(groups, key=lambda r: (r["length"], r["__salt"])):
        before.append((int(r["length"]), int(r["__salt"]), counts[r["length"]]))
        counts[r["length"]] += r["n"]
    places = defaultdict(list)
    for length, first, times, sequence, offset in slots(plan(dict(counts), limit)):
        places[length].append((first, sequence, offset))
    known = Shipped(spark, ({(a, b): c for a, b, c in before}, {k: tuple(np.array(x, np.int64) for x in zip(*sorted(v), strict=True)) for k, v in places.items()}))

    def place(batches):
        start, table = known.value
        for batch in batches:
            length, salt, rank = (batch.column(c).to_pylist() for c in ("length", "__salt", "__rank"))
            seq, off = [], []
            for a, b, r in zip(length, salt, rank, strict=True):
                number = start[a, b] + r
                first, sequence, offset = table[a]
                i = int(np.searchsorted(first, number, "right")) - 1
                seq.append(int(sequence[i] + number - first[i]))
                off.append(int(offset[i]))
            rows = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(seq, pa.int64()), pa.array(off, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    order = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("__rank", F.row_number().over(order) - 1)
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, spec: str, end_id: int = 1, limit: int = LIMIT) -> DataFrame:
    """One row per piece with its sequence and offset."""
    return packed(stored(pieces(docs, spec, end_id, limit), "pieces"), limit)
