"""Operator 5: secret scans, in DataFrame functions only.

Three fixed kinds (assignments, access keys, long hex runs) are found by pattern. The entropy scan adds spans: candidate
strings are maximal runs of token characters that hold a letter and a digit; a window slides over each, the counts of its
characters change by one in and one out, and with them the sum of c*log2(c) from which the Shannon entropy follows. The
threshold depends on the character class of the candidate (hex, alphanumeric, base64). Candidates on the allow list and
candidates that touch a fixed span add nothing.

Positions are code points, ends exclusive. ``split`` and ``regexp_extract_all`` run the same pattern with the same
matches, so the running lengths of pieces and matches are the positions.

Defined cases: a null text is empty; an empty text has no spans; rows are independent, so ties, repeated rows and empty
tables need no rule; further columns stay as they are, and working columns carry a prefix of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds and their patterns.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}"

#: Candidates that match one of these are no secrets: UUIDs, joined plain words and numbers, and documented examples.
ALLOW = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^([A-Za-z]+|[0-9]+)([-_/+]+([A-Za-z]+|[0-9]+))*[-_/+]*$",
    r"(?i)example|placeholder|changeme",
)
SPANS = "array<struct<start:int,rank:int,end:int>>"


@dataclass(frozen=True)
class EntropyRule:
    """Window in characters, and the least entropy in bits by character class."""

    window: int = 20
    hex_bits: float = 3.0
    alnum_bits: float = 3.8
    base64_bits: float = 3.9


#: Items per block of a running value, and characters per block of a text that is cut.
BLOCK = 256


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(items: Column, step) -> Column:
    """Array of an int state, 0 at first, after each item: ``step(state, item)``.

    An array grows by copying, so results are gathered in blocks: the work is linear in the items but for one append per block.
    """
    ints = F.expr("cast(array() as array<int>)")

    def one(state, item):
        return _bound(step(state["at"], item), lambda now: F.struct(now.alias("at"), F.array_append(state["out"], now).alias("out")))

    def block(state, part):
        done = F.aggregate(part, F.struct(state["at"].alias("at"), ints.alias("out")), one)
        return _bound(done, lambda d: F.struct(d["at"].alias("at"), F.array_append(state["parts"], d["out"]).alias("parts")))

    blocks = _bound(items, lambda xs: F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / BLOCK).cast("int")), lambda i: F.slice(xs, i * BLOCK + 1, F.lit(BLOCK))))
    begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<int>>)").alias("parts"))
    return F.flatten(F.aggregate(blocks, begin, block, lambda state: state["parts"]))


def _matches(text: Column, pattern: str, group: int) -> Column:
    """(word, part, end) of every match, ``part`` the length of its ``group``."""
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("word"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length).alias("part"),
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),  # one more than matches
    )
    found = F.filter(found, lambda m: m["word"].isNotNull())
    return _bound(found, lambda ms: F.zip_with(
        ms, _running(ms, lambda at, m: at + m["gap"] + F.length(m["word"])),
        lambda m, end: F.struct(m["word"].alias("word"), m["part"].alias("part"), end.alias("end"))))


def _placed(text: Column, pattern: str, rank: int, group: int, least: int) -> Column:
    """Spans of all matches whose ``group`` has at least ``least`` characters."""
    long = F.filter(_matches(text, pattern, group), lambda m: m["part"] >= least)
    return F.transform(long, lambda m: F.struct((m["end"] - F.length(m["word"])).alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))


def _reached(spans: Column, size: Column, point: Column) -> Column:
    """How many of the first spans of an array sorted by start begin before ``point``, by halving."""

    def halve(state, _):
        mid = F.floor((state["low"] + state["high"]) / 2).cast("int")
        before = F.element_at(spans, F.greatest(F.least(mid + 1, size), F.lit(1)))["start"] < point
        open_ = state["low"] < state["high"]
        return F.struct(F.when(open_ & before, mid + 1).otherwise(state["low"]).alias("low"), F.when(open_ & ~before, mid).otherwise(state["high"]).alias("high"))

    turns = F.sequence(F.lit(0), F.ceil(F.log2(size + 1)).cast("int"))
    return F.aggregate(turns, F.struct(F.lit(0).alias("low"), size.alias("high")), halve, lambda state: state["low"])


def _only_if(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.expr(f"cast(array() as {SPANS})"))


def _clog(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def hot_range(word: Column, rule: EntropyRule) -> Column:
    """(first, last): from the start of the first window at or above the threshold to the end of the last, within ``word``."""
    bits = F.when(word.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit(rule.hex_bits)).when(word.rlike("^[A-Za-z0-9]+$"), F.lit(rule.alnum_bits)).otherwise(F.lit(rule.base64_bits))
    w = rule.window
    #: Entropy >= bits holds exactly when sum(c * log2 c) <= w * (log2 w - bits).
    most = w * (F.log2(F.lit(float(w))) - bits)

    def coded(chars):
        return _bound(F.array_distinct(chars), lambda kinds: F.struct(
            F.transform(chars, lambda c: F.array_position(kinds, c).cast("int")).alias("codes"), F.transform(kinds, lambda _: F.lit(0)).alias("none"), most.alias("most")))

    def slide(k):
        def moved(state, i, m):
            plus = F.element_at(state["counts"], m["came"])
            minus = F.when(m["went"] > 0, F.element_at(state["counts"], F.greatest(m["went"], F.lit(1)))).otherwise(F.lit(0))
            return F.when(m["went"] == m["came"], state["total"]).otherwise(
                state["total"] + (_clog(plus + 1) - _clog(plus) + F.when(m["went"] > 0, _clog(minus - 1) - _clog(minus)).otherwise(F.lit(0.0))))

        def step(state, i):
            came = F.element_at(k["codes"], i)
            went = F.when(i > w, F.element_at(k["codes"], F.greatest(i - w, F.lit(1)))).otherwise(F.lit(0))
            move = F.struct(came.alias("came"), went.alias("went"))

            def after(m, total):
                hit = (i >= w) & (total <= k["most"] + 1e-9)
                counts = F.transform(state["counts"], lambda c, j: F.when(j + 1 == m["came"], c + 1).when(j + 1 == m["went"], c - 1).otherwise(c))
                return F.struct(
                    F.when(m["went"] == m["came"], state["counts"]).otherwise(counts).alias("counts"),
                    total.alias("total"),
                    F.when(hit & (state["first"] < 0), i - w).otherwise(state["first"]).alias("first"),
                    F.when(hit, i).otherwise(state["last"]).alias("last"),
                )

            return _bound(move, lambda m: _bound(moved(state, i, m), lambda total: after(m, total)))

        begin = F.struct(k["none"].alias("counts"), F.lit(0.0).cast("double").alias("total"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
        return F.aggregate(F.sequence(F.lit(1), F.size(k["codes"])), begin, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))

    return _bound(_bound(F.split(word, ""), coded), slide)


def secret_spans(docs: DataFrame, text: str = "text", into: str = "secret_spans", rule: EntropyRule = EntropyRule(), allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """All columns of ``docs`` and ``into``: spans (start, rank in KINDS, end), by start, then rank."""
    t, low = F.col("__sec_text"), F.col("__sec_low")
    named = F.lit(False)
    for key in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        named = named | low.contains(key)
    df = docs.withColumn("__sec_text", F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn("__sec_low", F.lower("__sec_text"))
    df = df.withColumn(
        "__sec_base",
        F.array_sort(F.concat(
            _only_if(named & t.rlike(ASSIGN), _placed(t, ASSIGN, 0, 2, 8)),
            _only_if(t.contains("AKIA") & t.rlike(ACCESS), _placed(t, ACCESS, 1, 0, 16)),
            _only_if(t.rlike(HEX), _placed(t, HEX, 2, 0, 32)),
        )),
    )
    df = df.withColumn("__sec_cand", F.when(t.rlike(CANDIDATE), _matches(t, CANDIDATE, 0)))
    has = F.size("__sec_cand") > 0
    #: The fixed spans, and the farthest end up to each: with the number that begin before a candidate ends, it tells whether one touches it.
    #: Bound here, outside the walk over the candidates: a column named once within that walk would be worked out for each of them.
    fixed = F.struct(F.col("__sec_base").alias("base"), _running(F.col("__sec_base"), lambda at, b: F.greatest(at, b["end"])).alias("far"))

    def judged(known, c):
        word = c["word"]
        start = c["end"] - F.length(word)
        allowed = F.lit(False)
        for p in allow:
            allowed = allowed | word.rlike(p)
        base = known["base"]
        touches = F.when(F.size(base) > 0, _bound(_reached(base, F.size(base), c["end"]), lambda n: (n > 0) & (F.element_at(known["far"], F.greatest(n, F.lit(1))) > start))).otherwise(F.lit(False))
        hot = F.when(allowed | touches, F.lit(None)).otherwise(hot_range(word, rule))
        return F.struct(start.alias("start"), hot.alias("hot"))

    extra = F.transform(
        F.filter(_bound(fixed, lambda known: F.transform(F.col("__sec_cand"), lambda c: judged(known, c))), lambda c: c["hot"]["first"] >= 0),
        lambda c: F.struct((c["start"] + c["hot"]["first"]).alias("start"), F.lit(3).alias("rank"), (c["start"] + c["hot"]["last"]).alias("end")),
    )
    df = df.withColumn(into, F.when(has, F.array_sort(F.concat(F.col("__sec_base"), extra.cast(SPANS)))).otherwise(F.col("__sec_base")))
    return df.drop("__sec_text", "__sec_low", "__sec_base", "__sec_cand")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order of ``spans``."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced; spans that overlap become one mark."""
    far = _running(spans, lambda at, s: F.greatest(at, s["end"]))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def cut(parts, begin, end):
        """Characters from ``begin`` to before ``end``, of the blocks that hold them alone."""
        first = F.floor(begin / BLOCK).cast("int")
        some = F.slice(parts, first + 1, F.floor(end / BLOCK).cast("int") - first + 1)
        return F.substring(F.array_join(some, ""), (begin - first * BLOCK + 1).cast("int"), (end - begin).cast("int"))

    def joined(bound):
        def piece(s, i):
            before = F.when(i > 0, F.element_at(bound["far"], F.greatest(i, F.lit(1)))).otherwise(F.lit(0))
            return F.when(s["start"] >= before, F.concat(cut(bound["blocks"], before, s["start"]), F.lit(mark)))

        kept = F.filter(F.transform(spans, piece), lambda p: p.isNotNull())
        return F.concat(F.array_join(kept, ""), cut(bound["blocks"], F.element_at(bound["far"], -1), F.length(text)))

    return F.when(F.size(spans) > 0, _bound(F.struct(far.alias("far"), blocks.alias("blocks")), joined)).otherwise(text)


def _of_kind(spans: Column, rank: int) -> Column:
    return F.filter(spans, lambda s: s["rank"] == rank)


def scan_report(docs: DataFrame) -> DataFrame:
    """Query columns: counts per fixed kind, the digest of the fixed spans, and all spans as text."""
    found = secret_spans(docs.select("doc_id", "text"), into="__spans").select(F.col("doc_id").cast("long").alias("doc_id"), "__spans")
    spans = F.col("__spans")
    return found.select(
        "doc_id",
        *[F.size(_of_kind(spans, k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(written(F.filter(spans, lambda s: s["rank"] < 3)), 256).alias("base_sha256"),
        written(spans).alias("spans"),
        F.size(_of_kind(spans, 3)).cast("long").alias("n_entropy"),
    )
