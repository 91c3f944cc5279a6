"""Record matching and merging against a master table.

The reference semantics compare every source record with every master record.  Here the rules themselves give exact
candidates: a pair can only reach the threshold when some minimal set of its deterministic rules agrees, so candidates
are equi joins on the normalised fields of those sets, and no pair that could match is missed.  Records that agree in
every match field are one profile, so copies are scored once, however many there are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.scalar import match_type, normalize_email, normalize_phone7
from curatrix.functions.similarity import similarity, token_sort
from curatrix.operators.skew import first_per_key, salt, salted_join
from curatrix.session import settled

EPS = 1e-9


@dataclass(frozen=True)
class MatchRule:
    """``exact`` is the same as ``deterministic``, ``probabilistic`` the same as ``fuzzy`` (first field only)."""

    name: str
    kind: str
    fields: tuple[str, ...]
    weight: float = 1.0
    threshold: float = 0.7
    algorithm: str = "ratio"

    @property
    def deterministic(self) -> bool:
        return self.kind in ("deterministic", "exact")


def normalized(field: str, value: Column) -> Column:
    """Fields named like a phone or an e-mail compare in their normal form."""
    name = field.lower()
    if "phone" in name:
        return normalize_phone7(value)
    if "email" in name:
        return normalize_email(value)
    return value


def applicable(rules: list[MatchRule], columns: list[str]) -> list[MatchRule]:
    """Rules with at least one known field; the others do not count towards the total weight."""
    out = []
    for r in rules:
        known = tuple(f for f in (r.fields if r.deterministic else r.fields[:1]) if f in columns)
        if known:
            out.append(MatchRule(r.name, r.kind, known, r.weight, r.threshold, r.algorithm))
    return out


def min_threshold(rules: list[MatchRule]) -> float:
    return min((r.threshold for r in rules), default=0.7)


def minimal_blocks(rules: list[MatchRule], threshold: float) -> list[tuple[MatchRule, ...]]:
    """Smallest sets of deterministic rules without which a pair cannot reach the threshold, even with perfect text."""
    det = [r for r in rules if r.deterministic]
    fuzzy = sum(r.weight for r in rules if not r.deterministic)
    need = threshold * sum(r.weight for r in rules)
    out: list[tuple[MatchRule, ...]] = []
    for size in range(len(det) + 1):
        for group in combinations(det, size):
            names = {r.name for r in group}
            if any({r.name for r in smaller} <= names for smaller in out):
                continue
            if sum(r.weight for r in group) + fuzzy >= need - EPS:
                out.append(group)
    return out


def profiles(df: DataFrame, fields: list[str], ident: str) -> tuple[DataFrame, DataFrame]:
    """(profiles, members): distinct match-field values with their number of records, and which record has which."""
    key = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256).alias("profile")
    distinct = df.groupBy(*fields).agg(F.count(F.lit(1)).alias("records"), F.min(ident).alias("first_id"))
    return distinct.select(key, "*"), df.select(key, F.col(ident).alias("id"))


def _rule_agrees(rule: MatchRule) -> Column:
    same = [normalized(f, F.col(f"m_{f}")) == normalized(f, F.col(f"s_{f}")) for f in rule.fields]
    return F.coalesce(reduce(lambda a, b: a & b, same), F.lit(False))


def block_pairs(master: DataFrame, source: DataFrame, blocks: list[tuple[tuple[str, Column], ...]]) -> DataFrame:
    """Pairs that agree on at least one block, each once.

    A block is a tuple of (name, key Column) over the unprefixed columns; NULL keys pair with nothing.  A pair is left
    to the first block it satisfies, so no distinct is needed.  Spark splits skewed keys at run time.
    """
    everything = {}
    for block in blocks:
        for name, key in block:
            everything[name] = key
    keyed = lambda df, pre: df.select(*[F.col(c).alias(pre + c) for c in df.columns], *[k.alias(f"{pre}k_{n}") for n, k in everything.items()])
    m, s = keyed(master, "m_"), keyed(source, "s_")
    parts, earlier = [], F.lit(False)
    for block in blocks:
        names = [f"k_{n}" for n, _ in block]
        left = reduce(DataFrame.filter, [F.col("s_" + n).isNotNull() for n in names], s)
        right = reduce(DataFrame.filter, [F.col("m_" + n).isNotNull() for n in names], m)
        for n in names:
            left, right = left.withColumn("b_" + n, F.col("s_" + n)), right.withColumn("b_" + n, F.col("m_" + n))
        joined = salted_join(left, right, ["b_" + n for n in names]).drop(*["b_" + n for n in names])
        parts.append(joined.filter(~earlier))
        agrees = reduce(lambda a, b: a & b, [F.col("s_" + n) == F.col("m_" + n) for n in names])
        earlier = earlier | F.coalesce(agrees, F.lit(False))
    out = reduce(DataFrame.unionByName, parts)
    return out.drop(*[p + f"k_{n}" for n in everything for p in ("m_", "s_")])


def rule_blocks(rules: list[MatchRule], threshold: float) -> list[tuple[tuple[str, Column], ...]]:
    """Exact blocks for ``block_pairs`` from the rules.

    Where text rules reach the threshold alone, ``text_pairs`` finds the pairs without an agreeing deterministic rule, and
    every deterministic rule is a block of its own: a pair that agrees on it may match below the floor of the text.
    """
    groups = minimal_blocks(rules, threshold)
    if () in groups:
        groups = [(r,) for r in rules if r.deterministic]
    return [tuple((f"{r.name}_{f}", normalized(f, F.col(f))) for r in group for f in r.fields) for group in groups]


def text_floor(rules: list[MatchRule], threshold: float) -> float | None:
    """The ratio that at least one text rule must have in a pair without any agreeing deterministic rule; None if no such pair matches."""
    weight = sum(r.weight for r in rules if not r.deterministic)
    need = threshold * sum(r.weight for r in rules)
    return None if weight <= 0 or need > weight + EPS else (need - EPS) / weight


# Per algorithm: the compared form of a text, and the share of a text's characters that edits can take at a ratio of ``floor``.
BOUNDED = {
    "ratio": (F.lower, lambda floor: 1 - floor),
    "token_sort": (token_sort, lambda floor: 1 - floor),
    "indel": (F.lower, lambda floor: 2 * (1 - floor) / (2 - floor)),
}


def gram_length(floor: float, algorithm: str = "ratio") -> int:
    """The longest q-grams, up to 3, of which two texts with a ratio of ``floor`` are sure to share one."""
    share = BOUNDED[algorithm][1](floor)
    return max(q for q in (1, 2, 3) if q == 1 or q * share <= 1 + EPS)


def text_pairs(master: DataFrame, source: DataFrame, field: str, floor: float, algorithm: str = "ratio") -> DataFrame:
    """(m_profile, s_profile) of every pair whose ``field`` may have a ratio of ``floor``; none is missed.

    Prefix filter over q-grams: an edit spoils at most q of the padded q-grams of a text, so at this ratio at most
    ``q * share * length`` of them are spoilt on either side.  With the grams of every text in one order, rarest first, the
    side whose prefix of two grams more ends earlier holds two unspoilt grams (all there are, where the text is too short),
    and the other side has them in its prefix too.  So an equi join on the grams of the prefixes finds the pair that often.
    Grams that tie with the last one belong to the prefix.  Lengths and places must be within the edits as well.
    """
    if floor <= 0:
        raise ValueError("a floor of 0 keeps every pair")
    form, lost = BOUNDED[algorithm]
    share, q = lost(floor), gram_length(floor, algorithm)
    pad, meetings = F.lit("\0" * (q - 1)), 2
    spoilt = lambda size: F.floor(q * share * size + 1e-6)

    def grams(df: DataFrame) -> DataFrame:
        text = df.select("profile", form(F.col(field).cast("string")).alias("text")).filter(F.length("text") > 0).withColumn("size", F.length("text"))
        padded = F.concat(pad, F.col("text"), pad)
        cut = F.transform(F.sequence(F.lit(1), F.col("size") + q - 1), lambda i: F.substr(padded, i, F.lit(q)))
        return text.select("profile", "size", F.posexplode(cut).alias("at", "gram"))

    sides = {"m": grams(master), "s": grams(source)}
    often = sides["m"].select("gram").unionByName(sides["s"].select("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("often"))

    def prefix(name: str) -> DataFrame:
        order = Window.partitionBy("profile").orderBy("often", "gram")
        ranked = sides[name].join(often, "gram").withColumn("place", F.rank().over(order))
        kept = ranked.filter(F.col("place") <= spoilt(F.col("size")) + meetings)
        return kept.select("gram", *[F.col(c).alias(f"{name}_{c}") for c in ("profile", "size", "at")])

    short, long = F.least("m_size", "s_size"), F.greatest("m_size", "s_size")
    if algorithm == "indel":
        edits = (1 - floor) * (short + long) + 1e-6
        near, moved = 2 * short + 1e-6 >= floor * (short + long), (edits + long - short) / 2
    else:
        near, moved = short + 1e-6 >= floor * long, (1 - floor) * long + 1e-6
    met = salted_join(prefix("s"), prefix("m"), ["gram"]).filter(near & (F.abs(F.col("m_at") - F.col("s_at")) <= moved))
    left = F.greatest(*[F.col(c) + q - 1 - spoilt(F.col(c)) for c in ("m_size", "s_size")])
    often_enough = F.col("met") >= F.least(F.lit(meetings), left)
    return met.groupBy("m_profile", "s_profile", "m_size", "s_size").agg(F.count(F.lit(1)).alias("met")).filter(often_enough).select("m_profile", "s_profile")


def score_deterministic(rule: MatchRule) -> Column:
    return F.when(_rule_agrees(rule), F.lit(float(rule.weight))).otherwise(0.0)


def score_fuzzy(rule: MatchRule) -> Column:
    f = rule.fields[0]
    return similarity(F.col(f"m_{f}").cast("string"), F.col(f"s_{f}").cast("string"), rule.algorithm) * rule.weight


def with_confidence(pairs: DataFrame, rules: list[MatchRule]) -> DataFrame:
    """Rule scores, the share of the total weight they reach, and the names of the rules that scored."""
    if not rules:
        return pairs.withColumn("confidence", F.lit(0.0)).withColumn("matched_rules", F.array().cast("array<string>"))
    out = pairs
    for i, r in enumerate(rules):
        out = out.withColumn(f"score_{i}", score_deterministic(r) if r.deterministic else score_fuzzy(r))
    scores = [F.col(f"score_{i}") for i in range(len(rules))]
    total = float(sum(r.weight for r in rules))
    confidence = sum(scores[1:], scores[0]) / total if total > 0 else F.lit(0.0)
    names = F.array(*[F.when(s > 0, F.lit(r.name)) for s, r in zip(scores, rules)])
    out = out.withColumn("confidence", confidence).withColumn("matched_rules", F.filter(names, lambda n: n.isNotNull()))
    return out.drop(*[f"score_{i}" for i in range(len(rules))])


def find_matches(master: DataFrame, source: DataFrame, rules: list[MatchRule], blocks=None) -> DataFrame:
    """Pairs of profiles that reach the lowest rule threshold; ``master`` and ``source`` come from ``profiles``."""
    used = applicable(rules, master.columns)
    threshold = min_threshold(rules)
    keys = blocks or rule_blocks(used, threshold)
    pairs = [block_pairs(master, source, keys)] if keys else []
    floor = None if blocks else text_floor(used, threshold)
    if floor is not None:
        text = [r for r in used if not r.deterministic]
        if any(r.algorithm not in BOUNDED for r in text):
            raise ValueError(f"text rules reach the threshold alone: pass block keys, only {', '.join(BOUNDED)} bound their candidates")
        near = reduce(DataFrame.unionByName, [text_pairs(master, source, r.fields[0], floor, r.algorithm) for r in text]).distinct()
        sides = [df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns]) for p, df in (("m", master), ("s", source))]
        pairs.append(near.join(sides[0], "m_profile").join(sides[1], "s_profile"))
    if not pairs:
        raise ValueError("no rule can reach the threshold")
    both = reduce(DataFrame.unionByName, pairs)
    both = both.dropDuplicates(["m_profile", "s_profile"]) if len(pairs) > 1 else both
    return with_confidence(both, used).filter(F.col("confidence") >= threshold - EPS)


def with_master_columns(source: DataFrame, mapping: dict[str, str], columns: list[str]) -> DataFrame:
    """``source`` under the master's column names; ``mapping`` goes from source to master names.

    Columns that are named alike need no entry, case does not matter, and what the source lacks is NULL.
    """
    own = {c.lower(): c for c in source.columns}
    back = {v.lower(): own[k.lower()] for k, v in mapping.items() if k.lower() in own}
    pick = lambda c: back.get(c.lower(), own.get(c.lower()))
    return source.select(*[(F.col(pick(c)) if pick(c) else F.lit(None).cast("string")).alias(c) for c in columns])


def pair_candidates(matches: DataFrame, master: DataFrame, source: DataFrame, master_members: DataFrame, source_members: DataFrame, ident: str) -> DataFrame:
    """One pending candidate for every pair of records behind the matches, with both records as JSON.

    The JSON is made once per record and joined to the members, so that the pairs, which grow with the square of a profile's copies, are never shuffled.
    """
    record = lambda df, name: df.select(F.col(ident).alias("id"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(f"{name}_record"))
    rows = expand_matches(matches, master_members.join(record(master, "master").hint("merge"), "id"), source_members.join(record(source, "source").hint("merge"), "id"))
    return rows.select("source_id", "master_id", "confidence", match_type(F.col("confidence")).alias("match_type"), "matched_rules", "master_record", "source_record", F.lit("pending").alias("status"))


def best_candidates(matches: DataFrame, source_members: DataFrame) -> DataFrame:
    """One candidate per source record: its best master profile (ties: lowest master id), or ``new`` with confidence 1."""
    best = first_per_key(matches, ["s_profile"], [F.col("confidence").desc(), F.col("m_first_id")])
    best = best.select(F.col("s_profile").alias("profile"), F.col("m_first_id").alias("master_id"), "confidence", "matched_rules")
    rows = source_members.join(best, "profile", "left")
    return rows.select(
        F.col("id").alias("source_id"), "master_id", F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        F.when(F.col("master_id").isNull(), "new").otherwise(match_type(F.col("confidence"))).alias("match_type"),
        F.coalesce("matched_rules", F.array().cast("array<string>")).alias("matched_rules"), F.lit("pending").alias("status"))


# Records of a profile that stand together: a file names so few of them by number, and two such tiles make a few million pairs. Masters of a tile that a row holds.
TILE, RUN = 2048, 64


def expand_matches(matches: DataFrame, master_members: DataFrame, source_members: DataFrame) -> DataFrame:
    """Record pairs behind profile pairs, for callers who want every single one; the result is as large as it is.

    ``matches`` come from ``find_matches`` and are written once. Further columns of the members come along.
    """
    side = lambda df, pre, name: df.withColumnsRenamed({"profile": f"{pre}_profile", "id": f"{name}_id"})
    found = settled(matches.select("m_profile", "s_profile", "confidence", "matched_rules", "m_records", "s_records"), "matches")
    masters, sources = side(master_members, "m", "master"), side(source_members, "s", "source")
    many = F.greatest("m_records", "s_records") > RUN
    few = sources.join(found.filter(~many), "s_profile").join(masters, "m_profile").drop("m_records", "s_records")
    return few.unionByName(_tiled(found.filter(many), masters, sources).select(*few.columns))


def _tiled(found: DataFrame, masters: DataFrame, sources: DataFrame) -> DataFrame:
    """The record pairs of matches that have many: tile against tile, each source record of one with runs of masters of the other, always in the same order.

    The records of a profile are dealt into tiles by their content. What is shuffled are tiles, not pairs, and they go to tasks by the number of pairs, of which
    AQE knows nothing. A task writes pairs of few different records, again and again in one order, so that a file of very many pairs stays small. A run is
    short because Spark holds what a row of runs makes with all sources of a tile before it hands on the first pair.
    """
    tiles = lambda pre: F.ceil(F.col(f"{pre}_records") / TILE).cast("int")
    every = lambda pre: F.explode(F.sequence(F.lit(0), tiles(pre) - 1))
    cell = ["m_profile", "s_profile", "m_number", "s_number"]
    held, rest = [[c for c in df.columns if c != key] for df, key in ((masters, "m_profile"), (sources, "s_profile"))]

    dealt = masters.join(found.select("m_profile", tiles("m").alias("_tiles")).distinct(), "m_profile").withColumn("m_number", salt(masters, F.col("_tiles")))
    tile = dealt.groupBy("m_profile", "m_number").agg(F.collect_list(F.struct(*held)).alias("_tile"))
    starts = F.sequence(F.lit(1), F.size("_tile"), F.lit(RUN))
    runs = tile.select("m_profile", "m_number", F.explode(F.transform(starts, lambda i: F.slice("_tile", i, RUN))).alias("_run"))
    cells = found.withColumn("m_number", every("m")).withColumn("s_number", every("s")).select(*cell, "confidence", "matched_rules")
    left = cells.join(runs.hint("merge"), ["m_profile", "m_number"])
    right = sources.join(found, "s_profile").withColumn("s_number", salt(sources, tiles("s"))).withColumn("m_number", every("m")).select(*cell, *rest)

    pairs = found.agg(F.sum(F.col("m_records") * F.col("s_records"))).head()[0] or 0
    spread = lambda df: df.repartition(pairs // TILE**2 + 1, *cell)
    return spread(left).join(spread(right).hint("merge"), cell).select(*cell[:2], "confidence", "matched_rules", *rest, F.inline("_run"))


def run_totals(candidates: DataFrame, master: DataFrame, source: DataFrame) -> DataFrame:
    one = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return candidates.agg(
        F.count_if(F.col("match_type") != "new").alias("matches"), F.count_if(F.col("match_type") == "new").alias("new_records")
    ).select("*", one(source).alias("source_count"), one(master).alias("master_count"))


# ---- merging --------------------------------------------------------------------------------------------------------


def _present(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def survive(master: Column, source: Column, strategy: str) -> Column:
    """The value that survives, by the strategy of the field."""
    if strategy == "most_complete":
        longer = _present(source) & (~_present(master) | (F.length(source.cast("string")) > F.length(master.cast("string"))))
        return F.when(longer, source).otherwise(master)
    if strategy == "master_wins":
        return F.when(_present(master), master).otherwise(source)
    if strategy in ("source_wins", "most_recent"):
        return F.when(_present(source), source).otherwise(master)
    raise ValueError(strategy)


def survivorship(pairs: DataFrame, fields: list[str], strategies: dict[str, str], matched: Column) -> DataFrame:
    """``merged_<field>`` over ``m_`` and ``s_`` columns; without a master record the source is taken as it is."""
    out = pairs
    for f in fields:
        value = survive(F.col(f"m_{f}"), F.col(f"s_{f}"), strategies.get(f, "source_wins"))
        out = out.withColumn(f"merged_{f}", F.when(matched, value).otherwise(F.col(f"s_{f}")))
    return out


def most_trusted(values: DataFrame, key: str, field: str, priority: str) -> DataFrame:
    """The present value of the source with the smallest priority number, per key."""
    rows = values.filter(_present(F.col(field)))
    return rows.groupBy(key).agg(F.min(F.struct(F.col(priority), F.col(field))).alias("m")).select(key, F.col(f"m.{field}").alias(field))


def merge_approved(candidates: DataFrame, fields: list[str], strategies: dict[str, str], dry_run: bool = False) -> DataFrame:
    """Approved candidates with their merged record; a value given by the reviewer (``given_<field>``) wins.

    The status becomes ``merged`` unless it is a dry run.
    """
    out = survivorship(candidates.filter("status = 'approved'"), fields, strategies, F.col("master_id").isNotNull())
    for f in fields:
        if f"given_{f}" in candidates.columns:
            out = out.withColumn(f"merged_{f}", F.coalesce(f"given_{f}", f"merged_{f}"))
    return out if dry_run else out.withColumn("status", F.lit("merged"))


def golden_table(master: DataFrame, merged: DataFrame, ident: str, fields: list[str]) -> DataFrame:
    """Master with the merged values in place; where several candidates hit one record the most confident one counts."""
    one = first_per_key(merged.filter("master_id IS NOT NULL"), ["master_id"], [F.col("confidence").desc(), F.col("source_id")])
    upd = one.select(F.col("master_id").alias(ident), F.lit(True).alias("_upd"), *[F.col(f"merged_{f}").alias(f"_{f}") for f in fields])
    out = master.join(upd, ident, "left")
    for f in fields:
        out = out.withColumn(f, F.when(F.col("_upd"), F.col(f"_{f}")).otherwise(F.col(f)))
    return out.select(*master.columns)


# Confidence bands of the review routing.
ROUTES = ((0.95, "auto_merge"), (0.90, "review"), (0.80, "valid"))


def route(confidence: Column) -> Column:
    out = F.lit("reject")
    for bound, name in reversed(ROUTES):
        out = F.when(confidence >= bound, name).otherwise(out)
    return out


def exclude(df: DataFrame, rules: list[Column]) -> DataFrame:
    """Rows that no exclusion rule hits."""
    hit = reduce(lambda a, b: a | b, [F.coalesce(r, F.lit(False)) for r in rules], F.lit(False))
    return df.filter(~hit)


def changed_since(df: DataFrame, column: str, since) -> DataFrame:
    return df.filter(F.col(column) > F.lit(since).cast("timestamp_ntz"))


def sync_review_status(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """(review_id, new_status) for linked candidates that were decided; ``reviews`` holds review_id."""
    decided = candidates.filter(F.col("review_id").isNotNull() & F.col("status").isin("approved", "rejected"))
    return decided.join(reviews.select("review_id"), "review_id", "left_semi").select("review_id", F.col("status").alias("new_status"))


def sync_counts(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    known = reviews.select("review_id", F.lit(True).alias("known")).distinct()
    ok = F.coalesce("known", F.lit(False))
    out = candidates.join(known, "review_id", "left")
    return out.agg(
        F.count_if(ok & (F.col("status") == "approved")).alias("synced_approved"), F.count_if(ok & (F.col("status") == "rejected")).alias("synced_rejected"),
        F.count_if(~(ok & F.col("status").isin("approved", "rejected"))).alias("skipped"))
