"""Data-quality checks: any number of checks on one table compile into one aggregation pass.

A check is a ``Check``: a name, the column it is about, and a Column that says whether a row *violates* it.  Uniqueness
needs a grouping, so all unique keys together add one pass.

A column may be a path: ``address.city`` is a field of a struct, ``lines[].price`` a field of every element of an array and
``tags[]`` every element.  A row violates a check on elements when any of them does; results still count rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from curatrix.functions.predicates import regex_accepted
from curatrix.operators.skew import previous_in_order

RESULT_COLUMNS = ("seq", "object_name", "check_type", "column_name", "passed", "violations_count", "message")


@dataclass(frozen=True)
class Property:
    """Declared column of a contract object."""

    name: str
    logical_type: str | None = None
    required: bool = False
    unique: bool = False
    minimum: float | str | None = None
    maximum: float | str | None = None
    exclusive_minimum: float | str | None = None
    exclusive_maximum: float | str | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    enum: tuple | None = None
    min_items: int | None = None
    max_items: int | None = None
    unique_items: bool = False
    required_keys: tuple[str, ...] = ()


@dataclass(frozen=True)
class Check:
    check_type: str
    column: str
    violated: Column = field(compare=False)
    message: str = ""


def actual_name(df: DataFrame, name: str) -> str | None:
    """The table's own spelling of a column, whatever the case on either side."""
    return {c.lower(): c for c in df.columns}.get(name.lower())


def actual_path(schema: T.DataType, path: str) -> str | None:
    """``path`` as the schema spells it, whatever the case; None where the schema has no such field."""
    done, here = "", schema
    for step in re.findall(r"\[\]|[^.\[\]]+", path):
        if step == "[]":
            if not isinstance(here, T.ArrayType):
                return None
            done, here = done + "[]", here.elementType
            continue
        known = {f.name.lower(): f for f in here.fields} if isinstance(here, T.StructType) else {}
        if step.lower() not in known:
            return None
        found = known[step.lower()]
        done, here = f"{done}.{found.name}" if done else found.name, found.dataType
    return done


def _fields(c: Column, names: str) -> Column:
    return reduce(lambda x, name: x.getField(name), [n for n in names.split(".") if n], c)


def over(path: str, test: Callable[[Column], Column]) -> Column:
    """``test`` of the value at ``path``; for a path through arrays, whether it holds for any element."""
    head, *rest = path.split("[]")

    def at(c: Column, left: list[str]) -> Column:
        return F.exists(c, lambda e: at(_fields(e, left[0]), left[1:])) if left else F.coalesce(test(c), F.lit(False))

    return at(F.col(head), rest)


def elements(path: str) -> Column:
    """Array of the values at ``path``: one for a plain path, one per element for a path through arrays."""
    head, *rest = path.split("[]")
    if not rest:
        return F.array(F.col(head))

    def at(c: Column, left: list[str]) -> Column:
        inner = F.transform(c, lambda e: at(_fields(e, left[0]), left[1:]) if len(left) > 1 else _fields(e, left[0]))
        return F.flatten(F.filter(inner, lambda x: x.isNotNull())) if len(left) > 1 else inner

    return at(F.col(head), rest)


def any_of(conds: list[Column]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conds]), F.lit(False))


def required(col: str) -> Check:
    """NULL where a value has to be; a field is only required where the struct or element that holds it is there."""
    parent, _, name = col.rpartition(".")
    missing = over(parent, lambda c: c.isNotNull() & c.getField(name).isNull()) if parent and not name.endswith("[]") else over(col, lambda c: c.isNull())
    return Check("required", col, F.coalesce(missing, F.lit(False)), "null values")


def value_range(col: str, minimum=None, maximum=None, exclusive_minimum=None, exclusive_maximum=None, as_type="double") -> Check:
    """Inclusive (or exclusive) bounds after a cast; NULL is not a violation."""
    bound = lambda v: F.lit(v).cast(as_type)

    def outside(value: Column) -> Column:
        c, conds = value.try_cast(as_type), []
        if minimum is not None:
            conds.append(c < bound(minimum))
        if maximum is not None:
            conds.append(c > bound(maximum))
        if exclusive_minimum is not None:
            conds.append(c <= bound(exclusive_minimum))
        if exclusive_maximum is not None:
            conds.append(c >= bound(exclusive_maximum))
        return any_of(conds)

    return Check("range", col, any_of([over(col, outside)]), f"outside [{minimum}, {maximum}]")


def text_length(col: str, min_length: int | None = None, max_length: int | None = None) -> Check:
    def outside(value: Column) -> Column:
        n, conds = F.length(value.cast("string")), []
        if min_length is not None:
            conds.append(n < min_length)
        if max_length is not None:
            conds.append(n > max_length)
        return any_of(conds)

    return Check("length", col, any_of([over(col, outside)]), f"length outside [{min_length}, {max_length}]")


def valid_regex(pattern: str) -> bool:
    """Whether the engine that will run the pattern, Java's, accepts it."""
    return regex_accepted(pattern)


def pattern(col: str, regex: str) -> Check:
    """Unanchored regex on the text form.  A pattern that does not compile is reported as a rule error on every row."""
    if not valid_regex(regex):
        return Check("rule_error", col, F.lit(True), f"invalid pattern {regex}")
    return Check("pattern", col, any_of([over(col, lambda c: ~c.cast("string").rlike(regex))]), f"does not match {regex}")


def enum(col: str, values) -> Check:
    return Check("enum", col, any_of([over(col, lambda c: ~c.isin(list(values)))]), "not an allowed value")


def array_items(col: str, min_items=None, max_items=None, unique_items=False) -> Check:
    def wrong(c: Column) -> Column:
        conds = ([F.size(c) < min_items] if min_items is not None else []) + ([F.size(c) > max_items] if max_items is not None else [])
        return c.isNotNull() & any_of(conds + ([F.size(F.array_distinct(c)) < F.size(c)] if unique_items else []))

    return Check("items", col, any_of([over(col, wrong)]), "array items")


def required_keys(col: str, keys) -> Check:
    """Map keys or struct fields given as ``col.key`` that must be present."""
    wrong = lambda c: any_of([c.isNotNull() & F.try_element_at(c, F.lit(k)).isNull() for k in keys])
    return Check("required_keys", col, any_of([over(col, wrong)]), "missing keys " + ",".join(keys))


def expression(name: str, sql_expr: str) -> Check:
    """Row rule in Spark SQL; a NULL outcome is not a violation."""
    return Check("expression", name, any_of([~F.expr(sql_expr)]), sql_expr)


def checks_of(df: DataFrame, props: list[Property]) -> tuple[list[Check], list[str]]:
    """Checks in report order (required, range, length, pattern, ...) and the unique columns; unknown columns are left out."""
    known = [(p, actual_name(df, p.name) or actual_path(df.schema, p.name)) for p in props]
    known = [(p, c) for p, c in known if c]
    out: list[Check] = [required(c) for p, c in known if p.required]
    for p, c in known:
        bounds = (p.minimum, p.maximum, p.exclusive_minimum, p.exclusive_maximum)
        if any(b is not None for b in bounds):
            as_type = {"date": "date", "timestamp": "timestamp_ntz"}.get(p.logical_type or "", "double")
            out.append(value_range(c, *bounds, as_type=as_type))
    out += [text_length(c, p.min_length, p.max_length) for p, c in known if p.min_length is not None or p.max_length is not None]
    out += [pattern(c, p.pattern) for p, c in known if p.pattern]
    out += [enum(c, p.enum) for p, c in known if p.enum]
    out += [
        array_items(c, p.min_items, p.max_items, p.unique_items)
        for p, c in known
        if p.min_items is not None or p.max_items is not None or p.unique_items
    ]
    out += [required_keys(c, p.required_keys) for p, c in known if p.required_keys]
    return out, [c for p, c in known if p.unique]


def _result(seq: int, object_name: str, check_type: str, column: str, count: Column, message: str) -> Column:
    return F.struct(
        F.lit(seq).cast("bigint").alias("seq"),
        F.lit(object_name).alias("object_name"),
        F.lit(check_type).alias("check_type"),
        F.lit(column).alias("column_name"),
        ((count == 0) & F.lit(check_type != "rule_error")).alias("passed"),
        count.cast("bigint").alias("violations_count"),
        F.when(count == 0, "ok").otherwise(F.concat(count.cast("string"), F.lit(" violation(s): " + message))).alias("message"),
    )


def run_checks(df: DataFrame, checks: list[Check], object_name: str, first_seq: int = 0) -> DataFrame:
    """All row-level checks in one aggregation, one result row per check."""
    counts = [F.coalesce(F.sum(F.when(c.violated, 1)), F.lit(0)).alias(f"v{i}") for i, c in enumerate(checks)]
    rows = [
        _result(first_seq + i, object_name, c.check_type, c.column, F.col(f"v{i}"), c.message) for i, c in enumerate(checks)
    ]
    return df.agg(*counts).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def duplicate_groups(df: DataFrame, cols: list[str]) -> DataFrame:
    """Value groups that occur more than once; NULL is one group."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def repeated_values(df: DataFrame, keys: list[list[str]]) -> DataFrame:
    """(key, rows) for every value of the column lists ``keys`` that more than one row has, from one scan; ``key`` counts from 0.

    128-bit hashes of the values travel instead of the values, counted per task before the shuffle, so a hot value is cheap.
    A NULL is a value, told from others by its own flag.  A key of one path through arrays counts every element.
    """
    def marked(i: int, values: list[Column]) -> Column:
        nulls = F.concat(*[F.when(v.isNull(), "1").otherwise("0") for v in values])
        return F.struct(F.lit(i).alias("key"), nulls.alias("nulls"), F.xxhash64(*values).alias("h"), F.xxhash64(F.lit(i + 1), *values).alias("g"))

    def rows(i: int, cols: list[str]) -> Column:
        if len(cols) == 1 and "[]" in cols[0]:
            return F.coalesce(F.transform(elements(cols[0]), lambda v: marked(i, [v])), F.array())
        return F.array(marked(i, [F.col(c) for c in cols]))

    long = df.select(F.explode(F.concat(*[rows(i, cols) for i, cols in enumerate(keys)])).alias("v")).select("v.*")
    return long.groupBy("key", "nulls", "h", "g").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1).select("key", "rows")


def check_unique_keys(df: DataFrame, keys: list[list[str]], object_name: str, first_seq: int = 0) -> DataFrame:
    """One result per key, all from one pass; violations = number of duplicated values."""
    counts = [F.count_if(F.col("key") == i).alias(f"n{i}") for i in range(len(keys))]
    rows = [_result(first_seq + i, object_name, "unique", ",".join(cols), F.col(f"n{i}"), "duplicated values") for i, cols in enumerate(keys)]
    return repeated_values(df, keys).agg(*counts).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def check_unique(df: DataFrame, cols: list[str], object_name: str, seq: int = 0) -> DataFrame:
    """Violations = number of duplicated values."""
    return check_unique_keys(df, [cols], object_name, seq)


def run_contract_checks(df: DataFrame, object_name: str, props: list[Property]) -> DataFrame:
    """Results in report order: required, unique, range, length, pattern, then the rest."""
    checks, unique = checks_of(df, props)
    head = [c for c in checks if c.check_type == "required"]
    tail = [c for c in checks if c.check_type != "required"]
    ordered = head + tail
    parts = []
    if ordered:
        fused = run_checks(df, ordered, object_name)
        shift = F.when(F.col("seq") >= len(head), F.col("seq") + len(unique)).otherwise(F.col("seq"))
        parts.append(fused.withColumn("seq", shift))
    if unique:
        parts.append(check_unique_keys(df, [[c] for c in unique], object_name, len(head)))
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "seq bigint, object_name string, check_type string, column_name string, passed boolean, violations_count bigint, message string"
        )
    return reduce(DataFrame.unionByName, parts)


def table_access_failure(spark, object_name: str, reason: str) -> DataFrame:
    """The one failed result an unreadable table leaves behind."""
    row = (0, object_name, "table_access", "", False, 0, reason)
    return spark.createDataFrame(
        [row], "seq bigint, object_name string, check_type string, column_name string, passed boolean, violations_count bigint, message string"
    )


def checked_table(spark, read, object_name: str, props: list[Property]) -> DataFrame:
    """``read()`` gives the table; an unreadable one yields a failed result so that the other objects go on."""
    try:
        return run_contract_checks(read(), object_name, props)
    except AnalysisException as err:
        return table_access_failure(spark, object_name, str(err).splitlines()[0])


def score_expr(passed: Column, total: Column) -> Column:
    return F.round(100.0 * passed / F.greatest(total, F.lit(1)), 2)


def summarize_run(results: DataFrame, keys: tuple[str, ...] = ("object_name",)) -> DataFrame:
    """Counts, score and outcome of a run; ``status`` is failed as soon as one check failed."""
    agg = results.groupBy(*keys).agg(
        F.count_if("passed").alias("checks_passed"),
        F.count_if(~F.col("passed")).alias("checks_failed"),
        F.sum("violations_count").alias("violations"),
    )
    total = F.col("checks_passed") + F.col("checks_failed")
    return agg.withColumn("score", score_expr(F.col("checks_passed"), total)).withColumn(
        "status", F.when(F.col("checks_failed") == 0, "succeeded").otherwise("failed")
    )


# ---- row-level split ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class RowRule:
    """``expr`` is what a good row satisfies."""

    name: str
    expr: Column = field(compare=False)
    criticality: str = "error"
    schema: str | None = None


def expr_rule(name: str, sql_expr: str, criticality: str = "error", schema: str | None = None) -> RowRule:
    return RowRule(name, F.expr(sql_expr), criticality, schema)


def select_rules(rules: list[RowRule], schema: str) -> list[RowRule]:
    """Rules tagged with this schema, and untagged ones."""
    return [r for r in rules if r.schema is None or r.schema == schema]


def _broken(rules: list[RowRule], level: str) -> Column:
    names = [F.when(~F.coalesce(r.expr, F.lit(True)), F.lit(r.name)) for r in rules if r.criticality == level]
    return F.filter(F.array(*names), lambda x: x.isNotNull()) if names else F.array().cast("array<string>")


def annotate_rows(df: DataFrame, rules: list[RowRule]) -> DataFrame:
    return df.withColumn("_errors", _broken(rules, "error")).withColumn("_warnings", _broken(rules, "warn"))


def _holds(rules: list[RowRule], level: str) -> Column:
    """All rules of the level hold, as one boolean expression that stays in generated code; NULL outcomes hold."""
    return reduce(lambda a, b: a & b, [F.coalesce(r.expr, F.lit(True)) for r in rules if r.criticality == level], F.lit(True))


def split_rows(df: DataFrame, rules: list[RowRule]) -> tuple[DataFrame, DataFrame]:
    """Rows that break an error rule go to the bad side; warnings only annotate.  Both sides are plain filters."""
    ok = _holds(rules, "error")
    return annotate_rows(df.filter(ok), rules), annotate_rows(df.filter(~ok), rules)


def split_score(df: DataFrame, rules: list[RowRule]) -> DataFrame:
    """good, bad, warned and 100 * good / rows (an empty input scores 100) in one pass."""
    ok, quiet = _holds(rules, "error"), _holds(rules, "warn")
    agg = df.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(ok).alias("good_rows"), F.count_if(~ok).alias("bad_rows"), F.count_if(ok & ~quiet).alias("warned_rows"))
    score = F.when(F.col("total_rows") == 0, 100.0).otherwise(F.round(100.0 * F.col("good_rows") / F.col("total_rows"), 2))
    return agg.withColumn("score_percent", score)


# ---- rule library ---------------------------------------------------------------------------------------------

# Rule function to quality dimension.
RULE_DIMENSIONS = {
    "is_not_null": "completeness",
    "is_not_null_or_empty": "completeness",
    "is_null": "completeness",
    "min_max": "conformity",
    "is_in": "conformity",
    "pattern": "conformity",
    "is_unique": "uniqueness",
}


def rule_dimension(function: Column) -> Column:
    out = None
    for name, dim in RULE_DIMENSIONS.items():
        out = F.when(function == name, dim) if out is None else out.when(function == name, dim)
    return out.otherwise("accuracy")


def library_rule(function: str, col: str, **args) -> Column:
    """What a good value satisfies, for the named rule function.

    ``is_unique`` reads the flag that ``with_unique_flags`` adds for the column.
    """
    c = F.col(col)
    if function == "is_null":
        return c.isNull()
    if function == "is_unique":
        return F.col(unique_flag(col))
    if function == "is_not_null":
        return c.isNotNull()
    if function == "is_not_null_or_empty":
        return c.isNotNull() & (F.trim(c.cast("string")) != "")
    if function == "min_max":
        return c.between(args["min"], args["max"])
    if function == "is_in":
        return c.isin(list(args["values"]))
    if function == "pattern":
        return c.cast("string").rlike(args["regex"]) if valid_regex(args["regex"]) else F.lit(False)
    raise ValueError(f"unknown rule function {function}")


def unique_flag(col: str) -> str:
    return f"_unique_{col}"


def with_unique_flags(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with a flag per column: its value is NULL or this row's alone.

    Values that more than one row has are counted first and joined back, one row per value.  No window holds the rows of a
    value: they stay where the join finds them, and Spark splits skewed partitions.  NULLs take no part in the join.
    """
    out = df
    for col in cols:
        repeated = duplicate_groups(df.filter(F.col(col).isNotNull()), [col]).select(F.col(col).alias("_value"), F.lit(True).alias("_repeated"))
        rows = out.filter(F.col(col).isNotNull()).join(repeated, F.col(col) == F.col("_value"), "left").drop("_value")
        flagged = rows.withColumn(unique_flag(col), F.col("_repeated").isNull()).drop("_repeated")
        out = flagged.unionByName(out.filter(F.col(col).isNull()).withColumn(unique_flag(col), F.lit(True)))
    return out


def unique_violations(df: DataFrame, col: str) -> DataFrame:
    """One row with ``violations_count``: rows whose value is not theirs alone; counted per value before the shuffle."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col)).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("violations_count"))


def threshold(metric: Column, op: str, value, upper=None) -> Column:
    """mustBe, mustNotBe, mustBeGreaterThan, ... on an aggregated metric; a NULL metric fails."""
    tests = {
        "must_be": lambda: metric == value,
        "must_not_be": lambda: metric != value,
        "must_be_gt": lambda: metric > value,
        "must_be_ge": lambda: metric >= value,
        "must_be_lt": lambda: metric < value,
        "must_be_le": lambda: metric <= value,
        "must_be_between": lambda: metric.between(value, upper),
        "must_not_be_between": lambda: ~metric.between(value, upper),
    }
    return F.coalesce(tests[op](), F.lit(False))


def check_thresholds(df: DataFrame, specs: list[tuple[str, Column, str, object, object]]) -> DataFrame:
    """``(name, metric, op, value, upper)`` specs evaluated in one aggregation."""
    agg = df.agg(*[m.cast("double").alias(f"m{i}") for i, (_, m, *_r) in enumerate(specs)])
    rows = [
        F.struct(
            F.lit(name).alias("rule"),
            F.col(f"m{i}").alias("metric"),
            threshold(F.col(f"m{i}"), op, value, upper).alias("passed"),
        )
        for i, (name, _m, op, value, upper) in enumerate(specs)
    ]
    return agg.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# ---- references, freshness, order, volume ----------------------------------------------------------------------


def referential_violations(df: DataFrame, col: str, ref: DataFrame, ref_col: str, negate: bool = False) -> DataFrame:
    """Rows whose key is missing from (or, negated, present in) the reference; NULL keys are not violations."""
    keys = ref.select(F.col(ref_col).alias("_ref_key")).filter(F.col("_ref_key").isNotNull()).distinct()
    rows = df.filter(F.col(col).isNotNull())
    return rows.join(keys, F.col(col) == F.col("_ref_key"), "left_semi" if negate else "left_anti")


def row_freshness(ts: Column, as_of, seconds: int) -> Column:
    """A good row is not older than ``seconds`` at ``as_of``."""
    return ts >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(seconds)} seconds")


def sequence_violations(df: DataFrame, key: str, ts: str, tie: str, event: str, ranks: dict[str, int]) -> DataFrame:
    """Events of one key whose rank does not rise over the event before them."""
    rank = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[F.col(event)]
    ranked = df.filter(F.col(event).isin(list(ranks))).withColumn("rank", rank)
    prev = previous_in_order(ranked, [key], ts, tie, ["rank", event])
    return prev.filter(F.col("rank") <= F.col("prev_rank"))


def zero_filled(counts: DataFrame, at: str, n: str, keys: tuple[str, ...] = (), step: str = "1 day") -> DataFrame:
    """One row per key and step from the key's first to the last step of all keys; a step without a row counts 0."""
    last = counts.agg(F.max(at)).scalar()
    spans = counts.groupBy(*keys).agg(F.min(at).alias("_first"))
    grid = spans.select(*keys, F.explode(F.sequence(F.col("_first"), last, F.expr(f"interval {step}"))).alias(at))
    return grid.join(counts, [*keys, at], "left").withColumn(n, F.coalesce(F.col(n), F.lit(0).cast("long")))


def volume_floor(daily: DataFrame, day: str, n: str, keys: tuple[str, ...] = (), ratio: float = 0.8, days: int = 7, step: str = "1 day") -> DataFrame:
    """Counts per step against ``ratio`` times the mean of the ``days`` steps before; the first has nothing to miss.

    Steps without a row are filled with 0 first, so that an outage is judged and pulls the mean down.  A key has one row
    per step, so its window is small whatever the number of events behind it.
    """
    w = W.partitionBy(*[F.col(k) for k in keys]).orderBy(day).rowsBetween(-days, -1)
    out = zero_filled(daily.select(*keys, day, n), day, n, keys, step).withColumn("trailing_avg", F.avg(n).over(w))
    return out.withColumn("passed", F.coalesce(F.col(n) >= ratio * F.col("trailing_avg"), F.lit(True)))
