"""Two-valued rule predicates: every result is true or false, never NULL."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _two_valued(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def equals(a: Column, b) -> Column:
    """NULL equals NULL, NULL differs from everything else."""
    return a.eqNullSafe(b)


def differs(a: Column, b) -> Column:
    return ~a.eqNullSafe(b)


def compare(a: Column, op: str, b) -> Column:
    """Ordering comparison; false when either side is NULL."""
    b = b if isinstance(b, Column) else F.lit(b)
    test = {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]
    return _two_valued(test)


def regex_accepted(pattern: str) -> bool:
    """Whether Java's engine, which runs the patterns, compiles ``pattern``; asked when the plan is built."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def matches(c: Column, pattern: str) -> Column:
    """Regex anchored at the start of the text only; a pattern that does not compile matches nothing."""
    if not regex_accepted(f"^(?:{pattern})"):
        return F.lit(False)
    return _two_valued(c.cast("string").rlike(f"^(?:{pattern})"))


def member_of(c: Column, values: Iterable) -> Column:
    if isinstance(values, (str, bytes)) or not isinstance(values, Iterable):
        raise TypeError("IN needs a list")
    values = list(values)
    hit = _two_valued(c.isin([v for v in values if v is not None]))
    return (hit | c.isNull()) if None in values else hit


def contains(c: Column, needle, dtype: T.DataType = T.StringType()) -> Column:
    """Element of an array, key of a map, else a substring of the text form."""
    if isinstance(dtype, T.ArrayType):
        return _two_valued(F.array_contains(c, needle))
    if isinstance(dtype, T.MapType):
        return _two_valued(F.map_contains_key(c, needle))
    return _two_valued(c.cast("string").contains(needle))


def truthy(c: Column, dtype: T.DataType) -> Column:
    """0, empty text, empty collections and NULL count as false."""
    if isinstance(dtype, T.BooleanType):
        return _two_valued(c)
    if isinstance(dtype, T.NumericType):
        return _two_valued(c != F.lit(0))
    if isinstance(dtype, T.StringType):
        return _two_valued(F.length(c) > 0)
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return _two_valued(F.size(c) > 0)
    return c.isNotNull()


def case(subject: Column | None, branches: list[tuple], otherwise=None) -> Column:
    """First matching branch; NULL without an ELSE.  With a subject, branches compare by equality."""
    out = None
    for test, value in branches:
        cond = test if subject is None else equals(subject, test)
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out if otherwise is None else out.otherwise(otherwise)


def has_tag(tags: Column, key: str) -> Column:
    return _two_valued(F.map_contains_key(tags, key))


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def length0(c: Column) -> Column:
    return F.coalesce(F.length(c), F.lit(0))


def upper0(c: Column) -> Column:
    return F.coalesce(F.upper(c), F.lit(""))


def lower0(c: Column) -> Column:
    return F.coalesce(F.lower(c), F.lit(""))


def prop(df: DataFrame, path: str, props: str | None = None) -> Column:
    """``object.name`` or ``name``: a column, else an entry of the open property map, else NULL."""
    name = path.rsplit(".", 1)[-1]
    if name in df.columns:
        return F.col(name)
    if props and props in df.columns:
        return F.try_element_at(F.col(props), F.lit(name))
    return F.lit(None).cast("string")


def glob_regex(pattern: str) -> str:
    """Anchored regex in which ``*`` stands for any text and everything else is literal."""
    return "^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"


def name_matches(c: Column, pattern: str | None) -> Column:
    """``*`` everything, a pattern with ``*`` as a glob, ``^...`` as a regex, else equality; empty never matches."""
    if not pattern:
        return F.lit(False)
    if pattern == "*":
        hit = F.lit(True)
    elif pattern.startswith("^"):
        hit = c.rlike(pattern) if regex_accepted(pattern) else F.lit(False)
    elif "*" in pattern:
        hit = c.rlike(glob_regex(pattern))
    else:
        hit = c == F.lit(pattern)
    return _two_valued((F.length(c) > 0) & hit)


def tag_query(tags: Column, pattern: str) -> Column:
    """``space/name`` matches one tag, ``space`` the tag itself or anything below it; case does not matter."""
    want = pattern.lower()
    if "/" in want:
        test = lambda t: F.lower(t) == want
    else:
        test = lambda t: (F.lower(t) == want) | F.startswith(F.lower(t), F.lit(want + "/"))
    return _two_valued(F.exists(tags, test))


PREDICATES: dict[str, Callable[..., Column]] = {}


def register_predicate(name: str, fn: Callable[..., Column]) -> None:
    """Add a named Column -> Column function that structured rules may call."""
    PREDICATES[name.upper()] = fn


def call_predicate(name: str, *args) -> Column:
    return PREDICATES[name.upper()](*args)


register_predicate("HAS_TAG", has_tag)
register_predicate("TAG", tag)
register_predicate("LENGTH", length0)
register_predicate("UPPER", upper0)
register_predicate("LOWER", lower0)
