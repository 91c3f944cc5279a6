"""Contract validation and version comparison over frames that hold many contracts at once.

Schema rows carry the keys of their contract, so one full join compares every contract of a catalog in one job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.functions.scalar import next_version
from curatrix.operators.quality import score_expr
from curatrix.operators.skew import first_per_key
from curatrix.session import settled

# Type changes that stay compatible.
COMPATIBLE_TYPE_CHANGES = (("double", "float"), ("long", "int"), ("timestamp", "date"))


def field_paths(schema: T.DataType, path: str = "") -> list[tuple[str, str]]:
    """(path, type) of every field below ``schema``: ``a.b`` in structs, ``a[]`` for elements of arrays."""
    if isinstance(schema, T.StructType):
        below = [(f"{path}.{f.name}" if path else f.name, f.dataType) for f in schema.fields]
    elif isinstance(schema, T.ArrayType):
        below = [(f"{path}[]", schema.elementType)]
    else:
        return []
    return [row for name, kind in below for row in ((name, kind.simpleString()), *field_paths(kind, name))]


def schema_rows(df: DataFrame, object_name: str, nested: bool = False) -> DataFrame:
    """Actual schema of a table as (object_name, column_name, data_type) rows; ``nested`` adds the fields below columns, by path."""
    rows = [(object_name, name, dtype) for name, dtype in (field_paths(df.schema) if nested else df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "object_name string, column_name string, data_type string")


def property_paths(props: DataFrame) -> DataFrame:
    """``props`` with ``path``: names from the outermost property down, ``[]`` behind each array on the way, and ``depth``.

    ``props``: id, parent_id, object_id, name, logical_type. One join per level, so as many as properties are nested; each is
    written to the shared folder. A property whose parent is not there starts a path; those in a ring of parents have none.
    """
    rows = settled(props.select("id", "parent_id", "object_id", "name", "logical_type"), "properties")
    inside = F.when(F.lower("logical_type") == "array", F.concat("path", F.lit("[]"))).otherwise(F.col("path"))
    known = rows.select(F.col("id").alias("parent_id")).distinct()
    level = settled(rows.join(known, "parent_id", "left_anti").select(*rows.columns, F.col("name").alias("path"), F.lit(0).alias("depth")), "properties")
    levels = []
    while level.head(1):
        levels.append(level)
        above = level.select(F.col("id").alias("parent_id"), inside.alias("above"), F.col("depth").alias("up"))
        below = rows.join(above, "parent_id").withColumn("path", F.concat_ws(".", "above", "name")).withColumn("depth", F.col("up") + 1)
        level = settled(below.select(*level.columns), "properties")
    return reduce(DataFrame.unionByName, levels) if levels else level


def declared_paths(props: DataFrame) -> DataFrame:
    """(object_id, column_name, data_type) that nested properties declare: a row per property, and one per array whose items have a type.

    ``props`` also holds items_logical_type.
    """
    paths = property_paths(props)
    items = props.filter("items_logical_type IS NOT NULL AND lower(logical_type) = 'array'").select("id", "items_logical_type")
    own = paths.select("object_id", F.col("path").alias("column_name"), F.col("logical_type").alias("data_type"))
    return own.unionByName(paths.join(items, "id").select("object_id", F.concat("path", F.lit("[]")).alias("column_name"), F.col("items_logical_type").alias("data_type")))


def schema_drift(actual: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """One row per column of either side: missing, extra, type_mismatch or ok.

    Both frames hold ``keys``, ``column_name`` and ``data_type``; names compare without case, types match when one text
    contains the other.  A declared column without a type is not checked for it.
    """
    prep = lambda d, side: d.select(
        *keys, F.lower("column_name").alias("column_name"), F.lower("data_type").alias(f"{side}_type"), F.lit(True).alias(f"in_{side}")
    )
    both = prep(declared, "declared").join(prep(actual, "actual"), [*keys, "column_name"], "full")
    fits = F.col("actual_type").contains(F.col("declared_type")) | F.col("declared_type").contains(F.col("actual_type"))
    state = (
        F.when(F.col("in_actual").isNull(), "missing")
        .when(F.col("in_declared").isNull(), "extra")
        .when(F.coalesce(fits, F.lit(True)), "ok")
        .otherwise("type_mismatch")
    )
    return both.select(*keys, "column_name", "declared_type", "actual_type", state.alias("drift"))


def drift_result(drift: DataFrame, keys: list[str]) -> DataFrame:
    """Per object: counts and pass; extra columns are allowed."""
    kinds = {k: F.count_if(F.col("drift") == k).alias(a) for k, a in
             (("missing", "missing_columns"), ("extra", "extra_columns"), ("type_mismatch", "type_mismatches"))}
    out = drift.groupBy(*keys).agg(*kinds.values())
    return out.withColumn("passed", (F.col("missing_columns") == 0) & (F.col("type_mismatches") == 0))


def table_freshness(last_modified: DataFrame, as_of, max_age_hours: float = 24.0, ts: str = "last_modified") -> DataFrame:
    """Age in hours at ``as_of`` and pass; an unknown time fails."""
    seconds = F.timestamp_diff("SECOND", F.col(ts).cast("timestamp_ntz"), F.lit(as_of).cast("timestamp_ntz"))
    age = seconds / 3600.0
    return last_modified.withColumn("age_hours", F.round(age, 4)).withColumn("passed", F.coalesce(age <= max_age_hours, F.lit(False)))


def file_modified(spark, path: str) -> DataFrame:
    """Newest modification time of a file-backed table (file metadata only, no data columns are read)."""
    files = spark.read.parquet(path).select(F.col("_metadata.file_modification_time").alias("t"))
    return files.agg(F.max("t").cast("timestamp_ntz").alias("last_modified"))


def latest_runs(runs: DataFrame, key: str, ts: str = "started_at", id_col: str = "id") -> DataFrame:
    return first_per_key(runs, [key], [F.col(ts).desc(), F.col(id_col).desc()])


def dq_status(runs: DataFrame, contracts: DataFrame, key: str, min_score: float = 95.0) -> DataFrame:
    """Latest run per contract must have succeeded with at least ``min_score``; no run fails."""
    last = latest_runs(runs, key).select(key, "status", "score")
    out = contracts.select(key).join(last, key, "left")
    ok = (F.col("status") == "succeeded") & (F.col("score") >= min_score)
    return out.withColumn("passed", F.coalesce(ok, F.lit(False)))


def check_rows(df: DataFrame, key: str, check_type: str) -> DataFrame:
    return df.select(F.col(key), F.lit(check_type).alias("check_type"), "passed")


def validate_contracts(
    key: str, drift: DataFrame | None = None, freshness: DataFrame | None = None, dq: DataFrame | None = None
) -> DataFrame:
    """Counts and score per contract over the checks that are switched on (given)."""
    parts = [check_rows(df, key, name) for df, name in ((drift, "schema_drift"), (freshness, "freshness"), (dq, "dq_status")) if df is not None]
    results = reduce(DataFrame.unionByName, parts)
    out = results.groupBy(key).agg(F.count_if("passed").alias("checks_passed"), F.count_if(~F.col("passed")).alias("checks_failed"))
    return out.withColumn("score", score_expr(F.col("checks_passed"), F.col("checks_passed") + F.col("checks_failed")))


def structural_lint(columns: DataFrame, contracts: DataFrame, key: str) -> DataFrame:
    """Structural findings per contract as (key, finding, detail) rows.

    ``columns``: key, column_name, nullable, is_pk.  ``contracts``: key, domain, owner, pk_column, partition_column,
    classification, access_control, valid_from, valid_until.
    """
    found = lambda d, what, detail: d.select(key, F.lit(what).alias("finding"), detail.cast("string").alias("detail"))
    name, none = F.col("column_name"), F.lit(None)
    seen = columns.groupBy(key, "column_name").agg(
        F.count(F.lit(1)).alias("n"), F.max((F.col("nullable") & F.col("is_pk")).cast("int")).alias("bad_pk"))
    named = contracts.select(
        key,
        F.explode(F.array(
            F.struct(F.lit("missing_primary_key").alias("finding"), F.col("pk_column").alias("column_name")),
            F.struct(F.lit("missing_partition_column").alias("finding"), F.col("partition_column").alias("column_name")),
        )).alias("_n"),
    ).select(key, "_n.*").filter(name.isNotNull())
    absent = named.join(seen, [key, "column_name"], "left_anti").select(key, "finding", name.alias("detail"))
    flags = F.array(
        F.when(F.coalesce("domain", F.lit("")) == "", "domain_required"),
        F.when(F.coalesce("owner", F.lit("")) == "", "owner_required"),
        F.when((F.col("classification") == "restricted") & F.col("access_control").isNull(), "restricted_without_access_control"),
        F.when(F.col("valid_until") < F.col("valid_from"), "ends_before_start"),
    )
    header = contracts.select(key, F.explode(F.filter(flags, lambda f: f.isNotNull())).alias("finding"), none.cast("string").alias("detail"))
    dup = found(seen.filter("n > 1"), "duplicate_column", name)
    nullable_pk = found(seen.filter("bad_pk = 1"), "nullable_primary_key", name)
    return reduce(DataFrame.unionByName, [dup, nullable_pk, absent, header])


# ---- version comparison -----------------------------------------------------------------------------------------


def _flag(name: str, cond: Column, impact, **extra) -> Column:
    impact = impact if isinstance(impact, Column) else F.lit(impact)
    text = lambda k: (extra[k].cast("string") if k in extra else F.lit(None).cast("string")).alias(k)
    return F.when(cond, F.struct(F.lit(name).alias("change_type"), impact.alias("impact"), text("old_value"), text("new_value")))


def diff_fields(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Schema and field changes per contract; frames hold key, schema_name, field_name, logical_type, required."""
    schemas = old.select(key, "schema_name", F.lit(True).alias("_old")).distinct().join(
        new.select(key, "schema_name", F.lit(True).alias("_new")).distinct(), [key, "schema_name"], "full")
    schema_changes = schemas.filter("_old IS NULL OR _new IS NULL").select(
        key, "schema_name", F.lit(None).cast("string").alias("field_name"),
        F.when(F.col("_new").isNull(), "removed").otherwise("added").alias("change_type"),
        F.when(F.col("_new").isNull(), "breaking").otherwise("feature").alias("impact"),
        F.lit(None).cast("string").alias("old_value"), F.lit(None).cast("string").alias("new_value"))
    kept = schemas.filter("_old AND _new").select(key, "schema_name")
    side = lambda d, s: d.select(key, "schema_name", "field_name", F.col("logical_type").alias(f"{s}_type"),
                                 F.coalesce("required", F.lit(False)).alias(f"{s}_required"))
    both = side(old, "old").join(side(new, "new"), [key, "schema_name", "field_name"], "full").join(kept, [key, "schema_name"], "left_semi")
    gone, fresh = F.col("new_required").isNull(), F.col("old_required").isNull()
    ot, nt, oreq, nreq = (F.col(c) for c in ("old_type", "new_type", "old_required", "new_required"))
    compatible = reduce(lambda a, b: a | b, [(ot == a) & (nt == b) for a, b in COMPATIBLE_TYPE_CHANGES])
    changes = F.array(
        _flag("removed", gone, F.when(oreq, "breaking").otherwise("fix")),
        _flag("added", fresh, F.when(nreq, "breaking").otherwise("feature")),
        _flag("type_changed", (ot != "") & (nt != "") & (ot != nt), F.when(compatible, "fix").otherwise("breaking"), old_value=ot, new_value=nt),
        _flag("modified", oreq != nreq, F.when(nreq, "breaking").otherwise("fix"),
              old_value=F.concat(F.lit("required="), oreq.cast("string")), new_value=F.concat(F.lit("required="), nreq.cast("string"))),
    )
    field_changes = both.select(key, "schema_name", "field_name", F.explode(F.filter(changes, lambda c: c.isNotNull())).alias("_c"))
    return schema_changes.unionByName(field_changes.select(key, "schema_name", "field_name", "_c.*"))


def diff_rules(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A removed quality rule is a fix, an added one breaks consumers."""
    k = [key, "rule_id"]
    removed = old.join(new, k, "left_anti").select(*k, F.lit("removed").alias("change_type"), F.lit("fix").alias("impact"))
    added = new.join(old, k, "left_anti").select(*k, F.lit("added").alias("change_type"), F.lit("breaking").alias("impact"))
    return removed.unionByName(added)


def version_bump(changes: DataFrame, versions: DataFrame, key: str) -> DataFrame:
    """Strongest impact per key and the version it leads to; no change gives ``none`` and keeps the version."""
    rank = F.when(F.col("impact") == "breaking", 3).when(F.col("impact") == "feature", 2).when(F.col("impact") == "fix", 1).otherwise(0)
    top = changes.groupBy(key).agg(F.max(rank).alias("rank"))
    out = versions.join(top, key, "left")
    r = F.coalesce("rank", F.lit(0))
    bump = F.when(r == 3, "major").when(r == 2, "minor").when(r == 1, "patch").otherwise("none")
    out = out.withColumn("version_bump", bump).drop("rank")
    return out.withColumn("next_version", F.when(F.col("version_bump") == "none", F.col("version")).otherwise(next_version(F.col("version"), F.col("version_bump"))))


def diff_ports(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Port changes of products; frames hold key, port_type, name, contract_id, version, required."""
    k = [key, "port_type", "name"]
    side = lambda d, s: d.select(*k, F.col("contract_id").alias(f"{s}_contract"), F.col("version").alias(f"{s}_version"),
                                 F.coalesce("required", F.lit(False)).alias(f"{s}_required"))
    both = side(old, "old").join(side(new, "new"), k, "full")
    gone, fresh = F.col("new_required").isNull(), F.col("old_required").isNull()
    is_out, is_in = F.col("port_type") == "output", F.col("port_type") == "input"
    changes = F.array(
        _flag("removed", gone, F.when(is_out | (is_in & F.col("old_required")), "breaking").otherwise("fix")),
        _flag("added", fresh, F.when(is_in & F.col("new_required"), "breaking").otherwise("feature")),
        _flag("contract_changed", F.col("old_contract") != F.col("new_contract"), F.when(is_out, "breaking").otherwise("fix"),
              old_value=F.col("old_contract"), new_value=F.col("new_contract")),
        _flag("version_changed", F.col("old_version") != F.col("new_version"), "fix",
              old_value=F.col("old_version"), new_value=F.col("new_version")),
    )
    return both.select(*k, F.explode(F.filter(changes, lambda c: c.isNotNull())).alias("_c")).select(*k, "_c.*")


# Team roles whose loss breaks a product.
CRITICAL_ROLES = ("owner", "product_owner")


def diff_members(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Team changes; frames hold key, member, role.  Losing an owner breaks, other losses are fixes, joiners are features."""
    k = [key, "member"]
    role = F.coalesce("role", F.lit("unknown"))
    removed = old.join(new, k, "left_anti").select(
        *k, F.lit("removed").alias("change_type"), F.when(F.lower(role).isin(*CRITICAL_ROLES), "breaking").otherwise("fix").alias("impact"))
    added = new.join(old, k, "left_anti").select(*k, F.lit("added").alias("change_type"), F.lit("feature").alias("impact"))
    return removed.unionByName(added)


def diff_support(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Support channels: a removed one is a fix, an added one a feature."""
    k = [key, "channel"]
    removed = old.join(new, k, "left_anti").select(*k, F.lit("removed").alias("change_type"), F.lit("fix").alias("impact"))
    added = new.join(old, k, "left_anti").select(*k, F.lit("added").alias("change_type"), F.lit("feature").alias("impact"))
    return removed.unionByName(added)


# Description parts that are compared, and the parts and fields of an update.
DESCRIPTION_PARTS = ("purpose", "limitations", "usage")


def diff_descriptions(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One fix per description part that differs (NULL-safe)."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"))
    parts = F.array(*[F.when(~F.col(f"o.{p}").eqNullSafe(F.col(f"n.{p}")), F.lit(p)) for p in DESCRIPTION_PARTS])
    return both.select(F.col(f"o.{key}").alias(key), F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("part")).select(
        key, "part", F.lit("modified").alias("change_type"), F.lit("fix").alias("impact"))


def update_impact(current: DataFrame, proposed: DataFrame, key: str, fields: list[str], sections: DataFrame, changes: DataFrame) -> DataFrame:
    """Changed metadata fields, changed child sections and the recommended action per key.

    ``sections``: key, section (parts that differ).  ``changes``: key, impact.  A NULL proposed field is not part of the
    update.
    """
    o, n = current.alias("o"), proposed.alias("n")
    hits = F.array(*[F.when(F.col(f"n.{f}").isNotNull() & ~F.col(f"n.{f}").eqNullSafe(F.col(f"o.{f}")), F.lit(f)) for f in fields])
    meta = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}")).select(
        F.col(f"o.{key}").alias(key), F.array_join(F.filter(hits, lambda h: h.isNotNull()), ",").alias("metadata_changes"))
    child = sections.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("section")), ",").alias("child_changes"))
    breaking = changes.groupBy(key).agg(F.max((F.col("impact") == "breaking").cast("int")).alias("b"))
    out = meta.join(child, key, "left").join(breaking, key, "left").fillna({"child_changes": "", "b": 0})
    return out.select(
        key, "metadata_changes", "child_changes", (F.col("b") == 1).alias("requires_versioning"),
        F.when(F.col("b") == 1, "clone").otherwise("update_in_place").alias("recommended_action"))
