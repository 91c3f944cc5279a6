"""Tags on catalogs, schemas and tables, as long (object, key, value) rows: templates, parents, discovery, reconciliation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions.scalar import render_template, sanitize_tag_key


def scan_tags(catalog_tags: DataFrame, schema_tags: DataFrame, table_tags: DataFrame) -> DataFrame:
    """Three tag sources as (object_type, full_name, tag_name, tag_value); a missing value is empty text."""
    name = {"CATALOG": ["catalog_name"], "SCHEMA": ["catalog_name", "schema_name"], "TABLE": ["catalog_name", "schema_name", "table_name"]}
    parts = [
        df.select(F.lit(kind).alias("object_type"), F.concat_ws(".", *name[kind]).alias("full_name"), "tag_name", F.coalesce("tag_value", F.lit("")).alias("tag_value"))
        for kind, df in (("CATALOG", catalog_tags), ("SCHEMA", schema_tags), ("TABLE", table_tags))
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("object_type", "full_name", "tag_name").agg(F.max("tag_value").alias("tag_value"))


@dataclass(frozen=True)
class TagConfig:
    """One tag per entity of ``entity_type``; semantic_assignment gives one per link."""

    entity_type: str
    key_format: str
    value_format: str
    enabled: bool = True


# Config type to the field that must be present.
CONFIG_FIELDS = {
    "data_domain": "domain_name", "data_contract": "contract_name", "data_product": "product_name", "asset": "asset_type", "semantic_assignment": "iri",
}


def desired_tags(infos: DataFrame, configs: list[TagConfig], variables: dict[str, str]) -> DataFrame:
    """(fqn, tag_key, tag_value) wanted by the configs.

    ``infos`` has one row per dataset and semantic link; ``variables`` maps template names to its columns.  A missing
    variable gives no tag; under the same key the later config, then the larger link, wins.
    """
    cols = {v: F.col(c) for v, c in variables.items()}
    packs = []
    for i, cfg in enumerate(configs):
        if not cfg.enabled:
            continue
        key = sanitize_tag_key(render_template(cfg.key_format, cols))
        value = render_template(cfg.value_format, cols)
        ok = (F.length(F.col(CONFIG_FIELDS[cfg.entity_type])) > 0) & (F.length(key) > 0) & (F.length(value) > 0)
        link = F.col("iri") if cfg.entity_type == "semantic_assignment" else F.lit(None).cast("string")
        packs.append(F.when(ok, F.struct(F.lit(i).alias("ord"), F.coalesce(link, F.lit("")).alias("link"), key.alias("key"), value.alias("value"))))
    rows = infos.select("fqn", F.explode(F.filter(F.array(*packs), lambda p: p.isNotNull())).alias("t"))
    return rows.groupBy("fqn", F.col("t.key").alias("tag_key")).agg(
        F.max(F.struct("t.ord", "t.link", "t.value")).alias("w")).select("fqn", "tag_key", F.col("w.value").alias("tag_value"))


def parent_tag_values(desired: DataFrame) -> DataFrame:
    """One row for every distinct value of the children, per key of every schema and catalog."""
    up = F.array(
        F.struct(F.lit("SCHEMA").alias("object_type"), F.substring_index("fqn", ".", 2).alias("full_name")),
        F.struct(F.lit("CATALOG").alias("object_type"), F.substring_index("fqn", ".", 1).alias("full_name")),
    )
    return desired.filter(F.length("tag_value") > 0).select(F.explode(up).alias("o"), "tag_key", "tag_value").select("o.*", "tag_key", "tag_value").distinct()


def parent_tags(desired: DataFrame) -> DataFrame:
    """The same as one sorted, comma-joined text per key: the form of a tag, for keys of few values."""
    rows = parent_tag_values(desired)
    return rows.groupBy("object_type", "full_name", "tag_key").agg(F.array_join(F.array_sort(F.collect_list("tag_value")), ",").alias("tag_value"))


def reconcile_tags(existing: DataFrame, desired: DataFrame, prefix: str) -> DataFrame:
    """Actions that turn the existing tags under ``prefix`` into the desired ones; equal tags need none."""
    k = ["object_name", "tag_key"]
    old = existing.filter(F.col("tag_key").startswith(prefix)).select(*k, F.col("tag_value").alias("old_value"), F.lit(True).alias("has"))
    new = desired.select(*k, F.col("tag_value").alias("new_value"), F.lit(True).alias("want"))
    both = old.join(new, k, "full")
    action = F.when(F.col("want").isNull(), "remove").when(F.col("has").isNull() | ~F.col("old_value").eqNullSafe(F.col("new_value")), "upsert")
    return both.withColumn("action", action).filter(F.col("action").isNotNull()).select(*k, "action", "old_value", "new_value")


@dataclass(frozen=True)
class DiscoveryPattern:
    entity_type: str
    key_regex: str
    extraction_regex: str
    extract_from: str = "value"
    filter_regex: str | None = None
    filter_source: str = "key"
    enabled: bool = True


def inherit_filter(tags: DataFrame, regex: str | None, source: str = "key") -> DataFrame:
    """(object_type, full_name) whose own tags, schema's tags or catalog's tags match the filter."""
    objects = tags.select("object_type", "full_name").distinct()
    if not regex:
        return objects
    text = F.col("tag_name" if source == "key" else "tag_value")
    hit = tags.filter(text.rlike(regex)).select("object_type", F.col("full_name").alias("hit_name")).distinct()
    names = lambda kind, col: hit.filter(F.col("object_type") == kind).select(F.col("hit_name").alias(col), F.lit(True).alias(col + "_hit"))
    o = objects.withColumn("schema_name", F.when(F.col("object_type") == "TABLE", F.substring_index("full_name", ".", 2)))
    o = o.withColumn("catalog_name", F.when(F.col("object_type") != "CATALOG", F.substring_index("full_name", ".", 1)))
    own = hit.withColumnRenamed("hit_name", "full_name").withColumn("own_hit", F.lit(True))
    o = o.join(own, ["object_type", "full_name"], "left").join(names("SCHEMA", "schema_name"), "schema_name", "left").join(names("CATALOG", "catalog_name"), "catalog_name", "left")
    return o.filter(F.coalesce("own_hit", "schema_name_hit", "catalog_name_hit").isNotNull()).select("object_type", "full_name")


def discover_entities(tags: DataFrame, patterns: list[DiscoveryPattern]) -> DataFrame:
    """(entity_type, entity, object_type, full_name): the first matching tag of an object, by key, names its entity.

    Every tag meets all patterns in one scan.  A pattern with a filter passes an object when the object, its schema or its
    catalog has a tag that the filter matches: one join on the places where a filter tag may be.
    """
    live = [p for p in patterns if p.enabled]
    pick = lambda source: F.col("tag_name" if source == "key" else "tag_value")
    marks = []
    for i, p in enumerate(live):
        text = pick(p.extract_from)
        entity = F.when(F.col("tag_name").rlike(p.key_regex) & text.rlike(p.extraction_regex), F.nullif(F.regexp_extract(text, p.extraction_regex, 1), F.lit("")))
        hit = F.coalesce(pick(p.filter_source).rlike(p.filter_regex), F.lit(False)) if p.filter_regex else F.lit(False)
        marks.append(F.struct(F.lit(i).alias("pattern"), F.lit(p.entity_type).alias("entity_type"), F.lit(bool(p.filter_regex)).alias("filtered"), entity.alias("entity"), hit.alias("hit")))
    rows = tags.select("object_type", "full_name", "tag_name", F.explode(F.array(*marks)).alias("m")).select("object_type", "full_name", "tag_name", "m.*")
    named = rows.filter("entity IS NOT NULL").groupBy("pattern", "entity_type", "filtered", "object_type", "full_name").agg(F.min_by("entity", "tag_name").alias("entity"))
    hits = rows.filter("hit").select("pattern", F.col("object_type").alias("at_type"), F.col("full_name").alias("at_name")).distinct()
    place = lambda kind, name: F.struct(kind.alias("at_type"), name.alias("at_name"))
    here = place(F.col("object_type"), F.col("full_name"))
    schema = F.when(F.col("object_type") == "TABLE", place(F.lit("SCHEMA"), F.substring_index("full_name", ".", 2)))
    catalog = F.when(F.col("object_type") != "CATALOG", place(F.lit("CATALOG"), F.substring_index("full_name", ".", 1)))
    spots = F.when(F.col("filtered"), F.filter(F.array(here, schema, catalog), lambda x: x.isNotNull())).otherwise(F.array(here))
    asked = named.select("*", F.explode(spots).alias("at")).select("*", "at.*")
    passed = asked.join(hits.withColumn("found", F.lit(True)), ["pattern", "at_type", "at_name"], "left").filter("found OR NOT filtered")
    return passed.select("pattern", "entity_type", "entity", "object_type", "full_name").distinct().drop("pattern")
