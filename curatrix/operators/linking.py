"""Joins that tie governance frames together: tag sources, price validity, merged metadata, previews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.operators.skew import BROADCAST_ROWS, broadcast_if_small, first_per_key, left_join_parts, salted_join


def contract_tag_sources(contracts: DataFrame, objects: DataFrame, domains: DataFrame, ports: DataFrame, products: DataFrame, links: DataFrame) -> DataFrame:
    """One row per contract object and semantic link, with domain and product, by left joins.

    Links hang on ``<contract id>#<object name>``; a port names both the contract and the object it delivers.
    """
    base = left_join_parts(
        contracts.select(F.col("id").alias("contract_id"), F.col("name").alias("contract_name"), "version", "domain_id"),
        objects.select("contract_id", F.col("name").alias("object_name"), "physical_name"), ["contract_id"])
    base = base.withColumn("link_key", F.concat(F.col("contract_id").cast("string"), F.lit("#"), F.col("object_name")))
    out = base.join(domains.select("domain_id", "domain_name"), "domain_id", "left")
    out = out.join(ports.select("contract_id", "object_name", "product_id"), ["contract_id", "object_name"], "left")
    out = out.join(products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name")), "product_id", "left")
    return out.join(links.select(F.col("entity_id").alias("link_key"), "iri"), "link_key", "left")


def asset_tag_sources(assets: DataFrame, relations: DataFrame, domains: DataFrame, contracts: DataFrame, datasets: DataFrame, products: DataFrame, links: DataFrame) -> DataFrame:
    """Active, located tables and views with everything that hangs on them.

    Relation predicates belong to the joins, so an asset without a match stays.  ``relations``: source_id, target_id,
    relationship_type.
    """
    rel = lambda kind, src, dst: relations.filter(F.col("relationship_type") == kind).select(
        F.col("source_id").alias(src), F.col("target_id").alias(dst))
    base = assets.filter(F.col("type").isin("Table", "View") & (F.col("status") == "active") & F.col("location").isNotNull()).select(
        F.col("id").alias("asset_id"), F.col("type").alias("asset_type"), "location", "domain_id")
    out = base.join(domains.select("domain_id", "domain_name"), "domain_id", "left")
    out = out.join(rel("governedBy", "asset_id", "contract_id"), "asset_id", "left")
    out = out.join(contracts.select(F.col("id").alias("contract_id"), F.col("name").alias("contract_name")), "contract_id", "left")
    out = out.join(rel("partOf", "asset_id", "dataset_id"), "asset_id", "left")
    out = out.join(datasets.select(F.col("id").alias("dataset_id"), "product_id"), "dataset_id", "left")
    out = out.join(products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name")), "product_id", "left")
    return out.join(links.select(F.col("entity_id").alias("asset_id"), "iri"), "asset_id", "left")


def _month_range(start, end):
    return F.sequence(F.trunc(start.cast("date"), "month"), F.trunc(end.cast("date"), "month"), F.expr("interval 1 month"))


def price_as_of(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Left join on the price that is valid when the usage ends; usage without a price costs 0.

    Prices are repeated per month of their validity (open ends stop at the last usage), so the equi key is (sku, month)
    and a long price history never meets all usage of its sku.  The months are joined by sort and merge: Spark estimates
    them at the size of the price list and would broadcast however many there are.
    """
    last = usage.agg(F.max("usage_end_time")).scalar()
    until = F.least(F.coalesce(F.col("price_end_time").cast("timestamp_ntz"), last), last)
    p = prices.withColumn("until", until).filter(F.col("price_start_time").cast("timestamp_ntz") <= F.col("until"))
    p = p.withColumn("month", F.explode(_month_range(F.col("price_start_time"), F.col("until")))).alias("p")
    u = usage.withColumn("month", F.trunc(F.col("usage_end_time").cast("date"), "month")).alias("u")
    t = F.col("u.usage_end_time")
    on = (
        (F.col("u.sku_name") == F.col("p.sku_name")) & (F.col("u.month") == F.col("p.month")) & (t >= F.col("p.price_start_time"))
        & (F.col("p.price_end_time").isNull() | (t < F.col("p.price_end_time")))
    )
    return u.join(p.hint("merge"), on, "left").select(*[F.col(f"u.{c}") for c in usage.columns], F.coalesce("p.price", F.lit(0.0)).alias("price"))


def campaign_sales(sales: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Revenue and buyers of every campaign, over the sales of its product within its dates.

    Sales are summed to (product, day, customer) first; campaigns are repeated per month, so the equi key is
    (product, month).  The months are joined by sort and merge: Spark estimates them at the size of the campaigns and
    would broadcast however many there are.
    """
    daily = sales.groupBy("product_id", "sold_on", "customer_id").agg(F.sum("amount").alias("amount"))
    s = daily.withColumn("month", F.trunc("sold_on", "month")).alias("s")
    c = campaigns.filter("start_date <= end_date").withColumn("month", F.explode(_month_range(F.col("start_date"), F.col("end_date")))).alias("c")
    on = (F.col("s.product_id") == F.col("c.product_id")) & (F.col("s.month") == F.col("c.month")) & F.col("s.sold_on").between(F.col("c.start_date"), F.col("c.end_date"))
    return s.join(c.hint("merge"), on).groupBy("c.campaign").agg(
        F.round(F.sum("s.amount"), 2).alias("revenue"), F.countDistinct("s.customer_id").alias("customers"))


def new_records(source: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """Source rows without any match."""
    return source.join(matches.select(F.col(key).alias("_matched")), F.col(key) == F.col("_matched"), "left_anti")


def merge_columns(assets: DataFrame, contracts: DataFrame) -> DataFrame:
    """Full outer merge of column entries by lower-cased (table, column).

    Contract label and classification win, the asset's description wins, terms are unioned without repeats.
    """
    key = lambda d: d.withColumn("k_table", F.lower("table_full_name")).withColumn("k_column", F.lower("column_name"))
    a, c = key(assets).alias("a"), key(contracts).alias("c")
    both = a.join(c, (F.col("a.k_table") == F.col("c.k_table")) & (F.col("a.k_column") == F.col("c.k_column")), "full")
    first = lambda x, y: F.coalesce(F.when(F.col(x) != "", F.col(x)), F.col(y))
    empty = F.array().cast("array<string>")
    source = F.when(F.col("c.k_column").isNull(), "asset").when(F.col("a.k_column").isNull(), "contract").otherwise("both")
    return both.select(
        F.coalesce("a.table_full_name", "c.table_full_name").alias("table_full_name"),
        F.coalesce("a.column_name", "c.column_name").alias("column_name"),
        first("c.label", "a.label").alias("label"),
        first("c.classification", "a.classification").alias("classification"),
        first("a.description", "c.description").alias("description"),
        F.array_union(F.coalesce("a.terms", empty), F.coalesce("c.terms", empty)).alias("terms"),
        F.col("a.asset_type").alias("asset_type"),
        F.col("a.system").alias("system"),
        source.alias("source"),
    )


def merge_tag_infos(contract_infos: DataFrame, asset_infos: DataFrame, fields: list[str]) -> DataFrame:
    """Full outer merge on ``fqn``: the first non-empty value per field, contract side first; links unioned."""
    c, a = contract_infos.alias("c"), asset_infos.alias("a")
    empty = F.array().cast("array<string>")
    pick = [F.coalesce(F.when(F.col(f"c.{f}").cast("string") != "", F.col(f"c.{f}")), F.col(f"a.{f}")).alias(f) for f in fields]
    return c.join(a, F.col("c.fqn") == F.col("a.fqn"), "full").select(
        F.coalesce("c.fqn", "a.fqn").alias("fqn"), *pick, F.array_union(F.coalesce("c.links", empty), F.coalesce("a.links", empty)).alias("links"))


def link_products_to_contracts(product_objects: DataFrame, contract_objects: DataFrame) -> DataFrame:
    """Products and contracts discovered on the same table."""
    tables = lambda d, name: d.filter("object_type = 'TABLE'").select(F.col("entity").alias(name), "full_name")
    return tables(product_objects, "product").join(tables(contract_objects, "contract"), "full_name").select("product", "contract", "full_name").distinct()


def link_schema_to_assets(objects: DataFrame, assets: DataFrame) -> DataFrame:
    """First table or view (lowest id) whose location contains the object's name or whose own name equals it.

    ``objects``: object_id, match_name.  Containment without comparing all pairs: every location is cut into its
    substrings of the lengths that names have, the lowest asset per substring is kept before the shuffle, and names meet
    them by equality.  The work is linear in the assets however common a name is.  Few names are broadcast and pick their
    substrings before the shuffle; the substrings themselves never are, whatever size Spark estimates.
    """
    cand = assets.filter(F.col("type").isin("Table", "View")).select("id", "name", F.lower("location").alias("loc"))
    objs = objects.filter(F.length("match_name") > 0).select("object_id", "match_name", F.lower("match_name").alias("m"))
    by_name = cand.groupBy(F.col("name").alias("match_name")).agg(F.min("id").alias("name_id"))
    lengths = objs.agg(F.collect_set(F.length("m"))).scalar()
    sized = cand.filter(F.length("loc") > 0).select("id", "loc", F.explode(lengths).alias("n")).filter(F.col("n") <= F.length("loc"))
    pieces = sized.select("id", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("loc") - F.col("n") + 1), lambda i: F.substr(F.col("loc"), i, F.col("n")))).alias("m"))
    names = objs.select("m").distinct()
    rows = names.count()
    if rows <= BROADCAST_ROWS:
        pieces = pieces.join(broadcast_if_small(names, rows), "m", "left_semi")
    by_piece = pieces.groupBy("m").agg(F.min("id").alias("loc_id"))
    out = objs.join(by_name.hint("merge"), "match_name", "left").join(by_piece.hint("merge"), "m", "left")
    return out.select("object_id", F.least("name_id", "loc_id").alias("asset_id")).filter("asset_id IS NOT NULL")


def products_for_contract(ports: DataFrame, products: DataFrame, contract_ids: DataFrame) -> DataFrame:
    """Distinct products with a port under one of the contracts."""
    hit = ports.join(contract_ids, "contract_id", "left_semi").select(F.col("product_id").alias("id"))
    return products.join(hit, "id", "left_semi")


def contracts_for_product(ports: DataFrame) -> DataFrame:
    """Distinct contracts per product with the first port that names them; order by ``first_port``."""
    return ports.filter("contract_id IS NOT NULL").groupBy("product_id", "contract_id").agg(F.min("port_order").alias("first_port"))


def merged_metadata(direct: DataFrame, attached: DataFrame, inherited: DataFrame, max_level: int | None = None) -> DataFrame:
    """Direct, attached and inheritable metadata per entity; one row per item, the lowest (level, created_at) wins.

    Frames hold entity_id, item_id, level, created_at; ``inherited`` also inheritable and contract_id.
    """
    cols = ["entity_id", "item_id", "level", "created_at"]
    parts = [
        direct.select(*cols, F.lit("direct").alias("origin"), F.lit(0).alias("pref")),
        attached.select(*cols, F.lit("attached").alias("origin"), F.lit(1).alias("pref")),
        inherited.filter(F.col("inheritable") if max_level is None else F.col("inheritable") & (F.col("level") <= max_level)).select(*cols, F.lit("inherited").alias("origin"), F.lit(2).alias("pref")),
    ]
    allm = reduce(DataFrame.unionByName, parts)
    return first_per_key(allm, ["entity_id", "item_id"], [F.col("level"), F.col("created_at"), F.col("pref")]).drop("pref")


def fan_out(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One notification per subscriber of the event's product."""
    return salted_join(events, subscriptions, ["product_id"]).select("event_id", "product_id", "subscriber", "event_type")


def import_preview(paths: DataFrame, assets: DataFrame) -> DataFrame:
    """Expanded paths against existing assets by (type, name, location): create or skip."""
    known = assets.select("type", "name", "location", F.col("id").alias("existing_id")).groupBy("type", "name", "location").agg(F.min("existing_id").alias("existing_id"))
    out = paths.join(known, ["type", "name", "location"], "left")
    return out.withColumn("action", F.when(F.col("existing_id").isNull(), "create").otherwise("skip"))


# Asset states a bulk file may name.
ASSET_STATUSES = ("draft", "active", "deprecated", "archived")


def duplicate_rows(rows: DataFrame) -> DataFrame:
    """Rows whose lower-cased identity occurred before, with the first row's number."""
    ident = [F.lower(F.coalesce(c, F.lit(""))).alias(f"k_{c}") for c in ("name", "type", "platform", "location")]
    keyed = rows.select("*", *ident)
    keys = [f"k_{c}" for c in ("name", "type", "platform", "location")]
    first = keyed.groupBy(*keys).agg(F.min("row_no").alias("first_row"))
    return keyed.join(first, keys).filter(F.col("row_no") > F.col("first_row")).select("row_no", "first_row")


def bulk_preview(rows: DataFrame, types: DataFrame, existing: DataFrame) -> DataFrame:
    """What a bulk file would do, row by row: the first reason for an error, else update or create.

    ``rows``: row_no, id, name, type, platform, location, status.  ``types``: type_name.  ``existing``: id, name, type,
    platform, location.
    """
    known = types.select(F.lower("type_name").alias("k_type"), F.lit(True).alias("type_ok")).distinct()
    by_id = existing.select(F.col("id").alias("id"), F.lit(True).alias("id_ok")).distinct()
    side = existing.select(F.col("name").alias("e_name"), F.lower("type").alias("e_type"), F.coalesce("platform", F.lit("")).alias("e_platform"),
                           F.coalesce("location", F.lit("")).alias("e_location"), F.col("id").alias("e_id"))
    side = side.groupBy("e_name", "e_type", "e_platform", "e_location").agg(F.min("e_id").alias("same_id"))
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    r = rows.withColumn("k_type", F.lower(clean("type")))
    r = r.join(known, "k_type", "left").join(by_id, "id", "left").join(duplicate_rows(rows), "row_no", "left")
    on = (clean("name") == F.col("e_name")) & (F.col("k_type") == F.col("e_type")) & (clean("platform") == F.col("e_platform")) & (clean("location") == F.col("e_location"))
    r = r.join(side, on, "left")
    reason = (
        F.when(clean("name") == "", "missing name")
        .when(clean("type") == "", "missing type")
        .when(F.col("type_ok").isNull(), "unknown type")
        .when(F.col("first_row").isNotNull(), F.concat(F.lit("duplicate of row "), F.col("first_row").cast("string")))
        .when((clean("status") != "") & ~F.lower(clean("status")).isin(*ASSET_STATUSES), "invalid status")
        .when(F.col("id").isNotNull() & F.col("id_ok").isNull(), "stale id")
    )
    target = F.when(F.col("id").isNotNull(), F.col("id")).otherwise(F.col("same_id"))
    out = r.withColumn("reason", reason).withColumn("existing_id", F.when(F.col("reason").isNull(), target))
    action = F.when(F.col("reason").isNotNull(), "error").when(F.col("existing_id").isNotNull(), "update").otherwise("create")
    return out.select("row_no", action.alias("action"), "reason", "existing_id")


def tags_for_entities(assoc: DataFrame, tags: DataFrame, namespaces: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Full tag names and values per entity, one row each."""
    a = assoc if entities is None else assoc.join(entities, ["entity_type", "entity_id"], "left_semi")
    named = a.join(tags, "tag_id").join(namespaces, "namespace_id")
    return named.select("entity_type", "entity_id", F.concat_ws("/", "namespace_name", "tag_name").alias("tag"), "assigned_value")
