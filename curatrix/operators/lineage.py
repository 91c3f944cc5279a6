"""Lineage and relationship graphs: business lineage, impact, hierarchies, certification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.operators.graph import directed, node_key, propagate_max, reach


def relation_edges(relations: DataFrame) -> DataFrame:
    """(src, dst, relationship_type) with ``type:id`` node keys, without repeats."""
    return relations.select(node_key("source_type", "source_id").alias("src"), node_key("target_type", "target_id").alias("dst"), "relationship_type").distinct()


def business_lineage_nodes(edges: DataFrame, start: DataFrame, depth: int | None = None, direction: str = "both") -> DataFrame:
    """(root, node, depth) within ``depth`` hops (None: all) of every start node (column ``root``)."""
    return reach(directed(edges, direction), start, depth)


def business_lineage_edges(edges: DataFrame, nodes: DataFrame, depth: int | None = None, direction: str = "both") -> DataFrame:
    """Edges that the search crossed: those leaving a node it expanded, in its direction."""
    inner = (nodes if depth is None else nodes.filter(F.col("depth") < depth)).select("root", "node")
    out = inner.join(edges, inner.node == edges.src).select("root", "src", "dst", "relationship_type")
    into = inner.join(edges, inner.node == edges.dst).select("root", "src", "dst", "relationship_type")
    return {"down": out, "up": into, "both": out.unionByName(into)}[direction].distinct()


def table_lineage(edges: DataFrame, start: DataFrame, depth: int | None = None, externals: DataFrame | None = None) -> DataFrame:
    """Per root: nodes upstream, downstream and external, over several hops."""
    ups = reach(directed(edges, "up"), start, depth).filter("depth > 0").select("root", "node", F.lit("upstream").alias("side"), "depth")
    downs = reach(directed(edges, "down"), start, depth).filter("depth > 0").select("root", "node", F.lit("downstream").alias("side"), "depth")
    out = ups.unionByName(downs)
    if externals is None:
        return out.withColumn("external", F.lit(False))
    ext = externals.select("node", F.lit(True).alias("external")).distinct()
    return out.join(ext, "node", "left").withColumn("external", F.coalesce("external", F.lit(False)))


def lineage_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("root").agg(
        F.count_if(F.col("side") == "upstream").alias("upstream"), F.count_if(F.col("side") == "downstream").alias("downstream"),
        F.count_if("external").alias("external"))


def column_lineage(edges: DataFrame, column: str) -> DataFrame:
    """Edges whose mappings touch the column, with just those mappings; edges without mappings stay."""
    touching = F.filter("column_mappings", lambda m: (m["source_column"] == column) | (m["target_column"] == column))
    unmapped = F.coalesce(F.size("column_mappings"), F.lit(0)) <= 0
    kept = edges.filter(unmapped | (F.size(touching) > 0))
    return kept.withColumn("column_mappings", F.when(unmapped, F.col("column_mappings")).otherwise(touching))


def impact(edges: DataFrame, start: DataFrame, nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """Assets downstream of every root with distance, kind and owner; ``nodes`` holds node, kind, owner."""
    hit = reach(directed(edges, "down"), start, depth).filter("depth > 0")
    kind = F.when(F.col("kind").isin("view", "external"), F.col("kind")).otherwise("table")
    return hit.join(nodes, "node", "left").select("root", "node", F.col("depth").alias("distance"), kind.alias("kind"), "owner")


def impact_summary(impacted: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("table", "view", "external")]
    return impacted.groupBy("root").agg(*counts, F.max("distance").alias("max_depth"), F.countDistinct("owner").alias("owners"), F.count(F.lit(1)).alias("total"))


def affected_columns(edges: DataFrame, impacted: DataFrame) -> DataFrame:
    """(root, node, target_column): columns that edges into impacted nodes write."""
    hits = impacted.select("root", "node").join(edges, F.col("node") == edges.dst)
    return hits.select("root", "node", F.explode("column_mappings").alias("m")).select("root", "node", F.col("m.target_column").alias("target_column")).distinct()


def entity_hierarchy(edges: DataFrame, roots: DataFrame, relations: list[str], inverse: list[str] = (), depth: int | None = None) -> DataFrame:
    """Tree below every root over hierarchical relations: (root, node, depth, parent, relationship_type).

    ``inverse`` relations point from child to parent.  A node hangs under the smallest parent at the depth where it is
    first found; there is no cap on children.
    """
    down = edges.filter(F.col("relationship_type").isin(list(relations))).select("src", "dst", "relationship_type")
    up = edges.filter(F.col("relationship_type").isin(list(inverse))).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relationship_type")
    steps = down.unionByName(up)
    nodes = reach(steps.select("src", "dst").distinct(), roots, depth)
    above = nodes.select("root", F.col("node").alias("src"), (F.col("depth") + 1).alias("depth"))
    links = above.join(steps, "src").select("root", F.col("dst").alias("node"), "depth", F.col("src").alias("parent"), "relationship_type")
    first = links.groupBy("root", "node", "depth").agg(F.min(F.struct("parent", "relationship_type")).alias("up"))
    return nodes.join(first, ["root", "node", "depth"], "left").select("root", "node", "depth", "up.parent", "up.relationship_type")


def resolve_parents(assets: DataFrame, parent_of: DataFrame) -> DataFrame:
    """Schema, catalog and system of every asset: the nearest above it by any path, the smallest of equally near ones.

    ``assets``: id, type.  ``parent_of``: id, parent_id, parent_type.
    """
    steps = parent_of.filter("id IS NOT NULL AND parent_id IS NOT NULL").select(F.col("id").alias("src"), F.col("parent_id").alias("dst")).distinct()
    kinds = parent_of.select(F.col("parent_id").alias("node"), F.col("parent_type").alias("kind")).distinct()
    above = reach(steps, assets.select(F.col("id").alias("root"))).filter("depth > 0").join(kinds, "node")
    near = above.groupBy("root").agg(*[F.min(F.when(F.col("kind") == k, F.struct("depth", "node"))).alias(k.lower()) for k in ("Schema", "Catalog", "System")])
    return assets.join(near, F.col("id") == F.col("root"), "left").select("id", *[F.col(f"{k}.node").alias(k) for k in ("schema", "catalog", "system")])


# Relationship types along which a certification is inherited.
INHERITING = ("hasContract", "hasOutputPort", "hasDataset", "hasAsset", "governedBy", "implementedBy", "contains", "hasColumn")


def propagate_certification(edges: DataFrame, levels: DataFrame, relations: list[str] | None = INHERITING) -> DataFrame:
    """Inherited certification of every node downstream of a certified one: the highest level upstream of it.

    Only edges of the inheriting ``relations`` pass a level on; None stands for every edge given.
    """
    return propagate_max(edges if relations is None else edges.filter(F.col("relationship_type").isin(list(relations))), levels)


def product_hierarchy(relations: DataFrame) -> DataFrame:
    """product -> dataset -> table or view -> column, one row per path, and one row per governing contract of a dataset.

    Contracts are rows of their own, so a dataset with many tables and many contracts is not multiplied out.
    """
    rel = lambda kind, a, b: relations.filter(F.col("relationship_type") == kind).select(F.col("source_id").alias(a), F.col("target_id").alias(b)).distinct()
    none = F.lit(None).cast("bigint")
    datasets, tables, contracts = rel("hasDataset", "product_id", "dataset_id"), rel("hasTable", "dataset_id", "table_id"), rel("governedBy", "dataset_id", "contract_id")
    # tables and contracts are one side of one join, so the datasets of all products are spread and sorted once; a dataset with contracts alone still has a path
    bare = contracts.select("dataset_id").distinct().join(tables, "dataset_id", "left_anti").select("dataset_id", F.lit("path").alias("part"), none.alias("table_id"), none.alias("contract_id"))
    below = tables.select("dataset_id", F.lit("path").alias("part"), "table_id", none.alias("contract_id")).unionByName(
        contracts.select("dataset_id", F.lit("contract").alias("part"), none.alias("table_id"), "contract_id")).unionByName(bare)
    rows = datasets.join(below, "dataset_id", "left").join(rel("hasColumn", "table_id", "column_id"), "table_id", "left")
    return rows.select(F.coalesce("part", F.lit("path")).alias("part"), "product_id", "dataset_id", "table_id", "column_id", "contract_id")


# The key under which two relationship rows are the same.
EDGE_KEY = ("source_type", "source_id", "relationship_type", "target_type", "target_id")


def relationships(edges: DataFrame, legacy: DataFrame, entities: DataFrame) -> DataFrame:
    """Outgoing and incoming edges of the wanted entities, legacy rows merged without repeats.

    ``entities``: entity_type, entity_id.
    """
    both = edges.select(*EDGE_KEY).unionByName(legacy.select(*EDGE_KEY)).dropDuplicates(list(EDGE_KEY))
    side = lambda pre, name: both.withColumn("entity_type", F.col(f"{pre}_type")).withColumn("entity_id", F.col(f"{pre}_id")).withColumn("direction", F.lit(name))
    return reduce(DataFrame.unionByName, [side("source", "outgoing"), side("target", "incoming")]).join(entities, ["entity_type", "entity_id"], "left_semi")
