"""Registered queries: lineage, relationships, knowledge graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.operators import graph as g
from curatrix.operators import knowledge as kg
from curatrix.operators import lineage as ln
from curatrix.plans.registry import query
from curatrix.sources import triples as tr
from curatrix.sources.triples import GOV, OWL, RDF, RDFS, SKOS


def _roots(d, *names, col="root"):
    """Start nodes, picked from the lineage frame so that the frame decides whether they exist."""
    return d["lineage"].filter(F.col("src").isin(*names)).select(F.col("src").alias(col)).distinct()


def _reach(edges, seeds, depth, extra=""):
    """Breadth-first oracle: smallest depth per (root, node)."""
    stop = f" AND r.depth < {depth}" if depth else ""
    return f"""WITH RECURSIVE st AS (SELECT DISTINCT src, dst FROM ({edges})), r AS (SELECT root, root AS node, 0 AS depth FROM ({seeds})
 UNION SELECT r.root, st.dst, r.depth + 1 FROM r JOIN st ON st.src = r.node WHERE true{stop}){extra}"""


_BOTH = "SELECT src, dst FROM {lineage} UNION ALL SELECT dst, src FROM {lineage}"
_SEED = "SELECT DISTINCT src AS root FROM {lineage} WHERE src IN ('t3', 't40')"


@query("business_lineage_nodes", "GR16", _reach(_BOTH, _SEED, 3) + " SELECT root, node, MIN(depth) AS depth FROM r GROUP BY 1, 2")
def business_lineage_nodes(d):
    return ln.business_lineage_nodes(d["lineage"], _roots(d, "t3", "t40"), 3)


@query("business_lineage_edges", "GR16", _reach(_BOTH, _SEED, 3, ", n AS (SELECT root, node, MIN(depth) AS depth FROM r GROUP BY 1, 2)") + """
 SELECT DISTINCT n.root, e.src, e.dst, e.relationship_type FROM n JOIN {lineage} e ON (e.src = n.node OR e.dst = n.node) WHERE n.depth < 3""")
def business_lineage_edges(d):
    e = d["lineage"].select("src", "dst", "relationship_type")
    return ln.business_lineage_edges(e, ln.business_lineage_nodes(e, _roots(d, "t3", "t40"), 3), 3)


_DOWN, _UP = "SELECT src, dst FROM {lineage}", "SELECT dst AS src, src AS dst FROM {lineage}"


@query("table_lineage", "GR17", f"""
SELECT x.root, x.node, x.side, x.depth, COALESCE(l.kind = 'external', false) AS external FROM (
 SELECT root, node, 'downstream' AS side, depth FROM ({_reach(_DOWN, _SEED, 4)} SELECT root, node, MIN(depth) AS depth FROM r GROUP BY 1, 2) WHERE depth > 0
 UNION ALL SELECT root, node, 'upstream', depth FROM ({_reach(_UP, _SEED, 4)} SELECT root, node, MIN(depth) AS depth FROM r GROUP BY 1, 2) WHERE depth > 0) x LEFT JOIN {{lineage_nodes}} l USING (node)""")
def table_lineage(d):
    return ln.table_lineage(d["lineage"], _roots(d, "t3", "t40"), 4, d["lineage_nodes"].filter("kind = 'external'"))


@query("lineage_counts", "GR17", f"""
SELECT x.root, COUNT(*) FILTER (side = 'upstream') AS upstream, COUNT(*) FILTER (side = 'downstream') AS downstream, COUNT(*) FILTER (l.kind = 'external') AS external FROM (
 SELECT root, node, 'downstream' AS side, depth FROM ({_reach(_DOWN, _SEED, 4)} SELECT root, node, MIN(depth) AS depth FROM r GROUP BY 1, 2) WHERE depth > 0
 UNION ALL SELECT root, node, 'upstream', depth FROM ({_reach(_UP, _SEED, 4)} SELECT root, node, MIN(depth) AS depth FROM r GROUP BY 1, 2) WHERE depth > 0) x LEFT JOIN {{lineage_nodes}} l USING (node) GROUP BY 1""")
def lineage_counts(d):
    return ln.lineage_counts(ln.table_lineage(d["lineage"], _roots(d, "t3", "t40"), 4, d["lineage_nodes"].filter("kind = 'external'")))


def _mapped(d):
    m = F.when(F.col("map_from").isNotNull(), F.array(F.struct(F.col("map_from").alias("source_column"), F.col("map_to").alias("target_column")),
                                                     F.struct(F.lit("id").alias("source_column"), F.lit("id").alias("target_column"))))
    return d["lineage"].select("src", "dst", m.alias("column_mappings"))


@query("column_lineage", "GR18", """
SELECT src, dst, CASE WHEN map_from IS NOT NULL THEN 1 ELSE 0 END AS mappings FROM {lineage} WHERE map_from IS NULL OR map_from = 'c1' OR map_to = 'c1'""")
def column_lineage(d):
    out = ln.column_lineage(_mapped(d), "c1")
    return out.select("src", "dst", F.when(F.col("column_mappings").isNull(), 0).otherwise(F.size("column_mappings")).alias("mappings"))


_IMPACT = f"""SELECT x.root, x.node, x.depth AS distance, CASE WHEN l.kind IN ('view', 'external') THEN l.kind ELSE 'table' END AS kind, l.owner FROM (
 {_reach(_DOWN, _SEED, 6)} SELECT root, node, MIN(depth) AS depth FROM r GROUP BY 1, 2 HAVING MIN(depth) > 0) x LEFT JOIN {{lineage_nodes}} l USING (node)"""


@query("impact", "GR19", _IMPACT)
def impact(d):
    return ln.impact(d["lineage"], _roots(d, "t3", "t40"), d["lineage_nodes"], 6)


@query("impact_summary", "GR19", f"""
SELECT root, COUNT(*) FILTER (kind = 'table') AS tables, COUNT(*) FILTER (kind = 'view') AS views, COUNT(*) FILTER (kind = 'external') AS externals, MAX(distance) AS max_depth, COUNT(DISTINCT owner) AS owners,
 COUNT(*) AS total FROM ({_IMPACT}) GROUP BY 1""")
def impact_summary(d):
    return ln.impact_summary(ln.impact(d["lineage"], _roots(d, "t3", "t40"), d["lineage_nodes"], 6))


@query("affected_columns", "GR19", f"""
SELECT DISTINCT i.root, i.node, c.col AS target_column FROM ({_IMPACT}) i JOIN (SELECT dst, map_to AS col FROM {{lineage}} WHERE map_from IS NOT NULL UNION ALL SELECT dst, 'id' FROM {{lineage}} WHERE map_from IS NOT NULL) c ON c.dst = i.node""")
def affected_columns(d):
    return ln.affected_columns(_mapped(d), ln.impact(d["lineage"], _roots(d, "t3", "t40"), d["lineage_nodes"], 6))


_HIER = """SELECT src, dst, relationship_type FROM {relation_edges} WHERE relationship_type IN ('hasDataset', 'hasTable', 'hasColumn')
 UNION ALL SELECT dst, src, relationship_type FROM {relation_edges} WHERE relationship_type = 'belongsToSystem'"""
_HSEED = "SELECT DISTINCT src AS root FROM {relation_edges} WHERE src IN ('data_product:1', 'data_product:8', 'dataset:7') UNION SELECT DISTINCT dst FROM {relation_edges} WHERE dst = 'system:3'"


@query("entity_hierarchy", "GR20", _reach(f"SELECT src, dst FROM ({_HIER})", _HSEED, 5, ", n AS (SELECT root, node, MIN(depth) AS depth FROM r GROUP BY 1, 2)") + f"""
 SELECT n.root, n.node, n.depth, MIN(e.src) AS parent FROM n LEFT JOIN (SELECT p.root, p.depth, h.src, h.dst FROM n p JOIN ({_HIER}) h ON h.src = p.node) e ON e.root = n.root AND e.dst = n.node AND e.depth = n.depth - 1 GROUP BY 1, 2, 3""")
def entity_hierarchy(d):
    e = d["relation_edges"]
    roots = e.filter(F.col("src").isin("data_product:1", "data_product:8", "dataset:7")).select(F.col("src").alias("root")).union(
        e.filter("dst = 'system:3'").select("dst")).distinct()
    return ln.entity_hierarchy(e, roots, ["hasDataset", "hasTable", "hasColumn"], ["belongsToSystem"], 5).select("root", "node", "depth", "parent")


_PARENTS3 = """SELECT 'Table' AS type, 't' || CAST(o_orderkey AS STRING) AS id, 's' || CAST(o_custkey AS STRING) AS parent_id, 'Schema' AS parent_type FROM {orders}
 UNION ALL SELECT 'Schema', 's' || CAST(c_custkey AS STRING), 'c' || CAST(c_nationkey AS STRING), 'Catalog' FROM {customer} WHERE c_custkey % 8 <> 0
 UNION ALL SELECT 'Catalog', 'c' || CAST(n_nationkey AS STRING), 'y' || CAST(n_regionkey AS STRING), 'System' FROM {nation}"""


@query("resolve_parents", "GR21", f"""
WITH p AS ({_PARENTS3}) SELECT a.id, a.parent_id AS schema, b.parent_id AS catalog, c.parent_id AS system FROM p a LEFT JOIN p b ON b.id = a.parent_id LEFT JOIN p c ON c.id = b.parent_id WHERE a.type = 'Table'""")
def resolve_parents(d):
    p = d.sql(_PARENTS3)
    return ln.resolve_parents(p.filter("type = 'Table'").select("id", "type"), p)


@query("propagate_certification", "GR22", """
WITH RECURSIVE st AS (SELECT DISTINCT src, dst FROM {lineage}), r AS (SELECT node, level, false AS moved FROM {lineage_nodes} WHERE level IS NOT NULL
 UNION SELECT st.dst, r.level, true FROM r JOIN st ON st.src = r.node) SELECT node, MAX(level) AS inherited FROM r WHERE moved GROUP BY 1""")
def propagate_certification(d):
    return ln.propagate_certification(d["lineage"], d["lineage_nodes"].select("node", "level"), None)


_MIXED = "SELECT src, dst, CASE WHEN length(dst) % 2 = 0 THEN 'contains' ELSE relationship_type END AS relationship_type FROM {lineage}"


@query("inherited_certification", "GR22", f"""
WITH RECURSIVE st AS (SELECT DISTINCT src, dst FROM ({_MIXED}) WHERE relationship_type = 'contains'), r AS (SELECT node, level, false AS moved FROM {{lineage_nodes}} WHERE level IS NOT NULL
 UNION SELECT st.dst, r.level, true FROM r JOIN st ON st.src = r.node) SELECT node, MAX(level) AS inherited FROM r WHERE moved GROUP BY 1""")
def inherited_certification(d):
    return ln.propagate_certification(d.sql(_MIXED), d["lineage_nodes"].select("node", "level"))


@query("product_hierarchy", "GR23", """
WITH r AS (SELECT DISTINCT source_id AS a, target_id AS b, relationship_type AS t FROM {relations})
SELECT 'path' AS part, p.a AS product_id, p.b AS dataset_id, t.b AS table_id, c.b AS column_id, NULL AS contract_id FROM (SELECT * FROM r WHERE t = 'hasDataset') p LEFT JOIN (SELECT * FROM r WHERE t = 'hasTable') t ON t.a = p.b
LEFT JOIN (SELECT * FROM r WHERE t = 'hasColumn') c ON c.a = t.b UNION ALL SELECT 'contract', p.a, p.b, NULL, NULL, k.b FROM (SELECT * FROM r WHERE t = 'hasDataset') p JOIN (SELECT * FROM r WHERE t = 'governedBy') k ON k.a = p.b""")
def product_hierarchy(d):
    return ln.product_hierarchy(d["relations"])


@query("detect_cycles", "GR24", """
WITH RECURSIVE e AS (SELECT node, parent FROM {asset_refs} WHERE parent IS NOT NULL), r AS (SELECT node AS start, parent AS at FROM e UNION SELECT r.start, e.parent FROM r JOIN e ON e.node = r.at)
SELECT a.start AS node, MIN(b.at) AS cycle FROM r a JOIN r b ON b.start = a.start JOIN r c ON c.start = b.at AND c.at = a.start WHERE a.at = a.start GROUP BY 1""")
def detect_cycles(d):
    return g.cycle_members(d["asset_refs"])


@query("cycle_paths", "GR24", """
WITH RECURSIVE e AS (SELECT DISTINCT node, parent FROM {asset_refs} WHERE parent IS NOT NULL), r AS (SELECT node AS start, parent AS at FROM e UNION SELECT r.start, e.parent FROM r JOIN e ON e.node = r.at),
 m AS (SELECT a.start AS node, MIN(b.at) AS cycle FROM r a JOIN r b ON b.start = a.start JOIN r c ON c.start = b.at AND c.at = a.start WHERE a.at = a.start GROUP BY 1),
 s AS (SELECT e.node, MIN(e.parent) AS nxt FROM e JOIN m x ON x.node = e.node JOIN m y ON y.node = e.parent AND y.cycle = x.cycle GROUP BY 1),
 w AS (SELECT node AS start, nxt AS cur, 1 AS steps FROM s UNION ALL SELECT w.start, s.nxt, w.steps + 1 FROM w JOIN s ON s.node = w.cur WHERE w.cur <> w.start AND w.steps < 200),
 o AS (SELECT start AS node, MAX(steps) AS size, MIN(cur) AS cycle FROM w WHERE start IN (SELECT start FROM w WHERE cur = start) GROUP BY 1)
SELECT o.cycle, CAST(COALESCE(p.steps, 0) % o.size AS BIGINT) AS position, o.node FROM o LEFT JOIN w p ON p.start = o.cycle AND p.cur = o.node""")
def cycle_paths(d):
    return g.cycle_paths(d["asset_refs"])


_ACYCLIC = "SELECT o_orderkey AS node, CASE WHEN o_orderkey < 10 THEN NULL ELSE CAST(FLOOR(o_orderkey / 4) AS BIGINT) END AS parent FROM {orders}"


@query("delete_order", "GR25", f"""
WITH RECURSIVE e AS ({_ACYCLIC}), r AS (SELECT node, 0 AS depth FROM e WHERE node IN (2, 5, 20) UNION SELECT e.node, r.depth + 1 FROM r JOIN e ON e.parent = r.node)
SELECT node, MAX(depth) AS depth FROM r GROUP BY 1""")
def delete_order(d):
    refs = d.sql(_ACYCLIC)
    return g.delete_order(refs, refs.filter("node IN (2, 5, 20)").select("node"))


@query("relationships", "GR29", """
WITH b AS (SELECT * FROM {relations} UNION SELECT * FROM {legacy_relations}), w AS (SELECT 'dataset' AS t, p_partkey AS i FROM part WHERE p_size < 10)
SELECT 'outgoing' AS direction, source_type AS entity_type, source_id AS entity_id, relationship_type, target_type, target_id, source_type, source_id FROM b JOIN w ON w.t = source_type AND w.i = source_id
UNION ALL SELECT 'incoming', target_type, target_id, relationship_type, target_type, target_id, source_type, source_id FROM b JOIN w ON w.t = target_type AND w.i = target_id""")
def relationships(d):
    w = d["part"].filter("p_size < 10").select(F.lit("dataset").alias("entity_type"), F.col("p_partkey").alias("entity_id"))
    return ln.relationships(d["relations"], d["legacy_relations"], w)


# ---- triples ------------------------------------------------------------------------------------------------------------

_T = "{triples}"


@query("match_patterns", "GR1 GR2", f"""
SELECT a.subject AS s, a.object AS parent, b.object AS label, c.object AS comment FROM {_T} a JOIN {_T} b ON b.subject = a.subject AND b.predicate = '{RDFS}label'
JOIN {_T} k ON k.subject = a.object AND k.predicate = '{RDF}type' AND k.object = '{OWL}Class' LEFT JOIN {_T} c ON c.subject = a.subject AND c.predicate = '{RDFS}comment' WHERE a.predicate = '{RDFS}subClassOf'""")
def match_patterns(d):
    return kg.match_patterns(
        d["triples"], [("?s", RDFS + "subClassOf", "?parent"), ("?s", RDFS + "label", "?label"), ("?parent", RDF + "type", OWL + "Class")], [("?s", RDFS + "comment", "?comment")])


@query("count_distinct_objects", "GR2", f"""
SELECT object AS parent, COUNT(DISTINCT subject) AS n FROM {_T} WHERE predicate IN ('{RDFS}subClassOf', '{SKOS}broader') GROUP BY 1 HAVING COUNT(DISTINCT subject) > 1""")
def count_distinct_objects(d):
    t = d["triples"]
    rows = kg.match_patterns(t, [("?s", RDFS + "subClassOf", "?parent")]).unionByName(kg.match_patterns(t, [("?s", SKOS + "broader", "?parent")])).distinct()
    return rows.groupBy("parent").agg(F.countDistinct("s").alias("n")).filter("n > 1")


@query("capped_triples", "GR3", f"""
SELECT subject, predicate, object, (SELECT COUNT(*) FROM {_T} WHERE context = 'urn:glossary:c3') > 40 AS truncated FROM {_T} WHERE context = 'urn:glossary:c3' ORDER BY subject, predicate, object LIMIT 40""")
def capped_triples(d):
    rows = d["triples"].filter("context = 'urn:glossary:c3'").select("subject", "predicate", "object")
    return kg.capped(rows, ["subject", "predicate", "object"], 40)


_IRI = "http://x.org/part/7"
_KINDS = f"(SELECT predicate AS x FROM {_T} UNION SELECT subject FROM {_T} WHERE predicate = '{RDF}type' AND object = '{RDF}Property')"


@query("neighbors", "GR4", f"""
SELECT direction, predicate, display, CASE WHEN NOT u THEN 'literal' WHEN display IN {_KINDS} THEN 'property' ELSE 'resource' END AS kind FROM (SELECT direction, predicate, display, bool_or(u) AS u FROM (
 SELECT 'outgoing' AS direction, predicate, object AS display, object_is_uri AS u FROM {_T} WHERE subject = '{_IRI}' UNION ALL SELECT 'incoming', predicate, subject, true FROM {_T} WHERE object = '{_IRI}' AND object_is_uri
 UNION ALL SELECT 'predicate', predicate, subject, true FROM {_T} WHERE predicate = '{_IRI}' UNION ALL SELECT 'predicate', predicate, object, object_is_uri FROM {_T} WHERE predicate = '{_IRI}') GROUP BY 1, 2, 3)
ORDER BY direction, predicate, display LIMIT 200""")
def neighbors(d):
    return kg.neighbors(d["triples"], _IRI, 200)


@query("describe_concept", "GR5", f"""
WITH b AS (SELECT object AS o FROM {_T} WHERE subject = 'http://x.org/part/40' AND object LIKE 'urn:gov:bnode:%')
SELECT DISTINCT subject, predicate, object, 0 AS level FROM {_T} WHERE subject = 'http://x.org/part/40' UNION ALL SELECT DISTINCT subject, predicate, object, 1 FROM {_T} WHERE subject IN (SELECT o FROM b)""")
def describe_concept(d):
    return kg.describe(d["triples"], "http://x.org/part/40")


def _in(items):
    return ", ".join(f"'{i}'" for i in items)


_VOCAB = " AND ".join(f"NOT starts_with(subject, '{v}')" for v in tr.VOCABULARIES)
_SUBJ = f"""SELECT DISTINCT subject, context FROM {_T} WHERE ((predicate = '{RDF}type' AND object IN ({_in(kg.CONCEPT_TYPES)})) OR predicate IN ({_in(kg.CONCEPT_EDGES)})) AND NOT starts_with(subject, 'urn:gov:bnode:') AND {_VOCAB}"""


def _text(pref, fall, name):
    """English, then no language, then the smallest language; per language the preferred predicate first."""
    return f"""SELECT subject, context, arg_min(object, CASE WHEN lang = 'en' THEN '0' WHEN lang = '' THEN '1' ELSE '2' || lang END) AS {name} FROM (
 SELECT subject, context, COALESCE(language, '') AS lang, arg_min(object, CASE predicate WHEN '{pref}' THEN 0 ELSE 1 END || object) AS object FROM {_T} WHERE predicate IN ('{pref}', '{fall}') GROUP BY 1, 2, 3) GROUP BY 1, 2"""


_RANK = f"""CASE WHEN predicate = '{RDF}type' AND object IN ('{RDFS}Class', '{OWL}Class') THEN 1 WHEN predicate = '{RDF}type' AND object IN ('{SKOS}Concept', '{SKOS}ConceptScheme') THEN 2
 WHEN predicate = '{RDF}type' AND object IN ('{RDF}Property', '{OWL}ObjectProperty', '{OWL}DatatypeProperty', '{OWL}AnnotationProperty') THEN 3 WHEN predicate = '{RDFS}subPropertyOf' THEN 4
 WHEN predicate IN ('{RDFS}subClassOf', '{OWL}equivalentClass') THEN 5 ELSE 6 END"""
_CTYPE = f"SELECT subject, context, CASE MIN({_RANK}) WHEN 1 THEN 'class' WHEN 2 THEN 'concept' WHEN 3 THEN 'property' WHEN 4 THEN 'property' WHEN 5 THEN 'class' ELSE 'individual' END AS concept_type FROM {_T} GROUP BY 1, 2"
_CONCEPTS = f"""SELECT s.subject AS iri, s.context, COALESCE(l.label, regexp_extract(s.subject, '[^/#]*$')) AS label, m.comment, k.concept_type,
 CASE WHEN starts_with(s.context, 'urn:glossary:') THEN substr(s.context, 14) WHEN starts_with(s.context, 'urn:app-entities') THEN 'Application Entities' END AS source_context
FROM ({_SUBJ}) s LEFT JOIN ({_text(SKOS + 'prefLabel', RDFS + 'label', 'label')}) l USING (subject, context) LEFT JOIN ({_text(SKOS + 'definition', RDFS + 'comment', 'comment')}) m USING (subject, context)
LEFT JOIN ({_CTYPE}) k USING (subject, context)"""


@query("concepts", "GR7 SC13 SC12", _CONCEPTS)
def concepts(d):
    return kg.concepts(d["triples"])


@query("concept_type", "GR8", _CTYPE)
def concept_type(d):
    return kg.concept_type(d["triples"])


@query("related_concepts", "GR7", f"SELECT DISTINCT subject AS iri, object AS related_iri FROM {_T} WHERE predicate = '{SKOS}related'")
def related_concepts(d):
    return kg.related(d["triples"])


_EQUIV = f"""SELECT DISTINCT a.subject AS child, f.object AS parent FROM {_T} a JOIN {_T} i ON i.subject = a.object AND i.predicate = '{OWL}intersectionOf'
 JOIN (SELECT subject AS head, subject AS cell FROM {_T} WHERE predicate = '{RDF}first' UNION SELECT subject, object FROM {_T} WHERE predicate = '{RDF}rest') c ON c.head = i.object
 JOIN {_T} f ON f.subject = c.cell AND f.predicate = '{RDF}first' WHERE a.predicate = '{OWL}equivalentClass'"""
_PARENTS = f"""SELECT DISTINCT subject AS child, object AS parent FROM {_T} WHERE (predicate IN ('{RDFS}subClassOf', '{RDFS}subPropertyOf') AND NOT starts_with(object, 'urn:gov:bnode:')) OR predicate = '{SKOS}broader'
 OR (predicate = '{RDF}type' AND {_VOCAB.replace('subject', 'object')}) UNION {_EQUIV}"""


@query("equivalent_parents", "GR10", _EQUIV)
def equivalent_parents(d):
    return kg.equivalent_parents(d["triples"])


@query("concept_parents", "GR9", _PARENTS)
def concept_parents(d):
    return kg.parents(d["triples"])


@query("concept_children", "GR11", f"SELECT DISTINCT parent, child FROM ({_PARENTS})")
def concept_children(d):
    return kg.children(kg.parents(d["triples"]))


_STEPS = f"SELECT subject AS child, object AS parent FROM {_T} WHERE predicate IN ('{RDFS}subClassOf', '{RDFS}subPropertyOf', '{SKOS}broader') AND NOT starts_with(object, 'urn:gov:bnode:')"


def _steps(d):
    t = d["triples"].filter(F.col("predicate").isin(RDFS + "subClassOf", RDFS + "subPropertyOf", SKOS + "broader") & ~F.col("object").startswith(tr.BNODE))
    return t.select(F.col("subject").alias("child"), F.col("object").alias("parent")).distinct()


@query("concept_ancestors", "GR12 GR27", f"""
WITH RECURSIVE e AS ({_STEPS}), r AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM e UNION SELECT r.node, e.parent, r.depth + 1 FROM r JOIN e ON e.child = r.ancestor)
SELECT node, ancestor, MIN(depth) AS depth FROM r GROUP BY 1, 2""")
def concept_ancestors(d):
    return g.ancestors(_steps(d))


@query("concept_descendants", "GR12", f"""
WITH RECURSIVE e AS ({_STEPS}), r AS (SELECT parent AS node, child AS descendant, 1 AS depth FROM e WHERE parent IN ('http://x.org/part/2', 'http://x.org/part/9') UNION SELECT r.node, e.child, r.depth + 1 FROM r JOIN e ON e.parent = r.descendant)
SELECT node, descendant, MIN(depth) AS depth FROM r GROUP BY 1, 2""")
def concept_descendants(d):
    s = _steps(d)
    roots = s.filter(F.col("parent").isin("http://x.org/part/2", "http://x.org/part/9")).select(F.col("parent").alias("node")).distinct()
    return g.descendants(s, roots)


@query("concept_siblings", "GR12", f"""
WITH e AS (SELECT DISTINCT * FROM ({_STEPS})) SELECT DISTINCT a.child AS node, b.child AS sibling FROM e a JOIN e b ON a.parent = b.parent AND a.child <> b.child WHERE a.child IN ('http://x.org/part/4', 'http://x.org/part/31')""")
def concept_siblings(d):
    s = _steps(d)
    return g.siblings(s, s.filter(F.col("child").isin("http://x.org/part/4", "http://x.org/part/31")).select(F.col("child").alias("node")).distinct())


def _meta(pred, name):
    return f"SELECT subject, MIN(object) AS {name} FROM {_T} WHERE context = 'urn:meta:sources' AND predicate = '{pred}' GROUP BY 1"


_COLLS = f"""SELECT c.subject AS iri, COALESCE(l.label, split_part(c.subject, ':', 3)) AS label, COALESCE(s.scope_level, 'enterprise') AS scope_level, p.parent_iri, e.editable = 'true' AS is_editable, COALESCE(n.n, 0) AS concept_count
FROM (SELECT DISTINCT subject FROM {_T} WHERE context = 'urn:meta:sources' AND object = 'urn:gov:KnowledgeCollection') c LEFT JOIN ({_meta(RDFS + 'label', 'label')}) l USING (subject)
LEFT JOIN ({_meta('urn:gov:scopeLevel', 'scope_level')}) s USING (subject) LEFT JOIN ({_meta('urn:gov:parentCollection', 'parent_iri')}) p USING (subject) LEFT JOIN ({_meta('urn:gov:isEditable', 'editable')}) e USING (subject)
LEFT JOIN (SELECT context, COUNT(DISTINCT subject) AS n FROM ({_SUBJ}) GROUP BY 1) n ON n.context = c.subject"""


def _collections(d):
    return kg.collections(d["triples"], kg.concepts(d["triples"]))


@query("collections", "GR32", _COLLS)
def collections(d):
    return _collections(d)


@query("collection_ancestors", "GR13", f"""
WITH RECURSIVE c AS ({_COLLS}), r AS (SELECT iri, iri AS ancestor, 0 AS depth FROM c UNION SELECT r.iri, c.parent_iri, r.depth + 1 FROM r JOIN c ON c.iri = r.ancestor WHERE c.parent_iri IS NOT NULL) SELECT * FROM r""")
def collection_ancestors(d):
    return kg.collection_paths(_collections(d))


@query("collection_tree", "GR13", f"""
WITH RECURSIVE c AS ({_COLLS}), r AS (SELECT iri, iri AS ancestor, 0 AS depth FROM c UNION SELECT r.iri, c.parent_iri, r.depth + 1 FROM r JOIN c ON c.iri = r.ancestor WHERE c.parent_iri IS NOT NULL)
SELECT iri, string_agg(ancestor, ' > ' ORDER BY depth DESC) AS path, MAX(depth) AS level FROM r GROUP BY 1""")
def collection_tree(d):
    return kg.collection_tree(kg.collection_paths(_collections(d)))


_RENAMED = "SELECT object AS label, subject FROM {triples} WHERE predicate IN ('http://www.w3.org/2000/01/rdf-schema#label', 'http://www.w3.org/2004/02/skos/core#prefLabel')"
_REQS = "SELECT 'http://x.org/part/' || CAST(p_partkey AS STRING) AS concept_iri, 'urn:glossary:c' || CAST(p_size * 31 AS STRING) AS target_iri FROM {part}"
_MOVE = f"""
q AS ({_REQS}), coll AS ({_COLLS}), lab AS (SELECT subject, MIN(label) AS label FROM ({_RENAMED}) GROUP BY 1),
home AS (SELECT subject, MIN(context) AS source_iri, MIN(object) FILTER (predicate = 'urn:gov:status') AS status FROM {_T} GROUP BY 1),
m AS (SELECT q.*, h.source_iri, h.status, c.is_editable, q.target_iri || '/' || regexp_replace(lower(COALESCE(l.label, regexp_extract(q.concept_iri, '[^/]*$'))), '[^a-z0-9_-]+', '-', 'g') AS new_iri
 FROM q LEFT JOIN home h ON h.subject = q.concept_iri LEFT JOIN lab l ON l.subject = q.concept_iri LEFT JOIN coll c ON c.iri = q.target_iri),
good AS (SELECT * FROM m WHERE source_iri IS NOT NULL AND is_editable QUALIFY ROW_NUMBER() OVER (PARTITION BY new_iri ORDER BY concept_iri) = 1)"""


def _moves(d, kind):
    return kg.move_concepts(d["triples"], d.sql(_REQS), _collections(d), kind, "2024-02-01T00:00:00Z")


@query("promote_inserts", "GR14", f"""
WITH {_MOVE}, body AS (SELECT g.new_iri AS subject, t.predicate, t.object, g.target_iri AS context FROM {_T} t JOIN good g ON g.concept_iri = t.subject WHERE t.predicate <> 'urn:gov:status')
SELECT DISTINCT * FROM (SELECT * FROM body UNION ALL SELECT new_iri, 'urn:gov:status', 'draft', target_iri FROM good UNION ALL SELECT new_iri, 'urn:gov:sourceConceptIri', concept_iri, target_iri FROM good
 UNION ALL SELECT new_iri, 'urn:gov:sourceCollectionIri', source_iri, target_iri FROM good UNION ALL SELECT new_iri, 'urn:gov:promotionType', 'promoted', target_iri FROM good
 UNION ALL SELECT new_iri, 'urn:gov:promotedAt', '2024-02-01T00:00:00Z', target_iri FROM good UNION ALL SELECT concept_iri, 'urn:gov:status', 'deprecated', source_iri FROM good
 UNION ALL SELECT concept_iri, '{RDFS}seeAlso', new_iri, source_iri FROM good)""")
def promote_inserts(d):
    return _moves(d, "promoted")[0].select("subject", "predicate", "object", "context").distinct()


@query("migrate_deletes", "GR14", f"""
WITH {_MOVE} SELECT DISTINCT t.subject, t.predicate, t.object, t.context FROM {_T} t JOIN good g ON g.concept_iri = t.subject WHERE COALESCE(g.status, 'draft') = 'draft' OR t.predicate = 'urn:gov:status'""")
def migrate_deletes(d):
    return _moves(d, "migrated")[1].select("subject", "predicate", "object", "context").distinct()


@query("move_conflicts", "GR14", f"""
WITH {_MOVE} SELECT concept_iri, target_iri, CASE WHEN source_iri IS NULL THEN 'concept not found' WHEN is_editable IS NULL THEN 'target not found' WHEN NOT is_editable THEN 'target not editable' ELSE 'already exists' END AS reason
FROM m WHERE (concept_iri, target_iri) NOT IN (SELECT (concept_iri, target_iri) FROM good)""")
def move_conflicts(d):
    return _moves(d, "promoted")[2]


@query("inferred_links", "GR15", f"""
SELECT regexp_extract(t.subject, '^urn:gov:([^:]+):(.+)$', 1) AS entity_type, regexp_extract(t.subject, '^urn:gov:([^:]+):(.+)$', 2) AS entity_id, l.object AS label FROM {_T} t
LEFT JOIN {_T} l ON l.subject = t.subject AND l.predicate = '{RDFS}label' WHERE t.predicate = '{RDF}type' AND t.object = 'http://x.org/part/3' AND starts_with(t.subject, 'urn:gov:')""")
def inferred_links(d):
    return kg.inferred_links(d["triples"], "http://x.org/part/3")


_STATS = f"""SELECT c.context, COALESCE(a.n, 0) AS concepts_count, COALESCE(b.n, 0) AS properties_count FROM (SELECT DISTINCT context FROM {_T}) c LEFT JOIN (
 SELECT context, COUNT(DISTINCT subject) AS n FROM (SELECT context, subject FROM {_T} WHERE (predicate = '{RDF}type' AND object IN ('{RDFS}Class', '{SKOS}Concept', '{SKOS}ConceptScheme', '{OWL}Class')) OR predicate = '{RDFS}subClassOf'
  UNION ALL SELECT context, object FROM {_T} WHERE predicate = '{RDF}type' AND object NOT IN ('{RDFS}Class', '{SKOS}Concept', '{RDF}Property', '{OWL}Class')
  UNION ALL SELECT context, subject FROM {_T} WHERE predicate IN ('{RDFS}label', '{RDFS}comment') GROUP BY 1, 2 HAVING COUNT(DISTINCT predicate) = 2) WHERE NOT starts_with(subject, 'urn:gov:bnode:') AND {_VOCAB} GROUP BY 1) a USING (context)
LEFT JOIN (SELECT context, COUNT(DISTINCT subject) AS n FROM {_T} WHERE predicate = '{RDF}type' AND object = '{RDF}Property' GROUP BY 1) b USING (context)"""


@query("taxonomy_stats", "AG19", _STATS)
def taxonomy_stats(d):
    return kg.taxonomy_stats(d["triples"])


@query("concept_totals", "AG19", f"""
SELECT concept_type, COUNT(*) AS concepts, COUNT(*) FILTER (iri NOT IN (SELECT child FROM ({_PARENTS}))) AS top_level FROM ({_CONCEPTS}) GROUP BY 1""")
def concept_totals(d):
    return kg.concept_totals(kg.concepts(d["triples"]), kg.parents(d["triples"]))


@query("grouped_concepts", "AG20", f"SELECT COALESCE(source_context, 'Unassigned') AS group_name, iri, label, concept_type FROM ({_CONCEPTS})")
def grouped_concepts(d):
    return kg.grouped_concepts(kg.concepts(d["triples"]))


@query("grouped_properties", "AG20", f"""
SELECT substr(p.context, 14) AS group_name, p.subject AS iri, 'object' AS property_type, COALESCE(l.object, regexp_extract(p.subject, '[^/]*$')) AS label, a.object AS domain, b.object AS range
FROM (SELECT DISTINCT subject, context FROM {_T} WHERE predicate = '{RDF}type' AND object = '{OWL}ObjectProperty') p LEFT JOIN {_T} l ON l.subject = p.subject AND l.predicate = '{RDFS}label'
LEFT JOIN {_T} a ON a.subject = p.subject AND a.predicate = '{RDFS}domain' LEFT JOIN {_T} b ON b.subject = p.subject AND b.predicate = '{RDFS}range'""")
def grouped_properties(d):
    return kg.grouped_properties(d["triples"])


@query("prefix_search", "S5 U1", f"""
SELECT DISTINCT value, kind FROM (SELECT subject AS value, 'resource' AS kind FROM {_T} UNION SELECT predicate, 'property' FROM {_T}) WHERE contains(lower(value), 'part/12') OR contains(lower(value), 'xyz') ORDER BY value, kind LIMIT 20""")
def prefix_search(d):
    return kg.prefix_search(d["triples"], "Part/12", 20)


def _search(types, edge, q, limit=None):
    return f"""SELECT s.subject AS iri, COALESCE(l.label, regexp_extract(s.subject, '[^/]*$')) AS label FROM (SELECT DISTINCT subject FROM {_T} WHERE (predicate = '{RDF}type' AND object IN ({_in(types)})) OR predicate = '{edge}') s
LEFT JOIN (SELECT subject, MIN(object) AS label FROM {_T} WHERE predicate IN ('{RDFS}label', '{SKOS}prefLabel') GROUP BY 1) l USING (subject)
WHERE (contains(lower(s.subject), '{q}') OR contains(lower(COALESCE(l.label, '')), '{q}')) AND NOT starts_with(s.subject, 'urn:gov:bnode:'){f' ORDER BY iri LIMIT {limit}' if limit else ''}"""


@query("search_concepts", "GR6 U1", _search(kg.SEARCH_CLASS_TYPES, RDFS + "subClassOf", "ring"))
def search_concepts(d):
    return kg.search_concepts(d["triples"], "Ring")


@query("search_properties", "GR6 U1", _search(kg.SEARCH_PROPERTY_TYPES, RDFS + "subPropertyOf", "bolt"))
def search_properties(d):
    return kg.search_properties(d["triples"], "bolt")


_KIDS = f"(SELECT DISTINCT child AS iri FROM ({_PARENTS}) WHERE parent = 'http://x.org/part/5' ORDER BY child LIMIT 10)"


@query("suggest_concepts", "S6", f"""
SELECT iri, 'suggested' AS section FROM {_KIDS} UNION ALL SELECT iri, 'other' FROM ({_search(kg.SEARCH_CLASS_TYPES, RDFS + 'subClassOf', 'red', 50)}) WHERE iri NOT IN (SELECT iri FROM {_KIDS})""")
def suggest_concepts(d):
    return kg.suggest_concepts(d["triples"], kg.parents(d["triples"]), "red", ["http://x.org/none", "http://x.org/part/5", "http://x.org/part/1"], 50, 10)


@query("hierarchy_paths", "GR26", f"""
SELECT regexp_extract(a.object, '[^/]*$') AS source_type, regexp_extract(p.subject, '[^/]*$') AS relationship, regexp_extract(b.object, '[^/]*$') AS target_type, COALESCE(u.object, regexp_extract(p.subject, '[^/]*$')) AS label, CAST(NULL AS VARCHAR) AS inverse_label
FROM (SELECT DISTINCT subject FROM {_T} WHERE predicate = '{RDF}type' AND object = '{OWL}ObjectProperty') p JOIN {_T} h ON h.subject = p.subject AND h.predicate = 'urn:gov:isHierarchical' AND h.object = 'true'
JOIN {_T} a ON a.subject = p.subject AND a.predicate = '{RDFS}domain' JOIN {_T} b ON b.subject = p.subject AND b.predicate = '{RDFS}range' LEFT JOIN {_T} u ON u.subject = p.subject AND u.predicate = 'urn:gov:uiLabel'""")
def hierarchy_paths(d):
    return kg.hierarchy_paths(d["triples"])


@query("class_ancestors", "GR27", f"""
WITH RECURSIVE e AS (SELECT DISTINCT subject AS child, object AS parent FROM {_T} WHERE predicate = '{RDFS}subClassOf' AND NOT starts_with(object, 'urn:gov:bnode:')),
 r AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM e UNION SELECT r.node, e.parent, r.depth + 1 FROM r JOIN e ON e.child = r.ancestor) SELECT node, ancestor, MIN(depth) AS depth FROM r GROUP BY 1, 2""")
def class_ancestors(d):
    t = d["triples"].filter((F.col("predicate") == RDFS + "subClassOf") & ~F.col("object").startswith(tr.BNODE))
    return g.ancestors(t.select(F.col("subject").alias("child"), F.col("object").alias("parent")))


@query("ontology_constraints", "GR28", f"""
SELECT 'functional' AS constraint_type, subject AS property_iri, NULL AS class_iri, NULL AS value FROM {_T} WHERE object = '{OWL}FunctionalProperty'
UNION ALL SELECT CASE f.predicate WHEN '{OWL}minCardinality' THEN 'minCardinality' ELSE 'someValuesFrom' END, p.object, s.subject, f.object FROM {_T} s JOIN {_T} k ON k.subject = s.subject AND k.predicate = '{RDF}type' AND k.object = '{OWL}Class'
JOIN {_T} p ON p.subject = s.object AND p.predicate = '{OWL}onProperty' JOIN {_T} f ON f.subject = s.object AND f.predicate IN ('{OWL}minCardinality', '{OWL}someValuesFrom') WHERE s.predicate = '{RDFS}subClassOf'""")
def ontology_constraints(d):
    return kg.constraints(d["triples"])


_SHAPES = [
    ("priced", OWL + "Class", GOV + "price", 1, "^[0-9]+$", 6.0, 40.0),
    ("labelled", SKOS + "Concept", RDFS + "label", 1, "^(red|blue|small|green)", None, None),
    ("described", RDF + "Property", RDFS + "comment", 1, None, None, None),
]


@query("shape_checks", "GR30", f"""
WITH f AS (SELECT DISTINCT subject AS focus, object AS t FROM {_T} WHERE predicate = '{RDF}type'), s(shape, t, path, mn, pat, lo, hi) AS (VALUES ('priced', '{OWL}Class', '{GOV}price', 1, '^[0-9]+$', 6.0, 40.0),
 ('labelled', '{SKOS}Concept', '{RDFS}label', 1, '^(red|blue|small|green)', NULL, NULL), ('described', '{RDF}Property', '{RDFS}comment', 1, NULL, NULL, NULL)),
 v AS (SELECT s.*, f.focus, t.object AS value FROM f JOIN s USING (t) LEFT JOIN {_T} t ON t.subject = f.focus AND t.predicate = s.path)
SELECT shape, focus, 'min_count' AS violation, CAST(COUNT(value) AS VARCHAR) AS value FROM v GROUP BY shape, focus, mn HAVING COUNT(value) < mn
UNION ALL SELECT shape, focus, 'pattern', value FROM v WHERE NOT regexp_matches(value, pat)
UNION ALL SELECT shape, focus, 'min_inclusive', value FROM v WHERE lo IS NOT NULL AND value IS NOT NULL AND TRY_CAST(value AS DOUBLE) < lo UNION ALL SELECT shape, focus, 'max_inclusive', value FROM v WHERE hi IS NOT NULL AND value IS NOT NULL AND TRY_CAST(value AS DOUBLE) > hi""")
def shape_checks(d):
    shapes = d.spark.createDataFrame(_SHAPES, "shape string, target_class string, path string, min_count int, pattern string, min_inclusive double, max_inclusive double")
    return kg.shape_checks(d["triples"], shapes)


# ---- loading triples ------------------------------------------------------------------------------------------------------

_NT = """SELECT CASE WHEN p_partkey % 6 = 0 THEN '_:b' || CAST(p_partkey AS STRING) ELSE '<http://x.org/part/' || CAST(p_partkey AS STRING) || '>' END || ' <http://x.org/p' || CAST(p_size % 3 AS STRING) || '> ' ||
 CASE p_partkey % 5 WHEN 0 THEN '<http://x.org/brand/' || p_brand || '>' WHEN 1 THEN '"' || p_name || '"' WHEN 2 THEN '"' || p_name || '"@en' WHEN 3 THEN '"' || CAST(p_size AS STRING) || '"^^<http://www.w3.org/2001/XMLSchema#integer>'
 ELSE 'broken' END || ' .' AS value FROM {part}"""
_NT_SQL = """SELECT CASE WHEN p_partkey % 6 = 0 THEN 'urn:gov:bnode:urn:taxonomy:parts:b' || p_partkey ELSE 'http://x.org/part/' || p_partkey END AS subject, 'http://x.org/p' || p_size % 3 AS predicate,
 CASE p_partkey % 5 WHEN 0 THEN 'http://x.org/brand/' || p_brand WHEN 3 THEN CAST(p_size AS VARCHAR) ELSE p_name END AS object, p_partkey % 5 = 0 AS object_is_uri,
 CASE p_partkey % 5 WHEN 2 THEN 'en' END AS language, CASE p_partkey % 5 WHEN 3 THEN 'http://www.w3.org/2001/XMLSchema#integer' END AS datatype, 'urn:taxonomy:parts' AS context FROM part WHERE p_partkey % 5 <> 4"""


@query("parse_ntriples", "SRC10", _NT_SQL)
def parse_ntriples(d):
    return tr.parse_ntriples(d.sql(_NT), "urn:taxonomy:parts")


@query("load_triples", "SRC10 U7", f"""
SELECT subject, predicate, object, object_is_uri, language, datatype, context FROM {_T} WHERE context <> 'urn:meta:sources'
UNION ALL (SELECT subject, predicate, object, object_is_uri, language, datatype, context FROM {_T} WHERE predicate <> '{RDFS}label' EXCEPT SELECT subject, predicate, object, object_is_uri, language, datatype, context FROM {_T} WHERE context <> 'urn:meta:sources')""")
def load_triples(d):
    t = d["triples"]
    return tr.load_triples(t.filter("context <> 'urn:meta:sources'"), t.filter(F.col("predicate") != RDFS + "label").unionByName(t.filter("context = 'urn:app-entities'")))


@query("active_triples", "SRC13", f"""
SELECT DISTINCT subject, predicate, object, object_is_uri, language, datatype, context FROM {_T} WHERE context NOT IN ('urn:glossary:c4', 'urn:glossary:c11')
UNION SELECT 'urn:gov:' || entity_type || ':' || entity_id, 'urn:gov:semanticAssignment', iri, true, NULL, NULL, 'urn:semantic-links' FROM {{semantic_links}}""")
def active_triples(d):
    off = d["triples"].filter("context IN ('urn:glossary:c4', 'urn:glossary:c11')").select("context").distinct()
    return tr.active_triples(d["triples"], off, d["semantic_links"])


@query("entities_to_triples", "GR31", f"""
SELECT 'urn:gov:data_domain:' || n_nationkey AS subject, '{RDF}type' AS predicate, 'urn:gov:entity-type:data_domain' AS object FROM nation UNION ALL SELECT 'urn:gov:data_domain:' || n_nationkey, '{RDFS}label', n_name FROM nation
UNION ALL SELECT 'urn:gov:data_product:' || id, '{RDF}type', 'urn:gov:entity-type:data_product' FROM {{products}} UNION ALL SELECT 'urn:gov:data_product:' || id, '{RDFS}label', name FROM {{products}}
UNION ALL SELECT 'urn:gov:data_contract:' || id, '{RDF}type', 'urn:gov:entity-type:data_contract' FROM {{contracts}} UNION ALL SELECT 'urn:gov:data_contract:' || id, '{RDF}type', 'http://x.org/DataContract' FROM {{contracts}}
UNION ALL SELECT 'urn:gov:data_contract:' || id, '{RDFS}label', base_name FROM {{contracts}} WHERE base_name IS NOT NULL""")
def entities_to_triples(d):
    domains = d["nation"].select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    contracts = d["contracts"].select("id", F.col("base_name").alias("name"))
    return tr.entities_to_triples(domains, d["products"].select("id", "name"), contracts, "http://x.org/DataContract").select("subject", "predicate", "object")
