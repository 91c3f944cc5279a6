"""Knowledge-graph operators over triple frames (subject, predicate, object, object_is_uri, language, datatype, context)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.scalar import local_name, pick_label, source_context
from curatrix.operators.graph import reach
from curatrix.operators.skew import first_per_key
from curatrix.session import cut_lineage
from curatrix.sources.triples import BNODE, COLUMNS, GOV, META_CONTEXT, OWL, RDF, RDFS, SKOS, VOCABULARIES

TYPE = RDF + "type"
# Types that make a subject a concept, and edges that do.
CONCEPT_TYPES = (
    RDFS + "Class", OWL + "Class", SKOS + "Concept", SKOS + "ConceptScheme", RDF + "Property", OWL + "ObjectProperty", OWL + "DatatypeProperty",
    OWL + "AnnotationProperty", OWL + "NamedIndividual",
)
CONCEPT_EDGES = (RDFS + "subClassOf", RDFS + "subPropertyOf")


def is_pattern_variable(term) -> bool:
    return isinstance(term, str) and term.startswith("?")


def match_patterns(triples: DataFrame, patterns: list[tuple[str, str, str]], optional: list[tuple[str, str, str]] = (), context: str | None = None) -> DataFrame:
    """Basic graph pattern: ``("?s", "iri", "?o")`` tuples joined on their shared variables; ``optional`` ones by left join.

    Constants become filters that reach the scan; the result has one column per variable.
    """
    base = triples if context is None else triples.filter(F.col("context") == context)

    def rows(pattern):
        cond, cols, seen = [], [], {}
        for pos, term in zip(("subject", "predicate", "object"), pattern):
            if not is_pattern_variable(term):
                cond.append(F.col(pos) == term)
            elif term in seen:
                cond.append(F.col(pos) == F.col(seen[term]))
            else:
                seen[term] = pos
                cols.append(F.col(pos).alias(term[1:]))
        return reduce(DataFrame.filter, cond, base).select(*cols)

    def join(left, pattern, how):
        right = rows(pattern)
        shared = [c for c in right.columns if c in left.columns]
        if not shared:
            raise ValueError(f"pattern {pattern} shares no variable with those before it")
        return left.join(right, shared, how)

    out = reduce(lambda acc, p: join(acc, p, "inner"), patterns[1:], rows(patterns[0]))
    return reduce(lambda acc, p: join(acc, p, "left"), optional, out)


def capped(df: DataFrame, order: list, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows and whether there were more; only ``max_rows + 1`` rows leave the sort."""
    head = df.orderBy(*order).limit(max_rows + 1)
    truncated = head.agg(F.count(F.lit(1)) > max_rows).scalar()
    return head.orderBy(*order).limit(max_rows).withColumn("truncated", truncated)


def _head(df: DataFrame, limit: int | None, *order: str) -> DataFrame:
    """The first ``limit`` rows in order; all rows, in no order, without a limit."""
    return df if limit is None else df.orderBy(*order).limit(limit)


def _is_blank(c: Column) -> Column:
    return c.startswith("_:") | c.startswith(BNODE)


def _in_vocabulary(c: Column) -> Column:
    return reduce(lambda a, b: a | b, [c.startswith(v) for v in VOCABULARIES])


def neighbors(triples: DataFrame, iri: str, limit: int | None = None) -> DataFrame:
    """Outgoing, incoming and as-predicate neighbours, once per (direction, predicate, display), with the node kind."""
    row = lambda d, node, uri, name: d.select(F.lit(name).alias("direction"), "predicate", node.alias("display"), uri.alias("is_uri"))
    s, o, yes, flag = F.col("subject"), F.col("object"), F.lit(True), F.col("object_is_uri")
    used = triples.filter(F.col("predicate") == iri)
    parts = [
        row(triples.filter(s == iri), o, flag, "outgoing"), row(triples.filter((o == iri) & flag), s, yes, "incoming"),
        row(used, s, yes, "predicate"), row(used, o, flag, "predicate"),
    ]
    out = reduce(DataFrame.unionByName, parts).groupBy("direction", "predicate", "display").agg(F.max("is_uri").alias("is_uri"))
    props = triples.select(F.col("predicate").alias("display")).unionByName(
        triples.filter((F.col("predicate") == TYPE) & (o == RDF + "Property")).select(s.alias("display"))).distinct().withColumn("is_prop", F.lit(True))
    kind = F.when(~F.col("is_uri"), "literal").when(F.col("is_prop"), "property").otherwise("resource")
    out = out.join(props, "display", "left").select("direction", "predicate", "display", kind.alias("kind"))
    return _head(out, limit, "direction", "predicate", "display")


def describe(triples: DataFrame, iri: str) -> DataFrame:
    """Direct triples (level 0) and, one level down, those of blank-node objects (level 1)."""
    direct = triples.filter(F.col("subject") == iri).select("subject", "predicate", "object", F.lit(0).alias("level"))
    blanks = direct.filter(_is_blank(F.col("object"))).select(F.col("object").alias("subject")).distinct()
    nested = triples.join(blanks, "subject", "left_semi").select("subject", "predicate", "object", F.lit(1).alias("level"))
    return direct.unionByName(nested).distinct()


def _typed(triples: DataFrame, types, edges=()) -> DataFrame:
    hit = ((F.col("predicate") == TYPE) & F.col("object").isin(list(types))) | F.col("predicate").isin(list(edges))
    return triples.filter(hit)


def concept_subjects(triples: DataFrame) -> DataFrame:
    """Distinct (subject, context) that are concepts: one scan, blank nodes and vocabulary terms left out."""
    rows = _typed(triples, CONCEPT_TYPES, CONCEPT_EDGES)
    s = F.col("subject")
    return rows.filter(~_is_blank(s) & ~_in_vocabulary(s)).select("subject", "context").distinct()


def _first_text(triples: DataFrame, preferred: str, fallback: str, name: str) -> DataFrame:
    """Per (subject, context): language -> text, the preferred predicate before the fallback, one entry per language."""
    rows = triples.filter(F.col("predicate").isin(preferred, fallback) & ~F.col("object_is_uri"))
    lang = F.coalesce("language", F.lit(""))
    rank = F.when(F.col("predicate") == preferred, 0).otherwise(1)
    one = rows.groupBy("subject", "context", lang.alias("lang")).agg(F.min(F.struct(rank.alias("r"), F.col("object").alias("v"))).alias("m"))
    # one entry per language tag, so the map stays small
    return one.groupBy("subject", "context").agg(F.map_from_entries(F.collect_list(F.struct("lang", "m.v"))).alias(name))


def concept_type(triples: DataFrame) -> DataFrame:
    """class, concept, property or individual per (subject, context): the first test that holds."""
    p, o = F.col("predicate"), F.col("object")
    is_a = lambda *names: (p == TYPE) & o.isin(list(names))
    rank = (
        F.when(is_a(RDFS + "Class", OWL + "Class"), 1)
        .when(is_a(SKOS + "Concept", SKOS + "ConceptScheme"), 2)
        .when(is_a(RDF + "Property", OWL + "ObjectProperty", OWL + "DatatypeProperty", OWL + "AnnotationProperty"), 3)
        .when(p == RDFS + "subPropertyOf", 4)
        .when(p.isin(RDFS + "subClassOf", OWL + "equivalentClass"), 5)
        .otherwise(6)
    )
    best = triples.groupBy("subject", "context").agg(F.min(rank).alias("r"))
    names = F.create_map(*[F.lit(x) for kv in {1: "class", 2: "concept", 3: "property", 4: "property", 5: "class", 6: "individual"}.items() for x in kv])
    return best.select("subject", "context", names[F.col("r")].alias("concept_type"))


def concepts(triples: DataFrame) -> DataFrame:
    """Concepts with label, comment, type and source context, one row per (iri, graph)."""
    subj = concept_subjects(triples)
    k = ["subject", "context"]
    out = subj.join(_first_text(triples, SKOS + "prefLabel", RDFS + "label", "labels"), k, "left")
    out = out.join(_first_text(triples, SKOS + "definition", RDFS + "comment", "comments"), k, "left").join(concept_type(triples), k, "left")
    none = F.lit(None).cast("string")
    comment = F.when(F.col("comments").isNotNull(), pick_label(F.col("comments"), none))
    label = F.coalesce(pick_label(F.col("labels"), F.col("subject")), pick_label(F.create_map().cast("map<string,string>"), F.col("subject")))
    return out.select(F.col("subject").alias("iri"), "context", label.alias("label"), comment.alias("comment"), "concept_type", source_context(F.col("context")).alias("source_context"))


def related(triples: DataFrame) -> DataFrame:
    return triples.filter(F.col("predicate") == SKOS + "related").select(F.col("subject").alias("iri"), F.col("object").alias("related_iri")).distinct()


def equivalent_parents(triples: DataFrame, max_length: int | None = None) -> DataFrame:
    """(child, parent) implied by ``A equivalentClass [intersectionOf (B C ...)]``: lists walked in rounds, cycles cut."""
    pick = lambda pred, a, b: triples.filter(F.col("predicate") == pred).select(F.col("subject").alias(a), F.col("object").alias(b)).distinct()
    heads = pick(OWL + "equivalentClass", "child", "node").join(pick(OWL + "intersectionOf", "node", "head"), "node").select("child", "head").distinct()
    rest = pick(RDF + "rest", "src", "dst").filter(F.col("dst") != RDF + "nil")
    cells = reach(rest, heads.select(F.col("head").alias("root")), max_length).select(F.col("root").alias("head"), F.col("node").alias("cell")).distinct()
    members = heads.join(cells, "head").join(pick(RDF + "first", "cell", "parent"), "cell")
    keep = ~_is_blank(F.col("parent")) & ~F.col("parent").startswith("http://www.w3.org/")
    return members.filter(keep).select("child", "parent").distinct()


def parents(triples: DataFrame, with_equivalent: bool = True) -> DataFrame:
    """Distinct (child, parent): subclass, subproperty, broader, custom types and intersection members."""
    p, o = F.col("predicate"), F.col("object")
    named = p.isin(*CONCEPT_EDGES) & ~_is_blank(o)
    custom = (p == TYPE) & ~_in_vocabulary(o)
    out = triples.filter(named | custom | (p == SKOS + "broader")).select(F.col("subject").alias("child"), o.alias("parent"))
    return (out.unionByName(equivalent_parents(triples)) if with_equivalent else out).distinct()


def children(parent_rows: DataFrame) -> DataFrame:
    return parent_rows.select("parent", "child").distinct()


def inferred_links(triples: DataFrame, iri: str) -> DataFrame:
    """Governed entities typed with ``iri``: (entity_type, entity_id, label)."""
    pat = f"^{GOV}([^:]+):(.+)$"
    s = F.col("subject")
    typed = triples.filter((F.col("predicate") == TYPE) & (F.col("object") == iri) & s.rlike(pat)).select("subject").distinct()
    labels = triples.filter(F.col("predicate") == RDFS + "label").groupBy("subject").agg(F.min("object").alias("label"))
    return typed.join(labels, "subject", "left").select(F.regexp_extract(s, pat, 1).alias("entity_type"), F.regexp_extract(s, pat, 2).alias("entity_id"), "label")


# ---- statistics and groups --------------------------------------------------------------------------------------------


def taxonomy_stats(triples: DataFrame) -> DataFrame:
    """Distinct concepts and rdf:Property subjects per named graph.

    Besides the typed subjects, a concept is any non-basic type of an instance, and anything with both a label and a
    comment.
    """
    p, o, s = F.col("predicate"), F.col("object"), F.col("subject")
    basic = (RDFS + "Class", SKOS + "Concept", SKOS + "ConceptScheme", OWL + "Class")
    not_types = (RDFS + "Class", SKOS + "Concept", RDF + "Property", OWL + "Class")
    subj = triples.filter(((p == TYPE) & o.isin(*basic)) | (p == RDFS + "subClassOf")).select("context", s.alias("concept"))
    types = triples.filter((p == TYPE) & ~o.isin(*not_types)).select("context", o.alias("concept"))
    both = triples.filter(p.isin(RDFS + "label", RDFS + "comment")).groupBy("context", "subject").agg(F.countDistinct("predicate").alias("n")).filter("n = 2")
    found = reduce(DataFrame.unionByName, [subj, types, both.select("context", s.alias("concept"))])
    c = F.col("concept")
    found = found.filter(~_is_blank(c) & ~_in_vocabulary(c)).distinct().groupBy("context").agg(F.count(F.lit(1)).alias("concepts_count"))
    props = triples.filter((p == TYPE) & (o == RDF + "Property")).groupBy("context").agg(F.countDistinct("subject").alias("properties_count"))
    graphs = triples.select("context").distinct()
    return graphs.join(found, "context", "left").join(props, "context", "left").fillna(0, ["concepts_count", "properties_count"])


def concept_totals(concept_rows: DataFrame, parent_rows: DataFrame) -> DataFrame:
    """Concepts per type, and how many of them have no parent."""
    has = parent_rows.select(F.col("child").alias("iri")).distinct().withColumn("has_parent", F.lit(True))
    return concept_rows.join(has, "iri", "left").groupBy("concept_type").agg(F.count(F.lit(1)).alias("concepts"), F.count_if(F.col("has_parent").isNull()).alias("top_level"))


def grouped_concepts(concept_rows: DataFrame) -> DataFrame:
    """Concepts under their source context, by label, as rows: a large group never becomes one array."""
    group = F.coalesce("source_context", F.lit("Unassigned"))
    return concept_rows.select(group.alias("group_name"), "iri", "label", "concept_type").orderBy("group_name", F.coalesce("label", "iri"), "iri")


def grouped_properties(triples: DataFrame) -> DataFrame:
    """Object, datatype and annotation properties with label, domain and range, per source context, as rows."""
    kinds = {OWL + "ObjectProperty": "object", OWL + "DatatypeProperty": "datatype", OWL + "AnnotationProperty": "annotation"}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("object")]
    props = triples.filter((F.col("predicate") == TYPE) & F.col("object").isin(list(kinds))).select("subject", "context", kind.alias("property_type")).distinct()
    value = lambda pred, name: F.min(F.when(F.col("predicate") == pred, F.col("object"))).alias(name)
    facts = triples.filter(F.col("predicate").isin(RDFS + "label", RDFS + "domain", RDFS + "range")).groupBy("subject", "context").agg(
        value(RDFS + "label", "label"), value(RDFS + "domain", "domain"), value(RDFS + "range", "range"))
    out = props.join(facts, ["subject", "context"], "left")
    return out.select(
        F.coalesce(source_context(F.col("context")), F.lit("Unassigned")).alias("group_name"), F.col("subject").alias("iri"), "property_type",
        F.coalesce("label", local_name(F.col("subject"))).alias("label"), "domain", "range").orderBy("group_name", "label", "iri")


def collections(triples: DataFrame, concept_rows: DataFrame) -> DataFrame:
    """Knowledge collections with scope, parent and the number of concepts in their graph."""
    meta = triples.filter(F.col("context") == META_CONTEXT)
    iris = meta.filter((F.col("predicate") == TYPE) & (F.col("object") == GOV + "KnowledgeCollection")).select("subject").distinct()
    value = lambda pred, name: F.min(F.when(F.col("predicate") == pred, F.col("object"))).alias(name)
    facts = meta.join(iris, "subject", "left_semi").groupBy("subject").agg(
        value(RDFS + "label", "label"), value(GOV + "scopeLevel", "scope_level"), value(GOV + "parentCollection", "parent_iri"), value(GOV + "isEditable", "editable"))
    counts = concept_rows.groupBy("source_context").agg(F.countDistinct("iri").alias("concept_count"))
    suffix = F.substring_index("subject", ":", -1)
    out = facts.withColumn("source_context", suffix).join(counts, "source_context", "left")
    return out.select(
        F.col("subject").alias("iri"), F.coalesce("label", "source_context").alias("label"), F.coalesce("scope_level", F.lit("enterprise")).alias("scope_level"),
        "parent_iri", F.coalesce(F.lower("editable").isin("true", "1"), F.lit(False)).alias("is_editable"), F.coalesce("concept_count", F.lit(0)).alias("concept_count"))


def collection_paths(collection_rows: DataFrame) -> DataFrame:
    """(iri, ancestor, depth): the chain above every collection; the root has the largest depth."""
    rows = cut_lineage(collection_rows.select("iri", "parent_iri"))
    steps = rows.filter("parent_iri IS NOT NULL").select(F.col("iri").alias("src"), F.col("parent_iri").alias("dst")).distinct()
    return reach(steps, rows.select(F.col("iri").alias("root"))).select(F.col("root").alias("iri"), F.col("node").alias("ancestor"), "depth")


def collection_tree(paths: DataFrame) -> DataFrame:
    """Root-first path text per collection; a chain is as long as the tree is deep, so its array stays small."""
    chain = F.reverse(F.array_sort(F.collect_list(F.struct("depth", "ancestor"))))
    return paths.groupBy("iri").agg(chain.alias("c")).select("iri", F.array_join(F.transform("c", lambda x: x["ancestor"]), " > ").alias("path"), (F.size("c") - 1).alias("level"))


# ---- search ---------------------------------------------------------------------------------------------------------


def prefix_search(triples: DataFrame, q: str, limit: int | None = None) -> DataFrame:
    """Distinct subjects and predicates that contain the text, as resource or property."""
    want = q.lower()
    res = triples.select(F.col("subject").alias("value"), F.lit("resource").alias("kind"))
    pred = triples.select(F.col("predicate").alias("value"), F.lit("property").alias("kind"))
    return _head(res.unionByName(pred).filter(F.lower("value").contains(want)).distinct(), limit, "value", "kind")


# Types that the concept and property searches offer.
SEARCH_CLASS_TYPES = (RDFS + "Class", OWL + "Class", SKOS + "Concept", SKOS + "ConceptScheme")
SEARCH_PROPERTY_TYPES = (RDF + "Property", OWL + "ObjectProperty", OWL + "DatatypeProperty", OWL + "AnnotationProperty")


def _search(triples: DataFrame, types, edge: str, q: str, limit: int | None) -> DataFrame:
    subj = _typed(triples, types, (edge,)).select("subject").distinct()
    labels = triples.filter(F.col("predicate").isin(RDFS + "label", SKOS + "prefLabel")).groupBy("subject").agg(F.min("object").alias("label"))
    out = subj.join(labels, "subject", "left").filter(~_is_blank(F.col("subject")))
    if q:
        want = q.lower()
        out = out.filter(F.lower("subject").contains(want) | F.coalesce(F.lower("label").contains(want), F.lit(False)))
    return _head(out.select(F.col("subject").alias("iri"), F.coalesce("label", local_name(F.col("subject"))).alias("label")), limit, "iri")


def search_concepts(triples: DataFrame, q: str = "", limit: int | None = None) -> DataFrame:
    return _search(triples, SEARCH_CLASS_TYPES, RDFS + "subClassOf", q, limit)


def search_properties(triples: DataFrame, q: str = "", limit: int | None = None) -> DataFrame:
    return _search(triples, SEARCH_PROPERTY_TYPES, RDFS + "subPropertyOf", q, limit)


def suggest_concepts(triples: DataFrame, parent_rows: DataFrame, q: str, parent_iris: list[str], limit: int | None = None, max_children: int | None = None) -> DataFrame:
    """Children of the nearest given parent that has any, then the other hits."""
    order = F.array_position(F.array(*map(F.lit, parent_iris)), F.col("parent"))
    kids = parent_rows.filter(F.col("parent").isin(parent_iris)).withColumn("near", order)
    nearest = kids.agg(F.min("near")).scalar()
    suggested = _head(kids.filter(F.col("near") == nearest).select(F.col("child").alias("iri")).distinct(), max_children, "iri")
    other = search_concepts(triples, q, limit).select("iri").join(suggested, "iri", "left_anti")
    return suggested.withColumn("section", F.lit("suggested")).unionByName(other.withColumn("section", F.lit("other")))


# ---- moving concepts ----------------------------------------------------------------------------------------------------


def move_concepts(triples: DataFrame, requests: DataFrame, collection_rows: DataFrame, kind: str, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Copies of concepts in other collections: (insert, delete, conflicts) triple frames.

    ``requests``: concept_iri, target_iri; ``kind`` is ``promoted`` or ``migrated``.  A request conflicts when its target is
    unknown or not editable, when the concept has no triples, or when the new IRI is taken.  The copy carries provenance.
    A promoted source becomes deprecated and points to its copy; a migrated draft is deleted, any other is deprecated.
    """
    label = triples.filter(F.col("predicate").isin(RDFS + "label", SKOS + "prefLabel")).groupBy(F.col("subject").alias("concept_iri")).agg(F.min("object").alias("label"))
    home = triples.groupBy(F.col("subject").alias("concept_iri")).agg(
        F.min("context").alias("source_iri"), F.min(F.when(F.col("predicate") == GOV + "status", F.col("object"))).alias("status"))
    name = F.regexp_replace(F.lower(F.coalesce("label", local_name(F.col("concept_iri")))), "[^a-z0-9_-]+", "-")
    req = requests.distinct().join(home, "concept_iri", "left").join(label, "concept_iri", "left")
    req = req.join(collection_rows.select(F.col("iri").alias("target_iri"), "is_editable"), "target_iri", "left")
    req = req.withColumn("new_iri", F.concat_ws("/", "target_iri", name))
    taken = triples.select(F.col("subject").alias("new_iri")).distinct().withColumn("taken", F.lit(True))
    req = req.join(taken, "new_iri", "left")
    reason = (
        F.when(F.col("source_iri").isNull(), "concept not found").when(F.col("is_editable").isNull(), "target not found")
        .when(~F.col("is_editable"), "target not editable").when(F.col("taken"), "already exists")
    )
    req = cut_lineage(req.withColumn("reason", reason))
    conflicts = req.filter("reason IS NOT NULL").select("concept_iri", "target_iri", "reason")
    # two concepts with the same name would land on one IRI: the smaller one is moved, the others conflict
    good = first_per_key(req.filter("reason IS NULL"), ["new_iri"], [F.col("concept_iri")])
    late = req.filter("reason IS NULL").join(good.select("concept_iri", "target_iri"), ["concept_iri", "target_iri"], "left_anti")
    conflicts = conflicts.unionByName(late.select("concept_iri", "target_iri", F.lit("already exists").alias("reason")))
    none = F.lit(None).cast("string")

    def triple(df, subject, predicate, obj, is_uri, context):
        return df.select(subject.alias("subject"), F.lit(predicate).alias("predicate"), obj.alias("object"), F.lit(is_uri).alias("object_is_uri"), none.alias("language"), none.alias("datatype"), context.alias("context"))

    body = triples.join(good.select(F.col("concept_iri").alias("subject"), "new_iri", "target_iri"), "subject").filter(F.col("predicate") != GOV + "status")
    copy = body.select(F.col("new_iri").alias("subject"), "predicate", "object", "object_is_uri", "language", "datatype", F.col("target_iri").alias("context"))
    new, target, old, home_c = F.col("new_iri"), F.col("target_iri"), F.col("concept_iri"), F.col("source_iri")
    inserts = [
        copy, triple(good, new, GOV + "status", F.lit("draft"), False, target), triple(good, new, GOV + "sourceConceptIri", old, True, target),
        triple(good, new, GOV + "sourceCollectionIri", home_c, True, target), triple(good, new, GOV + "promotionType", F.lit(kind), False, target),
        triple(good, new, GOV + "promotedAt", F.lit(at), False, target),
    ]
    draft = F.coalesce("status", F.lit("draft")) == "draft"
    stays = good.filter(~draft) if kind == "migrated" else good
    inserts.append(triple(stays, old, GOV + "status", F.lit("deprecated"), False, home_c))
    if kind == "promoted":
        inserts.append(triple(stays, old, RDFS + "seeAlso", new, True, home_c))
    # an inner join: a semi join would be done once for each frame that the triples are a union of, all of them in the same tasks
    leaving = good.select(F.col("concept_iri").alias("subject"), (draft if kind == "migrated" else F.lit(False)).alias("gone")).distinct()
    deletes = triples.join(leaving, "subject").filter(F.col("gone") | (F.col("predicate") == GOV + "status")).select(*COLUMNS)
    return reduce(DataFrame.unionByName, inserts).distinct(), deletes.distinct(), conflicts


# ---- ontology schema ------------------------------------------------------------------------------------------------


def hierarchy_paths(triples: DataFrame) -> DataFrame:
    """(source_type, relationship, target_type, label, inverse_label) of the hierarchical object properties."""
    pick = lambda pred, name: triples.filter(F.col("predicate") == pred).select("subject", F.col("object").alias(name)).distinct()
    one = lambda pred, name: pick(pred, name).groupBy("subject").agg(F.min(name).alias(name))
    props = triples.filter((F.col("predicate") == TYPE) & (F.col("object") == OWL + "ObjectProperty")).select("subject").distinct()
    hier = one(GOV + "isHierarchical", "flag").filter(F.lower("flag").isin("true", "1")).select("subject")
    out = props.join(hier, "subject", "left_semi").join(pick(RDFS + "domain", "dom"), "subject").join(pick(RDFS + "range", "rng"), "subject")
    out = out.join(one(GOV + "uiLabel", "ui"), "subject", "left").join(one(GOV + "inverseLabel", "inverse_label"), "subject", "left")
    name = local_name(F.col("subject"))
    return out.select(local_name(F.col("dom")).alias("source_type"), name.alias("relationship"), local_name(F.col("rng")).alias("target_type"), F.coalesce("ui", name).alias("label"), "inverse_label")


# Property characteristics and restriction facets.
CHARACTERISTICS = {
    OWL + "FunctionalProperty": "functional", OWL + "InverseFunctionalProperty": "inverseFunctional", OWL + "TransitiveProperty": "transitive",
    OWL + "SymmetricProperty": "symmetric", OWL + "AsymmetricProperty": "asymmetric", OWL + "ReflexiveProperty": "reflexive", OWL + "IrreflexiveProperty": "irreflexive",
}
RESTRICTIONS = {
    OWL + "minCardinality": "minCardinality", OWL + "maxCardinality": "maxCardinality", OWL + "cardinality": "exactCardinality",
    OWL + "allValuesFrom": "allValuesFrom", OWL + "someValuesFrom": "someValuesFrom", OWL + "hasValue": "hasValue",
}


def _names(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def constraints(triples: DataFrame) -> DataFrame:
    """Property characteristics and class restrictions as (constraint_type, property_iri, class_iri, value) rows."""
    p, o = F.col("predicate"), F.col("object")
    none = F.lit(None).cast("string")
    chars = triples.filter((p == TYPE) & o.isin(list(CHARACTERISTICS)) & ~_is_blank(F.col("subject"))).select(
        _names(CHARACTERISTICS, o).alias("constraint_type"), F.col("subject").alias("property_iri"), none.alias("class_iri"), none.alias("value")).distinct()
    typed = lambda t, name: triples.filter((p == TYPE) & (o == t)).select(F.col("subject").alias(name)).distinct()
    classes = typed(OWL + "Class", "class_iri").filter(~_is_blank(F.col("class_iri")))
    nodes = triples.filter(p == RDFS + "subClassOf").select(F.col("subject").alias("class_iri"), o.alias("node")).distinct()
    nodes = nodes.join(classes, "class_iri", "left_semi").join(typed(OWL + "Restriction", "node"), "node", "left_semi")
    on = triples.filter(p == OWL + "onProperty").groupBy(F.col("subject").alias("node")).agg(F.min("object").alias("property_iri"))
    facets = triples.filter(p.isin(list(RESTRICTIONS))).select(F.col("subject").alias("node"), _names(RESTRICTIONS, p).alias("constraint_type"), o.alias("value")).distinct()
    facets = facets.filter(~(F.col("constraint_type").endswith("ValuesFrom") & _is_blank(F.col("value"))))
    rows = nodes.join(on, "node").join(facets, "node").select("constraint_type", "property_iri", "class_iri", "value")
    return chars.unionByName(rows.distinct())


def shape_checks(triples: DataFrame, shapes: DataFrame) -> DataFrame:
    """Violations of shapes: (shape, focus, violation, value).

    ``shapes``: shape, target_class, path, min_count, pattern, min_inclusive, max_inclusive.  Values are counted per (focus,
    path) before they meet the shapes, and only along their paths; value tests are row filters after an inner join, which can split a hot focus.
    """
    focus = triples.filter(F.col("predicate") == TYPE).select(F.col("subject").alias("focus"), F.col("object").alias("target_class")).distinct()
    wanted = focus.join(shapes, "target_class")
    values = triples.select(F.col("subject").alias("focus"), F.col("predicate").alias("path"), F.col("object").alias("value"))
    values = values.join(F.broadcast(shapes.select("path").distinct()), "path")  # predicates that definitions name: few
    sizes = values.groupBy("focus", "path").agg(F.count("value").alias("n"))
    counts = wanted.join(sizes, ["focus", "path"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    few = counts.filter(F.col("n") < F.col("min_count")).select("shape", "focus", F.lit("min_count").alias("violation"), F.col("n").cast("string").alias("value"))
    both = wanted.join(values, ["path", "focus"])  # the other way round than the counts: a union of frames spread alike is worked by the same tasks
    number = F.col("value").try_cast("double")
    bad = F.array(
        F.when(F.coalesce(~F.regexp_like("value", F.col("pattern")), F.lit(False)), "pattern"),
        F.when(F.col("min_inclusive").isNotNull() & F.coalesce(number < F.col("min_inclusive"), F.lit(True)), "min_inclusive"),
        F.when(F.col("max_inclusive").isNotNull() & F.coalesce(number > F.col("max_inclusive"), F.lit(True)), "max_inclusive"),
    )
    rows = both.filter("value IS NOT NULL").select("shape", "focus", F.explode(F.filter(bad, lambda b: b.isNotNull())).alias("violation"), "value")
    return few.unionByName(rows)
