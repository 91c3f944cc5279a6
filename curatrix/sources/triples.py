"""Triples: reading N-Triples text, idempotent loading, active graphs, governed entities as triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.operators.skew import spread_by_rows

# Public vocabulary terms.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
VOCABULARIES = (RDF, RDFS, SKOS, OWL)
# The application's own namespace.
GOV = "urn:gov:"
BNODE = GOV + "bnode:"
META_CONTEXT = "urn:meta:sources"
APP_CONTEXT = "urn:app-entities"
LINK_CONTEXT = "urn:semantic-links"

COLUMNS = ("subject", "predicate", "object", "object_is_uri", "language", "datatype", "context")

_TERM = r'(<[^>]*>|_:\S+)'
_LINE = r'^\s*' + _TERM + r'\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'


# Letters after a backslash.
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_ESCAPE = r"\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)"


def unescaped(body: Column) -> Column:
    """Escapes decoded in one pass from left to right, so that an escaped backslash never starts another escape."""
    short = F.create_map(*[F.lit(x) for kv in ESCAPES.items() for x in kv])

    def one(mark: Column) -> Column:
        letter = F.substring(mark, 2, 1)
        code = F.conv(F.substr(mark, F.lit(3)), 16, 10).cast("int")
        point = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(letter.isin("u", "U") & (F.length(mark) > 2), point).otherwise(F.coalesce(F.try_element_at(short, letter), mark))

    marks = F.transform(F.regexp_extract_all(body, F.lit("(?s)" + _ESCAPE), F.lit(0)), one)
    plain = F.split(body, "(?s)" + _ESCAPE, -1)
    return F.when(body.contains("\\"), F.array_join(F.flatten(F.zip_with(plain, marks, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")).otherwise(body)


def parse_ntriples(lines: DataFrame, context: str, value: str = "value") -> DataFrame:
    """N-Triples lines as triples; blank nodes become IRIs that are unique to the context.

    Blank lines and comments hold nothing; other lines that are no triple are listed by ``rejected_ntriples``.
    """
    text = F.col(value)
    s, p, o = (F.regexp_extract(text, _LINE, i) for i in (1, 2, 3))
    resource = lambda t: F.when(t.startswith("_:"), F.concat(F.lit(f"{BNODE}{context}:"), F.substr(t, F.lit(3)))).otherwise(F.regexp_extract(t, "^<(.*)>$", 1))
    is_uri = ~o.startswith('"')
    body = F.regexp_extract(o, r'^"((?:[^"\\]|\\.)*)"', 1)
    plain = unescaped(body)
    tail = lambda pat: F.nullif(F.regexp_extract(o, pat, 1), F.lit(""))
    return lines.filter(text.rlike(_LINE)).select(
        resource(s).alias("subject"), p.alias("predicate"), F.when(is_uri, resource(o)).otherwise(plain).alias("object"), is_uri.alias("object_is_uri"),
        F.when(~is_uri, tail(r'"@([A-Za-z0-9-]+)$')).alias("language"), F.when(~is_uri, tail(r'"\^\^<([^>]*)>$')).alias("datatype"), F.lit(context).alias("context"))


def rejected_ntriples(lines: DataFrame, value: str = "value") -> DataFrame:
    """The lines that ``parse_ntriples`` could not read, without blank lines and comments."""
    text = F.coalesce(F.col(value), F.lit(""))
    return lines.filter(~text.rlike(_LINE) & ~text.rlike(r"^\s*(#.*)?$"))


def read_ntriples(spark, path: str, context: str) -> DataFrame:
    return parse_ntriples(spark.read.text(path), context)


def new_triples(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming triples that are not stored yet, once each; NULLs compare as equal."""
    key = list(COLUMNS)
    a, b = incoming.select(*key).dropDuplicates(key).alias("a"), existing.select(*key).alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key])
    return a.join(b, same, "left_anti")


def load_triples(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return existing.select(*COLUMNS).unionByName(new_triples(existing, incoming))


def active_triples(triples: DataFrame, disabled_contexts: DataFrame, links: DataFrame) -> DataFrame:
    """Triples outside disabled graphs, plus one assignment triple per semantic link.

    ``disabled_contexts``: context.  ``links``: entity_type, entity_id, iri.
    """
    kept = triples.select(*COLUMNS).join(disabled_contexts.select("context").distinct(), "context", "left_anti").select(*COLUMNS)
    none = F.lit(None).cast("string")
    assigned = links.select(
        F.concat(F.lit(GOV), F.concat_ws(":", "entity_type", F.col("entity_id").cast("string"))).alias("subject"), F.lit(GOV + "semanticAssignment").alias("predicate"),
        F.col("iri").alias("object"), F.lit(True).alias("object_is_uri"), none.alias("language"), none.alias("datatype"), F.lit(LINK_CONTEXT).alias("context"))
    return spread_by_rows(kept.unionByName(assigned), list(COLUMNS)).dropDuplicates(list(COLUMNS))


def entities_to_triples(domains: DataFrame, products: DataFrame, contracts: DataFrame, contract_type: str) -> DataFrame:
    """Type triples (two for contracts) and a label triple where a name exists; frames hold id, name."""
    none = F.lit(None).cast("string")

    def rows(df, kind, extra=()):
        subject = F.concat(F.lit(f"{GOV}{kind}:"), F.col("id").cast("string"))
        typed = [F.struct(F.lit(RDF + "type").alias("p"), F.lit(t).alias("o"), F.lit(True).alias("u")) for t in (f"{GOV}entity-type:{kind}", *extra)]
        label = F.when(F.length("name") > 0, F.struct(F.lit(RDFS + "label").alias("p"), F.col("name").alias("o"), F.lit(False).alias("u")))
        packed = F.filter(F.array(*typed, label), lambda x: x.isNotNull())
        return df.select(subject.alias("subject"), F.explode(packed).alias("t")).select(
            "subject", F.col("t.p").alias("predicate"), F.col("t.o").alias("object"), F.col("t.u").alias("object_is_uri"), none.alias("language"), none.alias("datatype"), F.lit(APP_CONTEXT).alias("context"))

    return reduce(DataFrame.unionByName, [rows(domains, "data_domain"), rows(products, "data_product"), rows(contracts, "data_contract", (contract_type,))])
