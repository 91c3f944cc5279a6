"""Column functions: names, tags, versions, months, JSON payloads, masking."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Graph names whose prefix is cut off, and graph families with one label.
CONTEXT_PREFIXES = ("urn:taxonomy:", "urn:semantic-model:", "urn:schema:", "urn:glossary:", "urn:ontology:")
CONTEXT_LABELS = {"urn:demo": "Demo Data", "urn:app-entities": "Application Entities"}


def last_after(c: Column, sep: str) -> Column:
    return F.substring_index(c, sep, -1)


def slugify_iri(c: Column) -> Column:
    """Last path part, last fragment, lower case, other characters to '-', outer '-' trimmed."""
    tail = F.lower(last_after(last_after(c, "/"), "#"))
    return F.regexp_replace(F.regexp_replace(tail, "[^a-z0-9-]", "-"), "^-+|-+$", "")


def sanitize_tag_key(c: Column) -> Column:
    # Fixed value: characters a tag key may not hold.
    bad = ",.:-/`="
    return F.translate(F.trim(c), bad, "_" * len(bad))


def render_template(fmt: str, variables: dict[str, Column]) -> Column:
    """Replace ``{NAME}``; a NULL variable that the template uses makes the result NULL."""
    out = F.lit(fmt)
    for name in re.findall(r"\{(\w+)\}", fmt):
        if name in variables:
            out = F.replace(out, F.lit("{" + name + "}"), variables[name].cast("string"))
    return out


def qualify_name(c: Column, catalog: str | None, schema: str | None) -> Column:
    """One-, two- or three-part names completed with defaults; NULL when a default is missing."""
    n = F.size(F.split(c, r"\."))
    two = F.concat(F.lit(catalog), F.lit("."), c) if catalog else F.lit(None).cast("string")
    one = F.concat(F.lit(f"{catalog}.{schema}."), c) if catalog and schema else F.lit(None).cast("string")
    return F.when(n == 3, c).when(n == 2, two).when(n == 1, one)


def normalize_phone7(c: Column) -> Column:
    return F.right(F.regexp_replace(c, "[^0-9]", ""), F.lit(7))


def normalize_email(c: Column) -> Column:
    return F.lower(F.trim(c))


def phone_e164(c: Column, country_code: str = "1") -> Column:
    """``+`` and the digits; ten-digit numbers get the country code; no digits gives NULL."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(digits) == 10, F.concat(F.lit("+" + country_code), digits)).when(
        F.length(digits) > 0, F.concat(F.lit("+"), digits)
    )


def match_type(confidence: Column) -> Column:
    return F.when(confidence >= 0.95, "exact").when(confidence >= 0.85, "fuzzy").otherwise("probabilistic")


def local_name(iri: Column) -> Column:
    return F.when(iri.contains("#"), last_after(iri, "#")).otherwise(last_after(iri, "/"))


def source_context(graph: Column) -> Column:
    """Readable name of a named graph; NULL when it follows none of the known forms."""
    names = [F.when(graph.startswith(p), F.substring(graph, F.lit(len(p) + 1), F.length(graph))) for p in CONTEXT_PREFIXES]
    names += [F.when(graph.startswith(p), F.lit(label)) for p, label in CONTEXT_LABELS.items()]
    return F.coalesce(*names)


def pick_label(labels: Column, iri: Column) -> Column:
    """``labels`` maps language to text: English first, then no language, then the smallest language, then the IRI's name."""
    keys = F.array_sort(F.map_keys(labels))
    english = F.filter(keys, lambda k: (k == "en") | F.startswith(k, F.lit("en-")))
    return F.coalesce(
        F.try_element_at(labels, F.try_element_at(english, F.lit(1))),
        F.try_element_at(labels, F.lit("")),
        F.try_element_at(labels, F.try_element_at(keys, F.lit(1))),
        last_after(last_after(iri, "#"), "/"),
    )


def next_version(version: Column, bump: Column) -> Column:
    pat = r"^(\d+)\.(\d+)\.(\d+)"
    major, minor, patch = (F.regexp_extract(version, pat, i).try_cast("bigint") for i in (1, 2, 3))
    return (
        F.when(~F.coalesce(version.rlike(pat), F.lit(False)), "1.0.0")
        .when(bump == "major", F.concat_ws(".", major + 1, F.lit("0"), F.lit("0")))
        .when(bump == "minor", F.concat_ws(".", major, minor + 1, F.lit("0")))
        .otherwise(F.concat_ws(".", major, minor, patch + 1))
    )


def parse_lookback(text: Column) -> Column:
    """``6h``, ``30m``, ``2d`` in seconds; a missing number means 1, a missing unit hours."""
    num = F.coalesce(F.regexp_replace(text, "[^0-9]", "").try_cast("bigint"), F.lit(1))
    unit = F.lower(F.regexp_replace(text, "[^A-Za-z]", ""))
    return num * F.when(unit == "m", 60).when(unit == "d", 86400).otherwise(3600)


def month_start(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "month")


def month_end_exclusive(ts: Column) -> Column:
    return F.add_months(month_start(ts), 1)


def logical_type(dtype: Column) -> Column:
    """Physical type text to logical type; the order of the tests matters."""
    t = F.lower(F.trim(dtype))
    return (
        F.when(t.rlike("array.*[<(]"), "array")
        .when(t.rlike("struct|map|object"), "object")
        .when(t.contains("bool"), "boolean")
        .when(t.rlike("date|time"), "date")
        .when(t.rlike("double|float|decimal|numeric"), "number")
        .when(t.contains("int"), "integer")
        .otherwise("string")
    )


def pii_mask(text: Column) -> Column:
    """Hide what follows ``PII:`` on its line and anything shaped like a US social security number."""
    masked = F.regexp_replace(text, r"PII:[^\n]*", "PII: [REDACTED]")
    return F.regexp_replace(masked, r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "XXX-XX-XXXX")


def parse_options(text: Column) -> Column:
    """Property options as a struct; bad JSON gives NULL fields."""
    schema = "minLength INT, maxLength INT, minimum STRING, maximum STRING, pattern STRING"
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def json_field(text: Column, path: str) -> Column:
    return F.get_json_object(text, path)
