"""Contracts as flat frames (contract, object, property) and from JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions.scalar import parse_options, qualify_name
from curatrix.operators.skew import left_join_parts


def load_contracts(contracts: DataFrame, objects: DataFrame, props: DataFrame, statuses: list[str], catalog: str | None = None, schema: str | None = None) -> DataFrame:
    """Contract x object, with properties where there are any; options parsed, bad JSON giving none.

    Rows stay flat: a contract with very many columns never becomes one nested value.
    """
    wanted = contracts.filter(F.lower("status").isin([s.lower() for s in statuses])).select(F.col("id").alias("contract_id"), F.col("name").alias("contract_name"))
    objs = objects.select("contract_id", F.col("id").alias("object_id"), F.col("name").alias("object_name"), "physical_name")
    cols = props.select("object_id", F.col("name").alias("property_name"), "logical_type", "required", parse_options(F.col("options_json")).alias("options"))
    out = left_join_parts(wanted.join(objs, "contract_id"), cols, ["object_id"])
    return out.withColumn("table_name", qualify_name(F.coalesce("physical_name", "object_name"), catalog, schema))


CONTRACT_JSON = """
id STRING, name STRING, version STRING, status STRING, domain STRING,
schema ARRAY<STRUCT<name: STRING, physicalName: STRING, properties: ARRAY<STRUCT<name: STRING, logicalType: STRING, required: BOOLEAN,
  `unique`: BOOLEAN, logicalTypeOptions: STRUCT<minLength: INT, maxLength: INT, minimum: STRING, maximum: STRING, pattern: STRING>>>>>
"""


def read_contract_json(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Contract documents (one per file, or one per line) under an explicit schema."""
    return spark.read.schema(CONTRACT_JSON).json(path, multiLine=multiline)


def contract_properties(documents: DataFrame) -> DataFrame:
    """One row per declared property; objects without properties give one row with NULLs."""
    objects = documents.select("id", "name", "version", "status", F.explode("schema").alias("o"))
    rows = objects.select(F.col("id").alias("contract_id"), F.col("o.name").alias("object_name"), F.explode_outer("o.properties").alias("p"))
    return rows.select(
        "contract_id", "object_name", F.col("p.name").alias("property_name"), F.col("p.logicalType").alias("logical_type"),
        F.coalesce("p.required", F.lit(False)).alias("required"), F.col("p.logicalTypeOptions.minimum").alias("minimum"), F.col("p.logicalTypeOptions.maxLength").alias("max_length"))
