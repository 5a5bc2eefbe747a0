"""The memory layer: closed-world validation, audit, aliases and automatic idents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.retrieval import MEMORY_PREFIXES

#: Entity type, attribute, whether it is required, type.
SCHEMA = (
    ("decision", ":description", True, "str"),
    ("decision", ":rationale", False, "str"),
    ("decision", ":date", False, "str"),
    ("decision", ":alias", False, "str"),
    ("preference", ":description", True, "str"),
    ("preference", ":rationale", False, "str"),
    ("preference", ":alias", False, "str"),
    ("constraint", ":description", True, "str"),
    ("constraint", ":rationale", False, "str"),
    ("constraint", ":alias", False, "str"),
    ("dependency", ":description", True, "str"),
    ("dependency", ":rationale", False, "str"),
    ("dependency", ":alias", False, "str"),
    ("module", ":description", True, "str"),
    ("module", ":path", False, "str"),
    ("module", ":alias", False, "str"),
    ("module", ":contains", False, "str"),
    ("module", ":depends-on", False, "str"),
    ("module", ":calls", False, "str"),
    ("module", ":introduced-by", False, "str"),
    ("module", ":modified-in", False, "str"),
    ("module", ":renamed-from", False, "str"),
    ("module", ":renamed-to", False, "str"),
    ("function", ":description", True, "str"),
    ("function", ":file", False, "str"),
    ("function", ":alias", False, "str"),
    ("function", ":introduced-by", False, "str"),
    ("function", ":modified-in", False, "str"),
    ("function", ":renamed-from", False, "str"),
    ("function", ":renamed-to", False, "str"),
    ("class", ":description", True, "str"),
    ("class", ":file", False, "str"),
    ("class", ":alias", False, "str"),
    ("class", ":introduced-by", False, "str"),
    ("class", ":modified-in", False, "str"),
    ("class", ":renamed-from", False, "str"),
    ("class", ":renamed-to", False, "str"),
    ("variable", ":description", True, "str"),
    ("variable", ":file", False, "str"),
    ("variable", ":alias", False, "str"),
    ("variable", ":introduced-by", False, "str"),
    ("variable", ":modified-in", False, "str"),
    ("variable", ":renamed-from", False, "str"),
    ("variable", ":renamed-to", False, "str"),
    ("field", ":description", True, "str"),
    ("field", ":file", False, "str"),
    ("field", ":alias", False, "str"),
    ("field", ":class", False, "str"),
    ("field", ":static", False, "bool"),
    ("field", ":introduced-by", False, "str"),
    ("field", ":modified-in", False, "str"),
    ("field", ":renamed-from", False, "str"),
    ("field", ":renamed-to", False, "str"),
    ("ingestion", ":description", True, "str"),
    ("ingestion", ":hash", False, "str"),
    ("ingestion", ":alias", False, "str"),
    ("ingestion", ":last-run-at", False, "str"),
    ("ingestion", ":last-commit", False, "str"),
    ("ingestion", ":total-ingested", False, "str"),
    ("ingestion", ":version", False, "str"),
)


def schema_table(spark: SparkSession) -> DataFrame:
    """(entity_type, attribute, required, wants): a fixed, small table."""
    return spark.createDataFrame(SCHEMA, "entity_type string, attribute string, required boolean, wants string")


def validate(facts: DataFrame) -> DataFrame:
    """``facts``: (entity, entity_type, attribute, v_type, value). Rows (entity, kind, attribute), one a violation.

    An unknown type is all that is said of its entity. The schema is a fixed table, so its joins broadcast;
    entities meet their missing attributes through it, without a product.
    """
    schema = F.broadcast(schema_table(facts.sparkSession))
    types = schema.select("entity_type").distinct()
    entity_types = facts.groupBy("entity").agg(F.max(F.when(F.col("entity_type") != "", F.col("entity_type"))).alias("entity_type"))
    entity_types = entity_types.withColumn("entity_type", F.coalesce("entity_type", F.lit("")))
    unknown = entity_types.join(F.broadcast(types), "entity_type", "left_anti").select("entity", F.lit("unknown_type").alias("kind"), F.lit("").alias("attribute"))
    attrs = facts.select("entity", "attribute", "v_type").distinct().join(entity_types, "entity").join(F.broadcast(types), "entity_type", "left_semi")
    judged = attrs.join(schema, ["entity_type", "attribute"], "left")
    attribute = judged.filter("wants IS NULL").select("entity", F.lit("unknown_attribute").alias("kind"), "attribute")
    wrong = judged.filter("wants IS NOT NULL AND v_type <> wants AND NOT (wants = 'str' AND v_type = 'ref')").select("entity", F.lit("wrong_type").alias("kind"), "attribute")
    needed = entity_types.join(schema.filter("required"), "entity_type").select("entity", "attribute")
    missing = needed.join(facts.select("entity", "attribute").distinct(), ["entity", "attribute"], "left_anti").select("entity", F.lit("missing_required").alias("kind"), "attribute")
    return unknown.union(attribute).union(wrong).union(missing)


def audit(facts: DataFrame) -> DataFrame:
    """(kind, violations, entities, facts_to_retract) of a snapshot; a current audit then retracts those entities' facts."""
    v = validate(facts)
    per = facts.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return v.groupBy("kind", "entity").agg(F.count(F.lit(1)).alias("k")).join(per, "entity").groupBy("kind").agg(F.sum("k").alias("violations"), F.count(F.lit(1)).alias("entities"), F.sum("n").alias("facts_to_retract"))


def subjects(facts: DataFrame) -> DataFrame:
    """A snapshot of the fact table as (entity, entity_type, attribute, v_type, value) of entities that are audited: internal
    type tags and idents are not subject to the schema, and neither are types kept by the system alone."""
    kind = F.regexp_extract("e", "^:([^/]+)/", 1)
    known = facts.sparkSession.createDataFrame([(t,) for t in sorted({r[0] for r in SCHEMA})], "entity_type string")
    rows = facts.filter(~F.col("a").isin(":entity-type", ":ident")).select(F.col("e").alias("entity"), kind.alias("entity_type"), F.col("a").alias("attribute"), "v_type", F.col("v").alias("value"))
    return rows.join(F.broadcast(known), "entity_type", "left_semi").select("entity", "entity_type", "attribute", "v_type", "value")


def retractions(facts: DataFrame) -> DataFrame:
    """(e, a, v) that a current audit retracts from a snapshot: all facts of entities with a violation."""
    bad = validate(subjects(facts)).select(F.col("entity").alias("e")).distinct()
    return facts.join(bad, "e", "left_semi").select("e", "a", "v")


def violators(facts: DataFrame) -> DataFrame:
    """The facts of ``facts`` (entity, …) whose entity violates the schema."""
    return facts.join(validate(facts).select("entity").distinct(), "entity", "left_semi")


def is_memory(entity: Column) -> Column:
    return reduce(lambda a, b: a | b, [entity.startswith(p) for p in MEMORY_PREFIXES])


def resolve_alias(names: DataFrame, facts: DataFrame) -> DataFrame:
    """(name, entity) by ``:ident`` or ``:alias``; each match once."""
    known = facts.filter(F.col("a").isin(":ident", ":alias")).select(F.col("v").alias("name"), F.col("e").alias("entity"))
    return names.join(known, "name").select("name", "entity").distinct()


def auto_ident(written: DataFrame, facts: DataFrame) -> DataFrame:
    """``:ident`` facts for memory entities among the written ones that have none yet."""
    have = facts.filter(F.col("a") == ":ident").select("e")
    new = written.select("e").distinct().filter(is_memory(F.col("e"))).join(have, "e", "left_anti")
    return new.select("e", F.lit(":ident").alias("a"), F.col("e").alias("v"))


def canonical_entities(facts: DataFrame, limit: int = 50) -> DataFrame:
    """Known memory entities with their descriptions for a prompt, at most ``limit``, in order."""
    d = facts.filter((F.col("a") == ":description") & is_memory(F.col("e")))
    return d.groupBy(F.col("e").alias("entity")).agg(F.min("v").alias("description")).orderBy("entity").limit(limit)
