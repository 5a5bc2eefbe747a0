"""Entity idents: slugs, collision scoring and name-based UUIDs, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name -> (underscores stay, runs of hyphens collapse).
SLUGS = {"old": (False, True), "R1": (True, True), "R2": (False, False), "R3": (True, False)}


def slug(value: Column, rule: str = "R3") -> Column:
    keep, collapse = SLUGS[rule]
    s = F.regexp_replace(F.lower(value), "[^a-z0-9_-]" if keep else "[^a-z0-9-]", "-")
    if collapse:
        s = F.regexp_replace(s, "-+", "-")
    return F.btrim(s, F.lit("-"))


def canonical_ident(entity_type: Column, value: Column) -> Column:
    return F.concat(F.lit(":"), entity_type, F.lit("/"), slug(value))


def raw_value(path: Column, name: Column) -> Column:
    """What an entity's ident is made of: its path, and ``::`` and its name if it has one."""
    return F.when(name.isNull(), path).otherwise(F.concat(path, F.lit("::"), name))


def code_ident(entity_type: Column, path: Column, name: Column) -> Column:
    return canonical_ident(entity_type, raw_value(path, name))


def commit_ident(commit: Column) -> Column:
    return F.concat(F.lit(":commit/"), F.substring(commit, 1, 12))


def _flat(entity: Column) -> Column:
    return F.replace(F.regexp_replace(entity, "^:+", ""), F.lit("/"), F.lit("-"))


def marker_ident(entity: Column) -> Column:
    """The companion that says an entity's introduction is provisional."""
    return F.concat(F.lit(":lineage/"), _flat(entity))


def candidate_ident(commit: Column, entity: Column) -> Column:
    return F.concat(F.lit(":candidate/"), F.substring(commit, 1, 12), F.lit("-"), _flat(entity))


def keyword_uuid(keyword: Column) -> Column:
    """uuid5 in the OID namespace: sha1 of the namespace's bytes and the keyword, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8129dad11d180b400c04fd430c8")), keyword.cast("binary")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), F.conv(part(17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def rule_idents(entity_type: Column, path: Column, name: Column) -> dict[str, Column]:
    """The ident of an entity under the old slug and under each candidate rule."""
    raw = raw_value(path, name)
    prefix = F.concat(F.lit(":"), entity_type, F.lit("/"))
    out = {r: F.concat(prefix, slug(raw, r)) for r in SLUGS}
    out["R4"] = F.concat(prefix, slug(raw, "old"), F.lit("-"), F.substring(F.sha2(raw.cast("binary"), 256), 1, 8))
    out["R5"] = F.concat(prefix, slug(path, "old"), F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("--"), slug(name, "old"))))
    return out


def collisions(inputs: DataFrame) -> DataFrame:
    """(ident, n) of old idents that more than one distinct input (entity_type, producer, file_path, name) has."""
    old = rule_idents(F.col("entity_type"), F.col("file_path"), F.col("name"))["old"]
    distinct = inputs.select(old.alias("ident"), "producer", "file_path", F.coalesce("name", F.lit("\x00")).alias("name")).distinct()
    return distinct.groupBy("ident").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def score_rules(inputs: DataFrame) -> DataFrame:
    """(rule, entity_type, residual, renames, total): collisions a rule leaves, and old idents it renames."""
    ids = rule_idents(F.col("entity_type"), F.col("file_path"), F.col("name"))
    rules = [r for r in ids if r != "old"]
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), ids[r].alias("new")) for r in rules]))
    rows = inputs.select("entity_type", "producer", "file_path", "name").distinct().select("entity_type", ids["old"].alias("old"), each.alias("x")).select("entity_type", "old", "x.rule", "x.new")
    residual = rows.groupBy("rule", "entity_type", "new").agg(F.count(F.lit(1)).alias("n")).groupBy("rule", "entity_type").agg(F.sum((F.col("n") > 1).cast("long")).alias("residual"))
    renamed = rows.groupBy("rule", "entity_type", "old").agg(F.max((F.col("new") != F.col("old")).cast("long")).alias("renamed")).groupBy("rule", "entity_type").agg(F.sum("renamed").alias("renames"), F.count(F.lit(1)).alias("total"))
    return residual.join(renamed, ["rule", "entity_type"])


def strip_private(name: Column) -> Column:
    """Drops the leading underscores of the last dotted part."""
    return F.regexp_replace(F.coalesce(name, F.lit("")), "(^|\\.)_+([^.]*)$", "$1$2")


def collision_shapes(inputs: DataFrame) -> DataFrame:
    """(ident, shapes): the families that the inputs of a colliding old ident belong to, as a sorted array.

    Pairs are made only inside colliding idents. ``other`` marks idents that nothing but the producer explains.
    """
    old = rule_idents(F.col("entity_type"), F.col("file_path"), F.col("name"))["old"]
    rows = inputs.select("entity_type", "producer", "file_path", "name").distinct().withColumn("ident", old)
    rows = rows.withColumns({"raw": raw_value(F.col("file_path"), F.col("name")), "key": F.xxhash64("producer", "file_path", "name")})
    hit = rows.groupBy("ident").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("ident")
    rows = rows.join(hit, "ident", "left_semi")
    a, b = rows.alias("a"), rows.alias("b")
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))

    def segment(named: str, other: str) -> Column:
        stem = F.regexp_replace(F.lower(F.col(f"{other}.file_path")), "\\.[^./]+$", "")
        name = low(F.col(f"{named}.name"))
        return (name != "") & ((stem == name) | stem.endswith(F.concat(F.lit("/"), name)))

    shapes = {
        "cross-producer": F.col("a.producer") != F.col("b.producer"),
        "case-only": (F.col("a.raw") != F.col("b.raw")) & (F.lower("a.raw") == F.lower("b.raw")),
        "leading-underscore": (low(F.col("a.name")) != low(F.col("b.name"))) & (F.col("a.file_path") == F.col("b.file_path")) & (F.lower(strip_private(F.col("a.name"))) == F.lower(strip_private(F.col("b.name")))),
        "separator-vs-path": segment("a", "b") | segment("b", "a"),
    }
    pairs = a.join(b, (F.col("a.ident") == F.col("b.ident")) & (F.col("a.key") < F.col("b.key")))
    seen = pairs.select(F.col("a.ident").alias("ident"), *[c.cast("int").alias(n) for n, c in shapes.items()]).groupBy("ident").agg(*[F.max(f"`{n}`").alias(n) for n in shapes])
    named = [F.when(F.col(f"`{n}`") == 1, F.lit(n)) for n in shapes]
    explained = F.greatest(*[F.col(f"`{n}`") for n in shapes if n != "cross-producer"]) == 1
    return seen.select("ident", F.array_sort(F.array_compact(F.array(*named, F.when(~explained, F.lit("other"))))).alias("shapes"))
