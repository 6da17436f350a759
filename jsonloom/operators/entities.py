"""Entities in documents: objects that carry a name, id, title, key, uuid or email."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifying members in order of preference and the type they stand for; roles and groups in paths.
IDENTIFYING = [("name", "person"), ("id", "identifier"), ("title", "document"), ("key", "reference"), ("uuid", "unique_id"), ("email", "contact")]
ROLES = ["member", "owner", "participant", "author", "assignee"]
GROUPS = ["project", "team", "organization", "department"]


def _context(which: Column) -> Column:
    """The other members of an entity object with their texts (containers as JSON)."""
    named = {kind: k for k, kind in IDENTIFYING}
    own = F.create_map(*[F.lit(x) for kind, k in named.items() for x in (kind, k)])[which]
    pairs = F.filter(F.arrays_zip("members", "texts"), lambda z: z["members"] != own)
    return F.map_from_entries(F.transform(pairs, lambda z: F.struct(z["members"], z["texts"]))).alias("context")


def track_entities(objects: DataFrame) -> DataFrame:
    """One row per entity object of json_objects: type, value, role, group, what the group stands in, and the other members.

    Role and group are the last such segments of the path; the group's context the segment before it.
    """
    member = [F.array_position("members", k) for k, _ in IDENTIFYING]
    which, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for (_, kind), at in reversed(list(zip(IDENTIFYING, member))):
        which = F.when(at > 0, F.lit(kind)).otherwise(which)
        value = F.when(at > 0, F.get("texts", (at - 1).cast("int"))).otherwise(value)
    parts = F.split("node_path", r"\.")
    last = lambda words: F.element_at(F.filter(parts, lambda p: p.isin(*words)), -1)
    spots = F.filter(F.transform(parts, lambda p, i: F.when(p.isin(*GROUPS) & (i > 0), i)), lambda i: i.isNotNull())
    e = objects.select("row_key", "node_path", "ordinal", which.alias("entity_type"), value.alias("entity_value"), F.when(F.size(F.filter(parts, lambda p: p.isin(*ROLES))) > 0, last(ROLES)).alias("role"), F.when(F.size(F.filter(parts, lambda p: p.isin(*GROUPS))) > 0, last(GROUPS)).alias("group_type"), F.when(F.size(spots) > 0, F.get(parts, F.element_at(spots, -1) - 1)).alias("group_context"), F.size("members").alias("n_members"), _context(which))
    return e.where("entity_type is not null")


def entity_registry(entities: DataFrame) -> DataFrame:
    """One row per document and entity value: the last object with it in document order."""
    e = entities.where("entity_value is not null")
    g = e.groupBy("row_key", "entity_value").agg(F.max(F.struct("ordinal", "node_path", "entity_type", "role")).alias("r"), F.count(F.lit(1)).alias("mentions"))
    return g.select("row_key", "entity_value", F.col("r.node_path").alias("node_path"), F.col("r.entity_type").alias("entity_type"), F.col("r.role").alias("role"), "mentions")


def display_names(nodes: DataFrame) -> DataFrame:
    """(row_key, object_path, name_key, name): name-like members, and X_name beside a textual X_id as X_id_display."""
    s = nodes.where("kind = 'string' and member is not null").select("row_key", "container_path", "member", "value")
    plain = s.where(F.col("member").isin("name", "title", "label", "display_name", "description")).select("row_key", F.col("container_path").alias("object_path"), F.col("member").alias("name_key"), F.col("value").alias("name"))
    stem = lambda end: F.regexp_extract("member", f"^(.+)_{end}$", 1)
    ids = s.where(F.col("member").rlike("^.+_id$")).select("row_key", "container_path", stem("id").alias("stem")).distinct()
    names = s.where(F.col("member").rlike("^.+_name$")).select("row_key", "container_path", stem("name").alias("stem"), "value")
    both = ids.join(names, ["row_key", "container_path", "stem"]).select("row_key", F.col("container_path").alias("object_path"), F.concat("stem", F.lit("_id_display")).alias("name_key"), F.col("value").alias("name"))
    return plain.unionByName(both)


def context_ids(nodes: DataFrame) -> DataFrame:
    """(row_key, field, value): textual id and *_id members; field holds the member names on the way, joined by _."""
    n = nodes.where("kind = 'string' and (member = 'id' or member like '%\\\\_id')")
    return n.select("row_key", F.regexp_replace(F.regexp_replace("path", r"\[\d+\]", ""), r"\.", "_").alias("field"), "value")


def entities_with_names(entities: DataFrame) -> DataFrame:
    """(row_key, node_path, entity_type, entity_id, name): the name is that of the object, or the id where it has none."""
    name = F.coalesce(F.when(F.col("entity_type") == "person", F.col("entity_value")), F.col("context")["name"], F.col("context")["title"], F.col("entity_value"))
    return entities.select("row_key", "node_path", "entity_type", F.col("entity_value").alias("entity_id"), name.alias("name"))
