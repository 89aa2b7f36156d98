"""Writes to the property graph: relating and linking by name, deleting with what hangs on it.

``entities`` is (id, name, kind, project_id, ...), ``relations`` is (src, dst,
relation), ``links`` is (memory_id, entity_id).  New entities get an id from
their name and project, so that a repeated job makes the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_id(name: Column, project: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", name, F.coalesce(project, F.lit(""))), 256), 1, 32)


def resolved(entities: DataFrame, named: DataFrame) -> DataFrame:
    """``(name, project_id, id)`` of each distinct name of (name, project_id): of that project first, else global; without a project any, the least id first; null where there is none."""
    wanted = named.select(F.col("name").alias("_n"), F.col("project_id").alias("_p")).where("_n IS NOT NULL").distinct()
    fits = (F.col("name") == F.col("_n")) & (F.col("_p").isNull() | F.col("project_id").isNull() | (F.col("project_id") == F.col("_p")))
    met = wanted.join(entities.select("id", "name", "project_id"), fits, "left")
    best = met.groupBy("_n", "_p").agg(F.min(F.struct((~F.col("project_id").eqNullSafe(F.col("_p"))).cast("int").alias("other"), "id")).alias("b"), F.count("id").alias("n"))
    return best.select(F.col("_n").alias("name"), F.col("_p").alias("project_id"), F.when(F.col("n") > 0, F.col("b.id")).alias("id"))


def with_missing(entities: DataFrame, named: DataFrame, kind: str = "concept") -> DataFrame:
    """``entities`` with one more row for each name that resolves to none; other columns are null."""
    made = resolved(entities, named).where("id IS NULL").select(new_id(F.col("name"), F.col("project_id")).alias("id"), "name", F.lit(kind).alias("kind"), "project_id")
    return entities.unionByName(made, allowMissingColumns=True)


def related(entities: DataFrame, relations: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) after relating by name: (src_name, relation, dst_name, project_id); missing names become concepts, repeated edges count once."""
    sides = wanted.select(F.explode(F.array("src_name", "dst_name")).alias("name"), "project_id")
    grown = with_missing(entities, sides)
    known = resolved(grown, sides)
    src, dst = (known.select(F.col("name").alias(f"{s}_name"), F.col("project_id").alias(f"_p{s}"), F.col("id").alias(s)) for s in ("src", "dst"))
    met = wanted.join(src, (wanted["src_name"] == src["src_name"]) & wanted["project_id"].eqNullSafe(src["_psrc"])).join(dst, (wanted["dst_name"] == dst["dst_name"]) & wanted["project_id"].eqNullSafe(dst["_pdst"]))
    return grown, relations.select("src", "dst", "relation").unionByName(met.select("src", "dst", "relation")).distinct()


def linked(entities: DataFrame, links: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, links) after linking memories to entities by name: (memory_id, name, project_id); missing names become concepts, repeated links count once."""
    grown = with_missing(entities, wanted)
    known = resolved(grown, wanted).select(F.col("name").alias("_n"), F.col("project_id").alias("_p"), F.col("id").alias("entity_id"))
    met = wanted.join(known, (wanted["name"] == known["_n"]) & wanted["project_id"].eqNullSafe(known["_p"]))
    return grown, links.select("memory_id", "entity_id").unionByName(met.select("memory_id", "entity_id")).distinct()


def without(entities: DataFrame, relations: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, links) without the entities of (id), their links and their edges in both directions."""
    ids = gone.select("id").distinct()
    edges = relations.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return entities.join(ids, "id", "left_anti"), edges.select(*relations.columns), links.join(ids.withColumnRenamed("id", "entity_id"), "entity_id", "left_anti").select(*links.columns)


def entities_of(links: DataFrame, entities: DataFrame) -> DataFrame:
    """``(memory_id, entities)``: the (name, kind) of each memory's entities, sorted."""
    named = entities.select(F.col("id").alias("entity_id"), "name", "kind")
    return links.join(named, "entity_id").groupBy("memory_id").agg(F.sort_array(F.collect_set(F.struct("name", "kind"))).alias("entities"))


def from_pseudo(entities: DataFrame, links: DataFrame, relations: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, links, relations) after entities named 'memory:<id>' became links of that memory; those of no memory are dropped with their edges."""
    pseudo = entities.where(F.col("name").startswith("memory:")).select("id", F.substring("name", 8, 1 << 20).alias("memory_id"))
    edges = relations.select(F.col("src").alias("id"), F.col("dst").alias("entity_id")).unionByName(relations.select(F.col("dst").alias("id"), F.col("src").alias("entity_id")))
    made = edges.join(pseudo, "id").join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").join(pseudo.select(F.col("id").alias("entity_id")), "entity_id", "left_anti").select("memory_id", "entity_id")
    kept, left, bridge = without(entities, relations, links.unionByName(made).distinct(), pseudo)
    return kept, bridge, left


def newest_of_kind(memories: DataFrame, kind: str, each: int) -> DataFrame:
    """``(project_id, id, place)``: the newest live memories of a kind in every project, ``each`` at most."""
    live = memories.where(~F.coalesce("obsolete", F.lit(False)) & (F.lower(F.trim("kind")) == kind))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("created_at"), "id"))
    return live.select("project_id", "id", place.alias("place")).where(F.col("place") <= each)


def context_sections(memories: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """``(project_id, section, place, id)``: the newest memories of each kind of ``sizes``, and the pinned ones, oldest first."""
    parts = [newest_of_kind(memories, kind, n).withColumn("section", F.lit(kind)) for kind, n in sizes.items()]
    pinned = memories.where(F.coalesce("pinned", F.lit(False)) & ~F.coalesce("obsolete", F.lit(False)))
    parts.append(pinned.select("project_id", "id", F.row_number().over(Window.partitionBy("project_id").orderBy("created_at", "id")).alias("place"), F.lit("pinned").alias("section")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("project_id", "section", "place", "id")


#: How many memories of a kind a session begins with, by tier, and how many a deep context has.
TIERS = {"L0": {}, "L1": {"decision": 20}, "L2": {"decision": 20, "issue": 10, "procedure": 10, "preference": 10}, "L3": {"decision": 20, "issue": 10, "procedure": 10, "preference": 10}}
DEEP = {"decision": 10, "issue": 5, "procedure": 5, "preference": 5}


def session_bundle(projects: DataFrame, memories: DataFrame, recalled: DataFrame | None, tier: str = "L3") -> DataFrame:
    """``(project_id, name, last_session, sections)``: what a session of each project begins with.

    ``sections`` maps a name to ids in order: kinds by tier (L0 to L3, 'full' is
    L3), 'pinned' from L1, and 'relevant' in L3, the rows of ``recalled``
    (project_id, id, rank).  Empty sections are left out.
    """
    tier = "L3" if tier.upper() == "FULL" else tier.upper()
    sections = context_sections(memories, TIERS[tier]) if tier > "L0" else None
    if recalled is not None and tier >= "L3":
        sections = sections.unionByName(recalled.select("project_id", F.lit("relevant").alias("section"), F.col("rank").alias("place"), "id"))
    last = memories.where("session_id IS NOT NULL").groupBy("project_id").agg(F.max_by("session_id", F.struct("created_at", "id")).alias("last_session"))
    out = projects.select(F.col("id").alias("project_id"), "name").join(last, "project_id", "left")
    if sections is None:
        return out.withColumn("sections", F.expr("cast(map() as map<string, array<string>>)"))
    lists = sections.groupBy("project_id", "section").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("ids"))
    maps = lists.groupBy("project_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("section", "ids")))).alias("sections"))
    return out.join(maps, "project_id", "left").withColumn("sections", F.coalesce("sections", F.expr("cast(map() as map<string, array<string>>)")))


def deep_context(recalled: DataFrame, questions: DataFrame, memories: DataFrame, entities: DataFrame, links: DataFrame, top: int = 5, each: int = 5) -> DataFrame:
    """``(query, id, score, source)``: recalled memories, and those linked to what the question and the first ``top`` results name.

    Names are the subjects and linked entities of the first results and the
    question's words of more than two characters.  Each named entity gives its
    newest ``each`` live memories that weren't recalled, with score 0.5 and source
    'graph'.  ``recalled`` is (query, id, rank, score), ``questions`` (query, question).
    """
    first = recalled.where(F.col("rank") <= top).select("query", "id")
    subjects = first.join(memories.select("id", "subject"), "id").where("subject IS NOT NULL").select("query", F.col("subject").alias("name"))
    tied = first.join(links.withColumnRenamed("memory_id", "id"), "id").join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id").select("query", "name")
    words = questions.select("query", F.explode(F.filter(F.split("question", r"\s+"), lambda w: F.length(w) > 2)).alias("name"))
    named = subjects.unionByName(tied).unionByName(words).distinct()
    asked = named.join(entities.select(F.col("id").alias("entity_id"), "name"), "name").select("query", "entity_id").distinct()
    live = memories.where(~F.coalesce("obsolete", F.lit(False))).select(F.col("id").alias("memory_id"), "created_at")
    order = Window.partitionBy("entity_id").orderBy(F.desc("created_at"), "memory_id")
    newest = links.join(asked.select("entity_id").distinct(), "entity_id", "left_semi").join(live, "memory_id").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each)
    more = asked.join(newest.select("entity_id", F.col("memory_id").alias("id")), "entity_id").select("query", "id").distinct().join(recalled.select("query", "id"), ["query", "id"], "left_anti")
    return recalled.select("query", "id", "score", F.lit("recall").alias("source")).unionByName(more.select("query", "id", F.lit(0.5).alias("score"), F.lit("graph").alias("source")))
