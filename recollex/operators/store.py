"""State on immutable files: an append-only log of events, its latest state, versions, schema upgrade, restore."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str, seq: str, deleted: str | None = None) -> DataFrame:
    """The last event of each key by ``seq`` (unique within a key), without keys whose last event deletes."""
    rows = log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), seq).alias("_last")).select(key, "_last.*")
    return rows.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else rows


def patched(state: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """State after column updates: non-null columns of ``changes`` (one row a key) win; unknown keys are ignored."""
    named = changes.withColumnsRenamed({c: f"_new_{c}" for c in changes.columns if c != key})
    both = state.join(named, key, "left")
    return both.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in changes.columns and c != key else F.col(c) for c in state.columns])


def assigned(state: DataFrame, changes: DataFrame, key: str, only: Column | None = None) -> DataFrame:
    """State after column updates that may set null: every other column of ``changes`` (one row a key) is set, where ``only`` (over the old row) holds."""
    given = [c for c in changes.columns if c != key]
    named = changes.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in given])
    both = state.join(named, key, "left").withColumn("_set", F.coalesce(F.col("_hit") & (F.lit(True) if only is None else only), F.lit(False)))
    return both.select(*[F.when(F.col("_set"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in state.columns])


def created(existing: DataFrame, incoming: DataFrame, name: str) -> DataFrame:
    """Existing rows and those incoming whose name is new; of equal new names the first by all columns counts."""
    fresh = incoming.join(existing.select(name), name, "left_anti")
    once = fresh.groupBy(name).agg(F.min(F.struct(*[c for c in incoming.columns if c != name])).alias("_f")).select(name, "_f.*")
    return existing.unionByName(once, allowMissingColumns=True)


def stored_memories(state: DataFrame, batch: DataFrame) -> DataFrame:
    """State with a batch of new memories; what they supersede becomes obsolete."""
    gone = batch.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("id")).distinct().withColumn("_gone", F.lit(True))
    old = state.join(gone, "id", "left").withColumn("obsolete", F.coalesce("_gone", F.col("obsolete"))).select(*state.columns)
    return old.unionByName(batch, allowMissingColumns=True)


def purged(memories: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories, links) without obsolete memories and the links of memories that are gone; links are (memory_id, ...)."""
    kept = memories.where(~F.coalesce("obsolete", F.lit(False)))
    return kept, links.join(memories.where(F.coalesce("obsolete", F.lit(False))).select(F.col("id").alias("memory_id")), "memory_id", "left_anti").select(*links.columns)


def logged(log: DataFrame, accesses: DataFrame) -> DataFrame:
    """The access log with more rows (memory_id, accessed_at, context); contexts are cut to 200 characters."""
    return log.unionByName(accesses.select("memory_id", "accessed_at", F.substring("context", 1, 200).alias("context")))


def numbered_sessions(existing: DataFrame, incoming: DataFrame, key: str = "session_id", project: str = "project_id", at: str = "started_at") -> DataFrame:
    """Incoming sessions with the next ``session_ordinal`` of their project (null is a project of its own), by start."""
    last = existing.groupBy(F.col(project).alias("_p")).agg(F.max("session_ordinal").alias("_last"))
    place = F.row_number().over(Window.partitionBy(project).orderBy(at, key))
    met = incoming.withColumn("_n", place).join(last, F.col(project).eqNullSafe(F.col("_p")), "left")
    return met.select(*incoming.columns, (F.coalesce("_last", F.lit(0)) + F.col("_n")).alias("session_ordinal"))


def sessions_of(memories: DataFrame) -> DataFrame:
    """``(session_id, project_id, started_at, last_at, memories)``: sessions as their memories tell."""
    return memories.where("session_id IS NOT NULL").groupBy("session_id").agg(
        F.min("project_id").alias("project_id"), F.min("created_at").alias("started_at"), F.max("created_at").alias("last_at"), F.count(F.lit(1)).alias("memories")
    )


def open_sessions(sessions: DataFrame, as_of: Column, hours: float | None = None, ended: str = "ended_at", at: str = "started_at") -> DataFrame:
    """Sessions without an end, those started more than some hours before ``as_of`` if given."""
    old = F.lit(True) if hours is None else (F.unix_micros(as_of) - F.unix_micros(at)) > hours * 3_600_000_000
    return sessions.where(F.col(ended).isNull() & old)


def plain_rows(df: DataFrame) -> DataFrame:
    """Rows for interchange: timestamps as ISO text in UTC, arrays, maps and structs as JSON with [] and {} for null."""
    def plain(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind.startswith("timestamp"):
            return F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias(name)
        if kind.startswith(("array", "map", "struct")):
            return F.coalesce(F.to_json(c), F.lit("[]" if kind.startswith("array") else "{}")).alias(name)
        return c.alias(name)

    return df.select(*[plain(n, k) for n, k in df.dtypes])


def typed_memories(rows: DataFrame) -> DataFrame:
    """Rows with defaults for what is missing: tags from an array or JSON text (else none), version 1, strengths 0 and 1, counts 0, flags false; '__global__' is no project."""
    tags = F.col("tags") if dict(rows.dtypes)["tags"].startswith("array") else F.from_json(F.col("tags"), "array<string>")
    return rows.withColumns({
        "tags": F.coalesce(tags, F.array().cast("array<string>")), "project_id": F.nullif("project_id", F.lit("__global__")), "version": F.coalesce("version", F.lit(1)),
        "storage_strength": F.coalesce("storage_strength", F.lit(0.0).cast("float")), "retrieval_strength": F.coalesce("retrieval_strength", F.lit(1.0).cast("float")),
        "access_count": F.coalesce("access_count", F.lit(0)), "obsolete": F.coalesce("obsolete", F.lit(False)), "pinned": F.coalesce("pinned", F.lit(False)),
    })


def new_version(state: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Old rows become obsolete; each change adds a row of the next version under the same root, inheriting what it leaves null.

    ``changes`` is (id of the old row, new_id, columns...); pinned is carried over.
    """
    hit = state.join(changes.select(key, "new_id", *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c not in (key, "new_id")]), key)
    given = [c for c in changes.columns if c not in (key, "new_id")]
    made = hit.select(*[
        F.col("new_id").alias(c) if c == key
        else (F.coalesce("version", F.lit(1)) + 1).alias(c) if c == "version"
        else F.coalesce("version_of", F.col(key)).alias(c) if c == "version_of"
        else F.lit(False).alias(c) if c == "obsolete"
        else F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in given
        else F.col(c)
        for c in state.columns
    ])
    old = state.join(changes.select(key).withColumn("_gone", F.lit(True)), key, "left").withColumn("obsolete", F.coalesce("_gone", F.col("obsolete"))).select(*state.columns)
    return old.unionByName(made)


def version_chains(memories: DataFrame) -> DataFrame:
    """``(root, id, version)`` of every row; an unversioned row is its own root."""
    return memories.select(F.coalesce("version_of", "id").alias("root"), "id", F.coalesce("version", F.lit(1)).alias("version"))


def session_ordinals(sessions: DataFrame, key: str, project: str, at: str) -> DataFrame:
    """Numbers sessions within their project by start; a null project is a project of its own."""
    order = Window.partitionBy(F.coalesce(F.col(project), F.lit("::global::"))).orderBy(at, key)
    return sessions.withColumn("session_ordinal", F.row_number().over(order))


def upserted_properties(entities: DataFrame, incoming: DataFrame) -> DataFrame:
    """Entities after an upsert by (name, project): the new kind wins, properties are merged with new values first."""
    new = incoming.select("name", "project_id", F.col("kind").alias("_kind"), F.col("properties").alias("_properties"))
    both = entities.join(new, (entities["name"] == new["name"]) & entities["project_id"].eqNullSafe(new["project_id"]), "full")
    old_p, new_p = F.coalesce(F.col("properties"), F.expr("cast(map() as map<string,string>)")), F.coalesce(F.col("_properties"), F.expr("cast(map() as map<string,string>)"))
    united = F.map_concat(F.map_filter(old_p, lambda k, _: ~F.map_contains_key(new_p, k)), new_p)
    return both.select(F.coalesce(entities["name"], new["name"]).alias("name"), F.coalesce(entities["project_id"], new["project_id"]).alias("project_id"), F.coalesce("_kind", "kind").alias("kind"), united.alias("properties"))


def upgraded(df: DataFrame, columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds columns that an older archive lacks, and fills nulls with the default: name to (type, default)."""
    return df.withColumns({name: F.coalesce(F.col(name).cast(kind), default.cast(kind)) if name in df.columns else default.cast(kind) for name, (kind, default) in columns.items()})


def restored(existing: DataFrame, incoming: DataFrame, key: list[str], update: bool = True, clean: bool = False) -> DataFrame:
    """Tables after a restore: 'clean' keeps only incoming rows; 'update' lets incoming rows win, else existing ones do."""
    if clean:
        return incoming.dropDuplicates(key)
    winner, other = (incoming, existing) if update else (existing, incoming)
    return winner.unionByName(other.join(winner.select(*key), key, "left_anti"), allowMissingColumns=True)


def filters(*conditions: Column | None) -> Column:
    """All given conditions; None means no filter."""
    given = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, given, F.lit(True))


def has_all_tags(tags: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), F.coalesce(tags, F.array().cast("array<string>")))) == 0


def may_read(project: Column, role: str, projects: list[str]) -> Column:
    """Rows that an identity may see: all for an admin or '*', else its projects and rows of none."""
    return F.lit(True) if role == "admin" or "*" in projects else project.isNull() | project.isin(*projects)


def kept_archives(archives: DataFrame, name: str, at: str, as_of: Column, newest: int = 10, days: float = 30.0) -> DataFrame:
    """Archives that retention keeps: among the newest few, or younger than some days."""
    place = F.row_number().over(Window.orderBy(F.col(at).desc(), F.col(name).desc()))  # one row an archive: a short list
    young = (F.unix_micros(as_of) - F.unix_micros(at)) / 86_400_000_000.0 < days
    return archives.withColumn("_n", place).where((F.col("_n") <= newest) | young).drop("_n")
