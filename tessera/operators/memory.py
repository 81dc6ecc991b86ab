"""Scoped memories: who may read and write what, search over them, and saving without doubles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import InvalidInput
from tessera.functions import text
from tessera.operators import retrieval
from tessera.operators.text_index import TextIndex

OVERFETCH, INDEX_OVERFETCH = 3, 5
CONTENT_CHARS, TOPIC_CHARS, SOURCE_BYTES = 4096, 128, 4096


@dataclass(frozen=True)
class Actor:
    workspace: str
    principal: str
    dept: str | None = None
    team_only: bool = False


def in_context(actor: Actor) -> Column:
    """What the actor's context shows: the team's, their own (anywhere's or this workspace's), the department's."""
    team = (F.col("scope_type") == "workspace") & (F.col("scope_id") == actor.workspace)
    if actor.team_only:
        return team
    here = F.col("origin_workspace_id").isNull() | (F.col("origin_workspace_id") == actor.workspace)
    own = (F.col("scope_type") == "principal") & (F.col("scope_id") == actor.principal) & here
    out = team | own
    if actor.dept is not None:
        out = out | ((F.col("scope_type") == "dept") & (F.col("scope_id") == actor.dept))
    return out


def writable(actor: Actor) -> Column:
    """What the actor may change."""
    out = (F.col("scope_type") == "workspace") & (F.col("scope_id") == actor.workspace)
    if actor.team_only:
        return out
    out = out | ((F.col("scope_type") == "principal") & (F.col("scope_id") == actor.principal))
    return out if actor.dept is None else out | ((F.col("scope_type") == "dept") & (F.col("scope_id") == actor.dept))


def live(now: str, topic: str | None = None, kind: str | None = None) -> Column:
    """Not expired; topic ``''`` asks for those without one."""
    out = F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp_ntz"))
    if topic is not None:
        out = out & (F.col("topic").isNull() if topic == "" else F.coalesce(F.col("topic") == topic, F.lit(False)))
    return out if kind is None else out & (F.col("kind") == kind)


def topic_counts(memories: DataFrame) -> DataFrame:
    """Rows by topic; those without one are a group of their own."""
    return memories.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


def width(scope_type: Column) -> Column:
    return F.when(scope_type == "workspace", 3).when(scope_type == "dept", 2).otherwise(1)


def recheck(candidates: DataFrame, memories: DataFrame, condition: Column) -> DataFrame:
    """Index hits (id, rank) that the authoritative rows still allow, in their order."""
    return candidates.join(memories.where(condition), "id")


def dedup(ranked: DataFrame, limit: int) -> DataFrame:
    """Of equal contents the row of the widest scope, at the first one's rank."""
    same = Window.partitionBy("content_hash")
    best = F.row_number().over(same.orderBy(F.desc(width(F.col("scope_type"))), "rank", "id"))
    out = ranked.withColumn("__best", best).withColumn("__first", F.min("rank").over(same)).where("__best = 1")
    return out.withColumn("rank", F.col("__first")).drop("__best", "__first").orderBy("rank", "id").limit(limit)


def scope(actor: Actor, name: str | None) -> Column:
    """One domain, ``team``, ``dept`` or ``mine``; or, without a name, the whole context."""
    if name is None:
        return in_context(actor)
    if name not in ("team", "dept", "mine"):
        raise InvalidInput(f"scope: {name!r}")
    if actor.team_only and name != "team":
        raise InvalidInput("only team memories are available")
    if name == "dept" and actor.dept is None:
        raise InvalidInput("no department")
    kind, own = {"team": ("workspace", actor.workspace), "dept": ("dept", actor.dept), "mine": ("principal", actor.principal)}[name]
    return (F.col("scope_type") == kind) & (F.col("scope_id") == own)


def search(memories: DataFrame, actor: Actor, query: str, vector: Sequence[float] | None, now: str, scope_name: str | None = None, limit: int = 10, mode: str = "hybrid", index: TextIndex | None = None) -> DataFrame:
    """The best live memories of a scope: id, rank, score and what ``dedup`` keeps.

    The index (id, content, vector; with a stored ``index`` of the contents no text is read) gives candidates of the scope, ``OVERFETCH`` times ``limit``,
    each ranker ``INDEX_OVERFETCH`` times those; the authoritative rows, in scope and live, are
    looked up anew; equal contents collapse to the widest scope at the first one's rank.
    """
    allowed = scope(actor, scope_name)
    rows = memories.where(allowed).select("id", "content", "vector")
    wanted = limit * OVERFETCH
    hits = retrieval.ranked_hits(rows, query, vector, mode, wanted, INDEX_OVERFETCH, index, None if index is None else rows.select("id"))
    return dedup(recheck(hits, memories.drop("vector"), allowed & live(now)), limit)


def inherited_topic(nearest: DataFrame, least: float = 0.75) -> DataFrame:
    """new_id, topic: each new memory's nearest neighbour's topic (new_id, id, score, topic), where near enough."""
    best = nearest.groupBy("new_id").agg(F.max_by(F.struct("topic", "score"), F.struct("score", F.negate("id"))).alias("b"))
    return best.select("new_id", F.when(F.col("b.score") >= least, F.col("b.topic")).alias("topic"))


def save(memories: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows to insert: trimmed, valid, new to their scope, one for each content."""
    new = incoming.withColumn("content", text.trimmed(F.col("content")))
    new = new.where((F.length("content") > 0) & (F.length("content") <= CONTENT_CHARS) & (F.coalesce(F.length("topic"), F.lit(0)) <= TOPIC_CHARS))
    new = new.withColumn("content_hash", F.sha2("content", 256))
    key = ["scope_type", "scope_id", "content_hash"]
    first = F.row_number().over(Window.partitionBy(*key).orderBy("id"))
    return new.withColumn("__n", first).where("__n = 1").drop("__n").join(memories.select(*key), key, "left_anti")


def origin(scope: Column, kind: Column, given: Column, workspace: str) -> Column:
    """Team and department memories have no origin; a preference has none unless given, other kinds
    are pinned to this workspace; an empty one means none."""
    return F.when(scope.isin("workspace", "dept"), F.lit(None)).when(given == "", F.lit(None)).when(given.isNotNull(), given).when(kind == "preference", F.lit(None)).otherwise(F.lit(workspace))


def update(memories: DataFrame, actor: Actor, id_: int, content: str) -> DataFrame:
    """``memories`` with one row's content replaced, if the actor may; others are as they were."""
    content = text.stripped(content)
    if not content or len(content) > CONTENT_CHARS:
        raise InvalidInput("content")
    hit = (F.col("id") == id_) & writable(actor)
    new = F.when(hit, F.lit(content)).otherwise(F.col("content"))
    return memories.withColumn("content", new).withColumn("content_hash", F.sha2("content", 256))


def touch(memories: DataFrame, ids: list[int], now: str) -> DataFrame:
    """``last_used_at`` of some rows; nothing else changes."""
    used = F.when(F.col("id").isin(ids), F.lit(now).cast("timestamp_ntz"))
    return memories.withColumn("last_used_at", F.coalesce(used, F.col("last_used_at")) if "last_used_at" in memories.columns else used)


def fresh_profiles(principals: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Principals with whether their profile is young enough to be used."""
    least = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL '{int(hours)}' HOUR")
    return principals.withColumn("fresh", F.col("profile_at") >= least)
