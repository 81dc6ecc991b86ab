"""Keys, workspaces, question logs: the store's own lists and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_keys(keys: DataFrame, workspaces: DataFrame, now: str) -> DataFrame:
    """Keys that are neither revoked nor expired, of workspaces that are active."""
    young = F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp_ntz"))
    own = keys.where(~F.col("revoked") & young).select("id", "workspace_id")
    active = workspaces.where("status = 'active'").select(F.col("id").alias("workspace_id"), "account_id", "kind")
    return own.join(active, "workspace_id")


def workspace_counts(workspaces: DataFrame, keys: DataFrame, tasks: DataFrame) -> DataFrame:
    """Workspaces with how many keys and tasks they have, 0 where none."""
    k = keys.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n_keys"))
    t = tasks.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n_tasks"))
    zero = F.lit(0).cast("long")
    own = workspaces.select(F.col("id").alias("workspace_id"))
    return own.join(k, "workspace_id", "left").join(t, "workspace_id", "left").select("workspace_id", F.coalesce("n_keys", zero).alias("n_keys"), F.coalesce("n_tasks", zero).alias("n_tasks"))


def keyword(text: str, *columns: str) -> Column:
    """Whether some column holds ``text`` in any case; ``%`` and ``_`` in it are wildcards."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return out


def qa_list(log: DataFrame, feedback: DataFrame, kind: int | None = None) -> DataFrame:
    """Questions with their likes and dislikes, all or those with feedback of a kind."""
    counts = feedback.groupBy("qa_id").agg(F.count_if(F.col("kind") == 1).alias("likes"), F.count_if(F.col("kind") == 2).alias("dislikes"))
    out = log
    if kind is not None:
        out = out.join(feedback.where(F.col("kind") == kind).select(F.col("qa_id").alias("id")), "id", "left_semi")
    zero = F.lit(0).cast("long")
    joined = out.join(counts.withColumnRenamed("qa_id", "id"), "id", "left")
    return joined.select("id", "outcome", "latency_ms", F.coalesce("likes", zero).alias("likes"), F.coalesce("dislikes", zero).alias("dislikes"))


def qa_stats(log: DataFrame, feedback: DataFrame, now: str, days: int) -> DataFrame:
    """name, n: questions by outcome and feedback by kind of the last ``days`` days."""
    lately = log.where(F.col("created_at") > F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL '{int(days)}' DAY"))
    outcomes = lately.groupBy(F.concat(F.lit("outcome:"), "outcome").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    kinds = feedback.join(lately.select(F.col("id").alias("qa_id")), "qa_id", "left_semi").groupBy(F.concat(F.lit("feedback:"), F.col("kind").cast("string")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return outcomes.unionByName(kinds)
