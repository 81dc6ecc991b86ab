"""Evidence numbering, rendering and citations of generated answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text

SNIPPET, FILE_WINDOW, ROUNDS, CALLS, CONTEXT_TOKENS = 600, 8000, 4, 5, 24_000
REFUSAL = "No relevant information was found in the workspace."


def evidence_blocks(hits: DataFrame) -> DataFrame:
    """Hits (answer_id, seq, path, chunk_index, memory_id) with their block's number and whether it is new.

    A block is a chunk, a file (no chunk) or a memory; memories come first, numbers follow first
    appearance, a repeat keeps its number.
    """
    key = F.when(F.col("memory_id").isNotNull(), F.concat(F.lit("m:"), F.col("memory_id").cast("string"))).otherwise(F.concat_ws("|", F.lit("f"), "path", F.col("chunk_index").cast("string")))
    own = hits.withColumn("key", key).withColumn("order", F.struct(F.col("memory_id").isNull().alias("late"), "seq"))
    firsts = own.groupBy("answer_id", "key").agg(F.min("order").alias("first"))
    numbered = firsts.withColumn("number", F.row_number().over(Window.partitionBy("answer_id").orderBy("first")))
    return own.join(numbered, ["answer_id", "key"]).select("answer_id", "seq", "path", "chunk_index", "memory_id", "number", (F.col("order") == F.col("first")).alias("is_new"))


def render_hits(blocks: DataFrame, snippet: int = SNIPPET) -> DataFrame:
    """``blocks`` (with content) as the lines a model reads; a repeat is named without its text."""
    head = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), F.col("path"), F.lit(" (chunk "), F.col("chunk_index").cast("string"), F.lit(")"))
    body = F.concat(F.lit(" <<<"), text.truncated(F.col("content"), snippet), F.lit(">>>"))
    return blocks.select("answer_id", "seq", F.concat(head, F.when(F.col("is_new"), body).otherwise(F.lit(" (as before)"))).alias("line"))


def align_citations(answers: DataFrame, refusal: str = REFUSAL) -> DataFrame:
    """answers (answer_id, answer, n_blocks) -> citations (valid numbers, once each, in order), grounded."""
    found = F.array_distinct(F.filter(text.citation_indices(F.col("answer")), lambda n: (n >= 1) & (n <= F.col("n_blocks"))))
    return answers.select("answer_id", found.alias("citations"), ((F.size(found) > 0) | F.contains(F.col("answer"), F.lit(refusal))).alias("grounded"))


def tool_loop(question: str, model: Callable, tools: dict[str, Callable], rounds: int = ROUNDS, calls: int = CALLS, budget: int = CONTEXT_TOKENS) -> tuple[str, int]:
    """Runs a model (history -> {"calls": [(tool, args)], "answer": text}) with tools until it answers.

    Rounds, calls a round and the estimated context are bounded; the last round must answer.
    """
    history = [("user", question)]
    for n in range(1, rounds + 1):
        last = n == rounds or sum(len(t) // 4 for _, t in history) > budget
        reply = model(history, force_answer=last)
        if last or not reply.get("calls"):
            return reply.get("answer") or REFUSAL, n
        for name, args in reply["calls"][:calls]:
            history.append((name, str(tools[name](**args)) if name in tools else f"unknown tool {name}"))
    return REFUSAL, rounds
