"""Chunk contexts: prompts out, generated responses back in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import lexicon as L
from corpusloom.functions import text as T
from corpusloom.functions.vectors import bisected


def truncate_document(c: Column, max_doc_tokens: int = 6000) -> Column:
    """Keep head and tail of a text over 4 characters per allowed token."""
    limit = max_doc_tokens * 4
    half = limit // 2
    return F.when(
        F.length(c) > limit,
        F.concat(F.left(c, F.lit(half)), F.lit(L.OMITTED_MIDDLE), F.right(c, F.lit(half))),
    ).otherwise(c)


def template_for(model: str = "", optimize: bool = True) -> tuple[str, str | None]:
    """Prompt template and system prompt chosen by the model name."""
    if optimize and "qwen3" in model.lower():
        return L.CONTEXT_PROMPTS["compact"], L.COMPACT_SYSTEM_PROMPT
    return L.CONTEXT_PROMPTS["medical"], None


def fill(template: str, **values: Column) -> Column:
    """Concatenate the template's literal parts with columns; no scan of the text."""
    parts: list[Column] = []
    rest = template
    while True:
        at = [(rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest]
        if not at:
            parts.append(F.lit(rest))
            return F.concat(*parts)
        where, key = min(at)
        parts += [F.lit(rest[:where]), values[key]]
        rest = rest[where + len(key) + 2 :]


def build_context_prompts(
    docs: DataFrame, chunks: DataFrame, model: str = "", max_doc_tokens: int = 6000, template: str | None = None
) -> DataFrame:
    """doc_id, chunk_index, system_prompt, prompt: one row per chunk."""
    chosen, system = (template, None) if template else template_for(model)
    cut = docs.select("doc_id", truncate_document(F.col("text"), max_doc_tokens).alias("_document"))
    return chunks.join(cut, "doc_id").select(
        "doc_id",
        "chunk_index",
        F.lit(system).alias("system_prompt"),
        fill(chosen, document=F.col("_document"), chunk=F.col("text")).alias("prompt"),
    )


def generate(prompts: DataFrame, factory: Callable[[], Callable[[list[str]], list[str]]]) -> DataFrame:
    """Run a user text generator over the prompts; it is built once per worker.

    A prompt that the generator fails on has the response "", so that its chunk
    stays as it is; the others of its batch have theirs.
    """

    @F.pandas_udf("string")
    def respond(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = factory()
        for batch in batches:
            found, errors = bisected(run, batch.tolist())
            yield pd.Series(["" if e is not None else r for r, e in zip(found, errors, strict=True)], dtype=object)

    return prompts.withColumn("response", respond.asNondeterministic()("prompt"))


def apply_contexts(chunks: DataFrame, responses: DataFrame | None) -> DataFrame:
    """Prepend each chunk's generated context; no response leaves the chunk as it is."""
    if responses is None:
        joined = chunks.withColumn("response", F.lit(None).cast("string"))
    else:
        joined = chunks.join(responses.select("doc_id", "chunk_index", "response"), ["doc_id", "chunk_index"], "left")
    bare = T.strip(F.regexp_replace(F.col("response"), "(?s)<think>.*?</think>", ""))
    context = F.coalesce(bare, F.lit(""))
    others = [c for c in chunks.columns if c != "text"]
    return joined.withColumn("context", context).select(
        *others,
        F.when(F.col("context") != "", F.concat("context", F.lit("\n\n"), "text")).otherwise(F.col("text")).alias("text"),
        F.col("text").alias("original_text"),
        "context",
        (F.col("context") != "").alias("has_context"),
    )
