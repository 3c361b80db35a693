"""Batches of generated quotes. The texts come as a table; nothing here calls a service."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aphora import dimensions
from aphora.functions.prompts import generation_prompt
from aphora.functions.text import completion_text, hashed_position
from aphora.sources.sinks import surrogate_id


def assigned_category(*key: Column | str, seed: int = 42) -> Column:
    """One of the fifteen categories, by the hash of the key."""
    place = hashed_position(len(dimensions.CATEGORY_IDS), F.lit(str(seed)), *key)
    return F.element_at(F.array(*[F.lit(c) for c in dimensions.CATEGORY_IDS]), place + 1)


def generation_requests(slots: DataFrame, keys: list[str], lang: str = "EN", seed: int = 42) -> DataFrame:
    """Category and prompt for each quote that is to be written."""
    category = assigned_category(*keys, seed=seed)
    return slots.select(*keys, category.alias("category"), F.lit(lang).alias("lang")).withColumn(
        "prompt", generation_prompt(F.col("category"), F.col("lang"))
    )


def generated_batch(completions: DataFrame, key: list[str], at: Column, lang: str = "EN", seed: int = 42) -> DataFrame:
    """New quotes from completions: trimmed, empty ones dropped, each with a category and a repeatable id."""
    written = completions.withColumn("_text", completion_text("completion")).where(F.col("_text").isNotNull())
    return written.select(
        surrogate_id(*key, "_text").alias("quote_id"), F.col("_text").alias("text"),
        assigned_category(*key, seed=seed).alias("category"), F.lit(lang).alias("lang"), at.alias("created_at"),
    )


def complete_with(prompts: DataFrame, key: str, prompt: str, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """Run an injected function over prompts in batches; rows stream through, nothing is collected."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "completion": model(batch[prompt].tolist())})

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, prompt).mapInPandas(run, f"{key} {kind}, completion string")
