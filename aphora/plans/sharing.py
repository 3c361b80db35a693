"""The share feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aphora.functions import sharing
from aphora.functions.text import encode_component
from aphora.operators import relations


def share_feed(requests: DataFrame, quotes: DataFrame, base_url: str) -> DataFrame:
    """Share text, URL and platform link of every share request; unknown quotes are marked, not dropped.

    Text is assembled and encoded once per quote before the join, not once per share.
    """
    text = sharing.share_text(F.col("text"), F.col("author"))
    prepared = quotes.select("quote_id", text.alias("share_text")).withColumn("_encoded", encode_component("share_text"))
    joined = relations.find(requests, prepared, "quote_id")
    url = sharing.share_url(base_url, F.col("quote_id"))
    link = sharing.share_link(F.col("platform"), F.col("_encoded"), url)
    found = F.col("found")
    return joined.select(
        *requests.columns, "found", "share_text", F.when(found, url).alias("share_url"),
        F.when(found, link).alias("share_link"), F.when(~found, F.lit("quote_not_found")).alias("error"),
    )
