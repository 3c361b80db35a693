"""Share texts and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aphora.functions.text import encode_component


def share_text(text: Column, author: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('" - '), author)


def share_url(base: str, quote_id: Column) -> Column:
    return F.concat(F.lit(f"{base}/quote/"), quote_id.cast("string"))


def share_link(platform: Column, encoded_text: Column, url: Column) -> Column:
    """The platform's share address; an unknown platform gets the plain URL.

    The text arrives encoded so that it can be encoded once per quote instead of once per share.
    """
    link = encode_component(url)
    # The address formats of the platforms.
    return (
        F.when(platform == "twitter",
               F.concat(F.lit("https://twitter.com/intent/tweet?text="), encoded_text, F.lit("&url="), link))
        .when(platform == "facebook", F.concat(F.lit("https://www.facebook.com/sharer/sharer.php?u="), link))
        .when(platform == "whatsapp", F.concat(F.lit("https://wa.me/?text="), encoded_text, F.lit("%20"), link))
        .otherwise(url)
    )
