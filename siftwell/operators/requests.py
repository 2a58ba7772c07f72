"""Model requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.ids import request_key
from siftwell.functions.prompts import prompt
from siftwell.functions.urls import permalink
from siftwell.spec import Criteria, UrlSpec


def request_body(text: Column) -> Column:
    part = F.struct(text.alias("text"))
    content = F.struct(F.array(part).alias("parts"))
    return F.struct(F.array(content).alias("contents"))


def render_requests(items: DataFrame, criteria: Criteria, url: UrlSpec) -> DataFrame:
    """One request per post.

    The prompt adds over a kilobyte of constant text to every post, so this
    belongs after the last shuffle, right before the model or the sink.
    """
    key = request_key(F.col("item_id"))
    return items.select(
        key.alias("key"),
        permalink(key, url).alias("tweet_url"),
        request_body(prompt(F.col("item_text"), criteria)).alias("request"),
        "chunk_id",
    )


def request_lines(requests: DataFrame) -> DataFrame:
    """Chunk, key and the request as the JSON line a model service takes."""
    line = F.to_json(F.struct("key", "tweet_url", "request"))
    return requests.select("chunk_id", "key", line.alias("line"))
