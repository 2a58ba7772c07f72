"""Ids of posts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.fixed_values import UNKNOWN_ID

# White space as str.strip() sees it: Unicode white space and four separators.
_BLANK = r"[\s\x1c-\x1f]"


def resolve_id(id_str: Column, id_: Column) -> Column:
    """id_str unless empty, else id unless empty or zero, else null."""
    return F.coalesce(F.nullif(id_str, F.lit("")), F.when(~id_.isin("", "0"), id_))


def request_key(item_id: Column) -> Column:
    return F.coalesce(item_id, F.lit(UNKNOWN_ID))


def store_key(item_id: Column) -> Column:
    """The id without white space around it: what the verdict store joins on."""
    return F.regexp_replace(item_id, rf"(?U)^{_BLANK}+|{_BLANK}+$", "")


def is_valid_id(item_id: Column) -> Column:
    return item_id.isNotNull() & (item_id != "") & (item_id != UNKNOWN_ID)
