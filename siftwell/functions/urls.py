"""Permanent links of posts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.spec import UrlSpec

_MARK = "\x00id\x00"


def permalink(item_id: Column, spec: UrlSpec) -> Column:
    """The URL pattern is filled once on the driver; tasks only concatenate."""
    pieces = spec.base_url.format(user=spec.user, id=_MARK).split(_MARK)
    parts = [F.lit(pieces[0])]
    for piece in pieces[1:]:
        parts += [item_id, F.lit(piece)]
    return F.concat(*parts)
