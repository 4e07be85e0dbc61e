"""Text form of a vertex state row (the per-level text sink)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def state_text(id_: Column, community: Column, t: Column, int_w: Column, out_w: Column,
               int_n: Column, n: Column, a: Column) -> Column:
    """`(id,{ community: c, communitySigmaTotal: t, internalWeight: .., nodeWeight: ..,
    internalVertices: .., communityVertices: n, communityInternalWeight: a })`."""
    return F.format_string(
        "(%d,{ community: %d, communitySigmaTotal: %d, internalWeight: %d, nodeWeight: %d, "
        "internalVertices: %d, communityVertices: %d, communityInternalWeight: %d })",
        id_, community, t, int_w, out_w, int_n, n, a,
    )
