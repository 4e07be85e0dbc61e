"""IPv4 <-> BIGINT conversion as native column expressions (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
# Fixed value: a dotted quad, four decimal octets of one to three digits, each at most 255.
DOTTED_QUAD = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def is_ipv4(s: Column) -> Column:
    return F.coalesce(s.rlike(DOTTED_QUAD), F.lit(False))


def ip_to_long_unchecked(s: Column) -> Column:
    """Unsigned 32-bit value of a dotted quad; null when the text is not one."""
    octets = [F.substring_index(F.substring_index(s, ".", k), ".", -1).cast("bigint") for k in range(1, 5)]
    value = ((octets[0] * 256 + octets[1]) * 256 + octets[2]) * 256 + octets[3]
    return F.when(s.rlike(DOTTED_QUAD), value)


def ip_to_long(s: Column) -> Column:
    """Dotted quad -> BIGINT; any other text raises (host names are not resolved)."""
    return F.coalesce(ip_to_long_unchecked(s), F.raise_error(
        F.concat(F.lit("not a dotted quad: "), F.coalesce(s, F.lit("null")))).cast("bigint"))


def long_to_ip(x: Column) -> Column:
    """Low 32 bits of a BIGINT as a dotted quad."""
    return F.concat_ws(
        ".",
        *[F.shiftright(x, k).bitwiseAND(255).cast("string") for k in (24, 16, 8, 0)],
    )
