"""Protocol, address and port normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WELL_KNOWN_MAX = 1024


def protocol(c: Column) -> Column:
    text = F.upper(F.trim(c.cast("string")))
    return (
        F.when(text.isin("6", "6.0"), F.lit("TCP"))
        .when(text.isin("17", "17.0"), F.lit("UDP"))
        .when(text.isin("1", "1.0"), F.lit("ICMP"))
        .when(text.isin("0", "0.0"), F.lit(None).cast("string"))
        .otherwise(text)
    )


def address(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def port(c: Column) -> Column:
    """Port number from an integer or from float text; anything else is null."""
    value = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(value), value.try_cast("int"))


def service_port(a: Column, b: Column) -> Column:
    """Smallest well-known port if there is one, else the smallest port."""
    known = F.least(F.when(a <= WELL_KNOWN_MAX, a), F.when(b <= WELL_KNOWN_MAX, b))
    return F.coalesce(known, F.least(a, b))


def address_pair(a: Column, b: Column) -> Column:
    """Both addresses in sorted order; null unless both are known."""
    return F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("|", F.least(a, b), F.greatest(a, b)))


def _endpoint(ip: Column, p: Column) -> Column:
    return F.concat(F.coalesce(ip, F.lit("")), F.lit(":"), F.coalesce(p.cast("string"), F.lit("")))


def conversation(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column) -> Column:
    """Direction-free key of a conversation.

    Two records share it exactly when their endpoints agree in the given or in the
    reversed direction; a missing address or port equals a missing one.
    """
    a, b = _endpoint(src_ip, src_port), _endpoint(dst_ip, dst_port)
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))
