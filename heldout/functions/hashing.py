"""Hash-based identities, seeds and orders, all JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_63_LESS_ONE = "9223372036854775807"


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def key(*parts) -> Column:
    """Composite key: the parts joined by '|'. Strings name columns; pass F.lit for constants."""
    return F.concat_ws("|", *[_col(p).cast("string") for p in parts])


def sha256(*parts) -> Column:
    """Hex SHA-256 of the composite key; hex order equals digest order."""
    return F.sha2(key(*parts), 256)


def stable_seed(*parts) -> Column:
    """First 64 hash bits modulo 2^63 - 1, as a long."""
    head = F.conv(F.substring(sha256(*parts), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % F.lit(TWO_63_LESS_ONE).cast("decimal(20,0)")).cast("long")


def hash_mod(hex_digest: Column, n) -> Column:
    """The 256-bit number written in ``hex_digest`` modulo ``n`` (n below 2^47)."""
    n = n if isinstance(n, Column) else F.lit(n)
    n = n.cast("long")
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(15)),
        F.lit(0).cast("long"),
        lambda acc, i: (
            acc * F.lit(65536).cast("long")
            + F.conv(F.substring(hex_digest, i * 4 + 1, F.lit(4)), 16, 10).cast("long")
        )
        % n,
    )


def unit_interval(*parts) -> Column:
    """First 32 hash bits scaled to [0, 1)."""
    return F.conv(F.substring(sha256(*parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_index(n, *parts) -> Column:
    """First 60 hash bits modulo ``n``: a cheap seeded index for resampling."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.conv(F.substring(sha256(*parts), 1, 15), 16, 10).cast("long") % n.cast("long")


def row_digest(columns) -> Column:
    """SHA-256 of one row as JSON with its fields in name order; NULL fields are left out."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def config_hash(config: dict) -> str:
    """Hash of a small configuration mapping, independent of key order."""
    import hashlib
    import json

    text = json.dumps(config, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return hashlib.sha256(text.encode()).hexdigest()
