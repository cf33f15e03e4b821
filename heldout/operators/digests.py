"""Order-free digests of tables, manifests and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import row_digest, sha256
from .durable import durable, small


def _word(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")


def combine_digests(df: DataFrame, digest: str = "digest", group=()) -> DataFrame:
    """One digest per group from row digests: count and eight word sums, hashed.

    Sums need no sort and no long string, so any number of rows is merged map-side.
    """
    sums = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("row_count"), *[F.sum(_word(F.col(digest), i)).alias(f"_w{i}") for i in range(8)]
    )
    text = F.concat_ws("|", F.col("row_count").cast("string"), *[F.col(f"_w{i}").cast("string") for i in range(8)])
    return sums.select(*group, "row_count", F.sha2(text, 256).alias("table_digest"))


def table_digest(df: DataFrame, columns=None, group=()) -> DataFrame:
    """Digest of a table as a multiset of rows; column order and row order do not matter."""
    columns = columns or [c for c in df.columns if c not in group]
    return combine_digests(df.select(*group, row_digest(columns).alias("digest")), "digest", group)


def verify_digests(expected: DataFrame, observed: DataFrame, name: str, value: str) -> DataFrame:
    """Full-outer comparison of two (name, digest) manifests with a status per name."""
    e = expected.select(name, F.col(value).alias("expected"))
    o = observed.select(name, F.col(value).alias("observed"))
    status = (
        F.when(F.col("observed").isNull(), "MISSING")
        .when(F.col("expected").isNull(), "UNEXPECTED")
        .when(F.col("expected") != F.col("observed"), "HASH_MISMATCH")
        .otherwise("MATCH")
    )
    return e.join(o, name, "full_outer").withColumn("status", status)


def _sums(df: DataFrame, group: list[str]) -> DataFrame:
    """Additive parts of a digest: rows and eight word sums of column ``digest``, as long numbers; a group holds less than 2^31 rows."""
    word = lambda i: F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long")
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(word(i)).alias(f"w{i}") for i in range(8)])


def digest_tree(df: DataFrame, key: list[str], levels: tuple[int, ...] = (1, 3, 5)) -> tuple[DataFrame, dict[int, DataFrame]]:
    """(rows with key, ``place`` and ``digest`` over all columns; per level the sums of each prefix of ``place``).

    ``place`` is the hash of the key, so a row keeps its leaf when other
    columns change. Sums add up, so each level comes from the one below.
    """
    rows = durable(df.select(*key, F.substring(sha256(*key), 1, max(levels)).alias("place"), row_digest(df.columns).alias("digest")))
    tree, below = {}, durable(_sums(rows, ["place"]))
    for level in sorted(levels, reverse=True):
        parts = [F.sum("rows").alias("rows"), *[F.sum(F.col(f"w{i}").cast("decimal(38,0)")).alias(f"w{i}") for i in range(8)]]
        below = tree[level] = durable(below.groupBy(F.substring("place", 1, level).alias("place")).agg(*parts))
    return rows, tree


def _unlike(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose sums differ, or that one side lacks."""
    words = ["rows", *[f"w{i}" for i in range(8)]]
    left, right = (t.select(*key, F.struct(*words).alias(name)) for t, name in ((a, "_a"), (b, "_b")))
    return left.join(right, key, "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(*key, F.when(F.col("_b").isNull(), "REMOVED").when(F.col("_a").isNull(), "ADDED").otherwise("CHANGED").alias("change"))


def changed_rows(before: tuple[DataFrame, dict[int, DataFrame]], after: tuple[DataFrame, dict[int, DataFrame]], key: list[str]) -> DataFrame:
    """(key, change) of the rows that two digest trees tell apart: ADDED, REMOVED or CHANGED.

    Levels are compared from the top; below it only children of prefixes that
    differ are looked at, and rows are read for differing leaves only. Rows that
    share a key are compared as a multiset. Keys hold no NULL.
    """
    (rows_a, tree_a), (rows_b, tree_b) = before, after
    found, above = None, None
    for level in sorted(tree_a):
        a, b = tree_a[level], tree_b[level]
        if found is not None:
            up = F.substring("place", 1, above)
            a, b = (t.withColumn("_up", up).join(found.select(F.col("place").alias("_up")), "_up", "left_semi").drop("_up") for t in (a, b))
        found, above = small(_unlike(a, b, ["place"])), level
    a, b = (_sums(rows.join(found.select("place"), "place", "left_semi"), key) for rows in (rows_a, rows_b))
    return _unlike(a, b, key)


def binding_differences(a: DataFrame, b: DataFrame, key: str, bindings: str) -> DataFrame:
    """Rows where two map columns differ, one per (key, name)."""
    left = a.select(key, F.explode(bindings).alias("name", "left_value"))
    right = b.select(key, F.explode(bindings).alias("name", "right_value"))
    return left.join(right, [key, "name"], "full_outer").filter(~F.col("left_value").eqNullSafe(F.col("right_value")))


def stamp(df: DataFrame, *, seed: int, fold: str, method: str, config: dict) -> DataFrame:
    """Run metadata as literal columns, with the hash of the sorted configuration."""
    from ..functions.hashing import config_hash

    if seed < 0 or not str(fold).strip() or not method.strip():
        raise ValueError("seed must not be negative; fold and method must not be blank")
    return df.select("*", F.lit(seed).alias("seed"), F.lit(str(fold)).alias("fold"), F.lit(method).alias("method"),
                     F.lit(config_hash(config)).alias("config_hash"))


def snapshot_contract(df: DataFrame, expected: dict[str, tuple[Column, object]]) -> DataFrame:
    """One row: the names of the aggregates that differ from their frozen value, and the outcome."""
    row = df.agg(*[a.alias(n) for n, (a, _) in expected.items()])
    failed = F.array_compact(F.array(*[F.when(~F.col(n).eqNullSafe(F.lit(v)), F.lit(n)) for n, (_, v) in expected.items()]))
    return row.withColumn("failed", F.array_sort(failed)).withColumn("outcome", F.when(F.size("failed") == 0, "PASS").otherwise("BLOCKED"))
