"""Running values over keys that may hold any share of the rows.

A window per key sorts a whole key in one task. Here a key's timeline is cut into buckets of fixed
width; ordinary windows run per (key, bucket), and only one summary row per bucket is carried on from
bucket to bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_of(position: Column, width: int) -> Column:
    """The bucket of a whole-number position (floor division, so negative positions are ordered too)."""
    return F.floor(position / F.lit(width)).cast("long")


def carry_forward(
    df: DataFrame, keys: list[str], bucket: str, summary: dict[str, Column], carried: dict[str, Column]
) -> DataFrame:
    """Adds to every row values computed from the *earlier* buckets of its key.

    ``summary`` maps names to aggregates per (key, bucket); ``carried`` maps new column names to
    aggregates over those names, taken over all earlier buckets of the key. The summary has one row
    per bucket in which a key occurs, so its window stays small however many rows a key has. Null
    keys match each other.
    """
    ks = [*keys, bucket]
    small = df.groupBy(*ks).agg(*[c.alias(n) for n, c in summary.items()])
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    small = small.select(*[F.col(k).alias(f"__{k}") for k in ks], *[c.over(before).alias(n) for n, c in carried.items()])
    nullable = {f.name for f in df.schema if f.nullable}
    on = None
    for k in ks:  # plain equality keeps the distribution of the windows before it
        eq = F.col(k).eqNullSafe(F.col(f"__{k}")) if k in nullable else F.col(k) == F.col(f"__{k}")
        on = eq if on is None else on & eq
    return df.join(small, on, "left").drop(*[f"__{k}" for k in ks])
