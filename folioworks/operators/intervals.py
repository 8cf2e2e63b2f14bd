"""Overlapping and gapped time intervals (problem 1) and temporal joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.operators.prefix import bucket_of, carry_forward

OFF_AIR_MS = 21_600_000
BUCKET_MS = 3_600_000


def to_ms(seconds: Column) -> Column:
    """Seconds as whole milliseconds; null for null, NaN, infinite and whatever no bigint holds."""
    ms = F.round(seconds * 1000)
    return F.when(F.abs(ms) < F.lit(2.0**63), ms.cast("long"))


def coverage(
    df: DataFrame,
    key: str | list[str],
    start_seconds: str = "start_seconds",
    end_seconds: str = "end_seconds",
    off_air_ms: int = OFF_AIR_MS,
    bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Continuous covered periods of every ``key`` and the gaps between them.

    Returns ``(<key>, kind, start_ms, end_ms)`` with ``kind`` ``period`` or ``gap``; ``key`` names one column or several.

    Method: spans are sorted by start per key, each start is compared with the running maximum of the
    earlier ends, islands are labelled cumulatively and aggregated; a gap lies between that running
    maximum and the start of the next island. Equal starts are pre-aggregated to their latest end, so
    a (key, bucket) window holds at most ``bucket_ms`` rows whatever the size of the key; across
    buckets only one running maximum and one label per bucket are carried.

    Defined cases: rows with a null, NaN, infinite, zero-length or reversed span, or one whose milliseconds
    no bigint holds, don't count; touching spans are continuous; repeated rows and ties change nothing; a null key is a key
    of its own; an empty table gives an empty result; other columns are ignored, whatever their names.
    Gaps of ``off_air_ms`` or more are left out.
    """
    names = [key] if isinstance(key, str) else list(key)
    ks = [f"k{i}" for i in range(len(names))]
    spans = (
        df.select(
            *[F.col(n).alias(k) for n, k in zip(names, ks, strict=True)], to_ms(F.col(start_seconds)).alias("s"), to_ms(F.col(end_seconds)).alias("e")
        )
        .where("s is not null and e is not null and e > s")
        .groupBy(*ks, "s")
        .agg(F.max("e").alias("e"))
        .withColumn("b", bucket_of(F.col("s"), bucket_ms))
    )
    # islands within a bucket
    here = Window.partitionBy(*ks, "b").orderBy("s")
    local = (
        spans.withColumn("run", F.max("e").over(here.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("label", F.sum(F.when(F.col("s") <= F.col("run"), 0).otherwise(1)).over(here))
        .groupBy(*ks, "b", "label")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
    )
    # the running maximum of all earlier buckets decides which of them begin a period
    local = carry_forward(local, ks, "b", {"be": F.max("e")}, {"before": F.max("be")})
    marked = (
        local.withColumn("run", F.max("e").over(here.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("prev", F.greatest("run", "before"))
        .withColumn("begins", F.col("prev").isNull() | (F.col("s") > F.col("prev")))
        .withColumn("island", F.sum(F.col("begins").cast("long")).over(here))
    )
    marked = carry_forward(
        marked.select(*ks, "b", "s", "e", "prev", "begins", "island"),
        ks, "b", {"n": F.max("island")}, {"earlier": F.sum("n")},
    )
    periods = (
        marked.withColumn("island", F.col("island") + F.coalesce("earlier", F.lit(0)))
        .groupBy(*ks, "island")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max(F.when(F.col("begins"), F.col("prev"))).alias("prev"))
    )
    rows = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("s").alias("start_ms"), F.col("e").alias("end_ms")),
        F.struct(F.lit("gap").alias("kind"), F.col("prev").alias("start_ms"), F.col("s").alias("end_ms")),
    )
    return (
        periods.select(*[F.col(k).alias(n) for n, k in zip(names, ks, strict=True)], F.explode(rows).alias("r"))
        .select(*names, "r.*")
        .where(f"kind = 'period' or (start_ms is not null and coalesce(try_subtract(end_ms, start_ms) < {int(off_air_ms)}, false))")
    )
