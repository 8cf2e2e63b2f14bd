"""Alignment of keyframes and speech in time, cuts and near-duplicate frames."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions.text import minutes_seconds, strip
from folioworks.operators.prefix import bucket_of

SILENCE = "*(Silence or ambient audio)*"
BUCKET_MS = 600_000


def neighbours(df: DataFrame, keys: list[str], order: str, bucket: str, ties: list[str]) -> DataFrame:
    """Adds ``before`` and ``after``: the value of ``order`` in the rows before and after, by key.

    Windows run per (key, bucket); the edges of a bucket come from one summary row per bucket.
    """
    here = Window.partitionBy(*keys, bucket).orderBy(order, *ties)
    by_bucket = Window.partitionBy(*keys).orderBy(bucket)
    edges = (
        df.groupBy(*keys, bucket)
        .agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
        .select(*keys, bucket, F.lag("hi").over(by_bucket).alias("__hi"), F.lead("lo").over(by_bucket).alias("__lo"))
    )
    return (
        df.join(edges, [*keys, bucket])
        .withColumn("before", F.coalesce(F.lag(order).over(here), "__hi"))
        .withColumn("after", F.coalesce(F.lead(order).over(here), "__lo"))
        .drop("__hi", "__lo")
    )


def scene_bounds(frames: DataFrame, durations: DataFrame, bucket_ms: int = 3_600_000) -> DataFrame:
    """Scenes around keyframes: from the middle to the frame before to the middle to the frame after.

    ``frames`` has ``(video_id, frame_id, at_ms)``, ``durations`` ``(video_id, duration_ms)``. The first scene
    begins at 0, the last ends with the video. Returns ``(video_id, frame_id, at_ms, start_cs, end_cs)`` in
    hundredths of a second, rounded half up.
    """
    rows = neighbours(frames.withColumn("b", bucket_of(F.col("at_ms"), bucket_ms)), ["video_id"], "at_ms", "b", ["frame_id"])
    middle = lambda a, b: F.floor((a + b + 10) / 20)
    whole = F.floor((F.col("duration_ms") + 5) / 10)
    start = F.greatest(F.lit(0), F.when(F.col("before").isNull(), F.lit(0)).otherwise(middle(F.col("before"), F.col("at_ms"))))
    end = F.when(F.col("after").isNull(), whole).otherwise(F.least(whole, middle(F.col("at_ms"), F.col("after"))))
    return (
        rows.join(durations, "video_id")
        .select("video_id", "frame_id", "at_ms", start.cast("long").alias("start_cs"), end.cast("long").alias("end_cs"))
        .withColumn("end_cs", F.greatest("start_cs", "end_cs"))
    )


#: Each level of buckets is this many times as wide as the one before; the widest holds any time in milliseconds.
LEVEL, LEVELS = 8, 16


def overlapping_pairs(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of spans of one ``key`` that overlap or touch.

    Both sides have ``key`` and ``<l|r>_start``, ``<l|r>_end`` in whole numbers. A span belongs to the level
    whose buckets (of ``width``, 8 x ``width``, ...) are as wide as it is long, so it meets two of them at
    most, whatever its length. Two spans are joined on (key, level, bucket) at the wider one's level, in the
    first bucket they share, so a long recording is spread over many tasks and no pair is found twice. A
    span stands at its own level and at those wider ones that occur (they are looked up first; usually there
    is one). Rows without both bounds or with an end before the start have no pairs.
    """

    def levelled(df: DataFrame, side: str) -> DataFrame:
        a, b = F.col(f"{side}_start"), F.col(f"{side}_end")
        length = (b - a).cast("double")
        level = reduce(add, [(length > float(width) * LEVEL**k).cast("int") for k in range(LEVELS)])
        return df.where(a.isNotNull() & b.isNotNull() & (b >= a)).withColumn("__own", level)

    sides = {s: levelled(df, s) for s, df in (("l", left), ("r", right))}
    there = sides["l"].select("__own").unionByName(sides["r"].select("__own")).distinct().collect()  # at most LEVELS + 1 rows
    levels = sorted(r[0] for r in there)

    def spread(side: str) -> DataFrame:
        a, b = F.col(f"{side}_start"), F.col(f"{side}_end")
        wide = F.lit(float(width)) * F.pow(F.lit(float(LEVEL)), F.col("__level"))
        df = sides[side].withColumn("__level", F.explode(F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x >= F.col("__own"))))
        df = df.withColumns({"__from": F.floor(a / wide).cast("long"), "__to": F.floor(b / wide).cast("long")})
        return df.withColumn("__bucket", F.explode(F.sequence("__from", "__to"))).drop("__to").withColumnsRenamed({"__own": f"__own_{side}", "__from": f"__from_{side}"})

    return (
        spread("l")
        .join(spread("r"), [key, "__level", "__bucket"])
        .where((F.col("r_end") >= F.col("l_start")) & (F.col("r_start") <= F.col("l_end")))
        .where((F.col("__level") == F.greatest("__own_l", "__own_r")) & (F.col("__bucket") == F.greatest("__from_l", "__from_r")))
        .drop("__level", "__bucket", "__own_l", "__own_r", "__from_l", "__from_r")
    )


def align_speech(scenes: DataFrame, segments: DataFrame, width_ms: int = BUCKET_MS) -> DataFrame:
    """What is said in each scene, in order; silence where nothing is.

    ``scenes`` has ``(video_id, scene_id, start_ms, end_ms)``, ``segments`` ``(video_id, segment_id, start_ms,
    end_ms, text)``. Bounds are closed, so a segment on the edge of two scenes belongs to both.
    """
    left = scenes.select("video_id", "scene_id", F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end"))
    right = segments.select("video_id", "segment_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), F.trim("text").alias("text"))
    said = (
        overlapping_pairs(left, right, "video_id", width_ms)
        .where("text is not null")
        .groupBy("video_id", "scene_id")
        .agg(F.sort_array(F.collect_list(F.struct("r_start", "segment_id", "text"))).alias("s"))
        .select("video_id", "scene_id", F.trim(F.array_join("s.text", " ")).alias("said"))
    )
    shown = F.concat(minutes_seconds(F.col("start_ms") / 1000), F.lit(" - "), minutes_seconds(F.col("end_ms") / 1000))
    return scenes.join(said, ["video_id", "scene_id"], "left").select(
        "video_id", "scene_id", "start_ms", "end_ms", shown.alias("timestamp_display"),
        F.when(F.coalesce("said", F.lit("")) == "", SILENCE).otherwise(F.col("said")).alias("spoken_transcript"),
    )


def spoken_segments(df: DataFrame, keys: list[str], start: str, end: str, text: str) -> DataFrame:
    """Segments of recognised speech: bounds in hundredths of a second, texts trimmed, those without words left out.

    Numbers of segments stay as they are, so they have gaps where a segment was empty.
    """
    said = strip(F.col(text))
    cents = lambda c: F.round(F.col(c) * 100) / 100 + F.lit(0.0)  # noqa: E731  (of a hundred times the number, not of the decimal it is written as)
    return df.where(F.coalesce(said, F.lit("")) != "").select(*keys, cents(start).alias("start_seconds"), cents(end).alias("end_seconds"), said.alias("text"))


def fallback_segments(durations: DataFrame, seconds: int = 10) -> DataFrame:
    """Scenes of ``seconds`` for a video without cuts; at least one, and none for a shorter rest.

    ``durations`` has ``(video_id, duration_ms)``; returns ``(video_id, scene_no, start_ms, end_ms)``. Scenes
    are listed in two steps, so that no array grows with a video's length but by its hundred thousands.
    """
    step, block = seconds * 1000, 100_000
    last = F.greatest(F.lit(1), F.floor(F.col("duration_ms") / step)).cast("long") - 1
    rows = durations.select("video_id", "duration_ms", last.alias("last"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / block).cast("long"))))
    inner = F.sequence(F.col("block") * block, F.least(F.col("last"), F.col("block") * block + (block - 1)))
    rows = rows.select("video_id", "duration_ms", F.explode(inner).alias("scene_no"))
    start = F.col("scene_no") * step
    return rows.select("video_id", "scene_no", start.alias("start_ms"), F.least(F.col("duration_ms"), start + step).alias("end_ms"))


def cut_intervals(df: DataFrame, key: str, at: str, corr: str, min_gap: float = 1.5, threshold: float = 0.65) -> DataFrame:
    """The intervals between the cuts of every ``key``: ``(<key>, start_at, end_at)``, the last one up to its last sample.

    A sample is a cut where ``corr`` is below the threshold and the last cut lies at least ``min_gap`` back.
    Each cut depends on the last one, so a key is one task; but its sorted samples stream through it, and
    only the last cut is held, so no key is ever gathered. Null keys and samples with a null don't count.
    """
    types = dict(df.dtypes)
    rows = df.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(corr).isNotNull())
    rows = rows.select(F.col(key), F.col(at).cast("double").alias("__at"), F.col(corr).cast("double").alias("__corr"))
    rows = rows.repartition(key).sortWithinPartitions(key, "__at", "__corr")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last, latest = None, 0.0, 0.0
        for frame in frames:
            out = []
            for k, t, c in zip(frame.iloc[:, 0].tolist(), frame["__at"].tolist(), frame["__corr"].tolist(), strict=True):
                if k != now:
                    if now is not None and latest > last:
                        out.append((now, last, latest))
                    now, last = k, 0.0
                latest = t
                if c < threshold and t - last >= min_gap:
                    out.append((k, last, t))
                    last = t
            yield pd.DataFrame(out, columns=[key, "start_at", "end_at"])
        if now is not None and latest > last:
            yield pd.DataFrame([(now, last, latest)], columns=[key, "start_at", "end_at"])

    return rows.mapInPandas(run, f"`{key}` {types[key]}, start_at double, end_at double")


def cut_fold(samples: Column, min_gap: float = 1.5, threshold: float = 0.65, duration: Column | None = None) -> Column:
    """Cuts among time-ordered samples ``struct<at, corr>``: where ``corr`` is below the threshold and the last cut
    lies at least ``min_gap`` back. Returns ``array<struct<start_at, end_at>>``; with ``duration``, what lies
    between the last cut and it is the last interval.

    A fold, as each cut depends on the last one; the array is one video's samples.
    """
    span = "struct<start_at:double,end_at:double>"
    start = F.struct(F.array().cast(f"array<{span}>").alias("cuts"), F.lit(0.0).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        cut = (x["corr"] < threshold) & (x["at"] - acc["last"] >= min_gap)
        this = F.array(F.struct(acc["last"].alias("start_at"), x["at"].alias("end_at")).cast(span))
        return F.struct(F.when(cut, F.concat(acc["cuts"], this)).otherwise(acc["cuts"]).alias("cuts"), F.when(cut, x["at"]).otherwise(acc["last"]).alias("last"))

    def finish(acc: Column) -> Column:
        if duration is None:
            return acc["cuts"]
        tail = F.array(F.struct(acc["last"].alias("start_at"), duration.alias("end_at")).cast(span))
        return F.when(duration > acc["last"], F.concat(acc["cuts"], tail)).otherwise(acc["cuts"])

    return F.aggregate(samples, start, step, finish)


def sampled_scenes(df: DataFrame, key: str, number: str, start: str, end: str, least: int = 1500) -> DataFrame:
    """The scenes of which a frame is taken: a video's first, which is always kept, and all of at least ``least`` after it."""
    first = df.groupBy(F.col(key).alias("__key")).agg(F.min(F.struct(start, number, end)).alias("__first"))
    is_first = F.struct(start, number, end) == F.col("__first")
    return df.join(first, F.col(key).eqNullSafe(F.col("__key"))).where(is_first | (F.col(end) - F.col(start) >= least)).drop("__key", "__first")


def sample_point(start: Column, end: Column, share: float = 0.8) -> Column:
    """Where a scene's frame is taken: when four fifths of it are over."""
    return start + (end - start) * share


def unlike_frames(df: DataFrame, key: str, order: str, frame_hash: str, max_distance: int = 7) -> DataFrame:
    """Every frame with the kept frame it repeats: ``(<key>, <order>, <hash>, kept, kept_at)``.

    In order, a frame is kept unless its 64-bit hash is within ``max_distance`` bits of one kept before. The
    decision depends on all earlier ones of its video, so a video is one task; its sorted frames stream
    through it and only the kept hashes are held, 16 bytes each. With up to 7 bits they are looked up by the
    parts of 8 bits and more that must agree (of d + 1 parts of a hash at least one does); with more, parts
    would be too short to tell hashes apart, so they are compared as one array.
    """
    types = dict(df.dtypes)
    parts = max_distance + 1
    edges = [round(64 * k / parts) for k in range(parts + 1)]
    rows = df.where(F.col(frame_hash).isNotNull() & F.col(order).isNotNull()).select(key, order, frame_hash)
    rows = rows.repartition(key).sortWithinPartitions(key, order)

    class Kept:
        def __init__(self):
            self.hashes, self.orders = np.zeros(1024, np.uint64), []
            self.at: list[dict[int, list[int]]] = [{} for _ in range(parts)]

        def keys(self, bits: int) -> list[int]:
            return [(bits >> edges[k]) & ((1 << (edges[k + 1] - edges[k])) - 1) for k in range(parts)]

        def like(self, bits: int) -> int:
            """The first kept frame that is alike, or -1."""
            n = len(self.orders)
            if max_distance > 7:
                near = np.bitwise_count(self.hashes[:n] ^ np.uint64(bits)) <= max_distance
                return int(near.argmax()) if near.any() else -1
            found = {i for d, k in zip(self.at, self.keys(bits), strict=True) for i in d.get(k, ())}
            return min((i for i in found if (int(self.hashes[i]) ^ bits).bit_count() <= max_distance), default=-1)

        def add(self, bits: int, o) -> None:
            n = len(self.orders)
            if n == len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros(n, np.uint64)])
            self.hashes[n] = bits
            self.orders.append(o)
            if max_distance <= 7:
                for d, k in zip(self.at, self.keys(bits), strict=True):
                    d.setdefault(k, []).append(n)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seen, fresh = None, Kept(), True
        for pdf in frames:
            kept, at = [], []
            for v, o, h in zip(pdf[key].tolist(), pdf[order].tolist(), pdf[frame_hash].tolist(), strict=True):
                if fresh or v != now and not (v is None and now is None):
                    now, seen, fresh = v, Kept(), False
                bits = int(h) & (2**64 - 1)
                i = seen.like(bits)
                kept.append(i < 0)
                at.append(o if i < 0 else seen.orders[i])
                if i < 0:
                    seen.add(bits, o)
            yield pd.DataFrame({key: pdf[key], order: pdf[order], frame_hash: pdf[frame_hash], "kept": kept, "kept_at": at})

    ddl = f"`{key}` {types[key]}, `{order}` {types[order]}, `{frame_hash}` {types[frame_hash]}, kept boolean, kept_at {types[order]}"
    return rows.mapInPandas(run, ddl)


def sign_hash(vector: Column) -> Column:
    """A 64-bit hash of a whole vector: bit i is set where the elements i, i + 64, i + 128, ... sum up above 0."""
    n = F.size(vector)
    strides = F.sequence(F.lit(0), F.floor((n - 1) / 64).cast("int"))
    total = lambda i: F.aggregate(strides, F.lit(0.0), lambda a, s: a + F.coalesce(F.get(vector, s * 64 + i).cast("double"), F.lit(0.0)))
    bit = lambda i: F.when(total(i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), bit)
    return F.when(n > 0, F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)))


def histogram_correlation(hist: DataFrame, key: str, frame: str, bins: int = 256) -> DataFrame:
    """The correlation of each frame's histogram with the one before it: ``(<key>, <frame>, corr)``.

    ``hist`` has ``(key, frame, bin, n)``; bins that are missing count as 0. From sums only: no bin is filled in.
    """
    per = hist.groupBy(key, frame).agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    w = Window.partitionBy(key).orderBy(frame)
    per = per.withColumn("prev", F.lag(frame).over(w)).withColumn("s0", F.lag("s").over(w)).withColumn("q0", F.lag("q").over(w))
    a = hist.select(key, frame, "bin", F.col("n").alias("n1"))
    b = hist.select(key, F.col(frame).alias("prev"), "bin", F.col("n").alias("n0"))
    cross = (
        a.join(per.select(key, frame, "prev"), [key, frame]).join(b, [key, "prev", "bin"]).groupBy(key, frame).agg(F.sum(F.col("n0") * F.col("n1")).alias("x"))
    )
    num = F.coalesce("x", F.lit(0)) - F.col("s") * F.col("s0") / bins
    den = F.sqrt((F.col("q") - F.col("s") * F.col("s") / bins) * (F.col("q0") - F.col("s0") * F.col("s0") / bins))
    return per.where("prev is not null").join(cross, [key, frame], "left").select(key, frame, F.try_divide(num, den).alias("corr"))
