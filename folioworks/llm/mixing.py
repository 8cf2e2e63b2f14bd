"""Mixing sources to target weights (problem 7)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioworks.llm.tokens import TOKENIZER, with_tokens
from folioworks.session import checkpoint

#: Size of a scheduled block in tokens.
BLOCK_TOKENS = 8192
#: Blocks of a recipe's schedule at most; beyond, blocks are made larger, so that one task can schedule a recipe.
MAX_BLOCKS = 1 << 20
#: Tokens of a hash bucket, which is ordered by one task.
BUCKET_TOKENS = 1 << 24


def exact_shares(weights: list[float | None]) -> tuple[list[int], int]:
    """The shares of weights as whole numbers over one common denominator, exactly as the decimals say."""
    parts = [Fraction(str(w)) if w and w > 0 and math.isfinite(w) else Fraction(0) for w in weights]
    total = sum(parts)
    if not total:
        return [0] * len(parts), 1
    shares = [p / total for p in parts]
    whole = math.lcm(*(s.denominator for s in shares))
    return [int(s * whole) for s in shares], whole


def pfair_slots(shares: list[int], whole: int, slots: int) -> Iterator[tuple[int, int, int]]:
    """The first ``slots`` slots of the Pfair schedule: (source, block of the source, slot).

    Block k of a source of weight w = share / whole is released at floor(k / w) and due at ceil((k + 1) / w),
    in whole numbers without rounding. Of the released blocks the one with the earliest deadline gets the
    next slot (ties: the successor bit, then the heavier source, then the source's place). Every block then
    lies in its window, so at any slot every source is less than one block from its share, for any weights
    and however long the schedule.
    """

    def due(s: int, k: int) -> tuple[int, int, int, int, int]:
        return -(-(k + 1) * whole // shares[s]), -((k + 1) * whole % shares[s] != 0), -shares[s], s, k

    waiting = [(0, s, 0) for s, n in enumerate(shares) if n]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int, int]] = []
    for slot in range(slots if waiting else 0):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, due(s, k))
        _, _, _, s, k = heapq.heappop(ready)
        yield s, k, slot
        heapq.heappush(waiting, ((k + 1) * whole // shares[s], s, k + 1))


class Mixture:
    """The result of ``mix_sources``: ``selection``, ``report`` and ``schedule``."""

    def __init__(self, selection: DataFrame, report: DataFrame, schedule: DataFrame):
        self.selection, self.report, self.schedule = selection, report, schedule


def mix_sources(
    df: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    block_tokens: int = BLOCK_TOKENS,
    bucket_tokens: int = BUCKET_TOKENS,
    tokenizer: str = TOKENIZER,
    max_blocks: int = MAX_BLOCKS,
) -> Mixture:
    """Selects records so that each source of a recipe contributes its share of the total size.

    ``targets`` holds ``(recipe, source, weight, max_repeats)``; it must be small (at most 100,000 rows,
    which is checked), as it is broadcast. The size of a mixture is that of all records of ``df``; a
    source's quota is its share of it. ``selection`` has ``(recipe, source, <key>, pass, tokens, slot)``: one row per use of a
    record, in pseudo-random order within its source, used again from the start in each further pass, at
    most ``max_repeats`` passes. ``slot`` is the place of the record's block in the recipe's Pfair
    schedule (``pfair_slots``); sorted by ``slot`` the mixture deviates from each target by less than one
    block (plus the record that crosses a block's edge) as long as every source lasts. A block has
    ``block_tokens``, or as many more as keep a recipe within ``max_blocks``. ``report`` has
    ``(recipe, source, target_share, actual_share, quota_tokens, available_tokens, used_tokens,
    reached)`` for every row of ``targets``.

    A record's place in its source is a running sum over hash buckets of about ``bucket_tokens`` and,
    within each, over its rows; a source with a third of all rows is spread over as many tasks. A recipe
    is scheduled by one task and its schedule is joined, not broadcast. Texts are read once, for their
    sizes, which are written to the checkpoint folder.

    Defined cases: null and empty texts have size 0 and aren't selected; null sources count in the total
    but belong to no recipe; sources without records or with null or non-positive weights or repeats are
    reported with what they can give; a source listed twice in one recipe counts with the sum of its weights
    and its largest ``max_repeats``; repeated rows are records of their own; an empty table selects nothing.
    """
    if targets.limit(100_001).count() > 100_000:
        raise ValueError("more than 100,000 targets")
    weight = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))
    recipes = (
        targets.where("source is not null and recipe is not null")
        .groupBy("recipe", "source")
        .agg(F.sum(weight).cast("double").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    )
    sizes = checkpoint(
        with_tokens(df.select(F.col(key).alias("k"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")), "text", path=tokenizer)
    )
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    block = max(block_tokens, -(-total // max_blocks))
    wanted = F.broadcast(recipes.select("source").distinct())
    wanted_sizes = sizes.where("tokens > 0").join(wanted, "source")
    per_source = wanted_sizes.groupBy("source").agg(F.sum("tokens").alias("size"))
    share = F.coalesce(F.try_divide(F.col("weight"), F.sum("weight").over(Window.partitionBy("recipe"))), F.lit(0.0))
    plan = (
        recipes.withColumn("target_share", share)
        .join(per_source, "source", "left")
        .select(
            "recipe", "source", "weight", "target_share", (F.col("target_share") * F.lit(float(total))).alias("quota"),
            F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).cast("long").alias("passes"), F.coalesce("size", F.lit(0)).cast("long").alias("size"),
        )
    )
    plan = checkpoint(plan)  # as many rows as targets

    n_slots = -(-total // block) + 1

    def schedule_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source", kind="stable")
        shares, whole = exact_shares(pdf["weight"].tolist())
        names = pdf["source"].tolist()
        # a source's last block may end beyond the mixture's size, so a slot for each source is added
        got = list(pfair_slots(shares, whole, n_slots + len(names)))
        columns = [[pdf["recipe"].iloc[0]] * len(got), [names[s] for s, _, _ in got], [k for _, k, _ in got], [t for _, _, t in got]]
        typed = zip(("recipe", "source", "block", "slot"), columns, (object, object, "int64", "int64"), strict=True)
        return pd.DataFrame({name: pd.Series(values, dtype=kind) for name, values, kind in typed})

    schedule = plan.select("recipe", "source", "weight").groupBy("recipe").applyInPandas(schedule_of, "recipe string, source string, block bigint, slot bigint")

    buckets = F.greatest(F.lit(1), F.ceil(F.col("size") / bucket_tokens)).cast("long")
    placed = (
        wanted_sizes.join(F.broadcast(plan.select("source", "size").distinct()), "source")
        .withColumn("bucket", F.pmod(F.xxhash64("k", F.lit("bucket")), buckets))
        .withColumn("at", F.xxhash64("k", F.lit("order")))
        .drop("size")
    )
    within = Window.partitionBy("source", "bucket").orderBy("at", "k", "tokens")
    offsets = placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = (
        placed.withColumn("inner", F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
        .join(offsets, ["source", "bucket"])
        .select("k", "source", "tokens", (F.col("offset") + F.col("inner")).alias("begin"))
    )
    uses = (
        placed.join(F.broadcast(plan), "source")
        .where("passes > 0 and begin < quota")
        .withColumn("last", F.least(F.col("passes"), F.ceil((F.col("quota") - F.col("begin")) / F.col("size"))))
        .withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") - 1)))
        .withColumn("block", F.floor((F.col("begin") + F.col("pass") * F.col("size")) / block).cast("long"))
        .select("recipe", "source", "k", F.col("pass").cast("int").alias("pass"), "tokens", "block")
    )
    # never broadcast: the schedule grows with the data
    selection = uses.join(schedule.hint("merge"), ["recipe", "source", "block"]).select("recipe", "source", F.col("k").alias(key), "pass", "tokens", "slot")
    used = uses.groupBy("recipe", "source").agg(F.sum("tokens").alias("used_tokens"))
    every = Window.partitionBy("recipe")
    report = (
        plan.join(used, ["recipe", "source"], "left")
        .withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)).cast("long"))
        .select(
            "recipe", "source", "target_share",
            F.try_divide(F.col("used_tokens").cast("double"), F.sum("used_tokens").over(every)).alias("actual_share"),
            F.col("quota").alias("quota_tokens"), (F.col("passes") * F.col("size")).alias("available_tokens"), "used_tokens",
            (F.col("used_tokens") >= F.col("quota")).alias("reached"),
        )
    )
    return Mixture(selection, report, schedule)
