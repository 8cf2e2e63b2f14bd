"""Filling fixed-capacity containers with items (problem 6)."""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioworks.llm.tokens import TOKENIZER, with_tokens
from folioworks.session import checkpoint

#: Tokens and items of one shard, which is packed by one task.
SHARD_TOKENS = 1 << 22
SHARD_ITEMS = 200_000
#: Containers of a shard that are opened again at most, and shards whose rests are packed together then.
REOPENED = 8
FAN_IN = 64
#: Most owed sources that are asked for a fitting item before the largest fitting item of any source is taken.
ASKED = 64


class _Queues:
    """The items still to be packed, by source and size, and the sizes there are as bits of one number."""

    def __init__(self, items: list[tuple[int, int, int]]):
        self.at: dict[tuple[int, int], list[int]] = {}
        self.sizes: dict[int, list[int]] = {}
        self.holders: dict[int, dict[int, None]] = {}
        self.mask = 0
        self.left = 0
        for size, source, i in sorted(items, reverse=True):
            self.put(size, source, i)

    def put(self, size: int, source: int, i: int) -> None:
        held = self.at.setdefault((size, source), [])
        if not held:
            insort(self.sizes.setdefault(source, []), size)
            self.holders.setdefault(size, {})[source] = None
            self.mask |= 1 << size
        held.append(i)
        self.left += 1

    def take(self, size: int, source: int) -> int:
        held = self.at[size, source]
        i = held.pop()
        if not held:
            own = self.sizes[source]
            own.pop(bisect_right(own, size) - 1)
            holders = self.holders[size]
            del holders[source]
            if not holders:
                self.mask ^= 1 << size
        self.left -= 1
        return i

    def largest(self, space: int) -> int:
        """The largest size of any source that fits into ``space``; -1 if none does."""
        return (self.mask & ((1 << (space + 1)) - 1)).bit_length() - 1

    def largest_of(self, source: int, space: int) -> int:
        own = self.sizes[source]
        k = bisect_right(own, space) - 1
        return own[k] if k >= 0 else -1


def pack_window_queue(
    items: list[tuple[int, int, int]], capacity: int, share: dict[int, float], owed: dict[int, float]
) -> tuple[list[tuple[int, int]], dict[int, float]]:
    """Packs ``items`` (size, source, index), each of at most ``capacity``, by deficit round-robin.

    A source's deficit is what it was owed at the start plus its ``share`` of all tokens packed so far less
    its own. The source whose deficit is largest in quanta (its share of a window) is served first, with
    its largest item that still fits; a source with nothing that fits waits for the next window. A window
    (container) is closed when no item of any queue fits. So that it gets full, an item of another source
    that leaves almost nothing is preferred, as is the largest fitting item of any source once ``ASKED``
    sources had none, and before a window is left with a rest, one of its items is exchanged for a larger
    one; the sources passed over stay owed and come first in the next window. Sources wait in a heap whose
    keys change only when they are served, so the time is that of a few heap operations an item, however
    many sources there are.

    Returns (index, window) pairs and the deficits at the end. Items of size 0 go into the first window.
    """
    out = [(i, 0) for size, _, i in items if not size]
    queues = _Queues([x for x in items if x[0]])
    served = {s: -owed.get(s, 0.0) for s in queues.sizes}
    packed, slack, window = 0, capacity >> 7, 0

    def place(s: int) -> tuple[float, float]:
        part = share.get(s, 0.0)
        return (served[s] / part, 0.0) if part > 0 else (float("inf"), served[s])

    heap = [(place(s), s) for s in served]
    heapq.heapify(heap)
    while queues.left:
        space = capacity
        held: list[tuple[int, int, int]] = []
        waiting: list[int] = []
        while (fits := queues.largest(space)) >= 0:
            size, source, popped = -1, -1, False
            while heap and len(waiting) < ASKED:
                key, s = heapq.heappop(heap)
                if not queues.sizes[s]:
                    continue
                if key != place(s):  # was served by another way; its own entry holds the right place
                    continue
                size = queues.largest_of(s, space)
                if size >= 0:
                    source, popped = s, True
                    break
                waiting.append(s)
            if source < 0 or (held and fits > size and space - fits < slack):
                if popped:
                    heapq.heappush(heap, (place(source), source))
                size = fits
                source = min(islice(queues.holders[size], ASKED), key=place)
            held.append((size, source, queues.take(size, source)))
            served[source] += size
            space -= size
            if source in waiting:
                waiting.remove(source)
            heapq.heappush(heap, (place(source), source))
            if space <= 0:
                break
        if space > slack:
            # exchange one item for a larger one of any queue, so that the least space is left
            gain, h = max(((queues.largest(space + size) - size, -n) for n, (size, _, _) in enumerate(held)), default=(0, 0))
            if gain > 0:
                size, source, i = held[-h]
                larger = size + gain
                other = min(islice(queues.holders[larger], ASKED), key=place)
                held[-h] = (larger, other, queues.take(larger, other))
                queues.put(size, source, i)
                served[source] -= size
                served[other] += larger
                waiting += [source, other]
        for s in dict.fromkeys(waiting):
            heapq.heappush(heap, (place(s), s))
        out.extend((i, window) for _, _, i in held)
        packed += sum(size for size, _, _ in held)
        window += 1
    return out, {s: share.get(s, 0.0) * packed - served[s] for s in served}


def _owed(rows: DataFrame, shares: DataFrame | None, before: DataFrame | None = None) -> DataFrame:
    """What every source is owed at the start of every shard: ``(at_shard, of_source, share, owed)``.

    All items of a shard are packed in it, so the deficits it ends with follow from its contents: the
    source's share of the shard's tokens less its own tokens there. Their running sum over the earlier
    shards is carried in, for all shards at once. ``before`` holds tokens packed earlier; without
    ``shares`` a source's share is that of its tokens. Null sources are a source.
    """
    per = rows.groupBy("shard", "source").agg(F.sum("piece_tokens").alias("own"))
    if before is not None:
        per = per.unionByName(before.groupBy("source").agg(F.sum("piece_tokens").alias("own")).withColumn("shard", F.lit(-1).cast("long")))
    totals = per.groupBy("shard").agg(F.sum("own").alias("all_own"))  # one row a shard
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("shard", F.coalesce(F.sum("all_own").over(earlier), F.lit(0)).alias("all_before"), F.sum("all_own").over(Window.orderBy(F.lit(1))).alias("everything"))
    per = per.join(totals, "shard")
    by_source = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    if shares is None:
        per = per.withColumn("share", F.sum("own").over(Window.partitionBy("source")) / F.greatest("everything", F.lit(1)))
    else:
        per = per.join(shares.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
        per = per.withColumn("share", F.coalesce("share", F.lit(0.0)))
    owed = F.col("share") * F.col("all_before") - F.coalesce(F.sum("own").over(by_source), F.lit(0))
    per = per.withColumn("owed", owed).where("shard >= 0")
    # names of its own: both sides of the cogroup come from the same rows
    return per.select(F.col("shard").alias("at_shard"), F.col("source").alias("of_source"), "share", "owed")


def pack_items(
    df: DataFrame,
    capacity: int,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: dict[str | None, float] | None = None,
    shard_tokens: int = SHARD_TOKENS,
    tokenizer: str = TOKENIZER,
    min_fill: float = 0.97,
    shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """Packs every item into containers of ``capacity`` tokens.

    Returns ``(<key>, source, piece, pieces, piece_tokens, container, target_share)``: one row per piece.
    An item is cut only when it exceeds the capacity by itself; its full pieces fill containers of their
    own and its rest is packed like an item. ``container`` is unique over the whole result.

    Method: mixture-controlled packing by deficit round-robin (``pack_window_queue``). The target
    proportions are ``weights`` by source (of no more than 100,000 sources) or, by default, each source's
    share of all tokens. Items are spread over shards of about ``shard_tokens`` and ``shard_items`` by a
    hash of key and size, whatever their source, so a source with a third of all rows is spread like all
    others; each shard is packed by one task, which starts with the deficits all earlier shards leave
    (``_owed``). Then, once, the ``REOPENED`` least filled containers of each shard, as far as they are
    filled below ``min_fill``, are opened again and packed ``FAN_IN`` shards together, going on with the
    deficits of all that stay closed; so no task ever holds more than that. Only keys, sources and sizes
    are shuffled. Sizes are written once to the checkpoint folder.

    Defined cases: null and empty texts have 0 tokens and share a container with others; null sources
    are a source of their own; repeated rows are items of their own; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    if weights and len(weights) > 100_000:
        raise ValueError("more than 100,000 weights")
    spark = df.sparkSession
    types = dict(df.select(key).dtypes)
    sizes = with_tokens(
        df.select(F.col(key).alias("k"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")), "text", path=tokenizer
    )
    sizes = checkpoint(sizes)
    tokens, items = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.lit(1))).first()
    n_shards = max(1, round(tokens / shard_tokens), round(items / shard_items))
    shares = None
    if weights:
        whole = sum(weights.values()) or 1.0
        shares = F.broadcast(spark.createDataFrame([(s, w / whole) for s, w in weights.items()], "source string, share double"))

    pieces = F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)).cast("int")
    cut = sizes.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    cut = cut.withColumn(
        "piece_tokens", F.when(F.col("piece") < F.col("pieces") - 1, F.lit(capacity)).otherwise(F.col("tokens") - (F.col("pieces") - 1) * capacity)
    ).withColumn("shard", F.pmod(F.xxhash64("k", "piece", "tokens"), F.lit(n_shards)).cast("long"))
    cols = ["k", "source", "piece", "pieces", "piece_tokens", "shard"]
    ddl = f"k {types[key]}, source string, piece int, pieces int, piece_tokens bigint, shard bigint, slot bigint, open boolean, target_share double"

    def pack(reopen: bool):
        def run(pdf: pd.DataFrame, owed: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["piece_tokens", "k", "piece"], kind="stable", na_position="first").reset_index(drop=True)
            owed = owed.sort_values("of_source", kind="stable", na_position="last")
            names = {s if isinstance(s, str) else None: n for n, s in enumerate(owed["of_source"])}
            share = dict(enumerate(owed["share"].astype(float)))
            queue = [names[s if isinstance(s, str) else None] for s in pdf["source"]]
            items = [(t, q, i) for i, (t, q) in enumerate(zip(pdf["piece_tokens"].tolist(), queue, strict=True))]
            got, _ = pack_window_queue(items, capacity, share, dict(enumerate(owed["owed"].astype(float))))
            pdf["slot"] = pd.Series(dict(got), dtype="int64").reindex(range(len(pdf))).to_numpy()
            pdf["target_share"] = [share[q] for q in queue]
            fill = pdf.groupby("slot")["piece_tokens"].sum()
            low = fill[fill < min_fill * capacity].sort_values(kind="stable").index[:REOPENED] if reopen else []
            pdf["open"] = pdf["slot"].isin(low)
            return pdf[["k", "source", "piece", "pieces", "piece_tokens", "shard", "slot", "open", "target_share"]]

        return run

    def round_of(rows: DataFrame, owed: DataFrame, reopen: bool) -> DataFrame:
        return rows.groupBy("shard").cogroup(owed.groupBy("at_shard")).applyInPandas(pack(reopen), ddl)

    def named(packed: DataFrame, level: int) -> DataFrame:
        container = F.concat_ws("-", F.lit(level), F.col("shard"), F.col("slot")).alias("container")
        return packed.select(F.col("k").alias(key), "source", "piece", "pieces", "piece_tokens", container, "target_share")

    first = round_of(cut.select(*cols), _owed(cut, shares), n_shards > 1)
    if n_shards == 1:
        return named(first, 0)
    first = checkpoint(first)
    groups = -(-n_shards // FAN_IN)
    rests = first.where("open").select(*cols).withColumn("shard", F.pmod(F.col("shard"), F.lit(groups)))
    second = round_of(rests, _owed(rests, shares, first.where("not open")), False)
    return named(first.where("not open"), 0).unionByName(named(second, 1))


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row for the whole result: containers, tokens and mean fill."""
    per = packed.groupBy("container").agg(F.sum("piece_tokens").alias("filled"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("filled").alias("tokens"),
        F.round(F.sum("filled") / (F.count(F.lit(1)) * capacity), 6).alias("mean_fill"),
    )


def window_shares(packed: DataFrame) -> DataFrame:
    """The proportions of every container: ``(container, source, tokens, target_share, actual_share)``, a row per source in it."""
    per = packed.groupBy("container", "source").agg(F.sum("piece_tokens").alias("tokens"), F.max("target_share").alias("target_share"))
    filled = F.sum("tokens").over(Window.partitionBy("container"))
    return per.withColumn("actual_share", F.try_divide(F.col("tokens").cast("double"), filled))
