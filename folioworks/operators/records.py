"""Relational operators over parents, their children and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_children(parents: DataFrame, children: DataFrame, key: str, order: list[str], fields: list[str], out: str, max_children: int | None = None) -> DataFrame:
    """Every parent with its children in order as an array of structs; an empty array where there are none.

    Children are gathered per key before the join. With ``max_children`` a key of more children gets several
    rows, each with about that many at most, numbered from 0 in column ``part`` and in order: its children
    are divided at quantiles of the first column of ``order``, which must be a number or a time then. So
    no list grows with a key that holds a large share of all rows, unless they tie in that column.
    """
    ordered = F.sort_array(F.collect_list(F.struct(*order, *[f for f in fields if f not in order])))
    ks = [key]
    if max_children is not None:
        at = F.col(order[0]).cast("double")
        n = children.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
        big = n.where(F.col("__n") > max_children)
        steps = F.transform(F.sequence(F.lit(1), F.ceil(F.col("__n") / max_children).cast("int") - 1), lambda i: i / F.ceil(F.col("__n") / max_children))
        # every key's cuts come from one sketch of 10,000 bins, which is combined before the shuffle
        marks = children.join(big, F.col(key) == F.col("__key"), "left_semi").groupBy(F.col(key).alias("__k2"))
        marks = marks.agg(F.percentile_approx(at, [i / 1000 for i in range(1001)], 10_000).alias("__grid"))
        cuts = big.join(marks, F.col("__key") == F.col("__k2")).select("__key", F.transform(steps, lambda q: F.get("__grid", F.floor(q * 1000).cast("int"))).alias("__cuts"))
        children = children.join(cuts, F.col(key) == F.col("__key"), "left").drop("__key")
        part = F.coalesce(F.size(F.filter("__cuts", lambda c: c < at)), F.lit(0))
        children = children.withColumn("part", F.greatest(part, F.lit(0))).drop("__cuts")
        ks.append("part")
    lists = children.groupBy(*ks).agg(ordered.alias("__list"))
    lists = lists.select(*ks, F.transform("__list", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(out))
    joined = parents.join(lists, key, "left")
    joined = joined.withColumn(out, F.coalesce(out, F.array().cast(lists.schema[out].dataType)))
    return joined if max_children is None else joined.withColumn("part", F.coalesce("part", F.lit(0)))


def owned_by(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """The rows whose owner is among ``owners``."""
    return rows.join(owners.select(key).distinct(), key, "left_semi")


def without_match(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """The rows without a partner: what breaks a reference, or what is missing from a store."""
    return rows.join(others.select(key).distinct(), key, "left_anti")


def size_mismatch(manifest: DataFrame, stored: DataFrame, key: str, size: str) -> DataFrame:
    """Files of a manifest that are missing from the store or have another size there: ``(<key>, problem)``."""
    there = stored.groupBy(key).agg(F.max(size).alias("__size"))
    problem = F.when(F.col("__size").isNull(), "missing").when(F.col("__size") != F.col(size), "size differs")
    return manifest.join(there, key, "left").select(key, problem.alias("problem")).where("problem is not null")


def first_claim(events: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The event that wins each key: the earliest, of equals the least ``tie``. Combined before the shuffle."""
    others = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(at, tie)).alias("r")).select(key, "r.*")


def latest_state(events: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The last event of each key: the state of an append-only log."""
    others = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(at, tie)).alias("r")).select(key, "r.*")


def newest(df: DataFrame, order: list[Column], n: int = 20) -> DataFrame:
    """The top-k report: the n first rows in the given order."""
    return df.orderBy(*order).limit(n)


def job_artifact(files: DataFrame, job: list[str], name: str, fields: list[str]) -> DataFrame:
    """One JSON document per job: the number of its files and a summary of each, in order of name.

    ``job`` names the columns of a job, with a block of its files among them where a job has many.
    """
    listed = F.sort_array(F.collect_list(F.struct(name, *[f for f in fields if f != name])))
    return files.groupBy(*job).agg(F.count(F.lit(1)).alias("file_count"), listed.alias("files")).select(
        *job, "file_count", F.to_json(F.struct("file_count", "files")).alias("artifact")
    )


def in_order_distinct(items: Column) -> Column:
    """The elements without repetitions, in the order in which they first occur."""
    return F.array_distinct(items)


def merged_params(maps: Column) -> Column:
    """Several maps in one; of equal keys the last wins, in any setting of the session."""
    entries = F.flatten(F.transform(maps, F.map_entries))
    last = F.filter(
        F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i"))),
        lambda e: ~F.exists(F.slice(entries, e["i"] + 2, F.size(entries)), lambda x: x["key"] == e["key"]),
    )
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def combined_sources(text: Column, files: Column) -> Column:
    """A source text and, below a rule, the sections of its files; ``files`` is ``array<struct<name, kind, markdown>>`` in order."""
    section = lambda f: F.concat(F.lit("## Data from "), f["name"], F.lit(" ("), f["kind"], F.lit("):\n\n"), f["markdown"])
    parts = F.transform(F.filter(files, lambda f: f["markdown"] != ""), section)
    return F.when(F.size(parts) > 0, F.concat(text, F.lit("\n\n---\n\n"), F.array_join(parts, "\n\n"))).otherwise(text)
