"""The queries of the problems for language models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm.lookalikes import class_members, look_classes, look_pairs
from folioworks.llm.mixing import mix_sources
from folioworks.llm.packing import fill_report, pack_items, window_shares
from folioworks.llm.personal import find_personal, fit_model
from folioworks.llm.splitting import split_documents
from folioworks.llm.turns import ANY, TEXT, Roster, anchor_rows, segment_rows, speaker_turns, turn_texts
from folioworks.session import spread, table


def capacity_of(spark: SparkSession, d: str, profile: str = "standard") -> int:
    return int(table(spark, d, "pack_profile").where(F.col("profile") == profile).select("capacity_tokens").first()[0])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_documents(spread(table(spark, d, "source_context")), table(spark, d, "split_profile"), with_text=False)
    return pieces.where("pieces > 1 and piece = 0").select("profile", "doc_id")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces with their texts."""
    return split_documents(spread(table(spark, d, "source_context")), table(spark, d, "split_profile"))


def _speech(spark: SparkSession, d: str, kept: str) -> DataFrame:
    roster = Roster(table(spark, d, "speaker_roster"))
    segments = segment_rows(spread(table(spark, d, "audio_segment")), roster, kept)
    return segments.unionByName(anchor_rows(spread(table(spark, d, "grounding_anchor")), roster, kept))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return speaker_turns(_speech(spark, d, ANY)).select("track", "recording", "start_ms", "speaker").distinct()


def p4_texts(spark: SparkSession, d: str) -> DataFrame:
    """The clean words of every turn."""
    return turn_texts(_speech(spark, d, TEXT))


#: The columns searched for personal information: (table, text column).
PERSONAL = (("grounding_anchor", "extracted_verbatim"), ("final_deliverable", "final_content"), ("sensitive_flag", "match"))


def _personal(spark: SparkSession, d: str, with_text: bool) -> DataFrame:
    model = fit_model([(table(spark, d, t), "row_id", c) for t, c in PERSONAL], table(spark, d, "staff_roster"))
    out = None
    for t, c in PERSONAL:
        one = find_personal(spread(table(spark, d, t)), "row_id", c, model, with_text).withColumn("field", F.lit(f"{t}.{c}"))
        out = one if out is None else out.unionByName(one)
    return out


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d, False).select("field", "row_id", "pii_type", "match_start")


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts with placeholders."""
    return _personal(spark, d, True).select("field", "row_id", "redacted")


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    n = capacity_of(spark, d)
    return pack_items(spread(table(spark, d, "documents")), n), n


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)[0].where("pieces > 1 and piece = 0").select("doc_id").distinct()


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(*_packed(spark, d))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """What lies in which container."""
    return _packed(spark, d)[0].drop("target_share")


def p6_windows(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source in every container."""
    return window_shares(_packed(spark, d)[0])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    mixture = mix_sources(spread(table(spark, d, "documents")), table(spark, d, "mix_target"))
    return mixture.report.where("not reached").select("recipe", "source")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(spread(table(spark, d, "documents")), table(spark, d, "mix_target")).report


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    """Every use of a page with the slot of its block."""
    return mix_sources(spread(table(spark, d, "documents")), table(spark, d, "mix_target")).selection


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return look_pairs(look_classes(spread(table(spark, d, "documents"))))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every page with the class of its looks and of its very text, each named by its least page, without pairs."""
    return class_members(look_classes(spread(table(spark, d, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        p2_found, p2_pieces, p4_found, p4_texts, p5_found, p5_redacted, p6_found, p6_fill, p6_containers, p6_windows, p7_found, p7_report, p7_selection,
        p8_found, p8_classes,
    )
    return {f.__name__: f for f in every}
