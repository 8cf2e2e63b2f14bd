"""Sections, chunks and grounding headers of markdown texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.functions.text import joined, strip, token_estimate

ROOT = "Document Root"
MAX_TOKENS = 1200
#: Fixed value: the line above and below a grounding header.
RULE = "=" * 80


def sections(text: Column) -> Column:
    """The sections of a markdown text: ``array<struct<heading, content>>``; empty ones are left out.

    A heading line (also one inside a code fence) begins a section and stays in it; what stands before the
    first heading belongs to ``Document Root``.
    """
    normal = F.regexp_replace(text, r"\r\n|\r", "\n")
    parts = F.split(normal, r"\n(?=#{1,6}[^\S\n][^\n])")

    def section(p: Column) -> Column:
        heading = strip(F.regexp_extract(p, r"^#{1,6}[^\S\n]([^\n]+)", 1))
        return F.struct(F.when(p.rlike(r"^#{1,6}[^\S\n][^\n]"), heading).otherwise(ROOT).alias("heading"), strip(p).alias("content"))

    return F.filter(F.transform(parts, section), lambda s: s["content"] != "")


def pack_paragraphs(content: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """A section's paragraphs in order, greedily packed to ``max_tokens``; a larger paragraph stands alone."""
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").cast("string").alias("cur"), F.lit(0).alias("n"), F.lit(False).alias("open")
    )

    def step(acc: Column, p: Column) -> Column:
        size = token_estimate(p)
        flush = acc["open"] & (acc["n"] + size > max_tokens)
        return F.struct(
            F.when(flush, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
            F.when(flush | ~acc["open"], p).otherwise(F.concat(acc["cur"], F.lit("\n\n"), p)).alias("cur"),
            F.when(flush, size).otherwise(acc["n"] + size).alias("n"),
            F.lit(True).alias("open"),
        )

    return F.aggregate(F.split(content, r"\n\s*\n"), start, step, lambda acc: F.concat(acc["done"], F.array(acc["cur"])))


def chunks(text: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """The chunks of a text: ``array<struct<chunk_id, parent_section, text, token_estimate, char_length>>``."""
    pieces = lambda s: F.transform(
        F.when(token_estimate(s["content"]) <= max_tokens, F.array(s["content"])).otherwise(pack_paragraphs(s["content"], max_tokens)),
        lambda t: F.struct(s["heading"].alias("heading"), t.alias("text")),
    )
    return F.transform(
        F.flatten(F.transform(sections(text), pieces)),
        lambda c, i: F.struct(
            (i + 1).alias("chunk_id"), c["heading"].alias("parent_section"), c["text"].alias("text"),
            token_estimate(c["text"]).alias("token_estimate"), F.length(c["text"]).alias("char_length"),
        ),
    )


def chunk_documents(df: DataFrame, keys: list[str], text: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row per chunk. Folds run inside the row, so nothing is shuffled."""
    return df.select(*keys, F.inline(chunks(F.col(text), max_tokens)))


def grounding_header(meta: dict[str, Column], iocs: dict[str, Column], threat: dict[str, Column], tables: Column) -> Column:
    """The header of a prompt: what was extracted from a document, line by line.

    ``meta`` has ``file_name``, ``file_type``, ``sha256``, ``word_count`` and ``estimated_tokens``.
    """
    none = "None identified"
    head = [
        F.lit(RULE),
        F.lit("IMMUTABLE SOURCE TELEMETRY & GROUNDING ANCHOR (PRE-EXTRACTED ZERO-LOSS CONTEXT)"),
        F.lit(RULE),
        F.concat(F.lit("SOURCE_DOCUMENT: "), meta["file_name"], F.lit(" ("), F.upper(meta["file_type"]), F.lit(")")),
        F.concat(F.lit("DOCUMENT_SHA256: "), meta["sha256"]),
        F.concat(
            F.lit("WORD_COUNT: "), meta["word_count"].cast("string"), F.lit(" | ESTIMATED_TOKENS: "), meta["estimated_tokens"].cast("string")
        ),
        F.lit(""),
    ]
    seen = (
        ("DETECTED_SEVERITY", threat["severity_keywords"]), ("CVSS_SCORES", F.transform(threat["cvss_scores"], lambda x: x.cast("string"))),
        ("IDENTIFIED_THREAT_ACTORS", threat["threat_actors"]), ("AFFECTED_SYSTEMS", threat["affected_systems"]),
        ("DETECTED_TIMELINES", threat["timelines"]),
    )
    body = [F.when(F.size(c) > 0, F.concat(F.lit(f"{name}: "), F.array_join(c, ", "))) for name, c in seen]
    body.append(F.lit("\n--- EXTRACTED DETERMINISTIC INDICATORS (IOCs) ---"))
    listed = (
        ("CVE_IDS", "cves"), ("MITRE_ATTACK_TECHNIQUES", "mitre_attack_ids"), ("IPV4_INDICATORS", "ipv4_addresses"),
        ("IPV6_INDICATORS", "ipv6_addresses"), ("SHA256_HASHES", "sha256_hashes"), ("SHA1_HASHES", "sha1_hashes"),
        ("MD5_HASHES", "md5_hashes"), ("DOMAINS", "domains"), ("URLS", "urls"),
    )
    body += [F.concat(F.lit(f"{name}: "), joined(iocs[k], none)) for name, k in listed]
    per_table = F.transform(
        tables,
        lambda t: F.concat(
            F.lit("[Table "), t["table_index"].cast("string"), F.lit("] Headers: "), F.array_join(t["headers"], ", "),
            F.lit(" ("), t["row_count"].cast("string"), F.lit(" rows)"),
        ),
    )
    count = F.size(tables)
    body.append(
        F.when(
            count > 0,
            F.concat(
                F.lit("\n--- EXTRACTED TABLES ("), count.cast("string"), F.lit(" table(s) parsed) ---\n"), F.array_join(per_table, "\n")
            ),
        )
    )
    body.append(F.lit(RULE))
    return F.concat_ws("\n", *head, *body)


def prompt(header: Column, text: Column) -> Column:
    """The header with the whole text below it."""
    return F.concat(header, F.lit("\n\n### FULL NORMALIZED DOCUMENT BODY\n\n```markdown\n"), text, F.lit("\n```\n"))
