"""Grounding summaries, model answers and citations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.functions.text import joined, strip
from folioworks.operators.indicators import LOCKED_FACTS

# Endings that may close a cut-off object.
CLOSINGS = ('"}', '"]}', '"]}}', '"]}}}', '"} }')


def strip_fence(c: Column) -> Column:
    """Text without a code fence around it."""
    s = F.regexp_replace(strip(c), r"^```(?:json)?\s*", "")
    return F.regexp_replace(s, r"\s*```\s*\z", "")


def salvage_json(answer: Column) -> Column:
    """The JSON value in a model's answer as a variant, or null.

    Tried in order: the whole answer without thoughts, the first fenced block, from the first ``{`` to the last
    ``}``, and the rest from the first ``{`` with one of a few endings.
    """
    s = strip(F.regexp_replace(answer, r"(?s)<think>.*?</think>", ""))
    first = F.instr(s, "{")
    last = F.length(s) - F.instr(F.reverse(s), "}") + 1
    rest = F.when(first > 0, F.substr(s, first))
    tries = [
        s,
        F.nullif(F.regexp_extract(s, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit("")),
        F.when((first > 0) & F.contains(s, F.lit("}")) & (last > first), F.substr(s, first, last - first + 1)),
        *[F.concat(rest, F.lit(x)) for x in CLOSINGS],
    ]
    return F.coalesce(*[F.try_parse_json(t) for t in tries])


def first_or(c: Column, default: str) -> Column:
    """The first element, or a default."""
    return F.coalesce(F.get(c, F.lit(0)), F.lit(default))


def key_indicators(iocs: dict[str, Column]) -> Column:
    """A few of each kind: five addresses, three hashes, five domains."""
    return F.concat(F.slice(iocs["ipv4_addresses"], 1, 5), F.slice(iocs["sha256_hashes"], 1, 3), F.slice(iocs["domains"], 1, 5))


def overview(text: Column, otherwise: Column) -> Column:
    """The first paragraph of more than 50 characters that is neither heading nor table, without leading marks."""
    long = F.filter(F.split(text, "\n\n"), lambda p: (F.length(strip(p)) > 50) & ~strip(p).startswith("#") & ~strip(p).startswith("|"))
    return F.when(F.size(long) > 0, strip(F.regexp_replace(F.get(long, F.lit(0)), r"^[#\s*_-]+", ""))).otherwise(otherwise)


def locked_facts(text: Column, words: Column, lines: Column, cvss: Column) -> Column:
    """The counted things a text names, in order; its size if there are none; and its highest score."""
    named = F.transform(F.regexp_extract_all(text, F.lit(LOCKED_FACTS), F.lit(0)), strip)
    size = F.concat(F.lit("Analyzed "), words.cast("string"), F.lit(" words across "), lines.cast("string"), F.lit(" lines"))
    facts = F.when(F.size(named) > 0, named).otherwise(F.array(size))
    score = F.concat(F.lit("CVSS Score: "), F.get(cvss, F.lit(0)).cast("string"))
    return F.when(F.size(cvss) > 0, F.array_append(facts, score)).otherwise(facts)


# The sentences of a grounding context that is made without a model.
SENTENCES = {
    "title": "Threat Assessment: {actor} Activity ({cves})",
    "overview": "Cybersecurity incident report regarding {name} involving {actor}.",
    "situation": "Enterprise infrastructure running {systems}.",
    "complication": "Active threat exploitation detected involving {cves} attributed to {actor}.",
    "solution": "Deploy emergency patches, block identified C2 infrastructure, and rotate credentials.",
    "impact": "Severity rated {severity}. Risk of unauthorized command execution and lateral movement.",
    "cause": "Adversary exploited weaknesses in {systems}.",
    "event": "Incident detected during scheduled monitoring",
    "mitigations": (
        "Apply urgent vendor patches for {cves}",
        "Block identified C2 IP indicators at network boundary firewalls",
        "Force multi-factor authentication and rotate administrative credentials",
    ),
    "advisory": (
        "Mitigate CVEs: {listed}",
        "Block outbound traffic to {addresses} known IP addresses",
        "Monitor endpoints for {hashes} flagged hash signatures",
    ),
    "takeaways": (
        "Operational risk rated {severity}",
        "Targeted software includes {three}",
        "Immediate patch deployment recommended within 24 hours",
    ),
    "hooks": (
        "🚨 Critical Alert: Active exploitation of {cves} by {actor}.",
        "Check your systems and apply patches immediately. #CyberSecurity #ThreatIntel",
    ),
    "scenes": (
        "Title card with critical red threat banner and target infrastructure logos",
        "Architecture diagram showing C2 beaconing flow to attacker IPs",
        "Mitigation checklist highlighting urgent patch steps",
    ),
    "no actor": "Unidentified Threat Actor",
    "no severity": "HIGH",
    "no cves": "Unclassified Vulnerabilities",
    "no systems": "mission-critical systems",
    "no targets": "target systems",
    "model": "qwen-heuristic-anchor",
}


def filled(sentence: str | tuple[str, ...], **values: Column) -> Column:
    """A sentence with columns in the places of ``{names}``; of several sentences an array."""
    if isinstance(sentence, tuple):
        return F.array(*[filled(x, **values) for x in sentence])
    parts = [values[x[1:-1]] if x.startswith("{") else F.lit(x) for x in re.split(r"(\{\w+\})", sentence) if x]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def heuristic_grounding(name: Column, text: Column, words: Column, lines: Column, iocs: dict[str, Column], threat: dict[str, Column]) -> Column:
    """A grounding context made from what was extracted alone, as one struct."""
    systems, say = threat["affected_systems"], SENTENCES
    known = {
        "name": name, "actor": first_or(threat["threat_actors"], say["no actor"]), "severity": first_or(threat["severity_keywords"], say["no severity"]),
        "cves": joined(iocs["cves"], say["no cves"]), "listed": F.array_join(iocs["cves"], ", "), "three": F.array_join(F.slice(systems, 1, 3), ", "),
        "addresses": F.size(iocs["ipv4_addresses"]).cast("string"), "hashes": F.size(iocs["sha256_hashes"]).cast("string"),
    }
    of = lambda key, **more: filled(say[key], **known | more)
    pyramid = {
        "situation": of("situation", systems=joined(systems, say["no systems"])), "complication": of("complication"), "solution": of("solution"),
        "business_impact_and_risk": of("impact"),
    }
    metadata = {
        "cve_ids": iocs["cves"], "threat_actor": known["actor"], "affected_systems": systems, "severity": known["severity"],
        "iocs": F.slice(F.concat(iocs["ipv4_addresses"], iocs["domains"], iocs["sha256_hashes"]), 1, 10),
    }
    directives = {
        "advisory_bullet_points": of("advisory"), "executive_takeaways": of("takeaways"), "social_dissemination_hooks": of("hooks"), "visual_scene_ideas": of("scenes"),
    }
    struct = lambda fields: F.struct(*[c.alias(n) for n, c in fields.items()])
    return struct(
        {
            "title": of("title"), "executive_overview": overview(text, of("overview")), "minto_pyramid": struct(pyramid),
            "technical_root_cause": of("cause", systems=joined(systems, say["no targets"])),
            "timeline_of_events": F.when(F.size(threat["timelines"]) > 0, threat["timelines"]).otherwise(F.array(of("event"))),
            "locked_numerical_facts": locked_facts(text, words, lines, threat["cvss_scores"]), "actionable_mitigations": of("mitigations"),
            "threat_metadata": struct(metadata), "downstream_directives": struct(directives), "interpreted_by_model": of("model"),
        }
    )


def anchors_of(answer: Column) -> Column:
    """The anchors in a model's answer: ``array<struct<id, anchor, extracted_verbatim, category, confidence>>``.

    A list answer counts as its first object; aliases of fields, single objects and missing values are filled
    in; an answer without anchors has one that stands for the whole. A broken answer gives null.
    """
    v = F.try_parse_json(strip_fence(answer))
    kind = F.schema_of_variant(v)
    whole = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$[0]", "variant")).otherwise(v)
    text = lambda path: F.nullif(F.try_variant_get(whole, path, "string"), F.lit(""))
    lists = [F.try_variant_get(whole, p, "array<variant>") for p in ("$.grounding_sources", "$.anchors")]
    singles = [F.try_variant_get(whole, p, "variant") for p in ("$.grounding_sources", "$.anchors")]
    single = lambda s: F.when(F.schema_of_variant(s).startswith("OBJECT"), F.array(s))
    items = F.coalesce(
        F.when(F.size(lists[0]) > 0, lists[0]), single(singles[0]), F.when(F.size(lists[1]) > 0, lists[1]), single(singles[1]), F.array().cast("array<variant>")
    )

    def anchor(a: Column, i: Column) -> Column:
        get = lambda *names: F.coalesce(*[F.nullif(F.try_variant_get(a, f"$.{n}", "string"), F.lit("")) for n in names])
        conf = F.coalesce(F.nullif(F.try_variant_get(a, "$.confidence", "double"), F.lit(0.0)), F.lit(0.95))
        return F.struct(
            F.coalesce(get("id"), F.concat(F.lit("src-"), (i + 1).cast("string"))).alias("id"),
            F.coalesce(get("visual_anchor", "anchor"), F.lit("Central Visual Field")).alias("anchor"),
            strip(F.coalesce(get("extracted_verbatim", "text", "detected_text"), F.lit(""))).alias("extracted_verbatim"),
            F.coalesce(get("category", "entity_type"), F.lit("CORE_CONCEPT")).alias("category"),
            conf.alias("confidence"),
        )

    objects = F.filter(items, lambda a: F.schema_of_variant(a).startswith("OBJECT"))
    alone = F.struct(
        F.lit("src-1").alias("id"), F.lit("Full Canvas").alias("anchor"),
        F.coalesce(text("$.overview"), text("$.summary"), F.when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), F.try_variant_get(v, "$", "string")), F.lit("Visual image tensor verified.")).alias("extracted_verbatim"),
        F.lit("CORE_CONCEPT").alias("category"), F.lit(1.0).alias("confidence"),
    )
    return F.when(v.isNotNull(), F.when(F.size(objects) > 0, F.transform(objects, anchor)).otherwise(F.array(alone)))


def anchor_label(anchor: Column, verbatim: Column, limit: int = 100) -> Column:
    """A citation's label: where, and the first words."""
    return F.concat(F.lit("["), anchor, F.lit("] "), F.left(verbatim, F.lit(limit)))


def indicator_citations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Citation rows ``(<keys>, id, kind, label)`` of the CVEs and addresses of a document."""
    row = lambda prefix: lambda v: F.struct(F.concat(F.lit(prefix), v).alias("id"), F.lit("file").alias("kind"), v.alias("label"))
    each = F.concat(F.transform(F.col("cves"), row("cve-")), F.transform(F.col("ipv4_addresses"), row("ip-")))
    return df.select(*keys, F.inline(each))


def media_citations(df: DataFrame, key: str, prefix: str, number: str, anchor: str, text: str, limit: int) -> DataFrame:
    """Citation rows ``(source, id, kind, label)`` of what was found in media, one for each row."""
    label = anchor_label(F.col(anchor), F.col(text), limit)
    return df.select(F.col(key).alias("source"), F.concat(F.lit(prefix), F.col(number).cast("string")).alias("id"), F.lit("file").alias("kind"), label.alias("label"))


def placeholder_citations(df: DataFrame, name: str) -> DataFrame:
    """Citation rows ``(source, id, kind, label)`` that stand for files of which nothing was extracted."""
    return df.select(F.col(name).alias("source"), F.concat(F.lit("src-"), name).alias("id"), F.lit("file").alias("kind"), F.col(name).alias("label"))


def numbered_facts(facts: Column, existing: Column) -> Column:
    """Fact citations numbered after those that exist."""
    return F.transform(
        facts, lambda v, i: F.struct(F.concat(F.lit("fact-"), (existing + i + 1).cast("string")).alias("id"), F.lit("text").alias("kind"), v.alias("label"))
    )


def provenance_defaults(items: Column) -> Column:
    """Provenance items with empty strings for what is missing."""
    return F.transform(
        F.coalesce(items, F.array().cast("array<struct<citation_marker:string,source_reference:string>>")),
        lambda x: F.struct(
            F.coalesce(x["citation_marker"], F.lit("")).alias("citation_marker"), F.coalesce(x["source_reference"], F.lit("")).alias("source_reference")
        ),
    )


def entities_of(answer: Column) -> Column:
    """The entities in a model's answer: ``struct<cves, actors, targets>``.

    They may stand as an object of lists or as one list of strings (``CVE...`` or targets) and of objects with
    ``cve``, ``actor`` or ``target``. A broken answer gives null, missing lists are empty.
    """
    v = F.try_parse_json(strip_fence(answer))
    whole = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$[0]", "variant")).otherwise(v)
    items = F.coalesce(F.try_variant_get(whole, "$.entities_detected", "array<variant>"), F.array().cast("array<variant>"))
    word = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
    texts = F.filter(F.transform(items, word), lambda x: x.isNotNull())
    named = lambda k: F.filter(F.transform(items, lambda x: F.try_variant_get(x, f"$.{k}", "string")), lambda x: x.isNotNull())
    listed = lambda k: F.coalesce(F.try_variant_get(whole, f"$.entities_detected.{k}", "array<string>"), F.array().cast("array<string>"))
    cve = lambda x: F.upper(x).startswith("CVE")
    return F.when(
        v.isNotNull(),
        F.struct(
            F.concat(listed("cves"), F.filter(texts, cve), named("cve")).alias("cves"), F.concat(listed("actors"), named("actor")).alias("actors"),
            F.concat(listed("targets"), F.filter(texts, lambda x: ~cve(x)), named("target")).alias("targets"),
        ),
    )


def recovered(answer: Column, fields: dict[str, tuple[str, Column]]) -> dict[str, Column]:
    """The fields of a salvaged answer, each by its path, its type and what stands for it when it is missing.

    ``fields`` maps a path such as ``minto_pyramid.situation`` to (type, default).
    """
    v = salvage_json(answer)
    return {path: F.coalesce(F.try_variant_get(v, f"$.{path}", kind), default) for path, (kind, default) in fields.items()}


def video_grounding(name: Column, seconds: Column, scenes: Column, n_scenes: Column, iocs: dict[str, Column]) -> Column:
    """A video's grounding context made from its scenes alone, as one struct.

    ``scenes`` is ``array<struct<scene_id, timestamp_display, narrative>>`` in order; the first five make the timeline.
    ``n_scenes`` is the number of all scenes, as ``scenes`` may hold the first five only.
    """
    cat = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    cves, n, s = joined(iocs["cves"], "Cyber Threats"), n_scenes.cast("string"), seconds.cast("string")
    event = lambda x: cat("Scene ", x["scene_id"].cast("string"), " [", x["timestamp_display"], "]: ", x["narrative"])
    return F.struct(
        cat("Video Intelligence Briefing: ", cves, " (", name, ")").alias("title"),
        cat("Multimodal intelligence analysis of ", name, " spanning ", s, " seconds across ", n, " scenes.").alias("executive_overview"),
        F.struct(
            F.lit("Enterprise infrastructure monitored during security briefing.").alias("situation"),
            cat("Vulnerability demonstration involving ", cves, ".").alias("complication"),
            F.lit("Apply patches and block identified indicators of compromise.").alias("solution"),
            F.lit("Risk of lateral movement and operational downtime.").alias("business_impact_and_risk"),
        ).alias("minto_pyramid"),
        F.lit("Exploitation of vulnerabilities demonstrated in video session.").alias("technical_root_cause"),
        F.transform(F.slice(scenes, 1, 5), event).alias("timeline_of_events"),
        F.array(cat("Video duration: ", s, " seconds"), cat("Detected ", n, " distinct visual scenes")).alias("locked_numerical_facts"),
        F.array(F.lit("Deploy vendor security updates"), F.lit("Monitor perimeter logs for identified C2 IPs")).alias("actionable_mitigations"),
        F.lit("heuristic-video-anchor").alias("interpreted_by_model"),
    )


def snippet(text: Column, limit: int = 120, empty: str = "") -> Column:
    """The beginning of a text on one line, as reports quote it."""
    s = strip(text)
    return F.when(s == "", F.lit(empty)).otherwise(F.concat(F.replace(F.left(s, F.lit(limit)), F.lit("\n"), F.lit(" ")), F.lit("...")))
