"""Payloads and results as markdown: one expression per kind, nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioworks.functions.text import lines, percent, strip

# The headings, labels and marks of all documents below.
NL = "\n"


def _s(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def cat(*parts: Column | str) -> Column:
    return F.concat(*map(_s, parts))


def doc(*rows: Column | str | None) -> Column:
    """Rows joined by line feeds; null rows are left out, so conditional rows are ``F.when(...)`` without an otherwise."""
    return F.concat_ws(NL, *[_s(r) for r in rows if r is not None])


def block(items: Column, row: Callable) -> Column:
    """The rows of a list joined by line feeds; null, so no row at all, for an empty or null list."""
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, row), NL, ""))


def bullets(items: Column) -> Column:
    return block(items, lambda x: cat("- ", x))


def numbered(items: Column) -> Column:
    return block(items, lambda x, i: cat((i + 1).cast("string"), ". ", x))


def _or(c: Column, default: str = "") -> Column:
    return F.coalesce(c, F.lit(default))


def _filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def linkedin_post(p: Column) -> Column:
    return doc(
        _or(p["hook"]), "", _or(p["threat_context"]), "", "## Key Insights", bullets(p["key_insights"]), "", "## Actionable Takeaways",
        numbered(p["actionable_takeaways"]), "", "---", "", _or(p["discussion_prompt"]), "", F.array_join(F.coalesce(p["hashtags"], F.array().cast("array<string>")), " "),
    )


def social_thread(p: Column) -> Column:
    five = F.array(*[_or(p[f"{k}_tweet"]) for k in ("hook", "exploit", "ioc", "mitigation", "wrapup")])
    return F.array_join(F.when(F.size(p["all_tweets"]) > 0, p["all_tweets"]).otherwise(five), "\n---\n")


def advisory(p: Column) -> Column:
    ioc = lambda x: cat("| ", _or(x["type"]), " | `", _or(x["indicator"]), "` | ", _or(x["context"]), " | ", _or(x["action"]), " |")
    return doc(
        "# TECHNICAL SECURITY ADVISORY",
        cat("**TRAFFIC LIGHT PROTOCOL:** ", _or(p["tl_protocol"], "TLP:AMBER+STRICT"), " | **SEVERITY:** ", _or(p["severity"], "CRITICAL")),
        F.when(_filled(p["cvss_score"]), cat("**CVSS v3.1:** ", p["cvss_score"])),
        F.when(F.size(p["cve_ids"]) > 0, cat("**CVE(s):** ", F.array_join(p["cve_ids"], ", "))),
        F.when(_filled(p["threat_actor"]), cat("**THREAT ACTOR:** ", p["threat_actor"])),
        "", "---", "", "## Executive Summary", _or(p["executive_summary"]), "", "## Technical Analysis & Exploit Chain",
        _or(p["technical_analysis"]), "", "## Indicators of Compromise (IOCs)", "| Type | Indicator | Context | Recommended Action |",
        "|------|-----------|---------|-------------------|", block(p["iocs"], ioc), "", "## Prioritized Mitigations", numbered(p["mitigations"]),
        F.when(_filled(p["cert_reporting"]), cat("\n## Official Reporting\n", p["cert_reporting"])),
    )


def exec_summary(p: Column) -> Column:
    return doc(
        "# EXECUTIVE BRIEF: CYBERSECURITY INCIDENT & RISK ASSESSMENT", "**CLASSIFICATION:** STRICTLY CONFIDENTIAL // BOARD MATERIAL",
        "", "---", "", "### BLUF (Bottom Line Up Front)", _or(p["bluf"]), "", "### Situation", _or(p["situation"]), "",
        "### Complication & Business Risk", _or(p["complication"]), "", "### Solution & Containment Actions", _or(p["solution"]), "",
        "### Strategic Recommendations & Decisions Required", numbered(p["strategic_recommendations"]),
    )


def incident_report(p: Column) -> Column:
    event = lambda x: cat("- **", _or(x["time"]), "** — ", _or(x["event"]))
    action = lambda x: cat("- [", F.upper(_or(x["status"], "pending")), "] ", _or(x["action"]), " (Owner: ", _or(x["owner"], "TBD"), ")")
    return doc(
        cat("# INCIDENT TRIAGE & FORENSIC REPORT: ", _or(p["incident_id"], "INC-2026-XXXX")),
        cat("**Status:** ", _or(p["status"], "CONTAINED"), " | **Severity:** ", _or(p["severity"], "Tier 1 High")),
        "", "---", "", "## Incident Timeline (UTC)", block(p["timeline"], event), "", "## Root Cause Analysis", _or(p["root_cause"]), "",
        "## Blast Radius & Affected Systems", bullets(p["blast_radius"]), "", "## Corrective Actions", block(p["corrective_actions"], action),
    )


def press_release(p: Column) -> Column:
    return doc(
        "# PUBLIC SECURITY ADVISORY & STATEMENT", "**FOR IMMEDIATE RELEASE**", cat("**Dateline:** ", _or(p["dateline"], "UNKNOWN — DATE")),
        "", "---", "", cat("## ", _or(p["headline"], "Security Advisory")), "", "### Customer Impact Statement", _or(p["customer_impact"]), "",
        "### Proactive Protections Applied", bullets(p["proactive_measures"]), "", "### Safe Practices for Users", bullets(p["user_guidance"]),
        "", "### Media Contact", _or(p["media_contact"]),
    )


def slide_deck(p: Column) -> Column:
    def slide(x: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        return doc(
            cat("## Slide ", n, ": ", F.coalesce(x["title"], cat("Slide ", n))), cat("**Type:** ", _or(x["type"], "CONTENT")), "",
            bullets(x["key_points"]), F.when(_filled(x["speaker_notes"]), cat("\n*Speaker Notes:* ", x["speaker_notes"])), "",
        )

    return doc("# PRESENTATION SLIDE DECK: THREAT RESPONSE & STRATEGY", "", block(p["slides"], slide))


def video_script(p: Column) -> Column:
    scene = lambda x: doc(
        cat("## ", _or(x["scene"], "Scene")), cat("**Visual:** ", _or(x["visual"])), cat("**Narrator (VO):** ", _or(x["narrator"])), ""
    )
    return doc(
        "# VIDEO NARRATION SCRIPT: CYBER THREAT BRIEFING", cat("**Runtime:** ", _or(p["runtime_seconds"].cast("string"), "90"), " seconds"),
        "", "---", "", block(p["scenes"], scene),
    )


def playbook(p: Column) -> Column:
    command = lambda x: cat("```bash\n", x, "\n```")
    stage = lambda x: doc(
        cat("## Stage ", _or(x["stage"].cast("string")), ": ", _or(x["title"])), "", bullets(x["steps"]),
        F.when(F.size(x["commands"]) > 0, cat("\n**Commands:**\n", block(x["commands"], command))), "",
    )
    return doc(
        cat("# REMEDIATION PLAYBOOK: ", _or(p["playbook_code"], "PB-SEC-XX")), "**Category:** Emergency Containment & Recovery",
        "", "---", "", block(p["stages"], stage),
    )


#: The renderer of each kind of deliverable; add to it to render further kinds.
RENDERERS: dict[str, Callable[[Column], Column]] = {
    f.__name__: f
    for f in (linkedin_post, social_thread, advisory, exec_summary, incident_report, press_release, slide_deck, video_script, playbook)
}


def grounding_markdown(g: Column, generated_at: Column) -> Column:
    """A grounding context as a document of eight sections; empty sections are left out."""
    m, t, d = g["minto_pyramid"], g["threat_metadata"], g["downstream_directives"]
    listed = lambda title, items: F.when(F.size(items) > 0, cat(title, NL, bullets(items)))
    return doc(
        cat("# 🛡️ ", g["title"]),
        cat("\n*Interpreted by `", g["interpreted_by_model"], "` | Generated: ", generated_at, "*"),
        cat("\n**Severity:** `", t["severity"], "` | **Threat Actor:** `", F.coalesce(F.nullif(t["threat_actor"], F.lit("")), F.lit("Unattributed")), "`\n"),
        "## 1. Executive Narrative", cat(g["executive_overview"], NL), "## 2. Minto Pyramid Briefing Structure",
        cat("- **Situation:** ", m["situation"]), cat("- **Complication:** ", m["complication"]), cat("- **Solution:** ", m["solution"]),
        cat("- **Business & Operational Impact:** ", m["business_impact_and_risk"], NL),
        "## 3. Technical Root Cause & Attack Vector", cat(g["technical_root_cause"], NL),
        F.when(F.size(g["timeline_of_events"]) > 0, cat("## 4. Timeline of Incident Progression\n", bullets(g["timeline_of_events"]), NL)),
        F.when(
            F.size(g["locked_numerical_facts"]) > 0,
            cat("## 5. Canonical Grounding Facts (Immutable Metrics)\n", block(g["locked_numerical_facts"], lambda x: cat("- 📌 **", x, "**")), NL),
        ),
        F.when(
            (F.size(t["cve_ids"]) > 0) | (F.size(t["affected_systems"]) > 0),
            doc(
                "## 6. Threat Telemetry & Target Infrastructure",
                F.when(F.size(t["cve_ids"]) > 0, cat("- **Associated CVEs:** ", F.array_join(t["cve_ids"], ", "))),
                F.when(F.size(t["affected_systems"]) > 0, cat("- **Affected Systems:** ", F.array_join(t["affected_systems"], ", "))),
                F.when(F.size(t["iocs"]) > 0, cat("- **Key IOCs:** ", F.array_join(t["iocs"], ", "))),
                "",
            ),
        ),
        F.when(F.size(g["actionable_mitigations"]) > 0, cat("## 7. Actionable Mitigations\n", numbered(g["actionable_mitigations"]), NL)),
        "## 8. Downstream LLM Guidance Directives",
        listed("### Advisory Highlights", d["advisory_bullet_points"]), listed("\n### Executive Takeaways", d["executive_takeaways"]),
        listed("\n### Social Media Hooks", d["social_dissemination_hooks"]), listed("\n### Storyboard & Slide Visual Themes", d["visual_scene_ideas"]),
    )


def video_markdown(g: Column, iocs: dict[str, Column], generated_at: Column) -> Column:
    """A video's grounding context as a document; empty sections are left out."""
    m = g["minto_pyramid"]
    section = lambda title, items, row: F.when(F.size(items) > 0, cat(title, NL, block(items, row), NL))
    line = lambda name, items: F.when(F.size(items) > 0, cat(f"- **{name}:** ", F.array_join(items, ", ")))
    return doc(
        cat("# 🎥 ", g["title"]), cat("\n*Interpreted by `", g["interpreted_by_model"], "` | Generated: ", generated_at, "*\n"),
        "## 1. Executive Narrative", cat(g["executive_overview"], NL), "## 2. Minto Pyramid Briefing Structure",
        cat("- **Situation:** ", m["situation"]), cat("- **Complication:** ", m["complication"]), cat("- **Solution:** ", m["solution"]),
        cat("- **Business Impact:** ", m["business_impact_and_risk"], NL), "## 3. Technical Root Cause & Exploit Mechanics",
        cat(g["technical_root_cause"], NL),
        section("## 4. Canonical Grounding Facts (Locked Metrics)", g["locked_numerical_facts"], lambda x: cat("- 📌 **", x, "**")),
        section("## 5. Timeline of Events", g["timeline_of_events"], lambda x: cat("- ", x)),
        section("## 6. Actionable Mitigations", g["actionable_mitigations"], lambda x, i: cat((i + 1).cast("string"), ". ", x)),
        "## 7. Indicators of Compromise", line("CVEs", iocs["cves"]), line("IP Addresses", iocs["ipv4_addresses"]),
        line("SHA-256 Hashes", iocs["sha256_hashes"]), line("Domains / URLs", F.concat(iocs["domains"], iocs["urls"])), "",
    )


def video_head(name: Column, seconds: Column, resolution: Column, fps: Column, sha256: Column, n_scenes: Column, iocs: dict[str, Column]) -> Column:
    """What stands above the scenes of a video report."""
    line = lambda label, items: cat(f"- **{label}:** ", F.when(F.size(items) > 0, F.array_join(items, ", ")).otherwise("None detected"))
    return doc(
        cat("# 🎥 Multimodal Video Intelligence: ", name),
        cat("\n*Duration: ", seconds.cast("string"), "s | Resolution: ", resolution, " @ ", fps.cast("string"), " FPS | SHA256: `", F.left(sha256, F.lit(16)), "...`*\n"),
        "## 1. Technical Telemetry & Extracted Indicators", cat("- **Total Visual Scenes:** ", n_scenes.cast("string")),
        line("Extracted CVEs", iocs["cves"]), line("IPv4 Addresses", iocs["ipv4_addresses"]), line("SHA256 Signatures", iocs["sha256_hashes"]),
        cat(line("Malicious Domains / URLs", F.concat(iocs["domains"], iocs["urls"])), NL), "## 2. Temporally Aligned Multimodal Scene Timeline\n",
    )


def _cell(c: Column) -> Column:
    return strip(F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit(NL), F.lit(" ")))


def anchor_advisory(kind: str, source: Column, title: Column, overview: Column, anchors: Column, entities: Column | None = None) -> Column:
    """An advisory made of anchors: points with footnotes, entities, a provenance table and the footnotes.

    ``kind`` is ``image`` (anchors with ``id, anchor, extracted_verbatim, category``) or ``audio`` (also ``speaker``
    and ``confidence``); ``entities`` has arrays ``actors``, ``cves``, ``targets`` and, for audio, ``iocs``.
    """
    one = lambda a: strip(F.replace(a["extracted_verbatim"], F.lit(NL), F.lit(" ")))
    if kind == "image":
        shown = F.filter(anchors, lambda a: ~((a["category"] == "CORE_CONCEPT") & (F.size(anchors) > 1)))

        def point(a: Column) -> Column:
            v = a["extracted_verbatim"]
            at = F.instr(v, ":")
            label = F.when(at > 0, strip(F.substr(v, F.lit(1), at - 1))).otherwise(a["anchor"])
            return cat("- **", label, "**: ", F.when(at > 0, strip(F.substr(v, at + 1))).otherwise(v), " [^", a["id"], "]")

        row = lambda a: cat("| ", source, " | ", _cell(a["anchor"]), " | ", _cell(a["extracted_verbatim"]), " |")
        note = lambda a: cat("[^", a["id"], "]: Source: `", source, "` | Visual Anchor: `", a["anchor"], '` | Verbatim: "', one(a), '"')
        names = (("actors", "Threat Actors"), ("cves", "Vulnerabilities / CVEs"), ("targets", "Target Infrastructure / Standards"))
        heads = ("## Threat & Target Entities", "## Provenance Table\n| Source Image | Visual Anchor | Verbatim Text |\n|---|---|---|", "## Key Benefits")
    else:
        shown = anchors
        point = lambda a: cat("- **[", a["speaker"], "]** (", a["anchor"], "): ", a["extracted_verbatim"], " [^", a["id"], "]")
        row = lambda a: cat(
            "| ", source, " | `", _cell(a["anchor"]), "` | ", _cell(a["speaker"]), " | ", _cell(a["extracted_verbatim"]), " | `", a["category"],
            "` | ", percent(a["confidence"]), " |",
        )
        note = lambda a: cat(
            "[^", a["id"], "]: Source: `", source, "` | Timecode: `", a["anchor"], "` | Speaker: `", a["speaker"], '` | Verbatim: "', one(a), '"'
        )
        names = (("actors", "Threat Actors Named"), ("cves", "CVEs Disclosed"), ("targets", "Target Infrastructure / Enclaves"))
        heads = (
            "## Verbalized Threat Entities & Indicators",
            "## Provenance & Audio Grounding Table\n| Source Audio | Timestamp Range | Speaker / Role | Verbatim Spoken Text | Category | Confidence |\n|---|---|---|---|---|---|",
            "## Key Findings",
        )
    found = None
    if entities is not None:
        parts = [F.when(F.size(entities[k]) > 0, cat(f"- **{n}**: ", F.array_join(entities[k], ", "))) for k, n in names]
        if kind == "audio":
            spoken = F.array_join(F.transform(entities["iocs"], lambda x: cat("`", x, "`")), ", ")
            parts.append(F.when(F.size(entities["iocs"]) > 0, cat("- **Spoken IOCs (IPs / Domains)**: ", spoken)))
        some = F.concat_ws("", *parts) != ""
        found = F.when(some, doc(heads[0], "", *parts, ""))
    return doc(
        cat("# ", title), "", "## Overview", strip(overview), "", heads[2], block(shown, point), "", found, heads[1], block(anchors, row), "",
        block(anchors, note), "",
    )


def anchor_transcript(anchors: Column, audio: bool) -> Column:
    """The raw text of anchors, one per line."""
    if audio:
        return block(anchors, lambda a: cat("[", a["id"], "] (", a["anchor"], ") ", a["speaker"], ': "', a["extracted_verbatim"], '"'))
    return block(anchors, lambda a: cat("[", a["id"], "] (", a["anchor"], "): ", a["extracted_verbatim"]))


# what a keyframe shows


def slide_content(text: Column) -> Column:
    rows = F.filter(F.transform(lines(text), strip), lambda x: x != "")
    marked = F.transform(F.slice(rows, 2, F.size(rows)), lambda x: F.when(x.rlike("^[-*•]"), x).otherwise(cat("- ", x)))
    return F.when(F.size(rows) > 0, doc(cat("#### 📑 Slide: ", F.get(rows, F.lit(0))), F.when(F.size(marked) > 0, F.array_join(marked, NL)))).otherwise("*(Empty slide)*")


def terminal_paths(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?:/[a-zA-Z0-9_\.\-]+)+|(?:[C-Z]:\\[a-zA-Z0-9_\.\-\\]+)"), F.lit(0))


def terminal_content(text: Column) -> Column:
    paths = terminal_paths(text)
    return cat(
        "#### 💻 Terminal Session / Shell Output\n\n```bash\n", text, "\n```",
        F.when(F.size(paths) > 0, cat("\n*Referenced Paths:* `", F.array_join(F.slice(paths, 1, 5), ", "), "`")).otherwise(""),
    )


def mermaid(text: Column) -> Column:
    """A flow chart of the first four lines of more than three characters, or a fixed one."""
    names = F.slice(
        F.transform(F.filter(lines(text), lambda x: F.length(strip(x)) > 3), lambda x: F.regexp_replace(x, r"[^a-zA-Z0-9_\- ]", "")), 1, 4
    )
    nodes = F.transform(names, lambda x, i: cat("    N", i.cast("string"), '["', x, '"]'))
    arrows = F.transform(F.slice(names, 2, 4), lambda x, i: cat("    N", i.cast("string"), " --> N", (i + 1).cast("string")))
    made = cat("```mermaid\nflowchart LR\n", F.array_join(F.concat(nodes, arrows), NL), "\n```")
    fixed = F.lit("```mermaid\nflowchart LR\n    A[Threat Actor] -->|Inbound Vector| B[Target Network]\n```")
    return F.when(F.size(names) >= 2, made).otherwise(fixed)


def visual_content(kind: Column, text: Column) -> Column:
    """A keyframe's text as markdown, by its kind."""
    diagram = cat(
        "#### 📊 Architecture / Attack Flow Diagram\n\n", mermaid(text),
        "\n\n**Narrative:** System architecture diagram illustrating network topology and threat pathways.",
    )
    other = cat(
        "*(Scene Visual: Visual scene displaying presenter briefing or transition slide.)*", F.when(text != "", cat("\n> ", text)).otherwise("")
    )
    return F.when(kind == "SLIDE", slide_content(text)).when(kind == "TERMINAL", terminal_content(text)).when(kind == "DIAGRAM", diagram).otherwise(other)


def visual_narrative(kind: Column, text: Column) -> Column:
    """What a keyframe shows, in a sentence; nothing for an empty slide."""
    rows = F.filter(F.transform(lines(text), strip), lambda x: x != "")
    slide = F.when(F.size(rows) > 0, cat("Presentation slide covering: ", F.get(rows, F.lit(0)))).otherwise("")
    return (
        F.when(kind == "SLIDE", slide)
        .when(kind == "TERMINAL", "Active command-line console session displaying terminal execution logs.")
        .when(kind == "DIAGRAM", "System architecture diagram illustrating network topology and threat pathways.")
        .otherwise("Visual scene displaying presenter briefing or transition slide.")
    )


def scene_section(scene: Column) -> Column:
    """One scene of a video report; ``scene`` has ``scene_id, timestamp_display, visual_type, spoken_transcript, content, iocs``."""
    return doc(
        cat("### ⏱️ Scene ", scene["scene_id"].cast("string"), " [", scene["timestamp_display"], "] - Visual: `", scene["visual_type"], "`"),
        cat('**Spoken Narration:** "', scene["spoken_transcript"], '"\n'), cat(scene["content"], NL),
        F.when(F.size(scene["iocs"]) > 0, cat("📌 **Scene Indicators:** `", F.array_join(scene["iocs"], ", "), "`\n")), "---",
    )


def source_summary(text: Column, files: Column, links: Column) -> Column:
    """``N chars of text · k file(s) · m link(s)``; parts that are zero are left out."""
    n = F.length(text)
    parts = F.concat_ws(
        " · ", F.when(n > 0, cat(F.format_number(n, 0), " chars of text")), F.when(files > 0, cat(files.cast("string"), " file(s)")),
        F.when(links > 0, cat(links.cast("string"), " link(s)")),
    )
    return F.coalesce(F.nullif(parts, F.lit("")), F.lit("empty source"))


def link_label(url: Column) -> Column:
    """Host and path of a URL, ``/`` for an empty path; the text itself if it isn't a URL."""
    host = F.try_parse_url(url, F.lit("HOST"))
    path = F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    return F.when(host.isNotNull(), cat(host, path)).otherwise(url)
