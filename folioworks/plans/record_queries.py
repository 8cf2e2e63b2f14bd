"""Queries over parents, children and events, and over deliverables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.functions import text as T
from folioworks.operators import classify, grounding, records, rendering
from folioworks.session import spread, table


def jobs_with_files(spark: SparkSession, d: str) -> DataFrame:
    """Every order with its items in order of number: parents with sorted children, also those without any."""
    items = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    rows = records.with_children(table(spark, d, "orders"), items, "o_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], ["l_linenumber", "l_partkey"], "items")
    shown = F.transform("items", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_partkey"].cast("string")))
    return rows.select("o_orderkey", F.size("items").alias("n_items"), F.array_join(shown, ",").alias("items"))


JOBS_SQL = """with i as (select l_orderkey k, count(*) n, string_agg(l_linenumber || ':' || l_partkey, ',' order by l_linenumber, l_partkey, l_suppkey) s from lineitem group by all)
select o_orderkey, cast(coalesce(n, 0) as int) n_items, coalesce(s, '') as items from orders left join i on k = o_orderkey"""


def owned_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The orders of the customers of one segment, and nothing of the customers."""
    mine = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return records.owned_by(table(spark, d, "orders").select("o_orderkey", "o_custkey"), mine, "o_custkey")


OWNED_SQL = "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')"


def missing_parents(spark: SparkSession, d: str) -> DataFrame:
    """Customers without any order."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return records.without_match(table(spark, d, "customer").select("c_custkey", "c_name"), o, "c_custkey")


MISSING_SQL = "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders)"


def user_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Point lookup by a normalized name, among active users only."""
    c = table(spark, d, "customer")
    return c.where((F.lower(T.strip(F.col("c_name"))) == "customer#000000077") & (F.col("c_acctbal") > -1e9)).select("c_custkey", "c_name")


USER_SQL = "select c_custkey, c_name from customer where lower(trim(c_name)) = 'customer#000000077' and c_acctbal > -1e9"


def first_claims(spark: SparkSession, d: str) -> DataFrame:
    """Which event wins each user: the first one."""
    return records.first_claim(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id")


CLAIM_SQL = "select user_id, ts, event_id, event_type from events qualify row_number() over (partition by user_id order by ts, event_id) = 1"


def last_states(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user: the state of an append-only log."""
    return records.latest_state(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id")


STATE_SQL = "select user_id, ts, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1"


def newest_jobs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return records.newest(o, [F.desc("o_orderdate"), F.desc("o_orderkey")], 20)


NEWEST_SQL = "select o_orderkey, o_orderdate, o_totalprice from orders order by o_orderdate desc, o_orderkey desc limit 20"


def job_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """One JSON summary per file type and block of a thousand reports: count and every file's name and size."""
    block = F.floor(F.col("doc_id") / 1000).alias("block")
    f = table(spark, d, "source_context").select(F.lower("file_type").alias("file_type"), block, "file_name", "processed_at", "line_count")
    artifacts = records.job_artifact(f, ["file_type", "block"], "file_name", ["processed_at", "line_count"])
    return artifacts.select("file_type", "block", "file_count", F.sha2("artifact", 256).alias("artifact_sha"))


ARTIFACT_SQL = """with f as (select lower(file_type) file_type, doc_id // 1000 block, file_name, processed_at, line_count from source_context),
j as (select file_type, block, count(*) n, string_agg('{' || array_to_string(list_filter(['"file_name":"' || file_name || '"', '"processed_at":"' || processed_at || '"', '"line_count":' || line_count], lambda x: x is not null), ',') || '}', ','
   order by file_name nulls first, processed_at nulls first, line_count nulls first) s from f group by all)
select file_type, block, n file_count, sha256('{"file_count":' || n || ',"files":[' || s || ']}') artifact_sha from j"""


def file_check(spark: SparkSession, d: str) -> DataFrame:
    """Reports whose stated number of characters isn't that of their text."""
    c = table(spark, d, "source_context")
    manifest = c.select(F.concat_ws("/", F.col("doc_id").cast("string"), "processed_at").alias("k"), F.coalesce("character_count", F.lit(-1)).cast("long").alias("size"))
    stored = c.select(F.concat_ws("/", F.col("doc_id").cast("string"), "processed_at").alias("k"), F.length("clean_markdown").cast("long").alias("size"))
    return records.size_mismatch(manifest, stored, "k", "size")


CHECK_SQL = """with a as (select concat_ws('/', doc_id, processed_at) k, cast(coalesce(character_count, -1) as bigint) s, cast(length(clean_markdown) as bigint) l from source_context),
b as (select k, max(l) m from a group by all)
select a.k, case when m is null then 'missing' else 'size differs' end problem from a join b on a.k = b.k where m is null or m <> s"""


def _payload(spark: SparkSession, d: str) -> DataFrame:
    """Deliverables taken apart: title, first paragraph, sentences and lines."""
    t = F.col("final_content")
    rows = spread(table(spark, d, "final_deliverable")).where("final_content is not null")
    paragraphs = F.filter(F.transform(F.split(t, r"\n+"), T.strip), lambda x: x != "")
    points = F.transform(F.filter(paragraphs, lambda x: x.startswith("- ")), lambda x: F.substr(x, F.lit(3)))
    return rows.select("row_id", classify.output_key(F.lower("platform_key")).alias("key"), F.get(paragraphs, F.lit(0)).alias("title"), F.get(paragraphs, F.lit(1)).alias("lead"), points.alias("points"), T.sorted_set(F.regexp_extract_all(t, F.lit(r"(?i)CVE-\d{4}-\d{4,7}\b"), F.lit(0))).alias("cves"))


def _struct(kind: str) -> Column:
    """The payload of one kind of deliverable, made of the parts of the text."""
    c = F.col
    none = F.lit(None).cast("string")
    few = F.slice("points", 1, 3)
    parts: dict[str, list[Column]] = {
        "linkedin_post": [c("title").alias("hook"), c("lead").alias("threat_context"), c("points").alias("key_insights"), few.alias("actionable_takeaways"), none.alias("discussion_prompt"), c("cves").alias("hashtags")],
        "social_thread": [c("points").alias("all_tweets"), *[c("title").alias(f"{k}_tweet") for k in ("hook", "exploit", "ioc", "mitigation", "wrapup")]],
        "advisory": [none.alias("tl_protocol"), F.lit("HIGH").alias("severity"), none.alias("cvss_score"), c("cves").alias("cve_ids"), c("title").alias("threat_actor"), c("lead").alias("executive_summary"), none.alias("technical_analysis"),
            F.transform("cves", lambda x: F.struct(F.lit("CVE").alias("type"), x.alias("indicator"), none.alias("context"), F.lit("Patch").alias("action"))).alias("iocs"), few.alias("mitigations"), c("title").alias("cert_reporting")],
        "exec_summary": [c("title").alias("bluf"), c("lead").alias("situation"), none.alias("complication"), c("title").alias("solution"), c("points").alias("strategic_recommendations")],
        "incident_report": [none.alias("incident_id"), none.alias("status"), none.alias("severity"), F.transform("points", lambda x, i: F.struct(F.concat(F.lit("T+"), i.cast("string")).alias("time"), x.alias("event"))).alias("timeline"), c("lead").alias("root_cause"),
            c("cves").alias("blast_radius"), F.transform(few, lambda x: F.struct(none.alias("status"), x.alias("action"), none.alias("owner"))).alias("corrective_actions")],
        "press_release": [none.alias("dateline"), c("title").alias("headline"), c("lead").alias("customer_impact"), c("points").alias("proactive_measures"), few.alias("user_guidance"), none.alias("media_contact")],
        "slide_deck": [F.transform("points", lambda x, i: F.struct(F.when(i > 0, x).alias("title"), none.alias("type"), F.array(x).alias("key_points"), F.when(i == 0, x).alias("speaker_notes"))).alias("slides")],
        "video_script": [F.lit(None).cast("int").alias("runtime_seconds"), F.transform("points", lambda x: F.struct(none.alias("scene"), x.alias("visual"), none.alias("narrator"))).alias("scenes")],
        "playbook": [none.alias("playbook_code"), F.transform("points", lambda x, i: F.struct((i + 1).alias("stage"), x.alias("title"), F.array(x, x).alias("steps"), F.when(i == 0, F.array(x)).otherwise(F.array().cast("array<string>")).alias("commands"))).alias("stages")],
    }
    return F.struct(*parts[kind])


def _render(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = _payload(spark, d).select("row_id", _struct(kind).alias("p"))
        return rows.select("row_id", rendering.RENDERERS[kind](F.col("p")).alias("markdown"))

    query.__name__ = f"render_{kind}"
    query.__doc__ = f"Every deliverable as {kind}."
    return query


_PAY = r"""with a as (select row_id, final_content t, list_filter(list_transform(string_split_regex(final_content, '\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') ps from final_deliverable where final_content is not null),
p as (select row_id, ps[1] title, coalesce(ps[2], '') lead, list_transform(list_filter(ps, lambda x: starts_with(x, '- ')), lambda x: substr(x, 3)) pt, list_sort(list_distinct(regexp_extract_all(t, '(?i)CVE-\d{4}-\d{4,7}\b'))) cv from a),
q as (select *, pt[1:3] few from p)
select row_id, """
_NL = "chr(10)"


def _rows(*rows: str) -> str:
    """Rows of SQL text joined by line feeds; null rows are left out."""
    return f"concat_ws({_NL}, {', '.join(rows)}) markdown from q"


def _blk(items: str, expr: str) -> str:
    return f"case when len({items}) > 0 then array_to_string(list_transform({items}, lambda x, i: {expr}), {_NL}) end"


_BUL, _NUM = "'- ' || x", "i || '. ' || x"
RENDER_SQL = {
    "linkedin_post": _rows("title", "''", "lead", "''", "'## Key Insights'", _blk("pt", _BUL), "''", "'## Actionable Takeaways'", _blk("few", _NUM), "''", "'---'", "''", "''", "''", "array_to_string(cv, ' ')"),
    "social_thread": f"array_to_string(case when len(pt) > 0 then pt else [title, title, title, title, title] end, {_NL} || '---' || {_NL}) markdown from q",
    "advisory": _rows("'# TECHNICAL SECURITY ADVISORY'", "'**TRAFFIC LIGHT PROTOCOL:** TLP:AMBER+STRICT | **SEVERITY:** HIGH'", "case when len(cv) > 0 then '**CVE(s):** ' || array_to_string(cv, ', ') end", "case when title <> '' then '**THREAT ACTOR:** ' || title end",
        "''", "'---'", "''", "'## Executive Summary'", "lead", "''", "'## Technical Analysis & Exploit Chain'", "''", "''", "'## Indicators of Compromise (IOCs)'", "'| Type | Indicator | Context | Recommended Action |'", "'|------|-----------|---------|-------------------|'",
        _blk("cv", "'| CVE | `' || x || '` |  | Patch |'"), "''", "'## Prioritized Mitigations'", _blk("few", _NUM), f"case when title <> '' then {_NL} || '## Official Reporting' || {_NL} || title end"),
    "exec_summary": _rows("'# EXECUTIVE BRIEF: CYBERSECURITY INCIDENT & RISK ASSESSMENT'", "'**CLASSIFICATION:** STRICTLY CONFIDENTIAL // BOARD MATERIAL'", "''", "'---'", "''", "'### BLUF (Bottom Line Up Front)'", "title", "''", "'### Situation'", "lead", "''",
        "'### Complication & Business Risk'", "''", "''", "'### Solution & Containment Actions'", "title", "''", "'### Strategic Recommendations & Decisions Required'", _blk("pt", _NUM)),
    "incident_report": _rows("'# INCIDENT TRIAGE & FORENSIC REPORT: INC-2026-XXXX'", "'**Status:** CONTAINED | **Severity:** Tier 1 High'", "''", "'---'", "''", "'## Incident Timeline (UTC)'", _blk("pt", "'- **T+' || (i - 1) || '** — ' || x"), "''", "'## Root Cause Analysis'", "lead", "''",
        "'## Blast Radius & Affected Systems'", _blk("cv", _BUL), "''", "'## Corrective Actions'", _blk("few", "'- [PENDING] ' || x || ' (Owner: TBD)'")),
    "press_release": _rows("'# PUBLIC SECURITY ADVISORY & STATEMENT'", "'**FOR IMMEDIATE RELEASE**'", "'**Dateline:** UNKNOWN — DATE'", "''", "'---'", "''", "'## ' || title", "''", "'### Customer Impact Statement'", "lead", "''", "'### Proactive Protections Applied'", _blk("pt", _BUL), "''",
        "'### Safe Practices for Users'", _blk("few", _BUL), "''", "'### Media Contact'", "''"),
    "slide_deck": _rows("'# PRESENTATION SLIDE DECK: THREAT RESPONSE & STRATEGY'", "''", _blk("pt", f"'## Slide ' || i || ': ' || case when i > 1 then x else 'Slide 1' end || {_NL} || '**Type:** CONTENT' || {_NL} || {_NL} || '- ' || x || case when i = 1 and x <> '' then {_NL} || {_NL} || '*Speaker Notes:* ' || x else '' end || {_NL}")),
    "video_script": _rows("'# VIDEO NARRATION SCRIPT: CYBER THREAT BRIEFING'", "'**Runtime:** 90 seconds'", "''", "'---'", "''", _blk("pt", f"'## Scene' || {_NL} || '**Visual:** ' || x || {_NL} || '**Narrator (VO):** ' || {_NL}")),
    "playbook": _rows("'# REMEDIATION PLAYBOOK: PB-SEC-XX'", "'**Category:** Emergency Containment & Recovery'", "''", "'---'", "''", _blk("pt", f"'## Stage ' || i || ': ' || x || {_NL} || {_NL} || '- ' || x || {_NL} || '- ' || x || case when i = 1 then {_NL} || {_NL} || '**Commands:**' || {_NL} || '```bash' || {_NL} || x || {_NL} || '```' else '' end || {_NL}")),
}


def deliverable_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Each deliverable by the renderer of its own key; unknown keys stay empty."""
    rows = _payload(spark, d)
    out = F.lit(None).cast("string")
    for kind, render in rendering.RENDERERS.items():
        rows = rows.withColumn(f"p_{kind}", _struct(kind))
        out = F.coalesce(out, F.when(F.col("key") == kind, render(F.col(f"p_{kind}"))))
    return rows.select("row_id", "key", T.title_case(F.col("key")).alias("display_name"), F.sha2(out, 256).alias("markdown_sha"))


DISPATCH_SQL = _PAY.replace("select row_id, final_content t", "select row_id, lower(platform_key) pk, final_content t").replace("p as (select row_id, ps[1]", "p as (select row_id, pk, ps[1]") + (
    "case pk when 'executive_summary' then 'exec_summary' when 'linkedin' then 'linkedin_post' when 'twitter' then 'social_thread' when 'presentation' then 'slide_deck' when 'video_package' then 'video_script' when 'infographic' then 'playbook' else pk end as key, "
    "array_to_string(list_transform(string_split(replace(pk, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') display_name, sha256(case pk "
    + " ".join(f"when '{k}' then {s.rpartition(' markdown from q')[0]}" for k, s in RENDER_SQL.items())
    + " end) markdown_sha from q"
)


def provenance(spark: SparkSession, d: str) -> DataFrame:
    """The provenance of every deliverable with defaults, and its number of items."""
    rows = table(spark, d, "final_deliverable").select("row_id", grounding.provenance_defaults(F.col("provenance")).alias("p"))
    shown = F.transform("p", lambda x: F.concat(x["citation_marker"], F.lit("="), x["source_reference"]))
    return rows.select("row_id", F.size("p").alias("n"), F.array_join(shown, ";").alias("items"))


PROVENANCE_SQL = "select row_id, cast(coalesce(len(provenance), 0) as int) n, coalesce(array_to_string(list_transform(provenance, lambda x: coalesce(x.citation_marker, '') || '=' || coalesce(x.source_reference, '')), ';'), '') as items from final_deliverable"


def source_summaries(spark: SparkSession, d: str) -> DataFrame:
    """What each deliverable is made of, and where its first link leads."""
    t = F.coalesce(F.col("final_content"), F.lit(""))
    links = F.coalesce(F.regexp_extract_all(t, F.lit(r"https?://[^\s<>]+"), F.lit(0)), F.array().cast("array<string>"))
    files = F.coalesce(F.greatest(F.size("provenance"), F.lit(0)), F.lit(0))
    first = F.coalesce(F.get(links, F.lit(0)), F.lit("not a link"))
    return table(spark, d, "final_deliverable").select("row_id", rendering.source_summary(T.strip(t), files, F.size(links)).alias("summary"), rendering.link_label(first).alias("link"))


SUMMARY_SQL = r"""with a as (select row_id, regexp_replace(coalesce(final_content, ''), '^\s+|\s+$', '', 'g') t, coalesce(len(provenance), 0) f, coalesce(regexp_extract_all(coalesce(final_content, ''), 'https?://[^\s<>]+'), []::varchar[]) l from final_deliverable)
select row_id, coalesce(nullif(concat_ws(' · ', case when length(t) > 0 then regexp_replace(reverse(regexp_replace(reverse(cast(length(t) as varchar)), '(\d{3})', '\1,', 'g')), '^,', '') || ' chars of text' end, case when f > 0 then f || ' file(s)' end, case when len(l) > 0 then len(l) || ' link(s)' end), ''), 'empty source') summary,
 case when len(l) > 0 then regexp_extract(l[1], '^https?://([^/?#]+)', 1) || regexp_replace(regexp_extract(l[1], '^https?://[^/?#]+([^?#]*)', 1), '^$', '/') else 'not a link' end link from a"""


def selected_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Per report the kinds of deliverables in the order in which they first came, and merged settings, the last winning."""
    rows = table(spark, d, "final_deliverable").where("doc_id is not null and platform_key is not null")
    per = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("row_id", "platform_key"))).alias("r"))
    keys = records.in_order_distinct(F.transform("r", lambda x: classify.output_key(F.lower(x["platform_key"]))))
    params = records.merged_params(F.transform("r", lambda x: F.create_map(F.lit("last"), x["platform_key"], F.lower(x["platform_key"]), x["row_id"].cast("string"))))
    return per.select("doc_id", F.array_join(keys, ",").alias("keys"), F.try_element_at(params, F.lit("last")).alias("last_key"), F.size(F.map_keys(params)).alias("n_params"))


SELECTED_SQL = """with o as (select doc_id, list(lower(platform_key) order by row_id, platform_key) k, max_by(platform_key, row_id) l from final_deliverable where doc_id is not null and platform_key is not null group by all)
select doc_id, array_to_string(list_transform(list_filter(list_transform(range(1, len(k) + 1), lambda i: case when list_position(k, k[i]) = i then k[i] end), lambda x: x is not null), lambda x: x), ',') as keys, l last_key, cast(len(list_distinct(k)) + 1 as int) n_params from o"""

QUERIES = {
    f.__name__: f
    for f in (
        jobs_with_files, owned_jobs, missing_parents, user_lookup, first_claims, last_states, newest_jobs, job_artifacts, file_check,
        *map(_render, rendering.RENDERERS), deliverable_dispatch, provenance, source_summaries, selected_outputs,
    )
}
SQL = {
    "jobs_with_files": JOBS_SQL, "owned_jobs": OWNED_SQL, "missing_parents": MISSING_SQL, "user_lookup": USER_SQL, "first_claims": CLAIM_SQL,
    "last_states": STATE_SQL, "newest_jobs": NEWEST_SQL, "job_artifacts": ARTIFACT_SQL, "file_check": CHECK_SQL, "provenance": PROVENANCE_SQL,
    "source_summaries": SUMMARY_SQL, "selected_outputs": SELECTED_SQL, "deliverable_dispatch": DISPATCH_SQL,
} | {f"render_{k}": _PAY + s for k, s in RENDER_SQL.items()}
