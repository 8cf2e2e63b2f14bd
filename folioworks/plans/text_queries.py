"""Queries over reports: statistics, indicators, tables, chunks, grounding and normal forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.functions import text as T
from folioworks.operators import chunking, classify, grounding, indicators, records, redaction, rendering, tables
from folioworks.session import spread, table
from folioworks.sources import readers, sinks

KEYS = ["doc_id", "processed_at"]
#: Bytes of a normalized text at most: the reference's upload limit.
NORMALIZED_BYTES = 25 * 1024 * 1024
ORIGIN = ["origin", "doc_id", "processed_at"]
#: Every text in which indicators and terms are searched: table, key, version, kind, text.
TEXTS = (
    ("source_context", "doc_id", "processed_at", "lower(file_type)", "clean_markdown || ' ' || coalesce(sha256_checksum, '')"),
    ("final_deliverable", "row_id", "cast(null as string)", "lower(platform_key)", "final_content"),
    ("enriched_grounding", "context_id", "cast(null as string)", "'answer'", "threat_metadata"),
    ("grounding_anchor", "row_id", "cast(null as string)", "lower(category)", "extracted_verbatim"),
    ("sensitive_flag", "row_id", "cast(null as string)", "lower(type)", "match"),
)


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """Every row of the reports, its text as ``t``."""
    return spread(table(spark, d, "source_context")).withColumn("t", F.col("clean_markdown"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Every text of the corpus: ``(origin, doc_id, processed_at, kind, t)``."""
    rows = [
        spread(table(spark, d, name)).selectExpr(f"'{name}' origin", f"{key} doc_id", f"{version} processed_at", f"{kind} kind", f"{text} t")
        for name, key, version, kind, text in TEXTS
    ]
    return reduce(DataFrame.unionByName, rows)


_BASE = (
    "with r as ("
    + " union all ".join(
        f"select '{name}' origin, {key} doc_id, {version} processed_at, {kind} kind, {text} t from {name}".replace("as string", "as varchar")
        for name, key, version, kind, text in TEXTS
    )
    + ")\n"
)
_REPORTS = "with r as (select *, clean_markdown t from source_context)\n"


def _re(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


_ALL = "coalesce(regexp_extract_all({t}, {p}, {g}), []::varchar[])"


def _all(p: str, g: int = 0, t: str = "t") -> str:
    return _ALL.format(t=t, p=_re(p), g=g)


def _refang(x: str) -> str:
    for a, b in (("[.]", "."), ("(.)", "."), ("hxxp://", "http://"), ("hxxps://", "https://"), ("[at]", "@"), ("(@)", "@")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"rtrim({x}, {_re(T.TRAILING)})"


_IGN_URL = " and ".join(f"not contains(lower(x), '{d}')" for d in indicators.IGNORED_DOMAINS)
_IGN_DOM = " and ".join(f"x <> '{d}' and not ends_with(x, '.{d}')" for d in indicators.IGNORED_DOMAINS)
_IOC_LISTS = f"""
i0 as (select *, list_distinct(list_transform({_all(indicators.SHA256)}, lambda x: lower(x))) s256,
  list_distinct(list_transform({_all(indicators.SHA1)}, lambda x: lower(x))) s1a, list_distinct(list_transform({_all(indicators.MD5)}, lambda x: lower(x))) m5a from r),
i1 as (select *, list_filter(s1a, lambda h: len(list_filter(s256, lambda s: contains(s, h))) = 0) s1 from i0),
i as (select *, list_filter(m5a, lambda h: len(list_filter(s256, lambda s: contains(s, h))) = 0 and len(list_filter(s1, lambda s: contains(s, h))) = 0) m5 from i1),
l as (select *,
  list_sort(list_distinct(list_transform({_all(indicators.CVE)}, lambda x: upper(x)))) cves,
  list_sort(list_distinct(list_filter({_all(indicators.IPV4)}, lambda x: regexp_matches(x, {_re(indicators.OCTETS)}) and x not in ('0.0.0.0','255.255.255.255') and not starts_with(x, '127.')))) ipv4_addresses,
  list_sort(list_distinct(list_filter({_all(indicators.IPV6)}, lambda x: (len(list_filter(string_split(x, ':'), lambda g: g <> '')) = 8 and not contains(x, '::'))
    or (contains(x, '::') and not regexp_matches(x, '::.*::|:::') and len(list_filter(string_split(x, ':'), lambda g: g <> '')) <= 7 and not regexp_matches(x, '^:[^:]|[^:]:$'))))) ipv6_addresses,
  list_sort(s256) sha256_hashes, list_sort(s1) sha1_hashes, list_sort(m5) md5_hashes,
  list_sort(list_distinct(list_filter(list_transform({_all(indicators.DOMAIN)}, lambda d: lower({_refang("d")})), lambda x: not ends_with(x, '.local') and {_IGN_DOM}))) domains,
  list_sort(list_distinct(list_filter(list_transform({_all(indicators.URL)}, lambda u: {_refang("u")}), lambda x: length(x) > 10 and {_IGN_URL}))) urls,
  list_sort(list_distinct(list_transform({_all(indicators.ATTACK)}, lambda x: upper(x)))) mitre_attack_ids
  from i)"""


def ext_indicators(spark: SparkSession, d: str) -> DataFrame:
    return indicators.indicators_long(_texts(spark, d), ORIGIN, "t")


EXT_SQL = _BASE.rstrip() + "," + _IOC_LISTS + "\n" + " union all ".join(
    f"select origin, doc_id, processed_at, '{k}' ioc_type, unnest({k}) as \"value\" from l" for k in indicators.KINDS
)


def ext_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = indicators.with_indicators(_texts(spark, d).select(*ORIGIN, "t"), "t")
    i = indicators.columns(indicators.KINDS)
    return rows.select(*ORIGIN, indicators.total_found(i).alias("total_iocs_found"), F.array_join(grounding.key_indicators(i), "|").alias("key_indicators"))


TOTALS_SQL = _BASE.rstrip() + "," + _IOC_LISTS + "\nselect origin, doc_id, processed_at, cast(" + " + ".join(f"len({k})" for k in indicators.KINDS) + """ as int) total_iocs_found,
  array_to_string(list_concat(list_concat(ipv4_addresses[1:5], sha256_hashes[1:3]), domains[1:5]), '|') key_indicators from l"""


def ext_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Indicators per kind and origin of text: how many and how many different ones, over the whole corpus."""
    rows = indicators.indicators_long(_texts(spark, d), ["origin", "kind"], "t")
    return rows.groupBy("origin", "kind", "ioc_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"))


KIND_SQL = _BASE.rstrip() + "," + _IOC_LISTS + ", x as (" + " union all ".join(
    f"select origin, kind, '{k}' ioc_type, unnest({k}) as v from l" for k in indicators.KINDS
) + ") select origin, kind, ioc_type, count(*) n, count(distinct v) n_values from x group by all"


def ext_artifacts(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d).select(*ORIGIN, F.explode(indicators.forensic_artifacts(F.col("t"))).alias("kind", "v"))
    return rows.select(*ORIGIN, "kind", F.explode("v").alias("value"))


ARTIFACT_SQL = _BASE + " union all ".join(
    f"select origin, doc_id, processed_at, '{k}' kind, unnest(list_distinct({_all(p)})) as \"value\" from r" for k, p in indicators.ARTIFACTS.items()
)


def ext_threat(spark: SparkSession, d: str) -> DataFrame:
    rows = indicators.with_terms(_texts(spark, d).select(*ORIGIN, "t"), "t")
    j = lambda c: F.array_join(c, "|").alias(c)
    return rows.select(
        *ORIGIN, j("threat_actors"), j("affected_systems"), j("severity_keywords"), F.get("cvss_scores", F.lit(0)).alias("top_cvss"),
        F.size("cvss_scores").alias("n_cvss"), j("timelines"),
    )


def _terms_sql(p: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_transform({_all(p)}, lambda m: regexp_replace(trim(m), '\\s+', ' ', 'g')))), '|')"


_CVSS_SQL = f"list_distinct(list_filter(list_transform(list_zip({_all(indicators.CVSS, 1)}, {_all(indicators.CVSS, 2)}), lambda z: try_cast(case when z[1] <> '' then z[1] else z[2] end as double)), lambda v: v is not null))"
THREAT_SQL = _BASE + f"""select origin, doc_id, processed_at, {_terms_sql(indicators.ACTORS)} threat_actors, {_terms_sql(indicators.SYSTEMS)} affected_systems,
  array_to_string(list_filter(['CRITICAL','HIGH','MEDIUM','LOW','INFORMATIONAL'], lambda s: list_contains(list_transform({_all(indicators.SEVERITY)}, lambda x: upper(x)), s)), '|') severity_keywords,
  list_max({_CVSS_SQL}) top_cvss, cast(len({_CVSS_SQL}) as int) n_cvss, {_terms_sql(indicators.TIMELINE)} timelines from r"""


def doc_stats(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    return _reports(spark, d).select(
        *KEYS, T.word_count(t).alias("words"), F.length(t).alias("chars"), F.size(T.lines(t)).alias("n_lines"), T.token_estimate(t).alias("tokens"),
        F.sha2(t, 256).alias("sha256"), (F.octet_length(t)).alias("bytes"),
    )


STATS_SQL = r"""
select doc_id, processed_at, cast(len(regexp_extract_all(clean_markdown, '\S+')) as int) words, cast(length(clean_markdown) as int) chars,
  cast(len(string_split(regexp_replace(replace(replace(clean_markdown, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n$', ''), chr(10))) as int) n_lines,
  cast(greatest(1, length(clean_markdown) // 4) as int) tokens, sha256(clean_markdown) sha256, cast(octet_length(encode(clean_markdown)) as int) bytes from source_context"""

_LINES = "string_split(regexp_replace(replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n$', ''), chr(10))"
_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_CELLS = "list_transform(string_split(regexp_replace({x}, '^\\|+|\\|+$', '', 'g'), '|'), lambda c: " + _STRIP.format(x="c") + ")"
_TABLES = (
    "src as (select doc_id, processed_at, clean_markdown t from source_context where clean_markdown is not null),\n"
    f"ln as (select doc_id, processed_at, unnest({_LINES.format(t='t')}) line, generate_subscripts({_LINES.format(t='t')}, 1) pos from src),\n"
    f"cl as (select doc_id, processed_at, pos, regexp_replace({_STRIP.format(x='line')}, '^[-*+]\\s*\\|', '|') line from ln),\n"
    "ro as (select *, starts_with(line, '|') and ends_with(line, '|') is_row from cl where line <> ''),\n"
    "isl as (select *, sum(case when is_row then 0 else 1 end) over (partition by doc_id, processed_at order by pos) island from ro),\n"
    "blk as (select doc_id, processed_at, island, list(line order by pos) b from isl where is_row group by all having count(*) >= 2),\n"
    "hd as (select *, row_number() over (partition by doc_id, processed_at order by island) table_index, " + _CELLS.format(x="b[1]") + " headers from blk),\n"
    f"tb as (select *, list_transform(list_filter(b[2:], lambda x: not regexp_matches(x, {_re(tables.SEPARATOR)})), lambda x: list_resize(" + _CELLS.format(x="x") + ", len(headers), '')) rws from hd)\n"
)


def text_tables(spark: SparkSession, d: str) -> DataFrame:
    t = tables.extract_tables(_reports(spark, d), KEYS, "t")
    return t.select(
        *KEYS, "table_index", F.array_join("headers", "|").alias("headers"),
        F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n").alias("cells"), "markdown", "row_count", "column_count",
    )


TABLE_SQL = "with " + _TABLES + """select doc_id, processed_at, cast(table_index as int) table_index, array_to_string(headers, '|') headers,
  array_to_string(list_transform(rws, lambda r: array_to_string(r, '|')), chr(10)) cells, array_to_string(b, chr(10)) markdown,
  cast(len(rws) as int) row_count, cast(len(headers) as int) column_count from tb"""


def aligned_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every table written anew with aligned columns."""
    t = tables.extract_tables(_reports(spark, d), KEYS, "t")
    return t.select(*KEYS, "table_index", tables.to_markdown(F.col("headers"), F.col("rows")).alias("aligned"))


ALIGNED_SQL = "with " + _TABLES + """, w as (select *, list_transform(range(1, len(headers) + 1), lambda i: list_max(list_concat([length(headers[i])], list_transform(rws, lambda r: length(r[i]))))) wd from tb)
select doc_id, processed_at, cast(table_index as int) table_index,
 '| ' || array_to_string(list_transform(range(1, len(headers) + 1), lambda i: rpad(headers[i], cast(wd[i] as int), ' ')), ' | ') || ' |' || chr(10) ||
 '| ' || array_to_string(list_transform(wd, lambda n: repeat('-', greatest(3, n))), ' | ') || ' |' ||
 case when len(rws) > 0 then chr(10) || array_to_string(list_transform(rws, lambda r: '| ' || array_to_string(list_transform(range(1, len(headers) + 1), lambda i: rpad(r[i], cast(wd[i] as int), ' ')), ' | ') || ' |'), chr(10)) else '' end aligned from w"""


def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(_reports(spark, d), KEYS, "t")


CHUNK_SQL = r"""
with s0 as (select doc_id, processed_at, replace(replace(clean_markdown, chr(13) || chr(10), chr(10)), chr(13), chr(10)) t from source_context where clean_markdown is not null),
s1 as (select *, string_split(regexp_replace(t, '\n(#{1,6}[ \t][^\n])', chr(12) || '\1', 'g'), chr(12)) parts from s0),
s2 as (select doc_id, processed_at, unnest(parts) p, generate_subscripts(parts, 1) sno from s1),
s3 as (select doc_id, processed_at, sno, case when regexp_matches(p, '^#{1,6}[ \t][^\n]') then regexp_replace(regexp_extract(p, '^#{1,6}[ \t]([^\n]+)', 1), '^\s+|\s+$', '', 'g') else 'Document Root' end heading,
  regexp_replace(p, '^\s+|\s+$', '', 'g') content from s2),
s4 as (select *, list_reduce(string_split_regex(content, '\n\s*\n'), lambda a, x: case when a.o and a.n + greatest(1, length(x) // 4) > 1200
     then {'d': list_append(a.d, a.c), 'c': x, 'n': greatest(1, length(x) // 4), 'o': true}
     when a.o then {'d': a.d, 'c': a.c || chr(10) || chr(10) || x, 'n': a.n + greatest(1, length(x) // 4), 'o': true}
     else {'d': a.d, 'c': x, 'n': a.n + greatest(1, length(x) // 4), 'o': true} end, {'d': []::varchar[], 'c': ''::varchar, 'n': 0::bigint, 'o': false}) pk from s3 where content <> ''),
s5 as (select *, case when greatest(1, length(content) // 4) <= 1200 then [content] else list_append(pk.d, pk.c) end ch from s4),
s6 as (select doc_id, processed_at, sno, heading, unnest(ch) txt, generate_subscripts(ch, 1) cno from s5)
select doc_id, processed_at, cast(row_number() over (partition by doc_id, processed_at order by sno, cno) as int) chunk_id, heading parent_section, txt as "text",
  cast(greatest(1, length(txt) // 4) as int) token_estimate, cast(length(txt) as int) char_length from s6"""


def grounding_headers(spark: SparkSession, d: str) -> DataFrame:
    """The whole text path: statistics, indicators, terms, tables and the header made of them."""
    t = F.col("t")
    rows = _reports(spark, d).select(*KEYS, "file_name", "file_type", "sha256_checksum", "t", tables.text_tables(t).alias("tb"))
    rows = indicators.with_terms(indicators.with_indicators(rows, "t"), "t", tables.column_scores(F.col("tb")))
    meta = {
        "file_name": F.col("file_name"), "file_type": F.col("file_type"), "sha256": F.col("sha256_checksum"),
        "word_count": T.word_count(t), "estimated_tokens": T.token_estimate(t),
    }
    i, s = indicators.columns(indicators.KINDS), indicators.columns(indicators.TERMS)
    rows = rows.select(*KEYS, "t", chunking.grounding_header(meta, i, s, F.col("tb")).alias("header"))
    return rows.select(*KEYS, "header", F.sha2(chunking.prompt(F.col("header"), t), 256).alias("prompt_sha"))


def groundings(spark: SparkSession, d: str) -> DataFrame:
    """The deterministic grounding context of every report, as a document."""
    t = F.col("t")
    rows = indicators.with_terms(indicators.with_indicators(_reports(spark, d).select(*KEYS, "file_name", "t"), "t"), "t")
    i, s = indicators.columns(indicators.KINDS), indicators.columns(indicators.TERMS)
    g = grounding.heuristic_grounding(F.col("file_name"), t, T.word_count(t), F.size(T.lines(t)), i, s)
    # an array of one: the optimizer doesn't write the fields of its struct out again at every use
    rows = rows.select(*KEYS, F.array(g).alias("g")).withColumn("g", F.filter("g", lambda x: F.lit(True)))
    one = F.get("g", F.lit(0))
    return rows.select(
        *KEYS, one["title"].alias("title"), one["executive_overview"].alias("executive_overview"), F.array_join(one["locked_numerical_facts"], "|").alias("facts"),
        rendering.grounding_markdown(one, F.col("processed_at")).alias("markdown"),
    )


def overviews(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    none = F.array().cast("array<double>")
    facts = grounding.locked_facts(t, T.word_count(t), F.size(T.lines(t)), none)
    return _reports(spark, d).where("t is not null").select(*KEYS, grounding.overview(t, F.lit("none")).alias("overview"), F.array_join(facts, "|").alias("facts"))


OVERVIEW_SQL = rf"""
with o as (select *, list_filter(string_split(clean_markdown, chr(10) || chr(10)), lambda p: length({_STRIP.format(x="p")}) > 50 and not starts_with({_STRIP.format(x="p")}, '#') and not starts_with({_STRIP.format(x="p")}, '|')) ps,
  list_transform({_all(indicators.LOCKED_FACTS, t="clean_markdown")}, lambda x: {_STRIP.format(x="x")}) nf from source_context where clean_markdown is not null)
select doc_id, processed_at, case when len(ps) > 0 then {_STRIP.format(x="regexp_replace(ps[1], '^[#\\s*_-]+', '')")} else 'none' end overview,
 case when len(nf) > 0 then array_to_string(nf, '|') else 'Analyzed ' || len(regexp_extract_all(clean_markdown, '\S+')) || ' words across ' ||
  len({_LINES.format(t="clean_markdown")}) || ' lines' end facts from o"""


def citations(spark: SparkSession, d: str) -> DataFrame:
    return grounding.indicator_citations(indicators.with_indicators(_reports(spark, d).select(*KEYS, "t"), "t"), KEYS)


CITATION_SQL = _REPORTS.rstrip() + "," + _IOC_LISTS + """
, c as (select doc_id, processed_at, unnest(cves) v, 'cve-' p from l union all select doc_id, processed_at, unnest(ipv4_addresses), 'ip-' from l)
select doc_id, processed_at, p || v id, 'file' kind, v as label from c"""


def fact_citations(spark: SparkSession, d: str) -> DataFrame:
    """The facts of every report, numbered after its citations of ``citations``."""
    t = F.col("t")
    facts = grounding.locked_facts(t, T.word_count(t), F.size(T.lines(t)), F.array().cast("array<double>"))
    rows = indicators.with_indicators(_reports(spark, d).where("t is not null").select(*KEYS, "t", facts.alias("facts")), "t")
    return rows.select(*KEYS, F.inline(grounding.numbered_facts(F.col("facts"), F.size("cves") + F.size("ipv4_addresses"))))


def normalized_reports(spark: SparkSession, d: str, limit: int = NORMALIZED_BYTES) -> DataFrame:
    """Normal form within ``limit`` bytes, with the shapes of records that have no text."""
    raw = table(spark, d, "source_context").withColumn("raw", F.concat(F.lit("A\u0301\x00\r\n"), "clean_markdown", F.lit("  \r\n\n")))
    ok = F.lower("file_type") != "pdf"
    n = T.normalize_text(F.col("raw"))
    cut = T.truncate_utf8(F.col("n"), limit)
    return (
        raw.select(*KEYS, ok.alias("supported"), n.alias("n"))
        .withColumn("normalized_text", F.when(F.col("supported"), cut))
        .select(
            *KEYS, "supported", "normalized_text", F.length("normalized_text").alias("normalized_char_count"),
            F.coalesce(F.col("supported") & (F.octet_length("n") > limit), F.lit(False)).alias("truncated"),
            F.when(~F.col("supported"), "no inspector registered for media category").when(F.col("n").isNull(), "no extractable text").alias("reason"),
        )
    )


NORMAL_SQL = r"""
with a as (select *, lower(file_type) <> 'pdf' supported, nfc_normalize('A' || chr(769) || chr(13) || chr(10) || clean_markdown || '  ' || chr(13) || chr(10) || chr(10)) x from source_context),
b as (select *, regexp_replace(regexp_replace(replace(replace(x, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\x00-\x08\x0B-\x1F\x7F]', '', 'g'), '(?m)[ \t]+$', '', 'g') y from a),
c as (select *, regexp_replace(y, '\n+$', '') || chr(10) n from b)
select doc_id, processed_at, supported, case when supported then n end normalized_text, cast(length(case when supported then n end) as int) normalized_char_count,
 coalesce(supported and octet_length(encode(n)) > 25 * 1024 * 1024, false) truncated,
 case when not supported then 'no inspector registered for media category' when n is null then 'no extractable text' end reason from c"""


def ocr_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d).select(*KEYS, T.clean_ocr(F.col("t")).alias("cleaned"))


OCR_SQL = rf"""select doc_id, processed_at, {_STRIP.format(x="regexp_replace(array_to_string(list_filter(list_transform(" + _LINES.format(t="clean_markdown") + ", lambda x: " + _STRIP.format(x="x") + "), lambda x: x <> ''), chr(10)), '~{5,}|`{5,}|\\|{5,}|_{5,}|-{5,}|={5,}|\\*{5,}|#{5,}', '', 'g')")} cleaned from source_context"""


def keyframe_types(spark: SparkSession, d: str) -> DataFrame:
    """The kind of each report's picture, were its text a frame's, and what it shows."""
    t = F.col("t")
    kind = classify.visual_type(t, F.pmod(F.col("doc_id") * 37, F.lit(256)), F.pmod(F.col("doc_id"), F.lit(7)))
    rows = _reports(spark, d).where("t is not null").select(*KEYS, "t", kind.alias("visual_type"))
    rows = indicators.with_indicators(rows, "t")
    shown = F.concat("cves", "ipv4_addresses", "sha256_hashes", "domains")  # in this order, nothing taken out
    return rows.select(*KEYS, "visual_type", rendering.visual_content(F.col("visual_type"), t).alias("content"), F.array_join(shown, "|").alias("iocs"))


_W = r"len(regexp_extract_all(t, '\S+'))"
_TERM = "(" + " + ".join(f"cast(regexp_matches(t, {_re(p)}) as int)" for p in classify.TERMINAL) + ")"
_DIAG = "(" + " + ".join(f"cast(contains(lower(t), '{w}') as int)" for w in classify.DIAGRAM_WORDS) + ")"
_SLIDE = "(" + " + ".join(f"cast(contains(lower(t), '{w}') as int)" for w in classify.SLIDE_WORDS) + ")"
KEYFRAME_SQL = rf"""
with r as (select doc_id, processed_at, clean_markdown t, doc_id * 37 % 256 br, doc_id % 7 bx from source_context where clean_markdown is not null),{_IOC_LISTS},
v as (select *, case when br < 110 and ({_TERM} >= 1 or contains(lower(t), 'powershell') or contains(lower(t), 'root@') or contains(t, '$ ')) or ({_TERM} >= 2 and {_W} > 5) then 'TERMINAL'
  when (bx >= 4 and {_W} < 60) or (bx >= 2 and {_DIAG} >= 2) then 'DIAGRAM'
  when {_W} >= 15 or {_SLIDE} >= 1 or len(list_filter({_LINES.format(t="t")}, lambda x: regexp_matches({_STRIP.format(x="x")}, '^(?:[-*•]|[123]\.)'))) > 0 then 'SLIDE' else 'OTHER' end visual_type from l),
s as (select *, list_filter(list_transform({_LINES.format(t="t")}, lambda x: {_STRIP.format(x="x")}), lambda x: x <> '') ls,
  regexp_extract_all(t, '(?:/[a-zA-Z0-9_\.\-]+)+|(?:[C-Z]:\\[a-zA-Z0-9_\.\-\\]+)') pa,
  list_transform(list_filter({_LINES.format(t="t")}, lambda x: length({_STRIP.format(x="x")}) > 3), lambda x: regexp_replace(x, '[^a-zA-Z0-9_\- ]', '', 'g'))[1:4] nm from v)
select doc_id, processed_at, visual_type, case visual_type
  when 'SLIDE' then case when len(ls) = 0 then '*(Empty slide)*' else '#### 📑 Slide: ' || ls[1] || case when len(ls) > 1 then chr(10) || array_to_string(list_transform(ls[2:], lambda x: case when regexp_matches(x, '^[-*•]') then x else '- ' || x end), chr(10)) else '' end end
  when 'TERMINAL' then '#### 💻 Terminal Session / Shell Output' || chr(10) || chr(10) || '```bash' || chr(10) || t || chr(10) || '```' || case when len(pa) > 0 then chr(10) || '*Referenced Paths:* `' || array_to_string(pa[1:5], ', ') || '`' else '' end
  when 'DIAGRAM' then '#### 📊 Architecture / Attack Flow Diagram' || chr(10) || chr(10) || case when len(nm) >= 2 then '```mermaid' || chr(10) || 'flowchart LR' || chr(10) ||
     array_to_string(list_concat(list_transform(nm, lambda x, i: '    N' || (i - 1) || '["' || x || '"]'), list_transform(nm[2:], lambda x, i: '    N' || (i - 1) || ' --> N' || i)), chr(10)) || chr(10) || '```'
     else '```mermaid' || chr(10) || 'flowchart LR' || chr(10) || '    A[Threat Actor] -->|Inbound Vector| B[Target Network]' || chr(10) || '```' end || chr(10) || chr(10) || '**Narrative:** System architecture diagram illustrating network topology and threat pathways.'
  else '*(Scene Visual: Visual scene displaying presenter briefing or transition slide.)*' || case when t <> '' then chr(10) || '> ' || t else '' end end content, array_to_string(list_concat(list_concat(cves, ipv4_addresses), list_concat(sha256_hashes, domains)), '|') iocs from s"""

_FILES_SPARK = (
    ("'/in/' || file_name", "case doc_id % 4 when 0 then 'text/plain; charset=utf-8' when 1 then 'application/pdf' when 2 then 'application/octet-stream' end"),
)


def file_formats(spark: SparkSession, d: str) -> DataFrame:
    """Category, parser and upload check of every file under a MIME type that is partly wrong."""
    name, mime = F.expr(_FILES_SPARK[0][0]), F.expr(_FILES_SPARK[0][1])
    check = classify.upload_check(name, mime)
    return table(spark, d, "source_context").select(
        *KEYS, classify.base_name(name).alias("name"), classify.extension(name).alias("ext"), classify.media_category(name, mime).alias("category"),
        classify.parser_of(name).alias("parser"), classify.accepted(name).alias("accepted"), classify.upload_kind(name).alias("upload_kind"), check["error"].alias("error"),
    )


def _case(x: str, t: dict[str, str], default: str) -> str:
    return f"case {x} " + " ".join(f"when '{k}' then '{v}'" for k, v in t.items()) + f" else {default} end"


FORMAT_SQL = f"""
with a as (select *, regexp_extract(file_name, '([^/]*)$', 1) nm, {_FILES_SPARK[0][1]} ct from source_context),
b as (select *, nullif(lower(regexp_extract(nm, '[^.]\\.([^.]+)$', 1)), '') ext, nullif(lower(trim(split_part(coalesce(ct, ''), ';', 1))), '') mt from a),
c as (select *, {_case("ext", classify.EXTENSIONS, "null")} ec, {_case("mt", classify.MIME_TYPES, "null")} mc,
  case ext {" ".join(f"when '{k}' then '{v}'" for k, v in classify.UPLOAD_TYPES.items())} end can from b)
select doc_id, processed_at, nm as name, ext, case when ec is not null and mc is not null and ec <> mc then 'unknown' else coalesce(ec, mc, 'unknown') end category,
 {_case("ext", classify.PARSERS, "'text'")} parser, coalesce(ext in ({", ".join(repr(x) for x in classify.ACCEPTED)}), false) accepted,
 {_case("ext", classify.UPLOAD_KINDS, "'text'")} upload_kind,
 case when can is null then 'file type not supported' when coalesce(mt, '') in ({", ".join(repr(x) for x in classify.UPLOAD_TYPES.values())}) and mt <> can then 'content type does not match file extension' end as error from c"""


def file_inspectors(spark: SparkSession, d: str) -> DataFrame:
    """Which inspector reads every file, or why none does, by its name and MIME type and by its category alone; its size in kilobytes."""
    name, mime = F.expr(_FILES_SPARK[0][0]), F.expr(_FILES_SPARK[0][1])
    rows = table(spark, d, "source_context").select(
        *KEYS, classify.media_category(name, mime).alias("category"), classify.extension(name).alias("ext"), classify.mime_type(mime).alias("mime"),
        T.kilobytes(F.col("file_size_bytes")).alias("kb"),
    )
    found = classify.inspector_of(F.col("category"), F.col("ext"), F.col("mime"))
    return rows.select(
        *KEYS, "category", found.alias("inspector"), F.when(found.isNull(), classify.NO_INSPECTOR).alias("reason"),
        classify.only_inspector(F.col("category")).alias("by_category"), "kb",
    )


INSPECTOR_SQL = FORMAT_SQL[: FORMAT_SQL.index("select doc_id, processed_at, nm as name")].rstrip() + """,
f as (select *, case when ec is not null and mc is not null and ec <> mc then 'unknown' else coalesce(ec, mc, 'unknown') end category from c),
i as (select *, case when category = 'text' and (ext = 'txt' or mt = 'text/plain') then 'text' when category = 'document' and (ext = 'pdf' or mt = 'application/pdf') then 'pdf'
  when category = 'document' and (ext = 'docx' or mt = 'application/vnd.openxmlformats-officedocument.wordprocessingml.document') then 'docx' end inspector from f)
select doc_id, processed_at, category, inspector, case when inspector is null then 'no inspector registered for media category' end reason,
 case when category = 'text' then 'text' end by_category, round(file_size_bytes / 1024, 2) kb from i"""


def sensitive_detect(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "final_deliverable").select("row_id", F.explode(redaction.sensitive_flags(F.col("final_content"))).alias("f"))
    return rows.select("row_id", "f.match", "f.type", "f.location")


DETECT_SQL = "with u as (" + " union all ".join(
    f"select row_id, {i} p, '{k}' as type, {_re(w)} as location, unnest(list_distinct(regexp_extract_all(final_content, {_re('(?i)' + p)}, 0))) m from final_deliverable"
    for i, (k, p, w) in enumerate(redaction.KINDS)
) + ") select row_id, m as \"match\", type, location from u qualify row_number() over (partition by row_id, m order by p) = 1"


def sensitive_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redaction.redact_texts(spread(table(spark, d, "final_deliverable")), ["row_id"], "final_content").select("row_id", "redacted_text", F.size("flags").alias("n_flags"))


REDACTED_SQL = (
    "with s as ("
    + " union all ".join(
        f"select row_id, {i} k, '{kind}' as kind, final_content t, string_split_regex(final_content, {_re('(?i)' + p)}) gaps, regexp_extract_all(final_content, {_re('(?i)' + p)}, 0) ms from final_deliverable"
        for i, (kind, p, _) in enumerate(redaction.KINDS)
    )
    + """),
e as (select row_id, k, kind, t, gaps, ms, unnest(ms) m, generate_subscripts(ms, 1) i from s),
p as (select row_id, k, kind, t, m, 1 + length(array_to_string(gaps[1:i], '')) + length(array_to_string(ms[1:i - 1], '')) a from e),
n as (select *, substr(t, greatest(1, a - 50), a + length(m) + 50 - greatest(1, a - 50)) around from p),
f as (select * from n where not contains(around, '[SENSITIVE:') and not contains(around, 'style="color: red"')
  qualify row_number() over (partition by row_id, m order by k, a) = 1),
g as (select row_id, count(*) n, list({'a': a, 'm': m, 'kind': kind} order by a desc, k) x from f group by all)
select d.row_id, case when n is null then final_content else list_reduce(x, lambda o, y: {'a': 0::bigint, 'm': left(o.m, y.a - 1) || '<span style="color: red; font-weight: bold;">[SENSITIVE: ' || y.m || ' (' || y.kind || ')]</span>' ||
  substr(o.m, y.a + length(y.m)), 'kind': ''}, {'a': 0::bigint, 'm': final_content, 'kind': ''}).m end redacted_text, cast(coalesce(n, 0) as int) n_flags from final_deliverable d left join g on g.row_id = d.row_id"""
)


def salvaged_answers(spark: SparkSession, d: str) -> DataFrame:
    """Which model answers hold JSON, and of what kind."""
    rows = table(spark, d, "enriched_grounding").select("context_id", *[grounding.salvage_json(F.col(c)).alias(c) for c in ("minto_pyramid", "threat_metadata", "downstream_directives")])
    kind = lambda c: F.regexp_extract(F.schema_of_variant(F.col(c)), "^([A-Z]+)", 1).alias(c)
    return rows.select("context_id", kind("minto_pyramid"), kind("threat_metadata"), kind("downstream_directives"))


def recovered_groundings(spark: SparkSession, d: str) -> DataFrame:
    """Fields of salvaged answers, each with what stands for it when it is missing."""
    fields = {
        "severity": ("string", F.lit("HIGH")), "threat_actor.name": ("string", F.lit("Unattributed")), "cve_ids": ("array<string>", F.array().cast("array<string>")),
    }
    got = grounding.recovered(F.col("threat_metadata"), fields)
    return spread(table(spark, d, "enriched_grounding")).select("context_id", got["severity"].alias("severity"), got["threat_actor.name"].alias("actor"), F.size(got["cve_ids"]).alias("n_cves"))


def deliverable_snippets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "final_deliverable").select("row_id", grounding.snippet(F.coalesce("final_content", F.lit(""))).alias("snippet"))


SNIPPET_SQL = r"""with a as (select row_id, regexp_replace(coalesce(final_content, ''), '^\s+|\s+$', '', 'g') s from final_deliverable)
select row_id, case when s = '' then '' else replace(left(s, 120), chr(10), ' ') || '...' end snippet from a"""

def combined_reports(spark: SparkSession, d: str) -> DataFrame:
    """Each report's latest text and, below a rule, the sections of its deliverables in order."""
    c = table(spark, d, "source_context").where("doc_id is not null and clean_markdown is not null")
    latest = c.groupBy("doc_id").agg(F.max_by("clean_markdown", F.struct("processed_at", "clean_markdown")).alias("text"))
    files = table(spark, d, "final_deliverable").where("doc_id is not null and final_content is not null")
    files = files.select("doc_id", "row_id", F.coalesce("platform_key", F.lit("other")).alias("name"), F.lit("text").alias("kind"), F.col("final_content").alias("markdown"))
    both = records.with_children(latest, files, "doc_id", ["row_id"], ["name", "kind", "markdown"], "files")
    return both.select("doc_id", records.combined_sources(F.col("text"), F.col("files")).alias("combined"))


COMBINED_SQL = """
with c as (select doc_id, max_by(clean_markdown, (processed_at, clean_markdown)) t from source_context where doc_id is not null and clean_markdown is not null group by all),
f as (select doc_id, string_agg('## Data from ' || coalesce(platform_key, 'other') || ' (text):' || chr(10) || chr(10) || final_content, chr(10) || chr(10) order by row_id) s
  from final_deliverable where doc_id is not null and final_content <> '' group by all)
select doc_id, t || coalesce(chr(10) || chr(10) || '---' || chr(10) || chr(10) || s, '') combined from c left join f using (doc_id)"""


def draft_points(spark: SparkSession, d: str) -> DataFrame:
    """The first four lines of every draft that aren't blank."""
    said = F.filter(F.transform(F.split("final_content", "\n"), T.strip), lambda x: x != "")
    return table(spark, d, "final_deliverable").where("final_content is not null").select("row_id", F.array_join(F.slice(said, 1, 4), "|").alias("key_points"))


POINTS_SQL = rf"""select row_id, array_to_string(list_filter(list_transform(string_split(final_content, chr(10)), lambda x: {_STRIP.format(x="x")}), lambda x: x <> '')[1:4], '|') key_points
from final_deliverable where final_content is not null"""

_FACTS = f"""case when len(nf) > 0 then nf else ['Analyzed ' || len(regexp_extract_all(clean_markdown, '\\S+')) || ' words across ' || len({_LINES.format(t="clean_markdown")}) || ' lines'] end"""
FACT_SQL = _REPORTS.rstrip() + "," + _IOC_LISTS + f""",
f as (select *, list_transform({_all(indicators.LOCKED_FACTS, t="clean_markdown")}, lambda x: {_STRIP.format(x="x")}) nf from l where t is not null),
g as (select doc_id, processed_at, len(cves) + len(ipv4_addresses) n, {_FACTS} facts from f),
u as (select doc_id, processed_at, n, unnest(facts) fact, generate_subscripts(facts, 1) i from g)
select doc_id, processed_at, 'fact-' || (n + i) id, 'text' kind, fact as label from u"""

def _term_list(p: str) -> str:
    return f"list_sort(list_distinct(list_transform({_all(p)}, lambda m: regexp_replace(trim(m), '\\s+', ' ', 'g'))))"


_TERM_LISTS = f"""
tm as (select *, {_term_list(indicators.ACTORS)} ac, {_term_list(indicators.SYSTEMS)} sy, {_term_list(indicators.TIMELINE)} tl,
  list_filter(['CRITICAL','HIGH','MEDIUM','LOW','INFORMATIONAL'], lambda s: list_contains(list_transform({_all(indicators.SEVERITY)}, lambda x: upper(x)), s)) sv,
  coalesce({_CVSS_SQL}, []) cv from l)"""


def _lined(title: str, *items: str) -> str:
    """A heading and a list below it as SQL; ``{}`` are columns."""
    rows = [x if x.startswith("(") else "'" + x.replace("'", "''") + "'" for x in items]
    return "'" + title + "' || chr(10) || " + " || chr(10) || ".join(rows)


GROUNDED_SQL = _REPORTS.rstrip() + "," + _IOC_LISTS + "," + _TERM_LISTS + f""",
a as (select *, coalesce(ac[1], 'Unidentified Threat Actor') actor, coalesce(sv[1], 'HIGH') sev, case when len(cves) > 0 then array_to_string(cves, ', ') else 'Unclassified Vulnerabilities' end cs,
  array_to_string(sy, ', ') sj, list_reverse(list_sort(cv)) scores,
  list_filter(string_split(t, chr(10) || chr(10)), lambda p: length({_STRIP.format(x="p")}) > 50 and not starts_with({_STRIP.format(x="p")}, '#') and not starts_with({_STRIP.format(x="p")}, '|')) ps,
  list_transform({_all(indicators.LOCKED_FACTS, t="clean_markdown")}, lambda x: {_STRIP.format(x="x")}) nf,
  (ipv4_addresses || domains || sha256_hashes)[1:10] ten from tm),
b as (select *, 'Threat Assessment: ' || actor || ' Activity (' || cs || ')' title,
  case when len(ps) > 0 then {_STRIP.format(x="regexp_replace(ps[1], '^[#\\s*_-]+', '')")} else 'Cybersecurity incident report regarding ' || file_name || ' involving ' || actor || '.' end ov,
  list_concat({_FACTS}, case when len(scores) > 0 then ['CVSS Score: ' || scores[1]::varchar] else [] end) fc from a)
select doc_id, processed_at, title, ov executive_overview, array_to_string(fc, '|') facts, concat_ws(chr(10), '# 🛡️ ' || title,
 chr(10) || '*Interpreted by `qwen-heuristic-anchor` | Generated: ' || processed_at || '*', chr(10) || '**Severity:** `' || sev || '` | **Threat Actor:** `' || actor || '`' || chr(10),
 '## 1. Executive Narrative', ov || chr(10), '## 2. Minto Pyramid Briefing Structure', '- **Situation:** Enterprise infrastructure running ' || coalesce(nullif(sj, ''), 'mission-critical systems') || '.',
 '- **Complication:** Active threat exploitation detected involving ' || cs || ' attributed to ' || actor || '.',
 '- **Solution:** Deploy emergency patches, block identified C2 infrastructure, and rotate credentials.',
 '- **Business & Operational Impact:** Severity rated ' || sev || '. Risk of unauthorized command execution and lateral movement.' || chr(10),
 '## 3. Technical Root Cause & Attack Vector', 'Adversary exploited weaknesses in ' || coalesce(nullif(sj, ''), 'target systems') || '.' || chr(10),
 '## 4. Timeline of Incident Progression' || chr(10) || case when len(tl) > 0 then array_to_string(list_transform(tl, lambda x: '- ' || x), chr(10)) else '- Incident detected during scheduled monitoring' end || chr(10),
 '## 5. Canonical Grounding Facts (Immutable Metrics)' || chr(10) || array_to_string(list_transform(fc, lambda x: '- 📌 **' || x || '**'), chr(10)) || chr(10),
 case when len(cves) > 0 or len(sy) > 0 then concat_ws(chr(10), '## 6. Threat Telemetry & Target Infrastructure', case when len(cves) > 0 then '- **Associated CVEs:** ' || cs end,
   case when len(sy) > 0 then '- **Affected Systems:** ' || sj end, case when len(ten) > 0 then '- **Key IOCs:** ' || array_to_string(ten, ', ') end, '') end,
 '## 7. Actionable Mitigations' || chr(10) || '1. Apply urgent vendor patches for ' || cs || chr(10) || '2. Block identified C2 IP indicators at network boundary firewalls' || chr(10) ||
   '3. Force multi-factor authentication and rotate administrative credentials' || chr(10),
 '## 8. Downstream LLM Guidance Directives',
 {_lined("### Advisory Highlights", "('- Mitigate CVEs: ' || array_to_string(cves, ', '))", "('- Block outbound traffic to ' || len(ipv4_addresses) || ' known IP addresses')", "('- Monitor endpoints for ' || len(sha256_hashes) || ' flagged hash signatures')")},
 chr(10) || {_lined("### Executive Takeaways", "('- Operational risk rated ' || sev)", "('- Targeted software includes ' || array_to_string(sy[1:3], ', '))", "- Immediate patch deployment recommended within 24 hours")},
 chr(10) || {_lined("### Social Media Hooks", "('- 🚨 Critical Alert: Active exploitation of ' || cs || ' by ' || actor || '.')", "- Check your systems and apply patches immediately. #CyberSecurity #ThreatIntel")},
 chr(10) || {_lined("### Storyboard & Slide Visual Themes", "- Title card with critical red threat banner and target infrastructure logos", "- Architecture diagram showing C2 beaconing flow to attacker IPs", "- Mitigation checklist highlighting urgent patch steps")}
) markdown from b"""

_SEEN = (("CVE_IDS", "cves"), ("MITRE_ATTACK_TECHNIQUES", "mitre_attack_ids"), ("IPV4_INDICATORS", "ipv4_addresses"), ("IPV6_INDICATORS", "ipv6_addresses"),
         ("SHA256_HASHES", "sha256_hashes"), ("SHA1_HASHES", "sha1_hashes"), ("MD5_HASHES", "md5_hashes"), ("DOMAINS", "domains"), ("URLS", "urls"))
HEADER_SQL = _REPORTS.rstrip() + "," + _IOC_LISTS + "," + _TERM_LISTS + ",\n" + _TABLES.rstrip() + f""",
ta as (select doc_id, processed_at, count(*) n, string_agg('[Table ' || table_index || '] Headers: ' || array_to_string(headers, ', ') || ' (' || len(rws) || ' rows)', chr(10) order by table_index) s,
  flatten(list(list_filter(list_transform(rws, lambda w: try_cast({_STRIP.format(x="w[list_position(list_transform(headers, lambda h: contains(lower(h), 'cvss')), true)]")} as double)), lambda v: v is not null) order by table_index)) tc
  from tb group by all),
h as (select tm.*, ta.n tn, ta.s ts, list_reverse(list_sort(list_distinct(list_concat(cv, coalesce(tc, []))))) scores from tm left join ta on ta.doc_id = tm.doc_id and ta.processed_at is not distinct from tm.processed_at),
g as (select doc_id, processed_at, t, concat_ws(chr(10), repeat('=', 80), 'IMMUTABLE SOURCE TELEMETRY & GROUNDING ANCHOR (PRE-EXTRACTED ZERO-LOSS CONTEXT)', repeat('=', 80),
 'SOURCE_DOCUMENT: ' || file_name || ' (' || upper(file_type) || ')', 'DOCUMENT_SHA256: ' || sha256_checksum,
 'WORD_COUNT: ' || len(regexp_extract_all(t, '\\S+')) || ' | ESTIMATED_TOKENS: ' || greatest(1, length(t) // 4), '',
 case when len(sv) > 0 then 'DETECTED_SEVERITY: ' || array_to_string(sv, ', ') end, case when len(scores) > 0 then 'CVSS_SCORES: ' || array_to_string(scores, ', ') end,
 case when len(ac) > 0 then 'IDENTIFIED_THREAT_ACTORS: ' || array_to_string(ac, ', ') end, case when len(sy) > 0 then 'AFFECTED_SYSTEMS: ' || array_to_string(sy, ', ') end,
 case when len(tl) > 0 then 'DETECTED_TIMELINES: ' || array_to_string(tl, ', ') end, chr(10) || '--- EXTRACTED DETERMINISTIC INDICATORS (IOCs) ---',
 {", ".join(f"'{name}: ' || case when len({k}) > 0 then array_to_string({k}, ', ') else 'None identified' end" for name, k in _SEEN)},
 case when tn > 0 then chr(10) || '--- EXTRACTED TABLES (' || tn || ' table(s) parsed) ---' || chr(10) || ts end, repeat('=', 80)) header from h)
select doc_id, processed_at, header, sha256(header || chr(10) || chr(10) || '### FULL NORMALIZED DOCUMENT BODY' || chr(10) || chr(10) || '```markdown' || chr(10) || t || chr(10) || '```' || chr(10)) prompt_sha from g"""

_ANSWERS = ("minto_pyramid", "threat_metadata", "downstream_directives")


def _salvaged_sql(c: str) -> str:
    """The JSON text that can be saved from an answer, or null."""
    s = f"regexp_replace(regexp_replace({c}, '<think>(?s:.*?)</think>', '', 'g'), '^\\s+|\\s+$', '', 'g')"
    fenced = f"nullif(regexp_extract({s}, '(?s)```(?:json)?\\s*(.*?)\\s*```', 1), '')"
    cut = f"substr({s}, strpos({s}, '{{'), greatest(0, length({s}) - strpos(reverse({s}), '}}') + 2 - strpos({s}, '{{')))"
    tries = [s, fenced, f"case when strpos({s}, '{{') > 0 and contains({s}, '}}') then {cut} end"]
    tries += [f"case when strpos({s}, '{{') > 0 then substr({s}, strpos({s}, '{{')) || '{x}' end" for x in grounding.CLOSINGS]
    return "case " + " ".join(f"when json_valid({t}) then {t}" for t in tries) + " end"


def _kind_sql(c: str) -> str:
    kinds = "when 'VARCHAR' then 'STRING' when 'NULL' then 'VOID' when 'UBIGINT' then 'BIGINT' when 'DOUBLE' then 'DECIMAL'"
    return f"case json_type({c}) {kinds} else json_type({c}) end as {c}"


SALVAGED_SQL = (
    "with s as (select context_id, " + ", ".join(f"{_salvaged_sql(c)} {c}" for c in _ANSWERS) + " from enriched_grounding)\nselect context_id, " + ", ".join(map(_kind_sql, _ANSWERS)) + " from s"
)
RECOVERED_SQL = f"""with s as (select context_id, {_salvaged_sql("threat_metadata")} v from enriched_grounding)
select context_id, coalesce(case when json_type(v, '$.severity') not in ('OBJECT', 'ARRAY') then v ->> '$.severity' end, 'HIGH') severity,
 coalesce(v ->> '$.threat_actor.name', 'Unattributed') actor, cast(case when json_type(v, '$.cve_ids') = 'ARRAY' then json_array_length(v, '$.cve_ids') else 0 end as int) n_cves from s"""


def word_files(spark: SparkSession, d: str) -> DataFrame:
    """Every deliverable written as a Word file and read again: its text, paragraphs and characters."""
    files = spread(table(spark, d, "final_deliverable")).select("row_id", F.lit("deliverable.docx").alias("name"), sinks.as_docx()("final_content").alias("content"))
    return readers.inspect_documents(files).select("row_id", "text", "paragraph_count", "char_count", "error")


WORD_SQL = rf"""
with t as (select row_id, replace(replace(final_content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) x from final_deliverable), s as (select *, {_STRIP.format(x="x")} t from t)
select row_id, nullif(t, '') as text, cast(len(string_split(x, chr(10))) as int) paragraph_count, cast(length(t) as int) char_count,
 case when x is null then 'no inspector for this file' end as error from s"""

QUERIES = {
    f.__name__: f
    for f in (
        ext_indicators, ext_totals, ext_by_kind, ext_artifacts, ext_threat, doc_stats, text_tables, aligned_tables, text_chunks, grounding_headers,
        groundings, overviews, citations, fact_citations, normalized_reports, ocr_cleanup, keyframe_types, file_formats, sensitive_detect, sensitive_redacted, salvaged_answers,
        recovered_groundings, deliverable_snippets, combined_reports, draft_points, word_files, file_inspectors,
    )
}
SQL = {
    "ext_indicators": EXT_SQL, "ext_totals": TOTALS_SQL, "ext_by_kind": KIND_SQL, "ext_artifacts": ARTIFACT_SQL, "ext_threat": THREAT_SQL,
    "doc_stats": STATS_SQL, "text_tables": TABLE_SQL, "aligned_tables": ALIGNED_SQL, "text_chunks": CHUNK_SQL, "overviews": OVERVIEW_SQL,
    "citations": CITATION_SQL, "normalized_reports": NORMAL_SQL, "ocr_cleanup": OCR_SQL, "keyframe_types": KEYFRAME_SQL,
    "file_formats": FORMAT_SQL, "file_inspectors": INSPECTOR_SQL, "sensitive_detect": DETECT_SQL, "sensitive_redacted": REDACTED_SQL, "deliverable_snippets": SNIPPET_SQL, "combined_reports": COMBINED_SQL, "draft_points": POINTS_SQL, "word_files": WORD_SQL, "fact_citations": FACT_SQL, "groundings": GROUNDED_SQL, "grounding_headers": HEADER_SQL,
    "salvaged_answers": SALVAGED_SQL, "recovered_groundings": RECOVERED_SQL,
}
