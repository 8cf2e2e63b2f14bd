"""Queries over speech, scenes and frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioworks.functions import text as T
from folioworks.operators import alignment, grounding, indicators, rendering
from folioworks.operators.intervals import to_ms
from folioworks.plans.text_queries import _IGN_DOM, _IGN_URL, _refang
from folioworks.session import table


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """The middle of each scene as its keyframe's time, each (video, scene) once."""
    s = table(spark, d, "aligned_scene").select("video_id", F.col("scene_id").alias("frame_id"), to_ms(F.col("start_seconds")).alias("a"), to_ms(F.col("end_seconds")).alias("b"))
    return s.where("a is not null and b is not null").groupBy("video_id", "frame_id").agg(F.min(F.floor((F.col("a") + F.col("b")) / 2)).alias("at_ms"))


def _durations(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "aligned_scene").where("start_seconds is not null and end_seconds is not null")
    return s.groupBy("video_id").agg(F.max(to_ms(F.greatest("start_seconds", "end_seconds"))).alias("duration_ms"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """Speech with both bounds in order, each (video, segment) once."""
    s = table(spark, d, "audio_segment").select("video_id", "segment_id", to_ms(F.col("start_seconds")).alias("a"), to_ms(F.col("end_seconds")).alias("b"), "text")
    s = s.where("a is not null and b is not null and b >= a and text is not null")
    return s.groupBy("video_id", "segment_id").agg(F.min(F.struct(F.col("a").alias("start_ms"), F.col("b").alias("end_ms"), "text")).alias("r")).select("video_id", "segment_id", "r.*")


_MS = "cast(round({} * 1000) as bigint)"
_BASE_SQL = f"""with f as (select video_id, scene_id frame_id, min(({_MS.format("start_seconds")} + {_MS.format("end_seconds")}) // 2) at_ms from aligned_scene
  where start_seconds is not null and end_seconds is not null group by all),
du as (select video_id, max({_MS.format("greatest(start_seconds, end_seconds)")}) duration_ms from aligned_scene where start_seconds is not null and end_seconds is not null group by all),
nb as (select *, lag(at_ms) over w before, lead(at_ms) over w after from f window w as (partition by video_id order by at_ms, frame_id)),
sb as (select video_id, frame_id, at_ms, cast(greatest(0, case when before is null then 0 else floor((before + at_ms + 10) / 20) end) as bigint) start_cs,
  cast(case when after is null then floor((duration_ms + 5) / 10) else least(floor((duration_ms + 5) / 10), floor((at_ms + after + 10) / 20)) end as bigint) e from nb join du using (video_id)),
sc as (select video_id, frame_id, at_ms, start_cs, greatest(start_cs, e) end_cs from sb),
sg as (select video_id, segment_id, min_by(trim(text, ' '), (a, b, text)) said, min(a) a, min_by(b, (a, b, text)) b from (
  select video_id, segment_id, text, {_MS.format("start_seconds")} a, {_MS.format("end_seconds")} b from audio_segment where start_seconds is not null and end_seconds is not null and text is not null) where b >= a group by all)
"""


def scene_bounds(spark: SparkSession, d: str) -> DataFrame:
    return alignment.scene_bounds(_frames(spark, d), _durations(spark, d))


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    b = scene_bounds(spark, d)
    scenes = b.select("video_id", F.col("frame_id").alias("scene_id"), (F.col("start_cs") * 10).alias("start_ms"), (F.col("end_cs") * 10).alias("end_ms"))
    return alignment.align_speech(scenes, _segments(spark, d))


def aligned_scenes(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d)


_CLOCK = "printf('%02d:%02d', cast(floor({0} / 60000) as bigint), cast(floor({0} / 1000) as bigint) % 60)"
ALIGNED_SQL = _BASE_SQL + f""", j as (select sc.video_id, frame_id, trim(string_agg(said, ' ' order by a, segment_id), ' ') t from sc join sg on sc.video_id = sg.video_id and b >= start_cs * 10 and a <= end_cs * 10 group by all)
select sc.video_id, sc.frame_id scene_id, start_cs * 10 start_ms, end_cs * 10 end_ms, {_CLOCK.format("start_cs * 10")} || ' - ' || {_CLOCK.format("end_cs * 10")} timestamp_display,
 case when coalesce(t, '') = '' then '*(Silence or ambient audio)*' else t end spoken_transcript from sc left join j on sc.video_id = j.video_id and sc.frame_id = j.frame_id"""


def scene_indicators(spark: SparkSession, d: str) -> DataFrame:
    """The indicators of what is said and listed in each scene, together and sorted."""
    listed = table(spark, d, "aligned_scene").groupBy("video_id", "scene_id").agg(F.max(F.array_join("scene_iocs", " ")).alias("shown"))
    rows = _aligned(spark, d).join(listed, ["video_id", "scene_id"], "left")
    both = F.concat(F.coalesce("shown", F.lit("")), F.lit(" "), "spoken_transcript")
    rows = indicators.with_indicators(rows.select("video_id", "scene_id", both.alias("t")), "t")
    return rows.select("video_id", "scene_id", F.array_join(indicators.scene_indicators(indicators.columns(indicators.KINDS)), "|").alias("scene_iocs"))


def _re(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


SCENE_IOC_SQL = ALIGNED_SQL.replace(_BASE_SQL, _BASE_SQL + ", al as (", 1).replace(", al as (, j as (", ", j as (").replace("\nselect sc.video_id", ",\nal as (select sc.video_id") + f"""),
sh as (select video_id, scene_id, max(array_to_string(scene_iocs, ' ')) shown from aligned_scene group by all),
tx as (select al.video_id, al.scene_id, coalesce(shown, '') || ' ' || spoken_transcript t from al left join sh using (video_id, scene_id))
select video_id, scene_id, array_to_string(list_sort(list_distinct(list_concat(list_concat(list_transform(regexp_extract_all(t, {_re(indicators.CVE)}), lambda x: upper(x)),
 list_filter(regexp_extract_all(t, {_re(indicators.IPV4)}), lambda x: regexp_matches(x, {_re(indicators.OCTETS)}) and x not in ('0.0.0.0','255.255.255.255') and not starts_with(x, '127.'))),
 list_concat(list_transform(regexp_extract_all(t, {_re(indicators.SHA256)}), lambda x: lower(x)),
 list_filter(list_transform(regexp_extract_all(t, {_re(indicators.DOMAIN)}), lambda x: lower(rtrim(replace(replace(x, '[.]', '.'), '(.)', '.'), '.,;:)''"`]'))),
   lambda x: not ends_with(x, '.local') and {" and ".join(f"x <> '{g}' and not ends_with(x, '.{g}')" for g in indicators.IGNORED_DOMAINS)}))))), '|') scene_iocs from tx"""


def fallback_scenes(spark: SparkSession, d: str) -> DataFrame:
    return alignment.fallback_segments(_durations(spark, d))


FALLBACK_SQL = _BASE_SQL + """, n as (select *, unnest(range(0, greatest(1, duration_ms // 10000))) k from du)
select video_id, k scene_no, k * 10000 start_ms, least(duration_ms, (k + 1) * 10000) end_ms from n"""


def event_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Intervals between cuts among a user's events, where the value is low and the last cut long enough ago; the last ends with the last event."""
    e = table(spark, d, "events").where("user_id is not null and ts is not null and value is not null")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.lit(1704067200.0)
    cuts = alignment.cut_intervals(e.select("user_id", at.alias("at"), (F.col("value") / 100).alias("corr")), "user_id", "at", "corr", 3600.0, 0.25)
    return cuts.select("user_id", F.round("start_at", 3).alias("start_at"), F.round("end_at", 3).alias("end_at"))


CUTS_SQL = """
with e as (select user_id, (epoch_us(ts) / 1e6) - 1704067200.0 t, value / 100 corr from events where user_id is not null and ts is not null and value is not null),
s as (select user_id, list({'t': t, 'c': corr} order by t, corr) s from e group by all),
c as (select user_id, list_reduce(s, lambda a, x: case when x.c < 0.25 and x.t - a.l >= 3600.0 then {'l': x.t, 'd': list_append(a.d, {'a': a.l, 'b': x.t})} else a end, {'l': 0.0::double, 'd': []::struct(a double, b double)[]}) r, s[-1].t lt from s),
u as (select user_id, unnest(case when lt > r.l then list_append(r.d, {'a': r.l, 'b': lt}) else r.d end) x from c)
select user_id, round(x.a, 3) start_at, round(x.b, 3) end_at from u"""


def unlike_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate suppression by sign hashes within each label, in order of id."""
    v = table(spark, d, "embeddings").select("label", "vec_id", alignment.sign_hash(F.col("embedding")).alias("h"))
    return alignment.unlike_frames(v, "label", "vec_id", "h", max_distance=22).select("label", "vec_id", "kept", "kept_at")


UNLIKE_SQL = """
with recursive v as (select label, vec_id, list_transform(range(0, 64), lambda i: list_sum(list_transform(range(0, (len(embedding) + 63) // 64), lambda s: coalesce(embedding[s * 64 + i + 1], 0)::double)) > 0) b, row_number() over (partition by label order by vec_id) n from embeddings),
h as (select *, (select sum(case when b[i] then cast(1 as hugeint) << (i - 1) else 0 end) from range(1, 65) t(i)) hb from v),
k as (
 select label, n, [{'v': vec_id, 'h': hb}] kept, true keep, vec_id kept_at, vec_id from h where n = 1
 union all
 select h.label, h.n, case when len(l) = 0 then list_append(k.kept, {'v': h.vec_id, 'h': h.hb}) else k.kept end, len(l) = 0, coalesce(list_min(l), h.vec_id), h.vec_id
 from k join h on h.label = k.label and h.n = k.n + 1, lateral (select list_transform(list_filter(k.kept, lambda x: bit_count(xor(x.h, h.hb)) <= 22), lambda x: x.v) l))
select label, vec_id, keep kept, kept_at from k"""


def sample_points(spark: SparkSession, d: str) -> DataFrame:
    """Where each scene's frame is taken and what its picture is called; short scenes after the first have none."""
    s = table(spark, d, "aligned_scene").where("end_seconds > start_seconds").select("video_id", "scene_id", "start_seconds", "end_seconds").distinct()
    s = s.withColumns({"a": to_ms(F.col("start_seconds")), "b": to_ms(F.col("end_seconds"))})
    s = alignment.sampled_scenes(s, "video_id", "scene_id", "a", "b")
    at = F.floor(to_ms(F.col("start_seconds")) + (to_ms(F.col("end_seconds")) - to_ms(F.col("start_seconds"))) * 8 / 10)
    return s.select("video_id", "scene_id", at.alias("at_ms"), F.format_string("keyframe_%03d_%ss.png", "scene_id", F.floor(at / 1000).cast("string")).alias("picture"))


POINT_SQL = f"""with d as (select distinct video_id, scene_id, start_seconds, end_seconds, {_MS.format("start_seconds")} sa, {_MS.format("end_seconds")} sb from aligned_scene where end_seconds > start_seconds),
s as (select * from d qualify sb - sa >= 1500 or rank() over (partition by video_id order by sa, scene_id, sb) = 1),
p as (select video_id, scene_id, cast(floor({_MS.format("start_seconds")} + ({_MS.format("end_seconds")} - {_MS.format("start_seconds")}) * 8 / 10.0) as bigint) at_ms from s)
select video_id, scene_id, at_ms, printf('keyframe_%03d_%ss.png', scene_id, cast(at_ms // 1000 as varchar)) picture from p"""


def histogram_shift(spark: SparkSession, d: str) -> DataFrame:
    """How alike the value histograms of successive hours are, per kind of event."""
    e = table(spark, d, "events").select("event_type", F.date_trunc("hour", "ts").alias("hour"), "value").where("ts is not null and value is not null")
    b = F.least(F.greatest(F.floor("value").cast("int"), F.lit(0)), F.lit(255))
    hist = e.groupBy("event_type", "hour", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return alignment.histogram_correlation(hist, "event_type", "hour").select("event_type", "hour", F.round("corr", 6).alias("corr"))


HIST_SQL = """
with hi as (select event_type, date_trunc('hour', ts) h, least(greatest(cast(floor(value) as int), 0), 255) b, count(*) n from events where ts is not null and value is not null group by all),
fr as (select *, lag(h) over (partition by event_type order by h) p from (select distinct event_type, h from hi)),
g as (select event_type, h, p, unnest(range(0, 256)) b from fr where p is not null),
x as (select g.event_type, g.h, coalesce(a.n, 0) n1, coalesce(c.n, 0) n0 from g left join hi a on a.event_type = g.event_type and a.h = g.h and a.b = g.b left join hi c on c.event_type = g.event_type and c.h = g.p and c.b = g.b)
select event_type, h as "hour", round(corr(n1, n0), 6) corr from x group by all"""


def video_reports(spark: SparkSession, d: str) -> DataFrame:
    """One section per scene: when, what was said, what is shown and which indicators."""
    rows = _aligned(spark, d)
    kinds = table(spark, d, "aligned_scene").groupBy("video_id", "scene_id").agg(F.max("visual_type").alias("visual_type"))
    rows = rows.join(kinds, ["video_id", "scene_id"], "left").withColumn("visual_type", F.coalesce("visual_type", F.lit("OTHER")))
    rows = indicators.with_indicators(rows, "spoken_transcript")
    i = indicators.scene_indicators(indicators.columns(indicators.KINDS))
    scene = F.struct("scene_id", "timestamp_display", "visual_type", "spoken_transcript", rendering.visual_content(F.col("visual_type"), F.lit("")).alias("content"), i.alias("iocs"))
    return rows.select("video_id", "scene_id", rendering.scene_section(scene).alias("section"))


def anchor_reports(spark: SparkSession, d: str) -> DataFrame:
    """An advisory per call, from its anchors in order of their ids; each (source, id) once."""
    a = table(spark, d, "grounding_anchor").where("source is not null and extracted_verbatim is not null")
    a = a.groupBy("source", "id").agg(F.min_by(F.struct("row_id", "temporal_anchor", "speaker", "extracted_verbatim", "category", "confidence"), "row_id").alias("r")).select("source", "id", "r.*")
    nz = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    item = F.struct("row_id", "id", nz("temporal_anchor", "00:00").alias("anchor"), nz("speaker", "Unknown Speaker"), "extracted_verbatim", nz("category", "CORE_CONCEPT"), nz("confidence", 0.95))
    calls = a.groupBy("source").agg(F.sort_array(F.collect_list(item)).alias("anchors"))
    md = rendering.anchor_advisory("audio", F.col("source"), F.lit("Audio Briefing"), F.lit("Spoken intelligence."), F.col("anchors"))
    return calls.select("source", md.alias("markdown"), rendering.anchor_transcript(F.col("anchors"), True).alias("transcript"))


ANCHOR_SQL = """
with a as (select source, id, min_by({'r': row_id, 't': coalesce(temporal_anchor, '00:00'), 's': coalesce(speaker, 'Unknown Speaker'), 'x': extracted_verbatim, 'c': coalesce(category, 'CORE_CONCEPT'), 'f': coalesce(confidence, 0.95)}, row_id) v
  from grounding_anchor where source is not null and extracted_verbatim is not null group by all),
p as (select source, v.r r, id, v.t t, v.s s, v.x x, v.c c, v.f f, regexp_replace(replace(v.x, chr(10), ' '), '^\\s+|\\s+$', '', 'g') o,
  regexp_replace(replace(replace(v.x, '|', '\\|'), chr(10), ' '), '^\\s+|\\s+$', '', 'g') cx, regexp_replace(replace(replace(v.t, '|', '\\|'), chr(10), ' '), '^\\s+|\\s+$', '', 'g') ct,
  regexp_replace(replace(replace(v.s, '|', '\\|'), chr(10), ' '), '^\\s+|\\s+$', '', 'g') cs from a)
select source, '# Audio Briefing' || chr(10) || chr(10) || '## Overview' || chr(10) || 'Spoken intelligence.' || chr(10) || chr(10) || '## Key Findings' || chr(10) ||
 string_agg('- **[' || s || ']** (' || t || '): ' || x || ' [^' || id || ']', chr(10) order by r) || chr(10) || chr(10) || '## Provenance & Audio Grounding Table' || chr(10) ||
 '| Source Audio | Timestamp Range | Speaker / Role | Verbatim Spoken Text | Category | Confidence |' || chr(10) || '|---|---|---|---|---|---|' || chr(10) ||
 string_agg('| ' || source || ' | `' || ct || '` | ' || cs || ' | ' || cx || ' | `' || c || '` | ' || printf('%.1f', f * 100) || '% |', chr(10) order by r) || chr(10) || chr(10) ||
 string_agg('[^' || id || ']: Source: `' || source || '` | Timecode: `' || t || '` | Speaker: `' || s || '` | Verbatim: "' || o || '"', chr(10) order by r) || chr(10) markdown,
 string_agg('[' || id || '] (' || t || ') ' || s || ': "' || x || '"', chr(10) order by r) transcript from p group by source""".replace("\\\\", "\\")


def video_indicators(spark: SparkSession, d: str) -> DataFrame:
    """Per video how many indicators of each kind are spoken of, over all its segments."""
    long = indicators.indicators_long(_segments(spark, d), ["video_id"], "text").distinct()
    return long.groupBy("video_id", "ioc_type").agg(F.count(F.lit(1)).alias("n"))


VIDEO_SQL = _BASE_SQL + f""", x as (
 select video_id, 'cves' ioc_type, upper(unnest(regexp_extract_all(said, {_re(indicators.CVE)}))) v from sg union
 select video_id, 'mitre_attack_ids', upper(unnest(regexp_extract_all(said, {_re(indicators.ATTACK)}))) from sg union
 select video_id, 'ipv4_addresses', unnest(list_filter(regexp_extract_all(said, {_re(indicators.IPV4)}), lambda x: regexp_matches(x, {_re(indicators.OCTETS)}) and x not in ('0.0.0.0','255.255.255.255') and not starts_with(x, '127.'))) from sg union
 select video_id, 'ipv6_addresses', unnest(list_filter(regexp_extract_all(said, {_re(indicators.IPV6)}), lambda x: contains(x, '::'))) from sg union
 select video_id, 'sha256_hashes', lower(unnest(regexp_extract_all(said, {_re(indicators.SHA256)}))) from sg union
 select video_id, 'domains', lower(unnest(regexp_extract_all(said, {_re(indicators.DOMAIN)}))) from sg union
 select video_id, 'urls', unnest(regexp_extract_all(said, {_re(indicators.URL)})) from sg)
select video_id, ioc_type, count(*) n from x group by all"""

def video_totals(spark: SparkSession, d: str) -> DataFrame:
    """A video's indicators as one bundle: the listed kinds leave SHA-1 out, the total counts it."""
    long = indicators.indicators_long(_segments(spark, d), ["video_id"], "text").distinct()
    kept = F.col("ioc_type") != "sha1_hashes"
    return long.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("total_iocs_found"), F.count(F.when(kept, 1)).alias("listed"), F.countDistinct("ioc_type").alias("kinds"),
    )


TOTALS_SQL = VIDEO_SQL.replace("select video_id, ioc_type, count(*) n from x group by all", "select video_id, count(*) total_iocs_found, count(case when ioc_type <> 'sha1_hashes' then 1 end) listed, count(distinct ioc_type) kinds from x group by all")


def _video_lists(texts: DataFrame) -> DataFrame:
    """Per video the sorted indicators of each kind in its texts."""
    long = indicators.indicators_long(texts, ["video_id"], "text").distinct()
    of = lambda k: F.array_sort(F.collect_set(F.when(F.col("ioc_type") == k, F.col("value")))).alias(k)
    return long.groupBy("video_id").agg(*[of(k) for k in indicators.KINDS])


def video_groundings(spark: SparkSession, d: str) -> DataFrame:
    """The grounding context of every video, made of all its scenes and every indicator spoken of or shown."""
    rows = _aligned(spark, d)
    first = Window.partitionBy("video_id").orderBy("start_ms", "scene_id")
    # of a video's scenes only five leave the window, so a long recording gathers no more than a short one
    five = rows.withColumn("n", F.row_number().over(first)).where("n <= 5")
    listed = table(spark, d, "aligned_scene")
    kinds = listed.groupBy("video_id", "scene_id").agg(F.max("visual_type").alias("visual_type"))
    narrative = rendering.visual_narrative(F.coalesce("visual_type", F.lit("OTHER")), F.lit("")).alias("narrative")  # the tables have no text of frames
    item = F.struct("n", F.col("scene_id"), "timestamp_display", narrative)
    five = five.join(kinds, ["video_id", "scene_id"], "left").groupBy("video_id").agg(F.sort_array(F.collect_list(item)).alias("scenes"))
    size = rows.groupBy("video_id").agg(F.max("end_ms").alias("ms"), F.count(F.lit(1)).alias("n_scenes"))
    texts = _segments(spark, d).select("video_id", "text").unionByName(listed.select("video_id", F.array_join("scene_iocs", " ").alias("text")))
    found = _video_lists(texts)
    none = F.array().cast("array<string>")
    all_ = five.join(size, "video_id").join(found, "video_id", "left").withColumns({k: F.coalesce(k, none) for k in indicators.KINDS})
    iocs = indicators.columns(indicators.KINDS)
    g = grounding.video_grounding(F.col("video_id"), F.floor(F.col("ms") / 1000), F.col("scenes"), F.col("n_scenes"), iocs)
    all_ = all_.select("video_id", *indicators.KINDS, F.filter(F.array(g), lambda x: F.lit(True)).alias("g"))
    return all_.select("video_id", F.get("g", F.lit(0))["title"].alias("title"), rendering.video_markdown(F.get("g", F.lit(0)), iocs, F.lit("now")).alias("markdown"))


_VALUES = {
    "cves": f"list_transform(regexp_extract_all(t, {_re(indicators.CVE)}), lambda x: upper(x))",
    "ipv4": f"list_filter(regexp_extract_all(t, {_re(indicators.IPV4)}), lambda x: regexp_matches(x, {_re(indicators.OCTETS)}) and x not in ('0.0.0.0','255.255.255.255') and not starts_with(x, '127.'))",
    "sha256": f"list_transform(regexp_extract_all(t, {_re(indicators.SHA256)}), lambda x: lower(x))",
    "domains": f"list_filter(list_transform(regexp_extract_all(t, {_re(indicators.DOMAIN)}), lambda x: lower({_refang('x')})), lambda x: not ends_with(x, '.local') and {_IGN_DOM})",
    "urls": f"list_filter(list_transform(regexp_extract_all(t, {_re(indicators.URL)}), lambda x: {_refang('x')}), lambda x: length(x) > 10 and {_IGN_URL})",
}
VG_SQL = ALIGNED_SQL.replace("\nselect sc.video_id", ",\nal as (select sc.video_id") + f"""),
vt as (select video_id, scene_id, max(visual_type) visual_type from aligned_scene group by all),
nn as (select al.*, coalesce(visual_type, 'OTHER') vt, row_number() over (partition by al.video_id order by start_ms, al.scene_id) n
  from al left join vt on vt.video_id = al.video_id and vt.scene_id = al.scene_id),
fv as (select video_id, string_agg('- Scene ' || scene_id || ' [' || timestamp_display || ']: ' || case vt when 'SLIDE' then ''
   when 'TERMINAL' then 'Active command-line console session displaying terminal execution logs.'
   when 'DIAGRAM' then 'System architecture diagram illustrating network topology and threat pathways.'
   else 'Visual scene displaying presenter briefing or transition slide.' end, chr(10) order by n) tl from nn where n <= 5 group by all),
sz as (select video_id, max(end_ms) // 1000 s, count(*) k from al group by all),
tx as (select video_id, said t from sg union all select video_id, array_to_string(scene_iocs, ' ') from aligned_scene where scene_iocs is not null),
iv as ({" union ".join(f"select video_id, '{k}' k, unnest({v}) v from tx" for k, v in _VALUES.items())}),
li as (select video_id, string_agg(v, ', ' order by v) filter (k = 'cves') c, string_agg(v, ', ' order by v) filter (k = 'ipv4') ip, string_agg(v, ', ' order by v) filter (k = 'sha256') h,
  string_agg(v, ', ' order by k, v) filter (k in ('domains', 'urls')) du from iv group by all)
select video_id, 'Video Intelligence Briefing: ' || coalesce(c, 'Cyber Threats') || ' (' || video_id || ')' title,
 concat_ws(chr(10), '# 🎥 Video Intelligence Briefing: ' || coalesce(c, 'Cyber Threats') || ' (' || video_id || ')', chr(10) || '*Interpreted by `heuristic-video-anchor` | Generated: now*' || chr(10),
 '## 1. Executive Narrative', 'Multimodal intelligence analysis of ' || video_id || ' spanning ' || s || ' seconds across ' || k || ' scenes.' || chr(10), '## 2. Minto Pyramid Briefing Structure',
 '- **Situation:** Enterprise infrastructure monitored during security briefing.', '- **Complication:** Vulnerability demonstration involving ' || coalesce(c, 'Cyber Threats') || '.',
 '- **Solution:** Apply patches and block identified indicators of compromise.', '- **Business Impact:** Risk of lateral movement and operational downtime.' || chr(10),
 '## 3. Technical Root Cause & Exploit Mechanics', 'Exploitation of vulnerabilities demonstrated in video session.' || chr(10), '## 4. Canonical Grounding Facts (Locked Metrics)',
 '- 📌 **Video duration: ' || s || ' seconds**', '- 📌 **Detected ' || k || ' distinct visual scenes**' || chr(10), '## 5. Timeline of Events', tl || chr(10), '## 6. Actionable Mitigations',
 '1. Deploy vendor security updates', '2. Monitor perimeter logs for identified C2 IPs' || chr(10), '## 7. Indicators of Compromise', '- **CVEs:** ' || c, '- **IP Addresses:** ' || ip,
 '- **SHA-256 Hashes:** ' || h, '- **Domains / URLs:** ' || du, '') markdown
from fv join sz using (video_id) left join li using (video_id)"""


def video_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every video's whole report in ordered parts: its head, a section per scene, its transcript hour by hour.

    ``part`` orders the parts of one ``section``; a recording of any length makes more rows, never larger ones. The
    tables state neither resolution nor frame rate nor checksum.
    """
    segments = _segments(spark, d)
    rows = _aligned(spark, d)
    shown = table(spark, d, "aligned_scene").select("video_id", F.array_join("scene_iocs", " ").alias("text"))
    size = rows.groupBy("video_id").agg(F.max("end_ms").alias("ms"), F.count(F.lit(1)).alias("n"))
    none, unknown = F.array().cast("array<string>"), F.lit("unknown")
    heads = size.join(_video_lists(segments.select("video_id", "text").unionByName(shown)), "video_id", "left")
    heads = heads.withColumns({k: F.coalesce(k, none) for k in indicators.KINDS})
    head = rendering.video_head(F.col("video_id"), F.floor(F.col("ms") / 1000), unknown, unknown, unknown, F.col("n"), indicators.columns(indicators.KINDS))
    heads = heads.select("video_id", F.lit(1).alias("section"), F.lit(0).cast("long").alias("part"), head.alias("text"))
    scenes = video_reports(spark, d).select("video_id", F.lit(2).alias("section"), F.col("scene_id").cast("long").alias("part"), F.col("section").alias("text"))
    hour = F.floor(F.col("start_ms") / 3_600_000).cast("long")
    said = segments.groupBy("video_id", hour.alias("part")).agg(F.sort_array(F.collect_list(F.struct("start_ms", "segment_id", F.trim("text").alias("text")))).alias("s"))
    first = F.row_number().over(Window.partitionBy("video_id").orderBy("part")) == 1
    opening = F.when(first, F.lit("\n## 3. Full Continuous Audio Transcript\n\n> ")).otherwise(F.lit(""))
    spoken = said.select("video_id", F.lit(3).alias("section"), "part", F.concat(opening, F.trim(F.array_join("s.text", " "))).alias("text"))
    return heads.unionByName(scenes).unionByName(spoken)


_SHOWN = (
    "case coalesce(visual_type, 'OTHER') when 'SLIDE' then '*(Empty slide)*' when 'TERMINAL' then '#### 💻 Terminal Session / Shell Output\n\n```bash\n\n```' "
    "when 'DIAGRAM' then '#### 📊 Architecture / Attack Flow Diagram\n\n```mermaid\nflowchart LR\n    A[Threat Actor] -->|Inbound Vector| B[Target Network]\n```\n\n"
    "**Narrative:** System architecture diagram illustrating network topology and threat pathways.' "
    "else '*(Scene Visual: Visual scene displaying presenter briefing or transition slide.)*' end"
)
#: What a scene's indicators are made of, here of what is spoken only.
_SPOKEN = "list_sort(list_distinct(list_concat(list_concat({cves}, {ipv4}), list_concat({sha256}, {domains}))))".format(
    **{k: v.replace("extract_all(t,", "extract_all(spoken_transcript,") for k, v in _VALUES.items()}
)
_SCENES = f"""sq as (select al.*, coalesce(visual_type, 'OTHER') kind, {_SHOWN} shown, {_SPOKEN} io from al left join vt on vt.video_id = al.video_id and vt.scene_id = al.scene_id),
se as (select video_id, scene_id, '### ⏱️ Scene ' || scene_id || ' [' || timestamp_display || '] - Visual: `' || kind || '`' || chr(10) || '**Spoken Narration:** "' || spoken_transcript || '"' || chr(10) || chr(10)
  || shown || chr(10) || chr(10) || case when len(io) > 0 then '📌 **Scene Indicators:** `' || array_to_string(io, ', ') || '`' || chr(10) || chr(10) else '' end || '---' as section from sq)"""
_VIDEO = VG_SQL[: VG_SQL.index("select video_id, 'Video Intelligence Briefing")].rstrip()
REPORTS_SQL = _VIDEO + ",\n" + _SCENES + " select * from se"
DOCUMENTS_SQL = _VIDEO + ",\n" + _SCENES + """,
hr as (select video_id, a // 3600000 part, trim(string_agg(said, ' ' order by a, segment_id), ' ') said from sg group by all)
select video_id, 1 section, cast(0 as bigint) part, '# 🎥 Multimodal Video Intelligence: ' || video_id || chr(10) || chr(10) || '*Duration: ' || s || 's | Resolution: unknown @ unknown FPS | SHA256: `unknown...`*' || chr(10) || chr(10) ||
 '## 1. Technical Telemetry & Extracted Indicators' || chr(10) || '- **Total Visual Scenes:** ' || k || chr(10) || '- **Extracted CVEs:** ' || coalesce(c, 'None detected') || chr(10) ||
 '- **IPv4 Addresses:** ' || coalesce(ip, 'None detected') || chr(10) || '- **SHA256 Signatures:** ' || coalesce(h, 'None detected') || chr(10) ||
 '- **Malicious Domains / URLs:** ' || coalesce(du, 'None detected') || chr(10) || chr(10) || '## 2. Temporally Aligned Multimodal Scene Timeline' || chr(10) as text from sz left join li using (video_id)
union all select video_id, 2, scene_id, section from se
union all select video_id, 3, part, case when row_number() over (partition by video_id order by part) = 1 then chr(10) || '## 3. Full Continuous Audio Transcript' || chr(10) || chr(10) || '> ' else '' end || said from hr"""


def media_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations of every call's anchors and every video's first five scenes; files that gave nothing have one that stands for them."""
    a = table(spark, d, "grounding_anchor").where("source is not null")
    said = a.where("id is not null and extracted_verbatim is not null").groupBy("source", "id")
    said = said.agg(F.min_by(F.struct(F.coalesce("temporal_anchor", F.lit("00:00")).alias("anchor"), "extracted_verbatim"), "row_id").alias("r")).select("source", "id", "r.*")
    first = Window.partitionBy("video_id").orderBy("start_ms", "scene_id")
    scenes = _aligned(spark, d).withColumn("n", F.row_number().over(first)).where("n <= 5")
    usable = lambda c: F.max(F.expr(c)).alias("usable")
    files = [
        a.groupBy(F.col("source").alias("name")).agg(usable("id is not null and extracted_verbatim is not null")),
        table(spark, d, "aligned_scene").where("video_id is not null").groupBy(F.col("video_id").alias("name")).agg(usable("start_seconds is not null and end_seconds is not null")),
        table(spark, d, "source_context").where("file_name is not null").groupBy(F.col("file_name").alias("name")).agg(usable("clean_markdown is not null")),
    ]
    rows = [
        grounding.media_citations(said, "source", "", "id", "anchor", "extracted_verbatim", 100),
        grounding.media_citations(scenes, "video_id", "vid-", "scene_id", "timestamp_display", "spoken_transcript", 80),
        *[grounding.placeholder_citations(f.where("not usable"), "name") for f in files],
    ]
    return reduce(DataFrame.unionByName, rows)


def speech_segments(spark: SparkSession, d: str) -> DataFrame:
    """What was recognised in every recording, each segment once, the empty ones left out."""
    rows = table(spark, d, "audio_segment").select("video_id", "segment_id", "start_seconds", "end_seconds", "text")
    return alignment.spoken_segments(rows, ["video_id", "segment_id"], "start_seconds", "end_seconds", "text").distinct()


SPEECH_SQL = r"""
with s as (select *, regexp_replace(text, '^\s+|\s+$', '', 'g') t from audio_segment)
select distinct video_id, segment_id, round(start_seconds, 2) + 0.0::double start_seconds, round(end_seconds, 2) + 0.0::double end_seconds, t as text from s where t <> ''"""


def image_reports(spark: SparkSession, d: str) -> DataFrame:
    """An advisory per source as for a picture: its anchors as places in it, with the CVEs they name; each (source, id) once."""
    a = table(spark, d, "grounding_anchor").where("source is not null and extracted_verbatim is not null")
    a = a.groupBy("source", "id").agg(F.min_by(F.struct("row_id", "temporal_anchor", "extracted_verbatim", "category"), "row_id").alias("r")).select("source", "id", "r.*")
    item = F.struct(
        "row_id", "id", F.coalesce("temporal_anchor", F.lit("Full Image")).alias("anchor"), "extracted_verbatim", F.coalesce("category", F.lit("CORE_CONCEPT")).alias("category")
    )
    a = a.withColumn("cves", F.transform(indicators.found(F.col("extracted_verbatim"), indicators.CVE), F.upper))
    pictures = a.groupBy("source").agg(F.sort_array(F.collect_list(item)).alias("anchors"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cves")))).alias("cves"))
    none = F.array().cast("array<string>")
    entities = F.struct(none.alias("actors"), F.col("cves"), none.alias("targets"))
    md = rendering.anchor_advisory("image", F.col("source"), F.lit("Image Briefing"), F.lit("Visible intelligence."), F.col("anchors"), entities)
    return pictures.select("source", md.alias("markdown"))


IMAGE_SQL = r"""
with a as (select source, id, min_by({'r': row_id, 't': coalesce(temporal_anchor, 'Full Image'), 'x': extracted_verbatim, 'c': coalesce(category, 'CORE_CONCEPT')}, row_id) v
  from grounding_anchor where source is not null and extracted_verbatim is not null group by all),
p as (select source, v.r r, id, v.t t, v.x x, v.c c, count(*) over (partition by source) n, strpos(v.x, ':') k, regexp_replace(replace(v.x, chr(10), ' '), '^\s+|\s+$', '', 'g') o,
  regexp_replace(replace(replace(v.x, '|', '\|'), chr(10), ' '), '^\s+|\s+$', '', 'g') cx, regexp_replace(replace(replace(v.t, '|', '\|'), chr(10), ' '), '^\s+|\s+$', '', 'g') ct from a),
e as (select source, string_agg(distinct v, ', ' order by v) cves from (select source, upper(unnest(regexp_extract_all(x, '{CVE}'))) v from p) group by all),
g as (select source,
  string_agg('- **' || case when k > 0 then regexp_replace(left(x, k - 1), '^\s+|\s+$', '', 'g') else t end || '**: ' || case when k > 0 then regexp_replace(substr(x, k + 1), '^\s+|\s+$', '', 'g') else x end
    || ' [^' || id || ']', chr(10) order by r) filter (not (c = 'CORE_CONCEPT' and n > 1)) points,
  string_agg('| ' || source || ' | ' || ct || ' | ' || cx || ' |', chr(10) order by r) cells,
  string_agg('[^' || id || ']: Source: `' || source || '` | Visual Anchor: `' || t || '` | Verbatim: "' || o || '"', chr(10) order by r) notes from p group by all)
select source, concat_ws(chr(10), '# Image Briefing', '', '## Overview', 'Visible intelligence.', '', '## Key Benefits', points, '',
 case when cves is not null then '## Threat & Target Entities' || chr(10) || chr(10) || '- **Vulnerabilities / CVEs**: ' || cves || chr(10) end,
 '## Provenance Table' || chr(10) || '| Source Image | Visual Anchor | Verbatim Text |' || chr(10) || '|---|---|---|', cells, '', notes, '') markdown from g left join e using (source)""".replace(
    "{CVE}", indicators.CVE
)

def parsed_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Every anchor as it comes out of a model's answer: a fenced object under other field names, with what is missing filled in."""
    a = table(spark, d, "grounding_anchor")
    item = F.struct("id", F.col("temporal_anchor").alias("anchor"), F.col("extracted_verbatim").alias("text"), F.col("category").alias("entity_type"), "confidence")
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct(item.alias("anchors"))), F.lit("\n```"))
    return a.select("row_id", F.inline(grounding.anchors_of(answer)))


PARSED_SQL = r"""
select row_id, coalesce(nullif(id, ''), 'src-1') id, coalesce(nullif(temporal_anchor, ''), 'Central Visual Field') anchor,
 regexp_replace(coalesce(extracted_verbatim, ''), '^\s+|\s+$', '', 'g') extracted_verbatim, coalesce(nullif(category, ''), 'CORE_CONCEPT') category,
 coalesce(nullif(confidence, 0), 0.95) confidence from grounding_anchor"""


CITED_SQL = ALIGNED_SQL.replace("\nselect sc.video_id", ",\nal as (select sc.video_id") + """),
an as (select source, id, min_by({'a': coalesce(temporal_anchor, '00:00'), 't': extracted_verbatim}, row_id) r from grounding_anchor
  where source is not null and id is not null and extracted_verbatim is not null group by all),
nn as (select *, row_number() over (partition by video_id order by start_ms, scene_id) n from al),
fi as (
  select source x, bool_or(id is not null and extracted_verbatim is not null) ok from grounding_anchor where source is not null group by all union all
  select video_id, bool_or(start_seconds is not null and end_seconds is not null) from aligned_scene where video_id is not null group by all union all
  select file_name, bool_or(clean_markdown is not null) from source_context where file_name is not null group by all)
select source, id, 'file' kind, '[' || r.a || '] ' || left(r.t, 100) as label from an
union all select video_id, 'vid-' || scene_id, 'file', '[' || timestamp_display || '] ' || left(spoken_transcript, 80) from nn where n <= 5
union all select x, 'src-' || x, 'file', x from fi where not ok"""

QUERIES = {
    f.__name__: f
    for f in (
        scene_bounds, aligned_scenes, scene_indicators, fallback_scenes, event_cuts, unlike_vectors, sample_points, histogram_shift, video_reports,
        anchor_reports, video_indicators, video_totals, video_groundings, video_documents, media_citations, speech_segments, image_reports, parsed_anchors,
    )
}
SQL = {
    "scene_bounds": _BASE_SQL + "select * from sc", "aligned_scenes": ALIGNED_SQL, "scene_indicators": SCENE_IOC_SQL, "fallback_scenes": FALLBACK_SQL,
    "event_cuts": CUTS_SQL, "unlike_vectors": UNLIKE_SQL, "sample_points": POINT_SQL, "histogram_shift": HIST_SQL, "anchor_reports": ANCHOR_SQL,
    "video_indicators": VIDEO_SQL, "video_totals": TOTALS_SQL, "video_groundings": VG_SQL, "video_reports": REPORTS_SQL, "video_documents": DOCUMENTS_SQL, "media_citations": CITED_SQL, "speech_segments": SPEECH_SQL, "image_reports": IMAGE_SQL, "parsed_anchors": PARSED_SQL,
}
