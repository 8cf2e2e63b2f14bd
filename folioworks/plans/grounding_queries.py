"""Queries of the interval and nested-record operators (problems 1 and 3)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.operators.intervals import coverage
from folioworks.operators.nested import bridge, flat_table, list_paths, object_store, occurrences
from folioworks.session import spread, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    spans = [table(spark, d, t).select(F.lit(t).alias("track"), "video_id", "start_seconds", "end_seconds") for t in ("audio_segment", "aligned_scene")]
    return coverage(spans[0].unionByName(spans[1]), ["track", "video_id"])


_P1 = """
    select '{t}' track, video_id, cast(round(start_seconds * 1000) as bigint) s, cast(round(end_seconds * 1000) as bigint) e
    from {t} where start_seconds is not null and end_seconds is not null"""

P1_SQL = f"""
with spans as ({_P1.format(t="audio_segment")} union all {_P1.format(t="aligned_scene")}),
runs as (
  select *, max(e) over (partition by track, video_id order by s, e rows between unbounded preceding and 1 preceding) prev
  from spans where e > s),
labels as (
  select *, sum(case when prev is null or s > prev then 1 else 0 end) over (partition by track, video_id order by s, e rows unbounded preceding) island
  from runs),
periods as (select track, video_id, island, min(s) s, max(e) e from labels group by all),
ordered as (select *, lag(e) over (partition by track, video_id order by s) before from periods)
select track, video_id, 'period' kind, s start_ms, e end_ms from ordered
union all
select track, video_id, 'gap', before, s from ordered where before is not null and s - before < 21600000
"""


def _occurrences(spark: SparkSession, d: str, **kw) -> DataFrame:
    return occurrences(spread(table(spark, d, "enriched_grounding")), **kw)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _occurrences(spark, d, columns=("kind", "array_path", "positions", "child_id"))
    return rows.where("kind = 'element' and child_id is not null").select("context_id", "array_path", "positions")


def p3_objects(spark: SparkSession, d: str) -> DataFrame:
    """Identical records, objects and elements, stored once."""
    return object_store(_occurrences(spark, d))


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    """The bridge: every occurrence with its parent's id."""
    return bridge(_occurrences(spark, d))


#: Written apart from the operator: the shape as a table, walked by a recursive query.
_SHAPE = """
    ('minto_pyramid', 'situation', 'object'), ('minto_pyramid', 'complication', 'object'), ('minto_pyramid', 'solution', 'object'),
    ('minto_pyramid', 'business_impact_and_risk', 'object'), ('minto_pyramid.complication', 'evidence', 'list'),
    ('minto_pyramid.complication.evidence', 'scores', 'list'), ('minto_pyramid.solution', 'steps', 'list'), ('minto_pyramid.solution.steps', 'subtasks', 'list'),
    ('minto_pyramid.business_impact_and_risk', 'risks', 'list'),
    ('threat_metadata', 'cve_ids', 'list'), ('threat_metadata', 'threat_actor', 'object'), ('threat_metadata.threat_actor', 'aliases', 'list'),
    ('threat_metadata', 'affected_systems', 'list'), ('threat_metadata.affected_systems', 'versions', 'list'), ('threat_metadata.affected_systems', 'hosts', 'list'),
    ('threat_metadata.affected_systems.hosts', 'ports', 'list'), ('threat_metadata', 'iocs', 'list'), ('threat_metadata.iocs', 'sightings', 'list'),
    ('downstream_directives', 'advisory_bullet_points', 'list'), ('downstream_directives.advisory_bullet_points', 'audience', 'list'),
    ('downstream_directives', 'executive_takeaways', 'list'), ('downstream_directives.executive_takeaways', 'metrics', 'list'),
    ('downstream_directives', 'social_dissemination_hooks', 'list'), ('downstream_directives', 'visual_scene_ideas', 'list'),
    ('downstream_directives.visual_scene_ideas', 'shots', 'list'), ('downstream_directives.visual_scene_ideas.shots', 'props', 'list')"""
_NODES = rf"""
with recursive shape(up, name, kind) as (values {_SHAPE}),
raw as (
  select context_id, 'minto_pyramid' c, minto_pyramid t from enriched_grounding union all select context_id, 'threat_metadata', threat_metadata from enriched_grounding
  union all select context_id, 'downstream_directives', downstream_directives from enriched_grounding),
o1 as (select context_id, c, case when json_valid(t) and json_type(t) = 'VARCHAR' then json(t) ->> '$' else t end t from raw where t <> ''),
o2 as (select context_id, c, case when json_valid(t) and json_type(t) = 'VARCHAR' then json(t) ->> '$' else t end t from o1),
o3 as (select context_id, c, t, substr(t, strpos(t, '{{'), greatest(0, length(t) - strpos(reverse(t), '}}') + 2 - strpos(t, '{{'))) cut from o2 where t <> ''),
o4 as (select context_id, c, case when json_valid(t) then case when json_type(t) = 'ARRAY' then list_filter(cast(json(t) as json[]), lambda x: json_type(x) = 'OBJECT')[1] else json(t) end
  when json_valid(cut) then json(cut) end v from o3),
node as (
  select context_id, c path, '' pos, false element, v from o4 where json_type(v) = 'OBJECT'
  union all
  select context_id, path, case when kind = 'object' then pos when pos = '' then (i - 1)::varchar else pos || '.' || (i - 1) end, kind = 'list', x from (
    select context_id, up || '.' || name path, pos, kind, unnest(items) x, generate_subscripts(items, 1) i from (
      select context_id, up, name, pos, kind, case
        when json_type(o) = 'NULL' then [] when kind = 'object' then [case when json_type(o) = 'ARRAY' then list_filter(cast(o as json[]), lambda y: json_type(y) <> 'NULL')[1] else o end]
        when json_type(o) = 'ARRAY' then cast(o as json[])
        when json_type(o) = 'OBJECT' and len(json_keys(o)) > 0 and len(list_filter(json_keys(o), lambda k: not regexp_full_match(k, '\d{{1,9}}'))) = 0
          then list_transform(list_sort(list_transform(json_keys(o), lambda k: k::bigint)), lambda k: json_extract(o, '$."' || k || '"'))
        else [o] end items
      from (select context_id, up, name, pos, kind, case when json_type(w) = 'VARCHAR' and regexp_matches(w ->> '$', '^\s*[\[{{]') and json_valid(w ->> '$') then json(w ->> '$') else w end o
        from (select context_id, path, pos, key, json_extract(v, '$."' || key || '"') w
          from (select context_id, path, pos, v, unnest(json_keys(v)) key from (
            select context_id, path, pos, case when json_type(v) = 'VARCHAR' and regexp_matches(v ->> '$', '^\s*[\[{{]') and json_valid(v ->> '$') then json(v ->> '$') else v end v from node) where json_type(v) = 'OBJECT'))
        join shape on up = path and replace(name, '_', '') = lower(regexp_replace(key, '[^A-Za-z0-9]', '', 'g'))))))"""
P3_SQL = _NODES + "\nselect context_id, path array_path, pos positions from node where element and json_type(v) <> 'NULL'"


def _flat_sql(path: str, fields: list[str]) -> str:
    """The flat table of one list from the walked nodes."""
    opened = r"case when json_type(v) = 'VARCHAR' and regexp_matches(v ->> '$', '^\s*[\[{]') and json_valid(v ->> '$') then json(v ->> '$') else v end"
    plain = "lower(regexp_replace(k, '[^A-Za-z0-9]', '', 'g'))"

    def field(f: str) -> str:
        if fields == ["value"]:
            return "v ->> '$' as \"value\""
        key = f"list_filter(json_keys(o), lambda k: {plain} = '{f.replace('_', '')}')[-1]"
        other = "o ->> '$'" if f == "value" else "null"
        return f"case when json_type(o) = 'OBJECT' then json_extract_string(o, '$.\"' || {key} || '\"') else {other} end as \"{f}\""

    return _NODES + rf"""
select context_id, cast(regexp_extract(pos, '(\d+)$', 1) as int) ordinal, pos positions, regexp_replace(pos, '\.?\d+$', '') parent_positions, {", ".join(map(field, fields))}
from (select *, case when json_type(o1) = 'ARRAY' then list_filter(cast(o1 as json[]), lambda y: json_type(y) <> 'NULL')[1] else o1 end o
  from (select *, {opened} o1 from node where path = '{path}' and element and json_type(v) <> 'NULL'))"""


def _flat(path: str, fields: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: flat_table(_occurrences(spark, d), path, fields).drop("parent_id", "child_id")


def _name(path: str) -> str:
    """``p3_iocs_sightings`` for ``threat_metadata.iocs.sightings``."""
    return f"p3_{path.partition('.')[2].replace('.', '_')}"


#: The flat table of each list: its context, its place, its parent's place, its fields.
FLAT = {_name(path): _flat(path, fields) for path, fields in list_paths().items()}

QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_objects, p3_links)} | FLAT
SQL = {"p1_found": P1_SQL, "p3_found": P3_SQL} | {_name(path): _flat_sql(path, fields) for path, fields in list_paths().items()}
