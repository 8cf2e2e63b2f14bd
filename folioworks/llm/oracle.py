"""SQL twins of the queries for language models, where SQL can express them."""

from __future__ import annotations

P2 = """
select distinct profile, doc_id from source_context, split_profile
where clean_markdown is not null and greatest(1, length(clean_markdown) // 4) > max_tokens"""

#: Written apart from the operator: other patterns, one window a recording, labels looked up once each.
_TURNS = r"""
with seg as (
  select 'audio_segment' track, video_id recording, cast(round(start_seconds * 1000) as bigint) start_ms, segment_id ord, text, null speaker
  from audio_segment where isfinite(start_seconds)
  qualify row_number() over (partition by video_id, segment_id order by ingested_at) = 1),
a as (select * from grounding_anchor qualify row_number() over (partition by source, id order by row_id) = 1),
t as (select *, regexp_extract(temporal_anchor, '^[\s\[(]*([0-9:hms]+)', 1) c from a),
anc as (
  select 'grounding_anchor' track, source recording,
    1000 * case
      when regexp_full_match(c, '\d+:\d+:\d+') then 3600 * split_part(c, ':', 1)::bigint + 60 * split_part(c, ':', 2)::bigint + split_part(c, ':', 3)::bigint
      when regexp_full_match(c, '\d+:\d+') then 60 * split_part(c, ':', 1)::bigint + split_part(c, ':', 2)::bigint
      when regexp_full_match(c, '(\d+h)?(\d+m)?(\d+s)?') and c <> '' then
        3600 * coalesce(try_cast(regexp_extract(c, '(\d+)h', 1) as bigint), 0) + 60 * coalesce(try_cast(regexp_extract(c, '(\d+)m', 1) as bigint), 0)
        + coalesce(try_cast(regexp_extract(c, '(\d+)s', 1) as bigint), 0) end start_ms,
    row_id ord, extracted_verbatim, speaker from t),
pieces as (
  select track, recording, start_ms, ord, unnest(string_split(replace(text, '<v ', '>><v '), '>>')) piece, generate_subscripts(string_split(replace(text, '<v ', '>><v '), '>>'), 1) part
  from seg),
bare as (select *, regexp_replace(piece, '^(?:[\s\x{00a0}]|[\[(]?\d+(?::\d\d)+[\])]?(?:[\s\x{00a0}]|$))+', '') said from pieces),
heads as (select *, regexp_extract(said, '^(?:\[[^\[\]]+\]|<v [^<>]+>|[^:\[\]<>]{1,60}?(?::|[\s\x{00a0}]--[\s\x{00a0}]))', 0) head from bare),
names as (
  select lower(regexp_replace(n, '[^A-Za-z0-9]', '', 'g')) k, speaker_name from (
    select speaker_name, unnest([speaker_name, short_name]) n from speaker_roster) where n is not null),
all_rows as (
  select track, recording, start_ms, ord, part, head written, said, substr(said, length(head) + 1) rest from heads
  union all select track, recording, start_ms, ord, 1, speaker, extracted_verbatim, extracted_verbatim from anc),
keys as (
  select distinct written, lower(regexp_replace(regexp_replace(regexp_replace(written, '^<v', ''), '\([^()]*\)', '', 'g'), '[^A-Za-z0-9]', '', 'g')) k
  from all_rows where written <> ''),
labels as (
  select written, coalesce(
    'Speaker ' || nullif(regexp_extract(k, '^(?:speaker|spkr|spk)0*(\d+)$', 1), ''),
    (select min(speaker_name) from names where names.k = keys.k),
    (select case when count(distinct speaker_name) = 1 then min(speaker_name) end from names
     where length(names.k) >= 5 and length(keys.k) >= 5 and damerau_levenshtein(names.k, keys.k) = 1)) label
  from keys),
told as (
  select all_rows.* exclude (written, said, rest), label, case when label is null then said else rest end said
  from all_rows left join labels using (written) where start_ms is not null),
plain as (
  select *, regexp_replace(regexp_replace(said, '(?i)\[{1,2}[^\[\]]*[a-z]{4,}[^\[\]]*\]{1,2}|\((?:laughs|crosstalk|door slams|pause [0-9]+s)\)|\{[^{}]*\}|<(?:unk|noise)>|\*[^*]+\*|♪[^♪]*♪?', ' ', 'g'),
    '(?i)(^|[^a-z0-9_-])(?:you know|i mean|well),', '\1 ', 'g') words from told),
counted as (
  select *, list_filter(string_split_regex(words, '[\s\x{00a0}]+'), lambda w: lower(trim(w, ' .,;:!?…-–—"''“”‘’()[]{}<>*♪|')) not in
    ('', 'um', 'uh', 'uhm', 'er', 'erm', 'ah', 'hmm', 'mm-hmm', 'mhm', 'mm', 'eh')) n from plain),
spoken as (select * exclude (said, words, n), array_to_string(n, ' ') words from counted where len(n) > 0),
breaks as (
  select *, coalesce(start_ms - lag(start_ms) over (partition by track, recording order by start_ms, ord, part) >= 21600000, true)::int fresh from spoken),
sessions as (select *, sum(fresh) over (partition by track, recording order by start_ms, ord, part) session from breaks),
filled as (
  select *, coalesce(last_value(label ignore nulls) over (partition by track, recording, session order by start_ms, ord, part), 'Unknown Speaker') speaker
  from sessions),
turns as (select *, lag(speaker) over (partition by track, recording, session order by start_ms, ord, part) previous from filled)"""
P4 = _TURNS + "\nselect distinct track, recording, start_ms, speaker from turns where previous is distinct from speaker"
P4_TEXTS = _TURNS + """,
islands as (select *, sum((previous is distinct from speaker)::int) over (partition by track, recording order by start_ms, ord, part) turn from turns)
select track, recording, cast(turn as bigint) turn, start_ms // 3600000 piece, any_value(speaker) speaker, string_agg(words, ' ' order by start_ms, ord, part) as text from islands group by all"""

#: No page is near the limit, so that characters decide as tokens do.
P6 = "select distinct doc_id from documents, pack_profile where profile = 'standard' and length(text) > 3 * capacity_tokens"

#: No case is close, so that sizes in characters decide as those in tokens do.
P7 = """
with s as (select source, sum(length(text)) n from documents group by source),
t as (select *, weight / sum(weight) over (partition by recipe) share from mix_target)
select recipe, t.source from t left join s on s.source = t.source
where share > max_repeats * coalesce(n, 0) / (select sum(length(text)) from documents)"""


#: Written apart from the operator's tables: letters as they stand here, the full-width block and spaces by rule.
_FORMS = r"""
with marks as (
  select string_agg(chr(c::int), '' order by c) a, string_agg(chr((c - 65248)::int), '' order by c) b from range(65281, 65375) r(c)),
f as (
  select doc_id, text, nfc_normalize(translate(translate(regexp_replace(text,
      '[\x{00ad}\x{200b}-\x{200f}\x{2060}\x{feff}]', '', 'g'),
    chr(160) || chr(5760) || chr(8239) || chr(8287) || chr(12288) || (select string_agg(chr(c::int), '') from range(8192, 8203) r(c)), repeat(' ', 16)),
    'АВЕКМНОРСТУХЅІЈаеорсухѕіјΑΒΕΖΗΙΚΜΝΟΡΤΥΧο‐‑ӒӓӦӧЁёЀѐЇїӖӗόΌΆΈ' || (select a from marks), 'ABEKMHOPCTYXSIJaeopcyxsijABEZHIKMNOPTYXo--ÄäÖöËëÈèÏïĔĕóÓÁÉ' || (select b from marks))) form
  from documents where text is not null)"""
P8_CLASSES = _FORMS + "\nselect doc_id, min(doc_id) over (partition by form) class_of, min(doc_id) over (partition by text) text_of from f"
P8 = _FORMS + "\nselect x.doc_id doc_a, y.doc_id doc_b from f x join f y on x.form = y.form and x.doc_id < y.doc_id and x.text <> y.text"


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2, "p4_found": P4, "p4_texts": P4_TEXTS, "p6_found": P6, "p7_found": P7, "p8_found": P8, "p8_classes": P8_CLASSES}
