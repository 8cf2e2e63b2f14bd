"""Speech transcripts into clean, ordered speaker turns (problem 4)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.operators.intervals import to_ms
from folioworks.operators.prefix import bucket_of, carry_forward
from folioworks.session import checkpoint

UNKNOWN = "Unknown Speaker"
BREAK_MS = 21_600_000
BUCKET_MS = 3_600_000
#: Fillers of one word and fillers of several words that stand before a comma.
FILLERS = ("um", "uh", "uhm", "er", "erm", "ah", "hmm", "mm-hmm", "mhm", "mm", "eh")
PHRASES = ("you know", "I mean", "well")
#: Words that tell a sound or a remark of the transcriber; in round brackets or stars, where speech may stand too.
SOUNDS = (
    "laugh", "chuckl", "applau", "clap", "cough", "sneez", "sigh", "breath", "gasp", "sniff", "cry", "sob", "groan", "whisper", "shout", "music", "sing", "tone",
    "beep", "buzz", "ring", "click", "clatter", "slam", "knock", "noise", "static", "feedback", "echo", "alarm", "siren", "typing", "footstep", "silence", "pause",
    "crosstalk", "overlap", "inaudible", "unintelligible", "indistinct", "foreign language", "background",
)

_SPACE = r"[\s ]"
_TIME = r"\d{1,9}(?::\d{2}){1,2}(?:[.,]\d+)?"
_SPAN = rf"{_TIME}(?:{_SPACE}*(?:-->|[-–—]|to){_SPACE}*{_TIME})?"
_CLOCK = rf"(?:\[{_SPACE}*{_SPAN}{_SPACE}*\]|\({_SPACE}*{_SPAN}{_SPACE}*\)|[\[(]?{_SPAN}[\])]?(?=$|{_SPACE}))(?:{_SPACE}*[-–—|]+(?={_SPACE}))?"
_REWRITTEN = r"(?:at|dot|@|\.|\d+)"
_SHORT = r"[^\s()*]+(?:\s+[^\s()*]+)?"
_SOUND = rf"(?i:(?=[^()*\n]*(?:{'|'.join(SOUNDS)}))[^()*\n]{{0,80}})"
_ROUND = rf"\((?!{_REWRITTEN}\))\s*(?:(?:{_SHORT})?|{_SOUND})\s*\)"
_STAR = rf"\*\s*(?:{_SHORT}|{_SOUND})\s*\*"
_SQUARE = rf"\[{{1,2}}(?!{_REWRITTEN}\])[^\[\]\n]{{0,80}}\]{{1,2}}"
_ANGLE = r"<(?![^<>]*(?:@|[ (\[](?:at|dot)[ )\]]))[^<>\n]{1,60}>"
_NOISE = rf"{_SQUARE}|{_ROUND}|\{{[^{{}}\n]{{0,80}}\}}|{_ANGLE}|{_STAR}|♪[^♪\n]{{0,80}}♪?"
_PHRASE = rf"(?i)(?<![\p{{L}}\p{{N}}_-])(?:{'|'.join(PHRASES)}),"
#: Marks that may stand around a word.
_MARKS = " .,;:!?…-–—\"'“”‘’()[]{}<>*♪| "
_MARK = "[" + re.escape(_MARKS).replace(r"\ ", " ") + "]"
#: The beginning of a word that is neither marks only nor a filler.
_SAID = rf"(?i)(?<![^\s\u00a0]){_MARK}*+(?!(?:{'|'.join(sorted(FILLERS, key=len, reverse=True))}){_MARK}*(?![^\s\u00a0]))[^\s\u00a0]"
#: What is kept of the words of a part: their text, their number, or whether there are any.
TEXT, NUMBER, ANY = "string", "int", "boolean"
#: The ways a label can stand before its words: [label], (label), <v label>, label: and label --, each also with a clock after the name.
_LABEL = (
    rf"^(?:\[[^\[\]\n]{{1,60}}\]{_SPACE}*[:：]?|\([^()\n]{{1,60}}\){_SPACE}*[:：]?|<v[ .][^<>\n]{{1,60}}>"
    rf"|[^:：\n\[\]<>]{{1,60}}?(?:{_SPACE}*[\[(]{_SPAN}[\])])?{_SPACE}*(?:[:：]|(?<={_SPACE})(?:--|[-–—])(?={_SPACE})))"
)
_LEAD = rf"^(?:{_SPACE}|{_CLOCK})+"
_NOTES = rf"^(?:{_SPACE}|{_CLOCK}|{_NOISE}|(?i:{'|'.join(sorted(FILLERS, key=len, reverse=True))})[,.…]*{_SPACE})+"
#: Where a part ends: at >>, before <v, at a line's end, and after a sentence that something with a colon follows.
_PARTS = r">>|(?=<v[ .])|\R|(?<=[.?!…])\s+(?=[^\s.?!:：][^.?!:：\n]{0,59}[:：](?:\s|$))"
_NEXT = r"[.?!…]\s+[^\s.?!:：][^.?!:：\n]{0,59}[:：](?:\s|$)"


def _literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, where ``value`` is evaluated once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _strip(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def _dashed(text: Column) -> Column:
    return F.contains(text, F.lit("-- ")) | F.contains(text, F.lit(" - ")) | F.contains(text, F.lit("– ")) | F.contains(text, F.lit("— "))


def label_key(label: Column) -> Column:
    """A label in one spelling: without case, separators, clocks, brackets and remarks such as ``(remote)``.

    A label that stands in round brackets itself is what is between them.
    """
    bare = F.regexp_replace(label, rf"^\(([^()]*)\)", "$1")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, rf"\([^()]*\)|\[{_SPAN}\]", ""), r"[^\p{L}\p{N}]", ""))


class Roster:
    """The proper speaker names by every key they are written under.

    ``speaker_roster`` is a small table (at most 1,000 rows, which is checked).
    """

    def __init__(self, roster: DataFrame, limit: int = 1000):
        rows = roster.select("speaker_name", "short_name").where("speaker_name is not null").limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"more than {limit} speakers")
        plain = lambda s: "".join(c for c in s.lower() if c.isalnum())
        self.names: dict[str, str] = {}
        for r in sorted(rows, key=lambda r: r[0]):
            for k in (r[0], r[1]):
                if k and plain(k):
                    self.names.setdefault(plain(k), r[0])
        self.keys = [k for k in self.names if len(k) >= 5]

    def resolve(self, written: Column) -> Column:
        """The proper name of a written label, or null.

        A label is found by its key, as ``Speaker N``, or within one slip of the pen: a letter too many,
        too few or wrong, or two neighbours exchanged; a slip counts only when it leads to one name.
        """
        names = F.map_from_arrays(_literals([*self.names]), _literals([*self.names.values()]))

        def slips(key: Column) -> Column:
            alike = F.array_sort(F.split(key, ""))

            def close(k: Column) -> Column:
                swapped = (F.length(k) == F.length(key)) & (F.levenshtein(k, key, 2) == 2) & (F.array_sort(F.split(k, "")) == alike)
                return (F.abs(F.length(k) - F.length(key)) <= 1) & ((F.levenshtein(k, key, 1) >= 0) | swapped)

            near = F.array_distinct(F.transform(F.filter(_literals(self.keys), close), lambda k: F.element_at(names, k)))
            return F.when(F.length(key) >= 5, _let(near, lambda n: F.when(F.size(n) == 1, F.get(n, F.lit(0)))))

        def name(key: Column) -> Column:
            number = F.regexp_extract(key, r"^(?:speaker|spkr|spk)0*(\d+)$", 1)
            exact = F.try_element_at(names, key) if self.names else F.lit(None).cast("string")
            found = F.coalesce(exact, slips(key)) if self.keys else exact
            return F.when(key.startswith("sp") & key.rlike(r"^(?:speaker|spkr|spk)\d+$"), F.concat(F.lit("Speaker "), number)).otherwise(found)

        return _let(label_key(written), name)


def clean_words(text: Column, kept: str = TEXT) -> Column:
    """The words of ``text`` in order, without marked noise and fillers: as text, as their number, or whether there are any.

    A step that needs a regular expression runs only where a cheap test finds what it would replace.
    """

    def has(t: Column, marks: list[str]) -> Column:
        any_of = F.lit(False)
        for m in marks:
            any_of = any_of | F.contains(t, F.lit(m))
        return any_of

    def unphrased(t: Column) -> Column:
        return F.when(has(F.lower(t), [p.lower() + "," for p in PHRASES]), F.regexp_replace(t, _PHRASE, " ")).otherwise(t)

    def noiseless(t: Column) -> Column:
        return F.when(has(t, list("[({<*♪")), F.regexp_replace(t, _NOISE, " ")).otherwise(t)

    said = _let(_let(text, noiseless), unphrased)
    if kept == ANY:
        return said.rlike(_SAID)
    words = F.filter(F.split(said, rf"{_SPACE}+"), lambda w: ~F.btrim(F.lower(w), F.lit(_MARKS)).isin("", *FILLERS))
    return F.array_join(words, " ") if kept == TEXT else F.size(words)


def _part(raw: Column, roster: Roster, kept: str) -> Column:
    """``struct(label, words)`` of one part: its label is the first thing in it but for clocks, noise and fillers."""

    def labelled(s: Column) -> Column:
        maybe = F.instr(s, ":").between(2, 90) | F.instr(s, "：").between(2, 90) | s.startswith("[") | s.startswith("(") | s.startswith("<") | _dashed(s)
        label = F.when(maybe, F.regexp_extract(s, _LABEL, 0)).otherwise(F.lit(""))

        def split(lab: Column) -> Column:
            name = F.when(lab != "", roster.resolve(F.regexp_replace(lab, r"^<v", "")))
            return _let(name, lambda n: F.struct(n.alias("label"), F.when(n.isNotNull(), F.substr(s, F.length(lab) + 1)).otherwise(s).alias("rest")))

        return _let(label, split)

    def behind_notes(s: Column, plain: Column) -> Column:
        def look(notes: Column) -> Column:
            def choose(b: Column) -> Column:
                said = F.filter(F.transform(F.regexp_extract_all(notes, F.lit(r"(\[[^\[\]\n]{1,60}\])"), 1), roster.resolve), lambda n: n.isNotNull())
                return F.struct(F.coalesce(b["label"], F.get(said, F.lit(0))).alias("label"), b["rest"].alias("rest"))

            return F.when(notes == "", plain).otherwise(_let(labelled(F.substr(s, F.length(notes) + 1)), choose))

        return _let(F.regexp_extract(s, _NOTES, 0), look)

    def parse(s: Column) -> Column:
        first = rf"^(?:[\[({{<*♪]|(?i:{'|'.join(FILLERS)})\b)"
        worth = (F.contains(s, F.lit(":")) | F.contains(s, F.lit("：")) | F.contains(s, F.lit("]")) | _dashed(s)) & s.rlike(first)
        return _let(labelled(s), lambda a: F.when(a["label"].isNull() & worth, behind_notes(s, a)).otherwise(a))

    found = _let(_strip(raw, _LEAD), parse)
    return _let(found, lambda f: F.struct(f["label"].alias("label"), clean_words(_strip(f["rest"], _LEAD), kept).alias("words")))


def parts_of(text: Column, roster: Roster, kept: str = TEXT) -> Column:
    """The parts of a segment's text as an array of ``struct(label, words)``; null for null text."""
    several = F.contains(text, F.lit(">>")) | F.contains(text, F.lit("<v")) | F.contains(text, F.lit("\n")) | (F.contains(text, F.lit(":")) & text.rlike(_NEXT))
    pieces = F.when(several, F.split(text, _PARTS)).otherwise(F.array(text))
    return F.when(text.isNotNull(), F.transform(pieces, lambda p: _part(p, roster, kept)))


def anchor_start_ms(anchor: Column) -> Column:
    """The start of a written time range (``mm:ss``, ``hh:mm:ss``, ``12s``, ``3m07s``, ``1h02m03s``); null if unreadable."""
    clock = r"^[\s \[(]*(?:(\d{1,9}):)?(\d{1,9}):(\d{2})(?!\d)(?:[.,](\d{1,3}))?"
    units = r"^[\s \[(]*(?=\d)(?:(\d{1,9})h)?(?:(\d{1,9})m)?(?:(\d{1,9})(?:\.(\d{1,3}))?s)?(?![\p{L}\p{N}:])"

    def ms(pattern: str) -> Column:
        g = [F.regexp_extract(anchor, pattern, k) for k in (1, 2, 3, 4)]
        whole = [F.coalesce(F.nullif(x, F.lit("")).cast("long"), F.lit(0)) for x in g[:3]]
        return (whole[0] * 3600 + whole[1] * 60 + whole[2]) * 1000 + F.coalesce(F.nullif(F.rpad(g[3], 3, "0"), F.lit("000")).cast("long"), F.lit(0))

    has_unit = F.regexp_extract(anchor, units, 0).rlike(r"\d[hms]")
    return F.when(anchor.rlike(clock), ms(clock)).when(has_unit, ms(units))


def _first_of(rows: DataFrame, order: list[str]) -> DataFrame:
    """Of the rows of one (track, recording, name) the first by ``order`` (of equals the least start, number and parts), as ``(track, recording, start_ms, ord, parts)``.

    Texts are taken apart before, so labels and words (or only their number) are shuffled, combined within
    each task first.
    """
    first = rows.groupBy("track", "recording", "name").agg(F.min(F.struct(*order, *(c for c in ("start_ms", "ord", "parts") if c not in order))).alias("r"))
    return first.select("track", "recording", "r.start_ms", "r.ord", "r.parts")


def segment_rows(segments: DataFrame, roster: Roster, kept: str = TEXT) -> DataFrame:
    """Rows ``(track, recording, start_ms, ord, parts)`` of ``audio_segment``, each (video_id, segment_id) once.

    Of re-delivered rows the first ingested counts; a row without a time of ingestion comes last.
    """
    rows = segments.select(
        F.lit("audio_segment").alias("track"), F.col("video_id").alias("recording"), F.col("segment_id").cast("string").alias("name"),
        to_ms(F.col("start_seconds")).alias("start_ms"), F.col("segment_id").cast("long").alias("ord"), parts_of(F.col("text"), roster, kept).alias("parts"),
        F.coalesce(F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit((1 << 63) - 1)).alias("version"),
    )
    return _first_of(rows, ["version"])


def anchor_rows(anchors: DataFrame, roster: Roster, kept: str = TEXT) -> DataFrame:
    """Rows ``(track, recording, start_ms, ord, parts)`` of ``grounding_anchor``; of each (source, id) the smallest ``row_id``."""
    said = F.array(F.struct(roster.resolve(F.col("speaker")).alias("label"), clean_words(F.coalesce("extracted_verbatim", F.lit("")), kept).alias("words")))
    rows = anchors.select(
        F.lit("grounding_anchor").alias("track"), F.col("source").alias("recording"), F.col("id").cast("string").alias("name"),
        anchor_start_ms(F.col("temporal_anchor")).alias("start_ms"), F.col("row_id").cast("long").alias("ord"), said.alias("parts"),
    )
    return _first_of(rows, ["ord"])


def speaker_parts(rows: DataFrame, bucket_ms: int = BUCKET_MS, break_ms: int = BREAK_MS, with_words: bool = True) -> DataFrame:
    """Every part with words, its speaker and its turn: ``(track, recording, start_ms, ord, part, words, speaker, turn)``.

    Without ``with_words``, ``words`` is their number (1 where the rows only hold whether there are any).
    ``turn`` numbers a recording's turns from 1. Speakers
    are filled forward and turns are islands of one speaker, both in windows over (recording, hour): a
    recording of any length is spread over as many tasks as it has hours, and only one row per hour (its
    last start and last label, its number of new turns) is carried on. A break of ``break_ms`` or more,
    which must be at least an hour, lies between two hours and so is found on those rows alone.
    """
    if break_ms < bucket_ms:
        raise ValueError("a break must be at least as long as a bucket")
    kept = dict(rows.select(F.inline("parts")).dtypes)["words"]
    if with_words and kept != TEXT:
        raise ValueError("these rows don't hold the words")
    words = F.col("p.words") if with_words else F.col("p.words").cast("int") if kept != TEXT else F.when(F.col("p.words") == "", 0).otherwise(F.size(F.split("p.words", " ")))
    # null keys would make every join below compare two columns more than the windows are distributed by
    keys = [F.coalesce(F.concat(F.lit("="), c), F.lit("")).alias(f"k_{c}") for c in ("track", "recording")]
    parts = rows.where("start_ms is not null").select(*keys, "start_ms", "ord", F.posexplode("parts").alias("part", "p"))
    parts = parts.select("k_track", "k_recording", "start_ms", "ord", "part", "p.label", words.alias("words"), bucket_of(F.col("start_ms"), bucket_ms).alias("b"))
    parts = checkpoint(parts.where("words <> ''" if with_words else "words > 0"))  # the texts are taken apart once, not again for each summary
    ks = ["k_track", "k_recording"]
    place = F.struct("start_ms", "ord", "part")
    hours = parts.groupBy(*ks, "b").agg(
        F.min("start_ms").alias("lo"), F.max("start_ms").alias("hi"),
        F.max_by("label", F.when(F.col("label").isNotNull(), place)).alias("last_label"),
    )
    by_hour = Window.partitionBy(*ks).orderBy("b")
    gap = F.try_subtract(F.col("lo"), F.lag("hi").over(by_hour))
    hours = hours.withColumn("fresh", F.coalesce(gap >= break_ms, F.lit(True)))
    hours = hours.withColumn("session", F.sum(F.col("fresh").cast("long")).over(by_hour))
    in_session = Window.partitionBy(*ks, "session").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.coalesce(F.last("last_label", ignorenulls=True).over(in_session), F.lit(UNKNOWN))
    hours = hours.select(*ks, "b", "fresh", carried.alias("carried"))
    here = Window.partitionBy(*ks, "b").orderBy("start_ms", "ord", "part")
    said = (
        parts.join(hours, [*ks, "b"])
        .withColumn("speaker", F.coalesce(F.last("label", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0)), "carried"))
        .withColumn("previous", F.coalesce(F.lag("speaker").over(here), F.when(~F.col("fresh"), F.col("carried"))))
        .withColumn("begins", F.coalesce(F.col("speaker") != F.col("previous"), F.lit(True)))
        .withColumn("island", F.sum(F.col("begins").cast("long")).over(here))
        .select(*ks, "b", "start_ms", "ord", "part", "words", "speaker", "island")
    )
    said = carry_forward(said, ks, "b", {"n": F.max("island")}, {"earlier": F.sum("n")})
    named = [F.when(F.col(k) != "", F.expr(f"substring({k}, 2)")).alias(k[2:]) for k in ks]
    return said.select(*named, "start_ms", "ord", "part", "words", "speaker", (F.col("island") + F.coalesce("earlier", F.lit(0))).alias("turn"))


def speaker_turns(rows: DataFrame, bucket_ms: int = BUCKET_MS, break_ms: int = BREAK_MS) -> DataFrame:
    """One row per turn: ``(track, recording, turn, start_ms, last_ms, speaker, parts, word_count)``.

    ``rows`` has ``(track, recording, start_ms, ord, parts)``, as ``segment_rows`` and ``anchor_rows`` make
    them, of one track or of several; where they hold only whether there are words, ``word_count`` is null.
    Defined cases: rows without a start, without text or with nothing left after cleaning don't count
    and their labels aren't carried; null recordings are one recording; ties are ordered by ``ord``, then
    by the place in the segment; empty tables give an empty result; extra columns are ignored.
    """
    told = dict(rows.select(F.inline("parts")).dtypes)["words"] != ANY
    words = F.sum("words").cast("long") if told else F.lit(None).cast("long")
    return speaker_parts(rows, bucket_ms, break_ms, with_words=False).groupBy("track", "recording", "turn").agg(
        F.min("start_ms").alias("start_ms"), F.max("start_ms").alias("last_ms"), F.first("speaker").alias("speaker"),
        F.count(F.lit(1)).alias("parts"), words.alias("word_count"),
    )


def turn_texts(rows: DataFrame, bucket_ms: int = BUCKET_MS, break_ms: int = BREAK_MS) -> DataFrame:
    """The words of each turn in order, in one piece per hour: ``(track, recording, turn, piece, speaker, text)``.

    A turn without any change of speaker may run through a whole recording, so its text isn't gathered
    into one row; ``piece`` is the hour, and pieces in order make the turn.
    """
    hour = bucket_of(F.col("start_ms"), bucket_ms)
    pieces = speaker_parts(rows, bucket_ms, break_ms).groupBy("track", "recording", "turn", hour.alias("piece")).agg(
        F.first("speaker").alias("speaker"), F.sort_array(F.collect_list(F.struct("start_ms", "ord", "part", "words"))).alias("w")
    )
    return pieces.select("track", "recording", "turn", "piece", "speaker", F.array_join(F.col("w.words"), " ").alias("text"))
