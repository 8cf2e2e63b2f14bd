from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioworks.llm.turns import ANY, NUMBER, TEXT, Roster, anchor_rows, anchor_start_ms, segment_rows, speaker_turns, turn_texts

SEG = "video_id string, segment_id int, start_seconds double, end_seconds double, text string, ingested_at timestamp, label string, words string, b int"
ANC = "row_id long, source string, id string, temporal_anchor string, speaker string, extracted_verbatim string, part int"


@pytest.fixture(scope="module")
def roster(spark):
    rows = [(1, "Night Analyst", "NightAn"), (2, "Legal Counsel", "Counsel"), (3, "Call Moderator", None), (4, None, "x")]
    return Roster(spark.createDataFrame(rows, "speaker_id int, speaker_name string, short_name string"))


def turns(spark, roster, texts, **kw):
    t = datetime(2026, 1, 1)
    rows = [("v", i, float(s), None, x, t, "clash", "clash", 0) for i, (s, x) in enumerate(texts)]
    got = speaker_turns(segment_rows(spark.createDataFrame(rows, SEG), roster), **kw).orderBy("turn").collect()
    return [(r.start_ms, r.speaker) for r in got]


def test_labels_in_all_their_forms(spark, roster):
    forms = [
        "Night Analyst: hi", "[NIGHT ANALYST] hi", "<v night_analyst> hi", ">> NightAn: hi", "[00:12] Night-Analyst (remote): hi", "Night  Analyst -- hi",
        "Nihgt Analyst: hi", "Nightt Analyst: hi", "01:02:03 [Night Analyst (cont'd)] hi", "Night Analyst: hi",
    ]
    for f in forms:
        assert turns(spark, roster, [(0, "hello"), (1, f)]) == [(0, "Unknown Speaker"), (1000, "Night Analyst")], f
    for f, name in (("Speaker7: hi", "Speaker 7"), ("SPEAKER_07: hi", "Speaker 7"), ("Spk 7 -- hi", "Speaker 7"), ("Question: why", None), ("see https://x.y", None)):
        assert turns(spark, roster, [(0, f)]) == [(0, name or "Unknown Speaker")], f


def test_labels_behind_clocks_notes_and_fillers(spark, roster):
    """Clocks of any number of hours, notes and fillers may stand before a label, a clock behind its name; lines and sentences may end before one."""
    forms = [
        "[1639:58:54] Night Analyst: hi", "(123456:00:01) >> Night Analyst: hi", "1000:00:00 Night Analyst -- hi", "[00:12]Night Analyst: hi", "00:12 - 00:15 Night Analyst: hi",
        "[noise] Night Analyst: hi", "[00:12] [laughs] Night Analyst: hi", "um Night Analyst: hi", "(door slams) um, Night Analyst: hi", "[noise] [Night Analyst] hi", "[noise] [NightAn] um, [static] hi",
        "Night Analyst [00:12]: hi", "Night Analyst (00:12): hi", "(Night Analyst) hi", "Night Analyst - hi", "Night Analyst – hi", "Night Analyst：hi",
    ]
    got = segment_rows(spark.createDataFrame([(f, 1, 1.0, None, f, None, "", "", 0) for f in forms], SEG), roster).collect()
    for r in got:
        assert [(p.label, p.words) for p in r.parts if p.words] == [("Night Analyst", "hi")], r
    for f in ("one\nNight Analyst: two", "one. Night Analyst: two", "one? um, Night Analyst: two >> three"):
        assert turns(spark, roster, [(0, f)]) == [(0, "Unknown Speaker"), (0, "Night Analyst")], f
    for f in ("it is 12:30 now", "the night analyst: gone", "we saw it - the counsel did", "[noise] so: this", "see (the counsel) there"):
        assert turns(spark, roster, [(0, f)]) == [(0, "Unknown Speaker")], f


def test_notes_go_and_speech_in_brackets_stays(spark, roster):
    notes = ["(laughs)", "*coughs*", "(door slams)", "(pause 20s)", "{beep}", "♪ tone ♪", "<unk>", "[[SILENCE]]", "(a phone is ringing somewhere)", "*keyboard clatter*"]
    for n in notes:
        assert turns(spark, roster, [(0, n)]) == [], n
    rows = segment_rows(spark.createDataFrame([("v", i, 1.0, None, x, None, "", "", 0) for i, x in enumerate(["(the budget is closed)", "*this is vital*"])], SEG), roster)
    assert {r.text for r in turn_texts(rows).collect()} == {"(the budget is closed) *this is vital*"}


def test_two_speakers_noise_and_carry(spark, roster):
    got = turns(
        spark, roster,
        [(0, "Counsel: one"), (1, "[static]"), (2, "two"), (3, "Night Analyst: um..."), (4, "three >> Night Analyst: four >> Counsel: [laughs]"), (5, "five"), (6, None), (7, "")],
    )
    assert got == [(0, "Legal Counsel"), (4000, "Night Analyst")]


def test_breaks_and_hours(spark, roster):
    h = 3600
    got = turns(spark, roster, [(0, "Counsel: a"), (5.9 * h, "b"), (11.9 * h, "c"), (11.9 * h + 1, "Counsel: d"), (18 * h, "e")])
    assert got == [(0, "Legal Counsel"), (int(11.9 * h * 1000), "Unknown Speaker"), (int(11.9 * h * 1000) + 1000, "Legal Counsel"), (18 * h * 1000, "Unknown Speaker")]
    with pytest.raises(ValueError, match="break"):
        turns(spark, roster, [(0, "a")], break_ms=1)


def test_ties_repeats_and_null_starts(spark, roster):
    t1, t2 = datetime(2026, 1, 1), datetime(2026, 1, 2)
    rows = [
        ("v", 2, 5.0, None, "Counsel: late twin", t1, "", "", 0), ("v", 1, 5.0, None, "Night Analyst: early twin", t1, "", "", 0), ("v", 1, 5.0, None, "Night Analyst: early twin", t2, "", "", 0),
        ("v", 3, None, 9.0, "Call Moderator: x", t1, "", "", 0), ("v", 4, float("nan"), 9.0, "Call Moderator: x", t1, "", "", 0), (None, 1, 1.0, 2.0, "y", t1, "", "", 0),
    ]
    df = spark.createDataFrame(rows, SEG)
    got = {(r.recording, r.turn, r.start_ms, r.speaker, r.parts) for r in speaker_turns(segment_rows(df, roster, NUMBER)).collect()}
    assert got == {("v", 1, 5000, "Night Analyst", 1), ("v", 2, 5000, "Legal Counsel", 1), (None, 1, 1000, "Unknown Speaker", 1)}
    assert speaker_turns(segment_rows(df.limit(0), roster)).count() == 0


def test_anchors(spark, roster):
    rows = [(5, "c", "a1", "00:10 - 00:12", "Night Analyst:", "um, hello (laughs) there", 0), (2, "c", "a1", "00:09", None, "first wins", 0), (3, "c", "a2", "n/a", "Counsel", "x", 0), (4, "c", "a3", "9m01s - 9m09s", "[Legal Counsel]", "call (415) 555-0118 at x [at] y", 0), (6, "c", "a4", None, None, None, 0)]
    df = spark.createDataFrame(rows, ANC)
    r = anchor_rows(df, roster)
    assert [(x.start_ms, x.speaker) for x in speaker_turns(r).orderBy("turn").collect()] == [(9000, "Unknown Speaker"), (541000, "Legal Counsel")]
    assert {x.text for x in turn_texts(r).collect()} == {"first wins", "call (415) 555-0118 at x [at] y"}


def test_time_forms(spark):
    forms = {
        "04:52 - 05:18": 292000, "01:00:44 - 01:01:04": 3644000, "121s - 135s": 121000, "32:25 - End": 1945000, "[03:23 - 03:41]": 203000, "00:03:03 --> 00:03:07": 183000,
        "9m05s - 9m10s": 545000, "1h02m03s": 3723000, "01:26-01:47": 86000, "00:01.5": 1500, "": None, "n/a": None, "--:--": None, "unknown": None, None: None, "12": None,
    }
    df = spark.createDataFrame([(k, v) for k, v in forms.items()], "t string, want long")
    for r in df.select("t", "want", anchor_start_ms(F.col("t")).alias("got")).collect():
        assert r.got == r.want, r.t


def test_what_is_kept_of_the_words(spark, roster):
    """Text, number and presence of words agree."""
    texts = ["", "um", "Um...", "um, er.", "...", "(laughs)", "well, um", "well, so", "I mean, you know, it", "\u2014 um \u2014", "umbrella", "um-hm", "a\u00a0um b", "\"uh\"", "Counsel: uh", None, " ", "*coughs* mm-hmm.", "er er er go"]
    df = spark.createDataFrame([("v", i, float(i), None, x, None, "", "", 0) for i, x in enumerate(texts)], SEG)
    by = [{r.ord: [p.words for p in r.parts or ()] for r in segment_rows(df, roster, kept).collect()} for kept in (TEXT, NUMBER, ANY)]
    for i in range(len(texts)):
        text, number, some = by[0][i], by[1][i], by[2][i]
        assert [len(x.split()) for x in text] == number and [n > 0 for n in number] == some, texts[i]
    turns_of = [{(r.turn, r.start_ms, r.speaker, r.parts) for r in speaker_turns(segment_rows(df, roster, kept)).collect()} for kept in (TEXT, NUMBER, ANY)]
    assert turns_of[0] == turns_of[1] == turns_of[2]
