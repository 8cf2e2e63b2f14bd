"""Queries over small tables whose rows the fixed limits used to cut."""

import datetime as dt

from folioworks.plans import scene_queries, text_queries

DAY = dt.datetime(2026, 1, 1)


def save(spark, folder, name, rows, ddl):
    spark.createDataFrame(rows, ddl).write.parquet(f"{folder}/{name}.parquet")


def test_normalized_reports_are_whole(spark, tmp_path):
    texts = ["short", "é" * 5000 + " end", None, "w" * 9000]
    rows = [(i, DAY, "PDF" if i == 3 else "md", t) for i, t in enumerate(texts)]
    save(spark, tmp_path, "source_context", rows, "doc_id long, processed_at timestamp, file_type string, clean_markdown string")
    got = {r.doc_id: r for r in text_queries.normalized_reports(spark, str(tmp_path)).collect()}
    whole = "Á\n" + texts[1] + "\n"
    assert got[1].normalized_text == whole and got[1].normalized_char_count == len(whole) and not got[1].truncated and got[1].reason is None
    assert got[2].normalized_text is None and got[2].reason == "no extractable text" and not got[2].truncated
    assert got[3].normalized_text is None and not got[3].supported and not got[3].truncated
    cut = {r.doc_id: r for r in text_queries.normalized_reports(spark, str(tmp_path), limit=10).collect()}
    assert cut[0].normalized_text == "Á\nshort\n" and not cut[0].truncated  # 9 bytes
    assert cut[1].normalized_text == "Á\n" + "é" * 3 and cut[1].normalized_char_count == 5 and cut[1].truncated
    assert not cut[2].truncated and not cut[3].truncated


SCENES = "video_id string, scene_id int, start_seconds double, end_seconds double, visual_type string, scene_iocs array<string>"
SPEECH = "video_id string, segment_id int, start_seconds double, end_seconds double, text string"


def test_video_groundings_count_all_scenes(spark, tmp_path):
    kinds = ["SLIDE", "TERMINAL", "DIAGRAM", "OTHER", None, "OTHER", "OTHER"]
    scenes = [("v", i + 1, 10.0 * i, 10.0 * i + 10, k, ["CVE-2020-0001"] if i == 6 else []) for i, k in enumerate(kinds)]
    save(spark, tmp_path, "aligned_scene", scenes + [("w", 1, 0.0, 5.0, "OTHER", [])], SCENES)
    said = [("v", 1, 0.0, 1.0, "CVE-2024-1234 from 198.51.100.42 and " + "a" * 64), ("v", 2, 65.0, 66.0, "evil-site.com and https://bad-payload.org/drop.exe")]
    save(spark, tmp_path, "audio_segment", said, SPEECH)
    got = {r.video_id: r for r in scene_queries.video_groundings(spark, str(tmp_path)).collect()}
    md = got["v"].markdown
    assert "across 7 scenes." in md and "**Detected 7 distinct visual scenes**" in md and md.count("- Scene ") == 5 and "- Scene 6 " not in md
    assert got["v"].title == "Video Intelligence Briefing: CVE-2020-0001, CVE-2024-1234 (v)"
    for line in (
        "- **CVEs:** CVE-2020-0001, CVE-2024-1234", "- **IP Addresses:** 198.51.100.42", "- **SHA-256 Hashes:** " + "a" * 64,
        "- **Domains / URLs:** bad-payload.org, evil-site.com, https://bad-payload.org/drop.exe",
    ):
        assert line in md.split("\n")
    assert [x.split("]: ")[1] for x in md.split("\n") if x.startswith("- Scene ")] == [
        "", "Active command-line console session displaying terminal execution logs.", "System architecture diagram illustrating network topology and threat pathways.",
        *["Visual scene displaying presenter briefing or transition slide."] * 2,
    ]
    assert "across 1 scenes." in got["w"].markdown and "Indicators of Compromise\n" in got["w"].markdown and "**CVEs:**" not in got["w"].markdown


def test_event_cuts_have_their_tail(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, 4000, 10.0), (1, 5000, 10.0), (1, 9000, 90.0), (2, 100, 90.0), (2, 7200, 80.0), (3, 100, 90.0), (3, 3600, 1.0)]
    save(spark, tmp_path, "events", [(u, at(s), v) for u, s, v in rows], "user_id long, ts timestamp, value double")
    got = sorted(tuple(r) for r in scene_queries.event_cuts(spark, str(tmp_path)).collect())
    assert got == [(1, 0.0, 4000.0), (1, 4000.0, 9000.0), (2, 0.0, 7200.0), (3, 0.0, 3600.0)]


def test_media_and_fact_citations(spark, tmp_path):
    anchors = [(1, "a.mp3", "aud-1", "00:15 - 00:42", "x" * 150), (2, "a.mp3", "aud-2", None, "short"), (3, "b.wav", "aud-1", "00:00", None)]
    save(spark, tmp_path, "grounding_anchor", anchors, "row_id long, source string, id string, temporal_anchor string, extracted_verbatim string")
    save(spark, tmp_path, "aligned_scene", [("v", i, 10.0 * i, 10.0 * i + 10, None, []) for i in range(1, 8)] + [("w", 1, None, 5.0, None, [])], SCENES)
    save(spark, tmp_path, "audio_segment", [("v", 1, 0.0, 1.0, "y" * 120)], SPEECH)
    reports = [(1, DAY, "r.md", "s", "CVE-2024-1234 hit 40 servers and 12 hosts"), (2, DAY, "none.md", "s", None)]
    save(spark, tmp_path, "source_context", reports, "doc_id long, processed_at timestamp, file_name string, sha256_checksum string, clean_markdown string")
    rows = [tuple(r) for r in scene_queries.media_citations(spark, str(tmp_path)).collect()]
    got = {(r[0], r[1]): r[3] for r in rows}
    assert len(rows) == 10 and {r[2] for r in rows} == {"file"}
    assert got["a.mp3", "aud-1"] == "[00:15 - 00:42] " + "x" * 100 and got["a.mp3", "aud-2"] == "[00:00] short"
    assert got["v", "vid-1"].split("] ")[1] == "y" * 80 and sorted(i for s, i in got if s == "v") == [f"vid-{i}" for i in range(1, 6)]
    assert [got[n, f"src-{n}"] for n in ("b.wav", "w", "none.md")] == ["b.wav", "w", "none.md"]
    n = len([r for r in text_queries.citations(spark, str(tmp_path)).collect() if r.doc_id == 1])
    facts = sorted((r.id, r.kind, r.label) for r in text_queries.fact_citations(spark, str(tmp_path)).collect())
    assert [f[:2] for f in facts] == [(f"fact-{n + 1}", "text"), (f"fact-{n + 2}", "text")] and ["servers" in facts[0][2], "hosts" in facts[1][2]] == [True, True]


def test_sample_points_skip_short_scenes(spark, tmp_path):
    scenes = [("v", 1, 0.0, 1.0), ("v", 2, 1.0, 2.0), ("v", 3, 2.0, 3.5), ("v", 4, 3.5, 20.0), ("w", 1, 0.0, 9.0), ("w", 2, 9.0, 9.5), (None, 1, 0.0, 1.0)]
    save(spark, tmp_path, "aligned_scene", [(*s, "OTHER", []) for s in scenes], SCENES)
    got = {(r.video_id, r.scene_id): r.at_ms for r in scene_queries.sample_points(spark, str(tmp_path)).collect()}
    assert got == {("v", 1): 800, ("v", 3): 3200, ("v", 4): 16700, ("w", 1): 7200, (None, 1): 800}
