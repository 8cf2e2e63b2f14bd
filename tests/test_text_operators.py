import re

import pytest
from pyspark.sql import functions as F

from folioworks.functions import text as T
from folioworks.operators import chunking, classify, grounding, indicators, redaction, rendering, tables


def one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'int'}" for n, v in cols.items())) if names else spark.range(1)
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Café\r\nÅ\r\n", "Café\nÅ\n"), ("ＡＢＣ ０１２", "ＡＢＣ ０１２\n"), ("a\r\nb\rc\nd", "a\nb\nc\nd\n"), ("a\x00b\x1f\x7fc\td\n", "abc\td\n"),
        ("left  \nright\t \n", "left\nright\n"), ("  para  \n\n\tdeep  \n", "  para\n\n\tdeep\n"), ("", ""), ("\x00\x00", ""), ("   \n\n  \n", ""), ("x", "x\n"), ("x\n\n", "x\n"),
    ],
)
def test_normalize(spark, raw, want):
    got = one(spark, T.normalize_text(F.col("t")), t=raw)
    assert got == want and one(spark, T.normalize_text(F.col("t")), t=got) == want


@pytest.mark.parametrize(("text", "limit", "want"), [("hello world", 100, "hello world"), ("é" * 5, 7, "é" * 3), ("é" * 4, 8, "é" * 4), ("anything", 0, ""), ("𝄞𝄞", 5, "𝄞")])
def test_truncate(spark, text, limit, want):
    assert one(spark, T.truncate_utf8(F.col("t"), limit), t=text) == want


def test_indicators(spark):
    text = (
        "CVE-2024-38077 asCVE-2019-19781 T1190 t1059.001 198.51.100.42 0.0.0.0 127.0.0.9 999.1.1.1 2001:0db8:85a3:0000:0000:8a2e:0370:7334 "
        "malicious-c2[.]net https://bad-payload.org/drop.exe. https://github.com/x docs.microsoft.com printer.local " + "a" * 64 + " " + "b" * 40 + " " + "c" * 32
    )
    df = spark.createDataFrame([(text,), (None,)], "t string")
    got, none = indicators.with_indicators(df, "t").collect()
    assert got.cves == ["CVE-2019-19781", "CVE-2024-38077"] and got.mitre_attack_ids == ["T1059.001", "T1190"]
    assert got.ipv4_addresses == ["198.51.100.42"] and got.ipv6_addresses == ["2001:0db8:85a3:0000:0000:8a2e:0370:7334"]
    assert got.urls == ["https://bad-payload.org/drop.exe"] and got.domains == ["bad-payload.org", "malicious-c2.net"]
    assert got.sha256_hashes == ["a" * 64] and got.sha1_hashes == ["b" * 40] and got.md5_hashes == ["c" * 32]
    assert all(none[k] == [] for k in indicators.KINDS)


def test_threat_summary(spark):
    text = "LockBit  3.0 and APT29, high then CRITICAL; CVSS: 9.8 Base Score: 7.1; 2024-01-02T03:04Z on Windows Server 2019"
    got = indicators.with_terms(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert got.threat_actors == ["APT29", "LockBit 3.0"] and got.severity_keywords == ["CRITICAL", "HIGH"] and got.cvss_scores == [9.8, 7.1]
    assert got.affected_systems == ["Windows Server 2019"] and got.timelines == ["2024-01-02T03:04Z"]


def test_tables(spark):
    text = "x\n- | a | b |\n| --- | --- |\n\n| 1 | 2 | 3 |\n|4|\nend\n| only |\ny\n| h | CVSS |\n| q | 9.1 |\n| z | n/a |"
    got = one(spark, tables.text_tables(F.col("t")), t=text)
    assert [(t.headers, t.rows) for t in got] == [(["a", "b"], [["1", "2"], ["4", ""]]), (["h", "CVSS"], [["q", "9.1"], ["z", "n/a"]])]
    assert one(spark, tables.column_scores(tables.text_tables(F.col("t"))), t=text) == [9.1]
    h, r = F.array(F.lit("Host"), F.lit("IP")), F.array(F.array(F.lit("a"), F.lit("10.0.0.1")), F.array(F.lit("b")))
    md = one(spark, tables.to_markdown(h, r))
    assert md == "| Host | IP       |\n| ---- | -------- |\n| a    | 10.0.0.1 |\n| b    |          |"
    back = one(spark, tables.text_tables(F.col("t")), t=md)[0]
    assert back.headers == ["Host", "IP"] and back.rows == [["a", "10.0.0.1"], ["b", ""]]
    assert one(spark, tables.text_tables(F.col("t")), t=None) == []


def brute_chunks(text, limit=1200):
    est = lambda t: max(1, len(t) // 4)
    out, head, cur = [], "Document Root", []
    secs = []
    for line in text.split("\n"):
        m = re.match(r"^(#{1,6})\s+(.+)$", line)
        if m:
            if cur:
                secs.append((head, "\n".join(cur).strip()))
            head, cur = m[2].strip(), []
        cur.append(line)
    secs.append((head, "\n".join(cur).strip()))
    for h, c in secs:
        if not c:
            continue
        group, n = [], 0
        parts = [c] if est(c) <= limit else re.split(r"\n\s*\n", c)
        for p in parts:
            if group and n + est(p) > limit:
                out.append((h, "\n\n".join(group)))
                group, n = [], 0
            group.append(p)
            n += est(p)
        out.append((h, "\n\n".join(group)))
    return out


def test_chunks(spark):
    text = "intro\n\n# A\nbody\n####### no\n## B\n" + "\n\n".join(f"para {i} " + "w" * (50 * i) for i in range(40)) + "\n# C\n```\n# in code\n```"
    got = one(spark, chunking.chunks(F.col("t"), 300), t=text)
    assert [(c.parent_section, c.text) for c in got] == brute_chunks(text, 300)
    assert [c.chunk_id for c in got] == list(range(1, len(got) + 1))


def test_redaction_matches_definition(spark):
    text = "10.0.0.1 and 10.0.0.1 password=hunter22 TOP SECRET db.internal EMP-12345"
    out, flags = redaction.wrap_sensitive(text)
    assert [f["type"] for f in flags] == ["Unredacted PII", "Internal Host", "Classified Entity", "Credential/Secret", "Internal IP"]
    assert out.count("[SENSITIVE: 10.0.0.1 (Internal IP)]") == 1 and redaction.wrap_sensitive(out)[1] == []
    got = one(spark, redaction.sensitive_flags(F.col("t")), t=text)
    assert {(f.match, f.type) for f in got} == {(f["match"], f["type"]) for f in flags}
    assert redaction.wrap_sensitive(None) == (None, [])


def test_formats(spark):
    rows = [
        ("a/b\\C.TXT", "text/plain; charset=x", "text"), ("x.pdf", "text/plain", "unknown"), ("x", "application/pdf", "document"), (".txt", None, "unknown"),
        ("y.bin", "application/octet-stream", "unknown"), ("v.mp4", None, "video"),
    ]
    for name, mime, want in rows:
        df = spark.createDataFrame([(name, mime)], "n string, m string")
        assert df.select(classify.media_category(F.col("n"), F.col("m"))).first()[0] == want, name
    df = spark.createDataFrame([("d/", ""), ("..\\x.docx", "application/pdf"), ("r.docx", None)], "n string, m string")
    got = [r for r in df.select(classify.base_name(F.col("n")).alias("b"), classify.upload_check(F.col("n"), F.col("m")).alias("u")).collect()]
    assert [r.b for r in got] == ["d", "x.docx", "r.docx"]
    assert got[1].u.error and got[2].u.extension == "docx" and got[0].u.error == "file type not supported"


def test_salvaged_json(spark):
    forms = ['{"a": 1}', '<think>x</think>```json\n{"a": 1}\n```', 'sure: {"a": 1} ok', '{"a": "x', "nothing"]
    got = [one(spark, grounding.salvage_json(F.col("t")).cast("string"), t=f) for f in forms]
    assert got == ['{"a":1}'] * 3 + ['{"a":"x"}', None]


def test_anchors(spark):
    get = lambda t: one(spark, grounding.anchors_of(F.col("t")), t=t)
    assert [tuple(a) for a in get('```json\n{"anchors": {"text": " hi ", "confidence": 0.5}}\n```')] == [("src-1", "Central Visual Field", "hi", "CORE_CONCEPT", 0.5)]
    assert get('[{"grounding_sources": [{"id": "x"}, 3, {"anchor": "A"}]}]')[1].anchor == "A"
    assert get('{"summary": "s"}')[0].extracted_verbatim == "s" and get("broken") is None


def test_render_defaults(spark):
    p = F.struct(*[F.lit(None).cast("string").alias(k) for k in ("bluf", "situation", "complication", "solution")], F.array(F.lit("one"), F.lit("two")).alias("strategic_recommendations"))
    assert one(spark, rendering.exec_summary(p)).endswith("Required\n1. one\n2. two")
    assert one(spark, rendering.mermaid(F.col("t")), t="Web Server\nDB!\nFirewall") == '```mermaid\nflowchart LR\n    N0["Web Server"]\n    N1["Firewall"]\n    N0 --> N1\n```'
    assert one(spark, rendering.slide_content(F.col("t")), t=" \n") == "*(Empty slide)*"


def test_entities_and_recovery(spark):
    get = lambda t: one(spark, grounding.entities_of(F.col("t")), t=t)
    assert tuple(get('{"entities_detected": {"cves": ["CVE-1"], "actors": null}}')) == (["CVE-1"], [], [])
    assert tuple(get('{"entities_detected": ["cve-2", "host", {"actor": "A", "target": "T"}]}')) == (["cve-2"], ["A"], ["host", "T"])
    assert get("broken") is None and tuple(get("{}")) == ([], [], [])
    got = grounding.recovered(F.col("t"), {"a.b": ("string", F.lit("d")), "n": ("int", F.lit(7))})
    assert one(spark, got["a.b"], t='x {"a": {"b": "v"}}') == "v" and one(spark, got["n"], t="nothing") == 7
    assert one(spark, grounding.snippet(F.col("t")), t=" a\nb ") == "a b..." and one(spark, grounding.snippet(F.col("t")), t=" ") == ""


def test_wrapping_puts_texts_together():
    from folioworks.operators.redaction import wrap_sensitive

    wrap = lambda s, kind: f'<span style="color: red; font-weight: bold;">[SENSITIVE: {s} ({kind})]</span>'
    text, flags = wrap_sensitive("at 10.0.0.5 by EMP-1234, 10.0.0.5 again")
    assert text == f"at {wrap('10.0.0.5', 'Internal IP')} by {wrap('EMP-1234', 'Unredacted PII')}, 10.0.0.5 again"
    assert [f["match"] for f in flags] == ["EMP-1234", "10.0.0.5"]
    near = "[SENSITIVE: 10.0.0.5 (x)] and " + "y" * 60 + " 10.0.0.5"
    assert wrap_sensitive(near)[0].endswith(wrap("10.0.0.5", "Internal IP")) and wrap_sensitive(near[:40]) == (near[:40], [])
    # the host is part of the address: its wrapper goes in first, and the address covers the host's characters of it
    text, flags = wrap_sensitive("to ann@dc.corp")
    inner = wrap("ann@dc.corp", "Unredacted PII")
    assert [f["match"] for f in flags] == ["dc.corp", "ann@dc.corp"] and text == "to " + inner + wrap("dc.corp", "Internal Host")[len("dc.corp") :]
    assert wrap_sensitive("") == ("", []) and wrap_sensitive(None) == (None, []) and wrap_sensitive("plain")[1] == []
    long, flags = wrap_sensitive(" ".join(f"10.0.{i // 250}.{i % 250}" for i in range(20_000)))
    assert len(flags) == 20_000 and long.count("[SENSITIVE:") == 20_000


def test_inspectors(spark):
    docx = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
    cases = [("text", "txt", None, "text"), ("text", "md", "text/plain", "text"), ("text", "md", None, None), ("document", "pdf", docx, "pdf"), ("document", None, docx, "docx"),
             ("document", "odt", None, None), ("image", "pdf", "application/pdf", None), (None, "txt", None, None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, c string, e string, m string, want string")
    for r in df.select("*", classify.inspector_of(F.col("c"), F.col("e"), F.col("m")).alias("got"), classify.only_inspector(F.col("c")).alias("only")).collect():
        assert r.got == r.want and r.only == ("text" if r.c == "text" else None), r


def test_filled_sentences(spark):
    cols = {"a": F.lit("x"), "b": F.lit("y")}
    row = spark.range(1).select(grounding.filled("{a} and {b}.", **cols).alias("s"), grounding.filled("plain", **cols).alias("p"), grounding.filled(("{b}", "z {a}"), **cols).alias("l")).first()
    assert (row.s, row.p, row.l) == ("x and y.", "plain", ["y", "z x"])


def test_spoken_segments(spark):
    from folioworks.operators.alignment import spoken_segments

    rows = [("v", 1, 0.004, 10.075, " a "), ("v", 2, 1.0, 2.0, "  "), ("v", 3, None, 2.555, "b"), ("v", 4, -0.001, 1.0, None)]
    got = spoken_segments(spark.createDataFrame(rows, "v string, i int, s double, e double, t string"), ["v", "i"], "s", "e", "t").collect()
    assert [tuple(r) for r in got] == [("v", 1, 0.0, 10.07, "a"), ("v", 3, None, 2.56, "b")]
