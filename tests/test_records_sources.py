import io
import os
import wave
import zipfile

import pytest
from pyspark.sql import functions as F

from folioworks.models import answers, ask_in_turn, any_error, cascade, model_is_gone, usable_key
from folioworks.operators import alignment, records
from folioworks.sources import readers, sinks


def test_children_claims_and_params(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b")], "k int, n string")
    c = spark.createDataFrame([(1, 3, "z"), (1, 1, "x"), (1, 1, "x")], "k int, o int, v string")
    got = {r.k: [(x.o, x.v) for x in r.kids] for r in records.with_children(p, c, "k", ["o"], ["o", "v"], "kids").collect()}
    assert got == {1: [(1, "x"), (1, "x"), (3, "z")], 2: []}
    many = spark.createDataFrame([(1, i * 7 % 5000, "x") for i in range(5000)] + [(2, 9, "y"), (2, 9, "y"), (2, 8, "y")], "k int, o int, v string")
    parts = records.with_children(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, n string"), many, "k", ["o"], ["o"], "kids", max_children=1000).collect()
    own = sorted((r.part, [x.o for x in r.kids]) for r in parts if r.k == 1)
    assert [x for _, kids in own for x in kids] == list(range(5000)) and len(own) == 5 and max(len(kids) for _, kids in own) < 1100
    assert [(r.part, [x.o for x in r.kids]) for r in parts if r.k > 1] in ([(0, [8, 9, 9]), (0, [])], [(0, []), (0, [8, 9, 9])])
    e = spark.createDataFrame([("j", 2, 1), ("j", 1, 9), ("j", 1, 5)], "job string, at int, id int")
    assert tuple(records.first_claim(e, "job", "at", "id").first()) == ("j", 1, 5)
    assert tuple(records.latest_state(e, "job", "at", "id").first()) == ("j", 2, 1)
    m = spark.range(1).select(records.merged_params(F.array(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("a"), F.lit(3)))).alias("m"))
    assert m.first().m == {"a": 3, "b": 2}


def test_files_through_parsers(spark, tmp_path):
    files = {
        "t.csv": b'CVE,Note\n\nCVE-1,"a, ""b""\nc"\nCVE-2\n', "t.json": b'[{"h": 1, "x": null}, {"h": true}]', "bad.json": b"{nope", "c.yaml": b"b: 1\na: [2]\n",
        "p.xml": b"<a><b>1</b></a>", "p.html": b"<p>broken", "m.eml": b"From: x@y.z\nTo: q\nSubject: Hi\n\nBody text\n", "l.log": b"one\r\ntwo\r\n",
        "r.md": b"# T\n| a | b |\n|---|---|\n| 1 | 2 |\n", "l1.txt": "caf\xe9".encode("latin-1"), "none.bin": b" x ",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    df = readers.read_folder(spark, str(tmp_path)).withColumn("text", readers.decoded(F.col("content")))
    got = {r.name: r for r in readers.parse_files(df.select("name", "text")).collect()}
    assert set(got) == set(files)
    assert got["t.csv"].tables[0].headers == ["CVE", "Note"] and got["t.csv"].tables[0].rows == [["CVE-1", 'a, "b"\nc'], ["CVE-2"]]
    assert got["t.json"].tables[0].rows == [["1", "None"], ["True", ""]] and got["t.json"].markdown.endswith("```")
    assert got["bad.json"].markdown == "```\n{nope\n```" and got["c.yaml"].markdown == "```yaml\nb: 1\na:\n- 2\n\n```"
    assert got["p.xml"].markdown == "```xml\n<a><b>1</b></a>\n```" and got["p.html"].markdown == "<p>broken"
    assert "- **Subject:** Hi" in got["m.eml"].markdown and got["m.eml"].markdown.endswith("Body text")
    assert got["l.log"].markdown == "### 🪵 Ingested Log Telemetry\n\n```text\none\ntwo\n```" and got["l1.txt"].markdown == "café"
    assert got["r.md"].tables[0].rows == [["1", "2"]] and got["none.bin"].markdown == "x"
    assert readers.read_folder(spark, str(tmp_path), (".md", ".csv")).count() == 2


def test_inspection_docx_wav(spark, tmp_path):
    b = spark.createDataFrame([(bytearray(b"\xef\xbb\xbfab\xff"), 6), (bytearray(b"abcdef"), 6), (bytearray(b"x"), 2)], "c binary, n int")
    got = [r.i for r in b.select(readers.inspected(F.col("c"), F.col("n"), 5).alias("i")).collect()]
    assert got[0].truncated and got[1].text == "abcde" and got[2].error and got[2].text is None
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    d = spark.createDataFrame([("x.docx", bytearray(buf.getvalue())), ("y.docx", bytearray(b"no")), ("z.pdf", bytearray(b"no"))], "n string, c binary")
    assert [r.t for r in d.select(readers.binary_text()("n", "c").alias("t")).collect()] == ["# Title\n\n| a |\n|---|", None, None]
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\0" * 4 * 4000)
    h = spark.createDataFrame([(bytearray(buf.getvalue()),), (bytearray(b"nothing"),)], "c binary").select(readers.wav_header(F.col("c")).alias("h")).collect()
    assert tuple(h[0].h) == (2, 8000, 2, 0.5) == readers.wav_details(buf.getvalue()) and h[1].h is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "m", 5), (2, "longer", 6)], "k int, md string, n int")
    sinks.write_pair(df, str(tmp_path / "p"), "k", "md")
    assert {tuple(r) for r in sinks.read_pair(spark, str(tmp_path / "p"), "k").collect()} == {(1, "m", '{"n":5}'), (2, "longer", '{"n":6}')}
    left = sinks.write_bounded(df, str(tmp_path / "b"), "md", 3)
    assert [r.k for r in left.collect()] == [2] and spark.read.parquet(str(tmp_path / "b")).count() == 1
    assert spark.range(1).select(sinks.safe_name(F.lit("../a/b")).alias("x")).first().x == "_a_b"


def test_models(spark):
    df = spark.createDataFrame([("a",), ("b",)], "p string")
    assert [r.o for r in answers(df, "p", "o", None, F.lit("d")).collect()] == ["d", "d"]
    assert [r.o for r in answers(df, "p", "o", lambda x: [None if t == "b" else t.upper() for t in x], F.lit("d")).collect()] == ["A", "d"]


def test_overlaps_and_frames(spark):
    import random

    rng = random.Random(1)
    spans = lambda n: [("v", i, (s := rng.randrange(0, 5000)), s + rng.randrange(0, 900)) for i in range(n)]
    a, b = spans(60), spans(60)
    left = spark.createDataFrame(a, "v string, li int, l_start long, l_end long")
    right = spark.createDataFrame(b, "v string, ri int, r_start long, r_end long")
    got = [(r.li, r.ri) for r in alignment.overlapping_pairs(left, right, "v", 100).collect()]
    assert sorted(got) == sorted((x[1], y[1]) for x in a for y in b if y[3] >= x[2] and y[2] <= x[3])
    hashes = [rng.getrandbits(64) - 2**63 for _ in range(20)]
    hashes += [h ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) for h in hashes]
    kept, want = [], []
    for h in hashes:
        like = [o for o, g in kept if ((g ^ h) & (2**64 - 1)).bit_count() <= 7]
        want.append(min(like) if like else len(want))
        if not like:
            kept.append((len(want) - 1, h))
    df = spark.createDataFrame([("v", i, h) for i, h in enumerate(hashes)], "v string, i int, h long")
    out = {r.i: r.kept_at for r in alignment.unlike_frames(df, "v", "i", "h").collect()}
    assert [out[i] for i in range(len(hashes))] == want


def test_streams_equal_batch(spark, tmp_path):
    from folioworks.streaming import streams

    rows = [("u", i * 0.7, (i * 37 % 100) / 100) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, at double, corr double")
    for i in range(3):
        df.where(f"at >= {i * 14} and at < {i * 14 + 14}").coalesce(1).write.parquet(str(tmp_path / "in" / f"part{i}"))
    src = tmp_path / "flat"
    src.mkdir()
    for i in range(3):
        for f in (tmp_path / "in" / f"part{i}").glob("*.parquet"):
            os.rename(f, src / f"{i}.parquet")
            os.utime(src / f"{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    stream = streams.stream_folder(spark, str(src), df.schema, per_trigger=1)
    q = streams.stream_cuts(stream, "key", "at", "corr").writeStream.format("memory").queryName("cuts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((round(r.start_at, 6), round(r.end_at, 6)) for r in spark.table("cuts").collect())
    s = df.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "corr"))).alias("s"))
    want = sorted((round(r.start_at, 6), round(r.end_at, 6)) for r in s.select(F.inline(alignment.cut_fold(F.col("s")))).collect())
    assert got == want and got
    q = streams.each_batch(streams.stream_folder(spark, str(src), df.schema), lambda b: b.where("corr < 0.5"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == df.where("corr < 0.5").count()


def test_spans_of_any_length_meet(spark):
    """Spans up to a corrupt end far away are paired with all they touch, against brute force."""
    import random

    rng = random.Random(5)
    span = lambda: (s := rng.randrange(-2000, 9000), s + rng.choice([0, 5, 80, 700, 9_000, 10**6]))
    left = [("v", *span(), i) for i in range(60)] + [("v", 0, 8 * 10**15, 60), ("v", None, 5, 61), ("v", 9, 3, 62), (None, 1, 2, 63)]
    right = [("v", *span(), i) for i in range(60)] + [("v", -(10**15), 10**15, 60)]
    names = lambda s: f"v string, {s}_start long, {s}_end long, {s}i long"
    got = [(r.li, r.ri) for r in alignment.overlapping_pairs(spark.createDataFrame(left, names("l")), spark.createDataFrame(right, names("r")), "v", 100).collect()]
    want = [(a[3], b[3]) for a in left for b in right if a[0] == b[0] and None not in a[1:3] and a[1] <= a[2] and b[2] >= a[1] and b[1] <= a[2]]
    assert sorted(got) == sorted(want)


def test_cut_intervals_are_those_of_the_fold(spark):
    import random

    rng = random.Random(6)
    rows = [(k, round(rng.random() * 40, 3), rng.random(), "clash") for k in ("a", "b", None, "c") for _ in range(rng.choice([1, 50, 200]))] + [("d", None, 0.1, ""), ("e", 3.0, None, "")]
    df = spark.createDataFrame(rows, "k string, t double, c double, start_at string")
    got = sorted(tuple(r) for r in alignment.cut_intervals(df, "k", "t", "c").collect())
    want = []
    for k in ("a", "b", "c"):
        last, own = 0.0, sorted((r[1], r[2]) for r in rows if r[0] == k)
        for t, c in own:
            if c < 0.65 and t - last >= 1.5:
                want.append((k, last, t))
                last = t
        if own[-1][0] > last:
            want.append((k, last, own[-1][0]))
    assert got == sorted(want)
    assert alignment.cut_intervals(df.limit(0), "k", "t", "c").count() == 0


def test_kept_frames_against_brute_force(spark):
    import random

    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(6)]
    flip = lambda h, n: h ^ sum(1 << b for b in rng.sample(range(64), n))
    rows = [(v, i, (h := flip(rng.choice(base), rng.randrange(0, 14))) - (1 << 64 if h >> 63 else 0)) for v in ("x", "y", None) for i in range(120)]
    df = spark.createDataFrame(rows, "v string, i long, h long")
    for d in (0, 3, 7, 8, 22):
        got = {(r.v, r.i): (r.kept, r.kept_at) for r in alignment.unlike_frames(df, "v", "i", "h", max_distance=d).collect()}
        want, kept = {}, {}
        for v, i, h in rows:
            like = [j for j, g in kept.setdefault(v, []) if ((g ^ h) & (2**64 - 1)).bit_count() <= d]
            want[v, i] = (not like, like[0] if like else i)
            if not like:
                kept[v].append((i, h))
        assert got == want, d


def test_sign_hash_reads_whole_vectors(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, [1.0] * 64 + [-5.0]), (3, [-1.0, 2.0]), (4, []), (5, None)], "i int, v array<float>")
    got = {r.i: r.h for r in df.select("i", alignment.sign_hash(F.col("v")).alias("h")).collect()}
    assert got == {1: -1, 2: -2, 3: 2, 4: None, 5: None}


def test_jobs_run_again_leave_one_state(spark, tmp_path):
    jobs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "job int, text string")
    out = str(tmp_path / "out")

    def work(bad):
        return lambda df: df.where("job <> 3").select("job", F.upper("text").alias("artifact"), F.when(F.col("job") == bad, "broken").alias("error"))

    def states():
        return {r.job: r.state for r in spark.read.parquet(f"{out}/state").collect()}

    sinks.finish_jobs(jobs, work(2), out, "job")
    assert states() == {1: "done", 2: "failed", 3: "failed"}
    assert {(r.job, r.error) for r in spark.read.parquet(f"{out}/failed").collect()} == {(2, "broken"), (3, "no result")}
    sinks.finish_jobs(jobs.where("job = 2"), work(None), out, "job")  # only that job is replaced
    sinks.finish_jobs(jobs.where("job = 2"), work(None), out, "job")  # and a repeated run changes nothing
    assert states() == {1: "done", 2: "done", 3: "failed"}
    assert {(r.job, r.artifact) for r in spark.read.parquet(f"{out}/done").collect()} == {(1, "A"), (2, "B")}


def test_models_are_asked_in_turn(spark):
    def first(prompts):
        if "poison" in prompts:
            raise RuntimeError("rate limit")
        return ["ok" if p == "b" else p.upper() * 10 if p == "a" else None for p in prompts]

    def second(prompts):
        return [f"second answers {p}" if p not in ("d", "poison") else None for p in prompts]

    models = [("one", first), ("two", second)]
    got = ask_in_turn(models, ["a", "b", "c", "d", "poison", None], 10, any_error)
    assert got == [
        ("A" * 10, "one", None), ("second answers b", "two", None), ("second answers c", "two", None), (None, None, "two: no answer"),
        (None, None, "two: no answer"), ("second answers ", "two", None),
    ]
    # an error that isn't about a missing model ends the search for that prompt only
    assert ask_in_turn(models, ["a", "poison"], 1, model_is_gone) == [("A" * 10, "one", None), (None, None, "one: rate limit")]

    def gone(prompts):
        raise LookupError("404 model not found")

    assert ask_in_turn([("old", gone), *models], ["a"], 1, model_is_gone) == [("A" * 10, "one", None)]
    assert ask_in_turn([("short", lambda p: [])], ["a"], 1, any_error) == [(None, None, "short: 0 answers to 1 prompts")]
    assert [usable_key(k) for k in (None, "", "YOUR_KEY_HERE", "short", " 0123456789 ")] == [False, False, False, False, True]
    df = spark.createDataFrame([("a",), ("d",), (None,)], "p string")
    rows = cascade(df, "p", "o", models, F.lit("made"), least=10).collect()
    assert [tuple(r) for r in rows] == [("a", "A" * 10, "one", None), ("d", "made", "heuristic", "two: no answer"), (None, "second answers ", "two", None)]
    assert [tuple(r) for r in cascade(df.limit(1), "p", "o", [], F.lit("made")).collect()] == [("a", "made", "heuristic", None)]
