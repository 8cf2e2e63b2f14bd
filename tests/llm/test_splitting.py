import random

from hypothesis import given, settings
from hypothesis import strategies as st

from folioworks.llm.splitting import boundaries, cohesion_depths, split_documents, split_spans, token_estimate

DDL = "doc_id long, clean_markdown string, processed_at string, piece int, profile string, k int"
PROFILES = [("small", 50, 5), ("large", 1000, 900), ("none", None, 1), ("zero", 0, 1), ("bare", 20, None)]


def spans(text, limit, overlap):
    at, kind = boundaries(text)
    return split_spans(len(text), text, at, kind, cohesion_depths(text, at), limit, overlap)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n#|-`\r,", max_size=900), st.integers(1, 60), st.integers(0, 80))
def test_every_cut_keeps_its_promises(text, limit, overlap):
    got = spans(text, limit, overlap)
    share = 4 * min(overlap, limit // 2)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(token_estimate(b - a) <= limit for a, b in got)
    assert all(b - a2 == share for (_, b), (a2, _) in zip(got, got[1:], strict=False))
    assert all(b2 > b for (_, b), (_, b2) in zip(got, got[1:], strict=False))
    assert (len(got) > 1) == (token_estimate(len(text)) > limit)


def test_cuts_lie_at_topic_changes():
    rng = random.Random(0)
    topics = ["harbor tide vessel anchor mooring pilot".split(), "orchard apple blossom graft pruning cider".split()]
    para = lambda t: " ".join(rng.choice(topics[t]) for _ in range(40)) + "."
    text = "\n\n".join(para(0) for _ in range(8)) + "\n\n" + "\n\n".join(para(1) for _ in range(8))
    change = len("\n\n".join(text.split("\n\n")[:8])) + 2
    at, _ = boundaries(text)
    depth = cohesion_depths(text, at)
    assert at[depth.argmax()] == change
    assert change in [b for _, b in spans(text, round(change / 4 * 1.3), 10)]


def test_code_and_tables_stay_whole_where_they_fit():
    code = "```\n" + "x = 1\n\n" * 20 + "```\n"
    table = "| a | b |\n" * 20
    text = ("word " * 60 + "\n\n") + code + "\n" + table + "\n" + "word " * 60
    for _, b in spans(text, 100, 0)[:-1]:
        for block in (code, table):
            s = text.index(block)
            assert not s < b < s + len(block.rstrip())


def test_rows(spark):
    long = "line of words here. " * 2_000
    rows = [(1, "a" * 500, "1", 1, "p", 1), (1, "a" * 500, "2", 1, "p", 1), (2, None, "1", 1, "p", 1), (3, "", "1", 1, "p", 1), (None, "x", "1", 1, "p", 1), (4, long, None, 1, "p", 1)]
    profiles = spark.createDataFrame(PROFILES, "profile string, max_tokens int, overlap_tokens int")
    got = split_documents(spark.createDataFrame(rows, DDL), profiles).collect()
    assert {r.profile for r in got} == {"small", "large", "bare"}
    by = {}
    for r in sorted(got, key=lambda r: r.piece):
        by.setdefault((r.profile, r.doc_id), []).append(r)
    assert {d for _, d in by} == {1, 3, 4, None}
    for (p, d), pieces in by.items():
        text = {1: "a" * 500, 3: "", 4: long, None: "x"}[d]
        back = ""
        for r in pieces:
            assert r.text == text[r.begin : r.end] and r.pieces == len(pieces) and r.tokens == token_estimate(len(r.text))
            back = back[: r.begin] + r.text
        assert back == text, (p, d)
    empty = spark.createDataFrame([], DDL)
    assert split_documents(empty, profiles).count() == 0


def test_very_long_lines_are_fast():
    for text in ("a" * 2_000_000, "word foo. " * 100_000, "\n" * 1_000_000):
        got = spans(text, 400, 40)
        assert got[-1][1] == len(text)


def test_versions_are_ordered_by_what_they_are(spark):
    profiles = spark.createDataFrame(PROFILES, "profile string, max_tokens int, overlap_tokens int").where("profile = 'large'")
    for versions in (["9", "10"], ["2026-01-09T23:00:00Z", "2026-01-10T01:00:00Z"], [None, "a"], ["a", "b"], ["9.5", "10.25"], ["junk", "3"]):
        df = spark.createDataFrame([(1, "old", versions[0], 1, "p", 1), (1, "newer", versions[1], 1, "p", 1)], DDL)
        for with_text in (True, False):
            assert [r.end for r in split_documents(df, profiles, with_text=with_text).collect()] == [5], versions
    numbers = spark.createDataFrame([(1, "old", 9), (1, "newer", 10)], "doc_id long, clean_markdown string, processed_at int")
    assert [r.text for r in split_documents(numbers, profiles).collect()] == ["newer"]


def test_depths_against_brute_force():
    """The cosines are those of the words themselves, however many different ones there are."""
    from collections import Counter

    rng = random.Random(8)
    text = "\n\n".join(" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, 90))) for _ in range(700))
    at, _ = boundaries(text)
    words = [text[a:b].split() for a, b in zip([0, *at], [*at, len(text)], strict=True)]
    flat, mid = [w for x in words for w in x], []
    for x in words[:-1]:
        mid.append((mid[-1] if mid else 0) + len(x))
    cosines = []
    for m in mid:
        a, b = Counter(flat[max(0, m - 60) : m]), Counter(flat[m : m + 60])
        norm = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
        cosines.append(sum(a[w] * b[w] for w in a) / norm)
    want = []
    for i, s in enumerate(cosines):
        lo = hi = s
        for j in range(i - 1, -1, -1):
            if cosines[j] < lo:
                break
            lo = cosines[j]
        for j in range(i + 1, len(cosines)):
            if cosines[j] < hi:
                break
            hi = cosines[j]
        want.append(lo + hi - 2 * s)
    got = cohesion_depths(text, at)
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-5
