import random
import time

import pytest
from pyspark.sql import functions as F

from folioworks.llm.mixing import exact_shares, mix_sources, pfair_slots
from folioworks.llm.packing import FAN_IN, REOPENED, _owed, fill_report, pack_items, pack_window_queue, window_shares
from folioworks.llm.tokens import count_tokens, encoder

DDL = "doc_id long, text string, source string, tokens int, k string, piece int"


def docs(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, "one two three " * rng.randrange(1, 90), rng.choice(["a", "a", "a", "b", None]), 0, "", 0) for i in range(n)]
    rows += [(n, None, "a", 0, "", 0), (n + 1, "", None, 0, "", 0), (n + 2, "word " * 3000, "b", 0, "", 0), (None, "null key", "b", 0, "", 0), (5, rows[5][1], "a", 0, "", 0)]
    return spark.createDataFrame(rows, DDL), rows


def test_counting_in_pieces():
    text = ("Some words, numbers 1234 and signs -- äöü 漢字 \n\n  x" * 30 + " ") * 40
    assert count_tokens(text, chunk=1000) == len(encoder().encode_ordinary(text))
    assert count_tokens(None) == count_tokens("") == 0
    # texts without a safe place to cut, beyond and at the size of a piece
    for long in ("1234567" * 9000, "short\nline\n" * 3000, "QUJDRA==" * 4500, "x" * 20_000, "x" * 20_001, "a b " * 9000, "été " * 9000, " " * 30_000):
        assert count_tokens(long) == len(encoder().encode_ordinary(long)), long[:20]


@pytest.mark.parametrize("shard_tokens", [1 << 24, 8000])
def test_pack(spark, shard_tokens):
    df, rows = docs(spark)
    out = pack_items(df, 512, shard_tokens=shard_tokens)
    got = out.collect()
    fill = {}
    for r in got:
        fill[r.container] = fill.get(r.container, 0) + r.piece_tokens
    assert max(fill.values()) <= 512
    per = {}
    for r in got:
        per.setdefault((r.doc_id, r.source), []).append(r)
    assert len(per) == len({(r[0], r[2]) for r in rows})
    for (d, s), pieces in per.items():
        texts = [r[1] for r in rows if r[0] == d and r[2] == s]
        assert sum(p.piece_tokens for p in pieces) == sum(count_tokens(t) for t in texts)
        if count_tokens(texts[0]) <= 512:
            assert all(p.pieces == 1 for p in pieces)
    total = sum(fill.values())
    assert total / (len(fill) * 512) > 0.95
    assert fill_report(out, 512).first().tokens == total


def test_windows_follow_the_shares():
    rng = random.Random(2)
    items = [(rng.randrange(20, 200), s, i) for i, s in enumerate([0] * 600 + [1] * 300 + [2] * 100)]
    size = {s: sum(x[0] for x in items if x[1] == s) for s in range(3)}
    share = {s: n / sum(size.values()) for s, n in size.items()}
    got, owed = pack_window_queue(items, 1000, share, {})
    assert sorted(i for i, _ in got) == list(range(1000)) and max(map(abs, owed.values())) < 1e-6
    used = {}
    for i, w in got:
        used.setdefault(w, {}).setdefault(items[i][1], []).append(items[i][0])
    done, every = dict.fromkeys(range(3), 0), 0
    for w in sorted(used)[: len(used) * 3 // 4]:
        for s, x in used[w].items():
            done[s] += sum(x)
            every += sum(x)
        assert all(abs(done[s] - share[s] * every) < 1000 for s in range(3)), w
    # what is owed at the start is served first
    first = [items[i][1] for i, w in pack_window_queue(items, 1000, share, {2: 900.0, 0: -900.0})[0] if w == 0]
    assert first.count(2) > first.count(0)
    assert pack_window_queue([], 10, {}, {}) == ([], {})
    assert pack_window_queue([(0, 0, 0), (10, 0, 1), (10, 0, 2)], 10, {0: 1.0}, {})[0].__len__() == 3


def test_many_sources_take_linear_time():
    def seconds(n_sources):
        rng = random.Random(3)
        items = [(rng.randrange(20, 2500), rng.randrange(n_sources), i) for i in range(20_000)]
        began = time.perf_counter()
        got, _ = pack_window_queue(items, 4096, dict.fromkeys(range(n_sources), 1 / n_sources), {})
        took = time.perf_counter() - began
        assert len(got) == 20_000
        assert sum(x[0] for x in items) / (4096 * (1 + max(w for _, w in got))) > 0.995
        return took

    assert seconds(5000) < 20 * seconds(10) + 1


def test_items_that_leave_every_container_open(spark):
    """Items of 0.6 capacity: no container reaches the least fill, yet only a few of each shard are packed again."""
    word = "word " * 300
    df = spark.createDataFrame([(i, word, f"s{i % 7}") for i in range(1200)], "doc_id long, text string, source string")
    n = count_tokens(word)
    out = pack_items(df, n * 10 // 6, shard_tokens=n * 60).collect()
    assert len(out) == 1200 and len({r.container for r in out}) == 1200
    again = [r for r in out if r.container.startswith("1-")]
    shards = {r.container.split("-")[1] for r in out if r.container.startswith("0-")}
    assert 0 < len(again) <= REOPENED * len(shards)
    assert len({r.container.split("-")[1] for r in again}) == -(-20 // FAN_IN)


def test_deficits_are_carried_over_shards(spark):
    """Explicit weights are met over any number of shards as long as sources last."""
    df = spark.createDataFrame([(i, "one two three " * (1 + i % 9), "ab"[i % 2]) for i in range(3000)], "doc_id long, text string, source string")
    out = pack_items(df, 256, shard_tokens=3000, weights={"a": 1.0, "b": 1.0})
    shares = window_shares(out).collect()
    assert {(r.source, r.target_share) for r in shares} == {("a", 0.5), ("b", 0.5)}
    per = {}
    for r in shares:
        per.setdefault(r.container, []).append(r.actual_share)
    assert all(abs(sum(x) - 1) < 1e-9 for x in per.values())
    rng = random.Random(4)
    rows = [(j, rng.choice(["a", "b", None, "c"][: 2 + j % 3]), rng.randrange(9)) for j in range(6) for _ in range(rng.randrange(1, 30))]
    before = [(None, "b", 50), (None, "z", 9)]
    frame = lambda x: spark.createDataFrame(x, "shard long, source string, piece_tokens long")
    everything = sum(r[2] for r in rows + before)
    got = {(r.at_shard, r.of_source): (r.share, r.owed) for r in _owed(frame(rows), None, frame(before)).collect()}
    assert set(got) == {r[:2] for r in rows}
    for (j, s), (share, owed) in got.items():
        earlier = before + [r for r in rows if r[0] < j]
        assert share == pytest.approx(sum(r[2] for r in rows + before if r[1] == s) / everything)
        assert owed == pytest.approx(share * sum(r[2] for r in earlier) - sum(r[2] for r in earlier if r[1] == s))


def test_pack_empty(spark):
    df, _ = docs(spark, 9)
    assert pack_items(df.limit(0), 512).count() == 0
    with pytest.raises(ValueError, match="capacity"):
        pack_items(df, 0)


def test_pfair_windows():
    for counts in ([3, 2, 5], [1, 1, 1], [30, 22, 14, 10, 10, 5, 6, 3], [7, 0, 4]):
        n = sum(counts)
        got = list(pfair_slots(counts, n, 3 * n))
        assert sorted(s for _, _, s in got) == list(range(3 * n))
        done = [0] * len(counts)
        for s, k, slot in sorted(got, key=lambda x: x[2]):
            assert k * n // counts[s] <= slot < -(-(k + 1) * n // counts[s])
            done[s] += 1
            for j, c in enumerate(counts):
                assert abs(done[j] - (slot + 1) * c / n) < 1
    assert exact_shares([0.3, 0.22, 0.48]) == ([15, 11, 24], 50) and exact_shares([1.0, 0.5, 4.0, 2.0]) == ([2, 1, 8, 4], 15)
    assert exact_shares([0.0, None, 0.0]) == ([0, 0, 0], 1) and list(pfair_slots([0, 0], 1, 5)) == []


def test_pfair_keeps_within_a_block_over_a_million_blocks():
    shares, whole = exact_shares([0.123456789, 0.7, 0.2])
    assert whole > 10**8
    done = [0, 0, 0]
    for s, k, slot in pfair_slots(shares, whole, 10**6):
        assert k == done[s]
        done[s] += 1
        assert abs(done[s] * whole - (slot + 1) * shares[s]) < whole
    assert all(abs(d * whole - 10**6 * n) < whole for d, n in zip(done, shares, strict=True))


def test_mix(spark):
    df, rows = docs(spark)
    targets = spark.createDataFrame(
        [("r", "a", 1.0, 1), ("r", "b", 1.0, 3), ("r", "gone", 0.1, 9), ("q", "a", 9.0, 1), ("q", "b", 1.0, 0), ("z", "b", None, None), (None, "a", 1.0, 1), ("r", None, 1.0, 1)],
        "recipe string, source string, weight double, max_repeats int",
    )
    m = mix_sources(df, targets, block_tokens=256, bucket_tokens=2000)
    report = {(r.recipe, r.source): r for r in m.report.collect()}
    assert set(report) == {("r", "a"), ("r", "b"), ("r", "gone"), ("q", "a"), ("q", "b"), ("z", "b")}
    size = {s: sum(count_tokens(r[1]) for r in rows if r[2] == s) for s in ("a", "b", None)}
    total = sum(size.values())
    for (recipe, source), r in report.items():
        quota = r.target_share * total
        if (recipe, source) == ("z", "b"):
            assert r.used_tokens == 0
            continue
        assert r.reached == (r.available_tokens >= quota), (recipe, source)
        if r.reached:
            assert 0 <= r.used_tokens - quota <= 6000
        else:
            assert r.used_tokens == r.available_tokens
    uses = m.selection.where("recipe = 'r' and source = 'b'").collect()
    per = {}
    for u in uses:
        per.setdefault((u.doc_id, u.tokens), []).append(u["pass"])
    assert max(map(len, per.values())) <= 3
    # sorted by slot, each source keeps to its share within a block and a record
    seen = {"a": 0, "b": 0}
    for u in m.selection.where("recipe = 'r' and source in ('a', 'b')").orderBy("slot").collect()[:60]:
        seen[u.source] += u.tokens
        assert abs(seen["a"] - seen["b"]) <= 2 * 256 + 2 * 6000
    selected = {(r.recipe, r.source): r.t for r in m.selection.groupBy("recipe", "source").agg(F.sum("tokens").alias("t")).collect()}
    assert selected == {k: r.used_tokens for k, r in report.items() if r.used_tokens}  # every use has its slot
    empty = mix_sources(df.limit(0), targets)
    assert empty.selection.count() == 0 and empty.report.count() == 6
