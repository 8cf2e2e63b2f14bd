import random

from pyspark.sql import Row

from folioworks.operators.intervals import coverage
from folioworks.operators.prefix import bucket_of, carry_forward

DDL = "video_id string, start_seconds double, end_seconds double, kind string, k string, s long"


def brute(rows, off_air=21_600_000):
    out = set()
    by = {}
    for v, a, b in rows:
        if a is None or b is None or a != a or b != b or abs(a) == float("inf") or abs(b) == float("inf"):
            continue
        a, b = round(a * 1000), round(b * 1000)
        if b > a:
            by.setdefault(v, []).append((a, b))
    for v, spans in by.items():
        spans.sort()
        s, e = spans[0]
        for a, b in spans[1:]:
            if a <= e:
                e = max(e, b)
            else:
                out.add((v, "period", s, e))
                if a - e < off_air:
                    out.add((v, "gap", e, a))
                s, e = a, b
        out.add((v, "period", s, e))
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(v, a, b, "x", "y", 1) for v, a, b in rows], DDL)
    got = [tuple(r) for r in coverage(df, "video_id", **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for v in ("a", "b", None):
        for _ in range(300):
            s = rng.randrange(0, 200_000) / 10
            rows.append((v, s, s + rng.choice([0, 0.001, 1, 7.5, 40, 4000, -3])))
    rows += rows[:50] + [("a", None, 3.0), ("a", 1.0, None), ("a", float("nan"), 2.0), ("a", 1.0, float("inf")), ("c", 5.0, 5.0)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, bucket_ms=60_000) == brute(rows)


def test_touching_off_air_and_negative(spark):
    rows = [("v", -2.0, -1.0), ("v", -1.0, 0.0), ("v", 21_600.0, 21_601.0), ("v", 21_601.001, 21_602.0), ("v", 0.0, 0.0)]
    got = run(spark, rows)
    assert ("v", "period", -2000, 0) in got
    assert ("v", "gap", 21_601_000, 21_601_001) in got
    assert not any(k == "gap" and s == 0 for _, k, s, _ in got)  # six hours is off the air


def test_empty(spark):
    assert run(spark, []) == set()


def test_one_span_over_everything(spark):
    rows = [("v", 0.0, 1_000_000.0)] + [("v", float(i * 3601), float(i * 3601 + 1)) for i in range(100)]
    assert run(spark, rows) == {("v", "period", 0, 1_000_000_000)}


def test_carry_forward(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([Row(k=k, x=x) for k in ("a", None) for x in range(-5, 20)]).withColumn("b", bucket_of(F.col("x"), 4))
    out = carry_forward(df, ["k"], "b", {"m": F.max("x")}, {"before": F.max("m")})
    for r in out.collect():
        want = max((x for x in range(-5, 20) if x // 4 < r.x // 4), default=None)
        assert r.before == want


def test_spans_of_any_size(spark):
    """Whatever milliseconds a bigint holds counts, at and beyond 9e15 and over the whole range."""
    rows = [("a", 0.0, 8.9e12), ("b", 0.0, 9.1e12), ("c", 9.0e12, 9.1e15), ("d", -9.1e15, -9.0e15), ("d", 9.0e15, 9.1e15), ("e", 0.0, 1e30)]
    got = {(r.video_id, r.kind, r.start_ms, r.end_ms) for r in coverage(spark.createDataFrame(rows, "video_id string, start_seconds double, end_seconds double"), "video_id").collect()}
    assert got == {(k, "period", int(round(a * 1000)), int(round(b * 1000))) for k, a, b in rows[:-1]}
