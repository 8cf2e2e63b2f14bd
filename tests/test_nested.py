import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioworks.operators.nested import GROUNDING_SHAPE, Level, bridge, find_record, flat_table, list_paths, object_store, occurrences, walk

DDL = "context_id long, minto_pyramid string, threat_metadata string, downstream_directives string, positions string"
FIELDS = Level(GROUNDING_SHAPE["threat_metadata"], "threat_metadata")


def frame(spark, *rows):
    return spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], DDL)


def elements(spark, *rows):
    return sorted((r.context_id, r.array_path, r.positions) for r in occurrences(frame(spark, *rows)).collect() if r.child_id and r.kind == "element")


THREAT = {"iocs": [{"kind": "ip", "sightings": [{"sensor": "a"}, None, {"sensor": "b"}]}, None, {"kind": "ip"}], "cve_ids": ["CVE-1"]}
WANT = [
    ("threat_metadata.cve_ids", "0"), ("threat_metadata.iocs", "0"), ("threat_metadata.iocs", "2"),
    ("threat_metadata.iocs.sightings", "0.0"), ("threat_metadata.iocs.sightings", "0.2"),
]


def test_shapes_of_one_record(spark):
    plain = json.dumps(THREAT)
    nested = plain
    for _ in range(12):  # JSON text in JSON text, deeper than any fixed number of openings
        nested = json.dumps(nested)
        if len(nested) > 200_000:
            break
    forms = [
        plain, f"```json\n{plain}\n```", "Here you are:\n" + plain + "\nbye", json.dumps(plain), json.dumps([THREAT]), plain.replace("cve_ids", "cveIds"),
        plain.replace('["CVE-1"]', '"CVE-1"'), json.dumps(THREAT | {"iocs": {str(i): x for i, x in enumerate(THREAT["iocs"])}}),
        json.dumps(THREAT | {"iocs": json.dumps(THREAT["iocs"])}), json.dumps(THREAT | {"extra": [1, 2]}), nested, "{" * 10_001 + plain + "}" * 3,
        '{"a": {"b": 1}, oops} ' * 12_000 + plain + " end", '{"x": ' + plain + ", oops} after",
    ]
    got = elements(spark, *[(None, f, None) for f in forms])
    for i in range(len(forms)):
        assert [(p, q) for c, p, q in got if c == i] == WANT, forms[i][:80]


def test_no_record(spark):
    plain = json.dumps(THREAT)
    assert elements(spark, (None, None, None), ("", "null", "no json"), (None, plain[:60], None), (None, "```json\n" + plain[:-5], "[]"), ("3", '"x"', "{")) == []
    assert elements(spark) == []
    assert find_record("[" * 200_000, FIELDS) is None
    cut = json.dumps({"severity": "LOW", "affected_systems": json.dumps([{"name": "x", "severity": "y"}]), "iocs": []})[:-4]
    assert find_record(cut, FIELDS) is None  # what a broken record holds as text is no record either
    assert find_record("so: " + json.dumps(json.dumps(THREAT)) + ".", FIELDS) == THREAT


def test_every_parent_is_stored_and_records_without_lists_have_rows(spark):
    pyramid = {"situation": {"summary": "s"}, "solution": {"summary": "t", "steps": [{"step": "1", "subtasks": [{"task": "x"}]}]}}
    threat = THREAT | {"severity": "LOW", "threat_actor": {"name": "n", "aliases": ["a", "b"]}}
    rows = occurrences(frame(spark, (json.dumps(pyramid), json.dumps(threat), None), (None, '{"severity": "HIGH"}', "{}"))).collect()
    stored = {r.child_id for r in rows if r.child_id}
    assert {r.parent_id for r in rows if r.kind != "record"} <= stored and all(r.parent_id is None for r in rows if r.kind == "record")
    own = {(r.context_id, r.kind, r.array_path): r.fields for r in rows if r.kind != "element"}
    assert own[0, "object", "minto_pyramid.situation"] == '{"summary":"s"}' and own[0, "object", "threat_metadata.threat_actor"] == '{"name":"n"}'
    assert own[0, "record", "threat_metadata"] == '{"severity":"LOW"}' and own[1, "record", "threat_metadata"] == '{"severity":"HIGH"}'
    assert own[1, "record", "downstream_directives"] == "{}" and (1, "record", "minto_pyramid") not in own


def test_identical_objects_are_stored_once(spark):
    df = spark.createDataFrame([(i, None, json.dumps(THREAT), None, "") for i in range(5)], DDL)
    rows = occurrences(df).cache()
    store = object_store(rows)
    assert store.count() == 6 and {r.uses for r in store.collect()} == {5}
    assert bridge(rows).count() == 5 * 8  # null elements keep their place
    t = flat_table(rows, "threat_metadata.iocs.sightings", ["sensor"]).collect()
    assert {(r.context_id, r.positions, r.parent_positions, r.sensor) for r in t} == {(i, p, "0", s) for i in range(5) for p, s in (("0.0", "a"), ("0.2", "b"))}
    parents = {r.child_id for r in rows.where("array_path = 'threat_metadata.iocs'").collect()}
    assert {r.parent_id for r in t} <= parents
    joined = bridge(rows).join(store, ["child_id", "array_path"]).where("array_path = 'threat_metadata.iocs.sightings'").collect()
    assert sorted((r.context_id, r.positions, json.loads(r.fields)["sensor"]) for r in joined) == sorted((r.context_id, r.positions, r.sensor) for r in t)
    assert {r.value for r in flat_table(rows, "threat_metadata.cve_ids", ["value"]).collect()} == {"CVE-1"}
    assert len(list_paths()) == 21 and list_paths()["threat_metadata.affected_systems.hosts"] == ["host"]


def test_identity_follows_the_subtree():
    def ident(x):
        return walk(x, FIELDS, "", [])[0]

    a = {"severity": "LOW", "iocs": [{"kind": "ip", "sightings": [{"sensor": "a"}]}]}
    b = {"iocs": [{"sightings": [{"sensor": "a"}], "kind": "ip"}], "severity": "LOW"}
    assert ident(a) == ident(b)
    b["iocs"][0]["sightings"][0]["sensor"] = "z"
    assert ident(a) != ident(b)


def test_two_spellings_of_a_list_go_on():
    rows = []
    walk({"cve_ids": ["a"], "CVE-IDs": ["b", "c"]}, FIELDS, "", rows)
    assert [(r[3], r[7]) for r in rows] == [("0", '{"value":"a"}'), ("1", '{"value":"b"}'), ("2", '{"value":"c"}')]


@pytest.mark.parametrize("tail", ["", "}", " oops"])
def test_broken_braces_take_linear_time(tail):
    assert find_record('{"a": ' * 900 + "1, " + tail + "!" * 400_000, FIELDS) is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.fixed_dictionaries({}, optional={"kind": st.text(), "sightings": st.lists(st.one_of(st.none(), st.just({"sensor": "s"})), max_size=4)})), max_size=5))
def test_against_brute_force(iocs):
    want = set()
    for i, x in enumerate(iocs):
        if x is None:
            continue
        want.add(("threat_metadata.iocs", str(i)))
        want |= {("threat_metadata.iocs.sightings", f"{i}.{j}") for j, y in enumerate(x.get("sightings", [])) if y is not None}
    record = find_record("note " + json.dumps({"iocs": iocs}) + " end", FIELDS)
    rows = []
    walk(record, FIELDS, "", rows)
    assert {(r[1], r[3]) for r in rows if r[6]} == want
