"""Deeply nested records into related flat tables (problem 3)."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The shape of the nested fields. A dict is an object, a list of one dict a list of
#: objects, [] a list of plain values, None a plain value.
GROUNDING_SHAPE: dict = {
    "minto_pyramid": {
        "situation": {"summary": None},
        "complication": {"summary": None, "evidence": [{"ref": None, "quote": None, "scores": []}]},
        "solution": {
            "summary": None,
            "steps": [{"step": None, "owner": None, "subtasks": [{"task": None, "due": None}]}],
        },
        "business_impact_and_risk": {"risks": [{"risk": None, "level": None}]},
    },
    "threat_metadata": {
        "severity": None,
        "cve_ids": [],
        "threat_actor": {"name": None, "aliases": []},
        "affected_systems": [{"name": None, "versions": [], "hosts": [{"host": None, "ports": []}]}],
        "iocs": [{"kind": None, "value": None, "sightings": [{"seen_at": None, "sensor": None}]}],
    },
    "downstream_directives": {
        "advisory_bullet_points": [{"text": None, "audience": []}],
        "executive_takeaways": [{"text": None, "metrics": [{"name": None, "value": None}]}],
        "social_dissemination_hooks": [],
        "visual_scene_ideas": [{"idea": None, "shots": [{"frame": None, "props": []}]}],
    },
}

_DECODER = json.JSONDecoder(strict=False)
_ENCODE = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode
_QUOTE = json.encoder.encode_basestring
_NOT_WORD = re.compile(r"[\W_]+")
_INDEX = re.compile(r"\d{1,9}\Z")
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.S)


def _plain(name: str) -> str:
    """A field name in one spelling: no case, no separators."""
    return _NOT_WORD.sub("", name).lower()


class Level:
    """The fields of one level of a shape, found by any spelling."""

    def __init__(self, shape: dict, path: str = ""):
        self.path = path
        self.fields: dict[str, tuple[str, str, Level | None]] = {}
        for name, sub in shape.items():
            at = f"{path}.{name}" if path else name
            if sub is None:
                self.fields[_plain(name)] = (name, "value", None)
            elif isinstance(sub, dict):
                self.fields[_plain(name)] = (name, "object", Level(sub, at))
            else:
                self.fields[_plain(name)] = (name, "list", Level(sub[0], at) if sub else None)
        self._spelled: dict[str, tuple | None] = {}

    def get(self, name: str) -> tuple[str, str, Level | None] | None:
        """(proper name, kind, level below) of a field, or null for one outside the shape."""
        try:
            return self._spelled[name]
        except KeyError:
            if len(self._spelled) > 10_000:  # spellings seen before are only looked up faster
                self._spelled.clear()
            known = self._spelled[name] = self.fields.get(_plain(name))
            return known

    def known(self, record: dict) -> int:
        return sum(self.get(k) is not None for k in record)


def _objects(text: str) -> tuple[list[tuple[dict, int]], bool]:
    """The complete JSON objects in ``text`` that stand in no other, each with its length, in one pass; and whether the text breaks off in one.

    An object that breaks off in the middle isn't one, but complete objects within it are. One that runs
    to the end of the text is cut off, and what it holds doesn't count.
    """
    out: list[tuple[dict, int]] = []
    i = text.find("{")
    end_of_text = len(text.rstrip()) - 1
    while i >= 0:
        try:
            value, end = _DECODER.raw_decode(text, i)
            out.append((value, end - i))
        except ValueError as error:
            end = max(getattr(error, "pos", i), i + 1)
            if end >= end_of_text or "Unterminated" in str(error):
                return out, True
            # up to the mistake the text is JSON, so its braces pair; the outermost pairs are objects
            opened: list[int] = []
            spans: list[tuple[int, int]] = []
            for m in _TOKEN.finditer(text, i, end):
                if m[0] == "{":
                    opened.append(m.start())
                elif m[0] == "}" and opened:
                    begin = opened.pop()
                    while spans and spans[-1][0] > begin:
                        spans.pop()
                    spans.append((begin, m.end()))
            for begin, stop in spans:
                try:
                    out.append((_DECODER.raw_decode(text, begin)[0], stop - begin))
                except ValueError:
                    continue
        i = text.find("{", end)
    return out, False


def find_record(text: str | None, level: Level) -> dict | None:
    """The complete JSON object in ``text``, whatever surrounds it; null if there is none.

    Text that is itself a JSON string, or a list, is opened, however often. Where several complete objects
    stand in the text, the one with most fields of the shape is taken, of equals the longest, then the
    first. JSON nested deeper than Python's parser reaches (thousands of levels) counts as broken.
    """
    try:
        return _find(text, level)
    except RecursionError:
        return None


def _find(text: str | None, level: Level) -> dict | None:
    while text:
        try:
            value = json.loads(text, strict=False)
        except ValueError:
            break
        if isinstance(value, dict):
            return value
        if isinstance(value, list):
            return max((x for x in value if isinstance(x, dict)), key=level.known, default=None)
        if not isinstance(value, str):
            return None
        text = value  # shorter than before, so this ends
    if not text:
        return None
    best, best_score = None, (0, -1)
    objects, broken_off = _objects(text)
    for value, size in objects:
        score = (level.known(value), size)
        if score > best_score:
            best, best_score = value, score
    if best is None and not broken_off and '\\"' in text:
        # a record inside a JSON string inside other text
        j = text.find('"')
        while j >= 0:
            try:
                value, end = _DECODER.raw_decode(text, j)
            except ValueError as error:
                if "Unterminated" in str(error):
                    break
                j = text.find('"', j + 1)
                continue
            if isinstance(value, str) and "{" in value:
                return _find(value, level)
            j = text.find('"', end)
    return best if best_score[0] > 0 else None


def _opened(value):
    """``value``, or what it holds when it is JSON text of a list or an object."""
    while isinstance(value, str):
        s = value.strip()
        if not s or s[0] not in "[{\"" or s[-1] not in "]}\"":
            break
        try:
            inner = json.loads(s, strict=False)
        except (ValueError, RecursionError):
            break
        if not isinstance(inner, list | dict | str):
            break
        value = inner
    return value


def as_list(value) -> list:
    """What stands where the shape has a list, as that list."""
    if isinstance(value, str):
        value = _opened(value)
    if value is None:
        return []
    if isinstance(value, list):
        return value
    if isinstance(value, dict) and value and all(map(_INDEX.match, value)):
        at = {int(k): v for k, v in value.items()}
        if sorted(at) in ([*range(len(at))], [*range(1, len(at) + 1)]):
            return [at[k] for k in sorted(at)]
    return [value]


def _text(value) -> str:
    """Canonical JSON of a plain value."""
    return _QUOTE(value) if type(value) is str else _ENCODE(value)


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


#: Columns of an occurrence; the key comes before them.
_COLUMNS = {
    "kind": "string", "array_path": "string", "ordinal": "int", "positions": "string", "parent_positions": "string",
    "parent_id": "string", "child_id": "string", "fields": "string",
}
_KIND, _PATH, _ORDINAL, _POSITIONS, _UP, _PARENT, _CHILD, _FIELDS = range(8)


def walk(value, level: Level, positions: str, rows: list[list]) -> tuple[str, str]:
    """Hashes ``value`` bottom-up; appends a row (in the order of ``_COLUMNS``) for each object and list element below it.

    The id of an object is the hash of its own fields and of its children's ids; equal subtrees have equal
    ids. Returns the id and the own fields as canonical JSON.
    """
    if isinstance(value, str):
        value = _opened(value)
    if isinstance(value, list):  # an object wrapped in a list of one
        value = next((x for x in value if x is not None), None)
    own: dict[str, str] = {}
    links: dict[str, list[str]] = {}
    mine: list[list] = []
    if isinstance(value, dict):
        for key, sub in value.items():
            known = level.get(key)
            if known is None:
                continue
            name, kind, below = known
            if kind == "value":
                own[name] = _text(sub)
            elif kind == "object":
                if sub is None:
                    continue
                ident, text = walk(sub, below, positions, rows)
                links.setdefault(name, []).append(ident)
                mine.append(["object", below.path, None, positions, positions, None, ident, text])
            else:
                at = f"{level.path}.{name}"
                ids = links.setdefault(name, [])
                first = len(ids)  # a second spelling of the list goes on where the first ended
                for k, x in enumerate(as_list(sub), first):
                    if x is None:
                        ids.append("")
                        mine.append(["element", at, k, None, positions, None, None, None])
                        continue
                    here = f"{positions}.{k}" if positions else str(k)
                    if below is None:
                        text = '{"value":' + _text(x) + "}"
                        ident = _digest(f"{at}\0{text}")
                    else:
                        ident, text = walk(x, below, here, rows)
                    ids.append(ident)
                    mine.append(["element", at, k, here, positions, None, ident, text])
    elif value is not None:
        own["value"] = _text(value)
    text = "{" + ",".join([f'"{n}":{own[n]}' for n in sorted(own)]) + "}"
    ident = _digest(f"{level.path}\0{text}\0" + "\0".join([f"{n}:{','.join(links[n])}" for n in sorted(links)]))
    for row in mine:
        row[_PARENT] = ident
    rows += mine
    return ident, text


def occurrences(df: DataFrame, key: str = "context_id", shape: dict | None = None, columns: tuple[str, ...] = tuple(_COLUMNS)) -> DataFrame:
    """Every record, object and list element of the nested columns of ``df``, with its place and its parent's.

    Returns ``(<key>, kind, array_path, ordinal, positions, parent_positions, parent_id, child_id, fields)``,
    or the key and those of ``columns``. ``kind`` is ``record`` for a whole field value, ``object`` for an
    object that stands in no list and ``element`` for an element of a list. ``array_path`` names the list
    or object, ``positions`` the 0-based places of the element and of the elements around it; ``child_id``
    and ``parent_id`` are Merkle identities of the row itself and of what is around it (null for a
    record); ``fields`` holds the row's own fields as canonical JSON, of a plain value ``{"value": ...}``.
    So every ``parent_id`` is the ``child_id`` of a row. The columns of the shape hold JSON text. Parsing
    runs in Arrow batches, without a shuffle.

    Defined cases: null, empty, broken or truncated text gives no rows; a record without lists has its own
    row; null elements keep their place and appear as a row with null ``child_id`` and ``positions``; a
    single value is a list of one, objects with the keys 0..n-1 are lists, JSON text inside a field is
    opened; unknown fields don't count; of two spellings of a list in one object the second goes on where
    the first ends, of two spellings of a plain field the last counts; repeated input rows give repeated
    output rows; extra columns are ignored.
    """
    shape = shape or GROUNDING_SHAPE
    levels = {c: Level(s, c) for c, s in shape.items()}
    types = dict(df.select(key).dtypes)
    places = [list(_COLUMNS).index(c) for c in columns]
    arrow = [pa.int32() if c == "ordinal" else pa.string() for c in columns]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take: list[int] = []
            rows: list[list] = []
            for c, level in levels.items():
                for i, text in enumerate(batch.column(c).to_pylist()):
                    record = find_record(text, level)
                    if record is None:
                        continue
                    before = len(rows)
                    ident, own = walk(record, level, "", rows)
                    rows.append(["record", c, None, None, None, None, ident, own])
                    take.extend([i] * (len(rows) - before))
            if not take:
                continue
            keys = batch.column(key).take(pa.array(take, pa.int64()))
            arrays = [pa.array([r[p] for r in rows], t) for p, t in zip(places, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([keys, *arrays], names=[key, *columns])

    return df.select(key, *levels).mapInArrow(parse, ", ".join([f"`{key}` {types[key]}", *(f"{c} {_COLUMNS[c]}" for c in columns)]))


def object_store(rows: DataFrame) -> DataFrame:
    """Identical objects once: ``(child_id, array_path, fields, uses)`` of the rows of ``occurrences``.

    Counts are combined before the shuffle, so an object that stands in a third of all records costs one
    row per task.
    """
    return rows.where("child_id is not null").groupBy("child_id", "array_path", "fields").agg(F.count(F.lit(1)).alias("uses"))


def bridge(rows: DataFrame, key: str = "context_id") -> DataFrame:
    """Parent-child links of every occurrence; a record links to nothing above it."""
    return rows.select(key, "kind", "array_path", "ordinal", "positions", "parent_positions", "parent_id", "child_id")


def list_paths(shape: dict | None = None, path: str = "") -> dict[str, list[str]]:
    """The lists of a shape by path, each with the plain fields of its elements (``value`` for plain ones)."""
    out: dict[str, list[str]] = {}
    for name, sub in (shape or GROUNDING_SHAPE).items():
        at = f"{path}.{name}" if path else name
        if isinstance(sub, list):
            out[at] = [n for n, x in sub[0].items() if x is None] if sub else ["value"]
            sub = sub[0] if sub else None
        if isinstance(sub, dict):
            out |= list_paths(sub, at)
    return out


def flat_table(rows: DataFrame, array_path: str, fields: list[str], key: str = "context_id") -> DataFrame:
    """The flat table of one list: ``(<key>, ordinal, positions, parent_positions, parent_id, child_id, *fields)``.

    Fields are text, as written in the record (lists and objects as JSON). Made of the rows of
    ``occurrences`` without a join, so an object that stands everywhere is no hot key; joining ``bridge``
    with ``object_store`` on ``child_id`` gives the same rows.
    """
    own = F.from_json("fields", ", ".join(f"`{f}` string" for f in fields))
    named = rows.where((F.col("array_path") == array_path) & F.col("child_id").isNotNull() & (F.col("kind") == "element")).withColumn("f", own)
    return named.select(key, "ordinal", "positions", "parent_positions", "parent_id", "child_id", *[F.col("f")[f].alias(f) for f in fields])
