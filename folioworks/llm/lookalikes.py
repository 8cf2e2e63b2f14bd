"""One consistent form for text that looks the same (problem 8)."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm.confusables import letter_shapes
from folioworks.session import checkpoint

#: Cyrillic and Greek letters with exactly the shape of a Latin letter, written as pairs of
#: strings of equal length. They hold without the confusables data and before it, and the way back to
#: Cyrillic goes by them.
CYRILLIC = "АВЕКМНОРСТХУЅІЈԌԚԜҮаеорсухѕіјһԛԝԁүҽӏ", "ABEKMHOPCTXYSIJGQWYaeopcyxsijhqwdyel"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳοϲ", "ABEZHIKMNOPTYXCjoc"
#: Symbols with the shape of a letter that Unicode does not map to it canonically.
SYMBOLS = "‐‑", "--"
#: Format characters that can be seen, so they stay.
VISIBLE_FORMAT = (0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD)
#: Invisible characters that are not of the category Cf.
INVISIBLE = (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0)
_SIZE = 0x110000
_SCRIPT_NONE, _SCRIPT_OTHER, _SCRIPT_CYRILLIC, _SCRIPT_SHARED = 0, 1, 2, 3


def _is_invisible(c: int) -> bool:
    if c in INVISIBLE or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF:
        return True
    return unicodedata.category(chr(c)) == "Cf" and c not in VISIBLE_FORMAT


def _is_space(c: int) -> bool:
    return unicodedata.category(chr(c)) == "Zs" or c == 9


def _spelled(c: int) -> str:
    """The code points that ``c`` stands for before letters are mapped by shape."""
    ch = chr(c)
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    if tag in ("<wide>", "<narrow>"):
        return "".join(chr(int(x, 16)) for x in rest.split())
    if tag == "<compat>":
        whole = "".join(chr(int(x, 16)) for x in rest.split())
        letters = all(unicodedata.category(x)[0] == "L" for x in whole)
        # ligatures, digraph letters, Roman numerals and the micro sign; spaced accents and the like look different
        if letters and (len(whole) > 1 or 0x2160 <= c <= 0x217F or c == 0xB5):
            return whole
    return ch


@functools.cache
def tables(shapes: tuple[tuple[int, int], ...] = ()) -> dict[str, np.ndarray]:
    """The lookup tables, built from rules over the Unicode data of this Python and the pairs of equal shape.

    ``to`` maps a code point to the one that stands for it, or, where ``length`` isn't 1, to the start of
    its expansion in ``pool``; ``ccc`` holds the combining classes, ``flag`` bit 1 where an expansion is
    needed and bit 2 where a mark may compose with what stands before it; ``full``/``full_length`` are the
    canonical decompositions in ``pool``; ``pair``/``composed`` the sorted base-mark pairs and what they
    compose to; ``script`` is the script evidence and ``cyrillic`` the way back to a Cyrillic letter.
    """
    shape = dict(shapes) | {ord(a): ord(b) for pair in (CYRILLIC, GREEK, SYMBOLS) for a, b in zip(*pair, strict=True)}
    to = np.arange(_SIZE, dtype=np.int32)
    length = np.ones(_SIZE, np.int8)
    full = np.zeros(_SIZE, np.int32)
    full_length = np.zeros(_SIZE, np.int8)
    ccc = np.zeros(_SIZE, np.uint8)
    flag = np.zeros(_SIZE, np.uint8)
    script = np.zeros(_SIZE, np.uint8)
    pool: list[int] = []
    order: dict[int, int] = {}
    for c in range(_SIZE):
        if 0xD800 <= c <= 0xDFFF or 0xE000 <= c <= 0xF8FF or 0x30000 <= c < 0xE0000 or c >= 0xF0000:
            continue
        ch = chr(c)
        if _is_invisible(c):
            out: tuple[int, ...] = ()
        elif _is_space(c):
            out = (0x20,)
        else:
            apart = unicodedata.normalize("NFD", _spelled(c))
            mapped = "".join(chr(shape.get(ord(x), ord(x))) for x in apart)
            out = tuple(map(ord, unicodedata.normalize("NFC", mapped)))
            if len(mapped) > 1 and len(out) == 1:  # decomposed again where a further mark follows
                full[out[0]], full_length[out[0]] = len(pool), len(mapped)
                pool.extend(map(ord, mapped))
        if len(out) == 1:
            to[c] = out[0]
        else:
            to[c], length[c] = len(pool), len(out)
            flag[c] |= 1
            pool.extend(out)
        ccc[c] = unicodedata.combining(ch)
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", unicodedata.normalize("NFD", ch)) == ch:
            x, y = (int(v, 16) for v in d.split())
            x = to[x] if x < c else shape.get(x, x)
            key = (int(x) << 21) | y
            if key not in order or out[0] < order[key]:
                order[key] = out[0] if len(out) == 1 else c
        if unicodedata.category(ch)[0] in "LM" and c < 0x530:
            script[c] = _SCRIPT_CYRILLIC if 0x400 <= c else _SCRIPT_OTHER
    for lead in range(19):  # Hangul syllables compose by rule
        for vowel in range(21):
            lv = 0xAC00 + (lead * 21 + vowel) * 28
            order[((0x1100 + lead) << 21) | (0x1161 + vowel)] = lv
            for tail in range(1, 28):
                order[(lv << 21) | (0x11A7 + tail)] = lv + tail
    cyrillic = np.arange(_SIZE, dtype=np.int32)
    for a, b in reversed(list(zip(*CYRILLIC, strict=True))):
        if ord(a) in range(0x410, 0x450):
            cyrillic[ord(b)] = ord(a)
            script[ord(b)] = _SCRIPT_SHARED
    keys = np.array(sorted(order), np.int64)
    flag[keys & ((1 << 21) - 1)] |= 2
    flag[ccc > 0] |= 2
    return {
        "to": to, "length": length, "pool": np.array(pool, np.int32), "full": full, "full_length": full_length, "ccc": ccc,
        "flag": flag, "pair": keys, "composed": np.array([order[int(k)] for k in keys], np.int32), "script": script,
        "cyrillic": cyrillic,
    }


def _expand(
    cp: np.ndarray, bounds: np.ndarray, at: np.ndarray, start: np.ndarray, length: np.ndarray, pool: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Replaces the code points at the places ``at`` by their expansions in ``pool``; moves the row bounds."""
    length = length.astype(np.int64)
    counts = np.ones(len(cp), np.int64)
    counts[at] = length
    out = np.repeat(cp, counts)
    moved = np.cumsum(length - 1)
    first = at + moved - (length - 1)
    total = int(length.sum())
    inner = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(first, length) + inner] = pool[np.repeat(start, length) + inner]
    shift = np.concatenate([[0], moved])[np.searchsorted(at, bounds)]
    return out, bounds + shift


def _found(cp: np.ndarray, base: np.ndarray, mark: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of the places of bases and marks those that compose, and what to."""
    key = (cp[base].astype(np.int64) << 21) | cp[mark]
    at = np.searchsorted(t["pair"], key)
    at[at == len(t["pair"])] = 0
    ok = t["pair"][at] == key
    return base[ok], mark[ok], t["composed"][at[ok]]


def _compose(cp: np.ndarray, bounds: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorts marks by their class and composes them with their bases, all rows at once."""

    def places() -> np.ndarray:
        """Where a code point stands that may compose with the one before it in its row."""
        at = np.flatnonzero(t["flag"][cp] & 2)
        at = at[at > 0]
        k = np.searchsorted(bounds, at)
        return at[(k == len(bounds)) | (bounds[np.minimum(k, len(bounds) - 1)] != at)]

    at = places()
    if not len(at):
        return cp, bounds
    # composed letters before a mark are taken apart first, so that the marks' order doesn't matter
    base = np.unique(at[t["ccc"][cp[at]] > 0] - 1)
    base = base[t["full_length"][cp[base]] > 0]
    if len(base):
        cp, bounds = _expand(cp, bounds, base, t["full"][cp[base]], t["full_length"][cp[base]], t["pool"])
        at = places()
    marks = np.flatnonzero(t["flag"][cp] & 2)
    classes = t["ccc"][cp[marks]].astype(np.int64)
    marks, classes = marks[classes > 0], classes[classes > 0]
    near = np.r_[False, marks[1:] == marks[:-1] + 1] & ~np.isin(marks, bounds)
    if (near[1:] & (classes[1:] < classes[:-1])).any():
        cp = cp.copy()
        cp[marks] = cp[marks[np.lexsort((classes, np.cumsum(~near)))]]
    while len(at):
        before = t["ccc"][cp[at - 1]]
        direct = at[before == 0]
        base, mark, new = _found(cp, direct - 1, direct, t)
        if len(base):
            keep = np.r_[True, np.diff(base) > 1]
            base, mark, new = base[keep], mark[keep], new[keep]
        else:
            # a mark may also reach its base over marks of a lower class that don't compose
            far = at[(before > 0) & (t["ccc"][cp[at]] > before)]
            back, ok = far - 1, np.ones(len(far), bool)
            while (go := ok & (t["ccc"][cp[back]] > 0)).any():
                ok &= ~(go & ((back == 0) | np.isin(back, bounds)))
                back = np.where(go & ok, back - 1, back)
                if not (go & ok).any():
                    break
            ok &= t["ccc"][cp[back]] == 0
            base, mark, new = _found(cp, back[ok], far[ok], t)
            if not len(base):
                break
            base, one = np.unique(base, return_index=True)
            mark, new = mark[one], new[one]
        cp = cp.copy()
        cp[base] = new
        cp, bounds = _expand(cp, bounds, mark, np.zeros(len(mark), np.int64), np.zeros(len(mark), np.int64), t["pool"])
        at = places()
    return cp, bounds


def _respell(cp: np.ndarray, bounds: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    """Gives letters of shared shape back to Cyrillic where their surroundings are Cyrillic.

    The choice depends on the mapped text alone, so equal looks stay equal: a word with a letter that
    only Cyrillic has becomes Cyrillic; a word of shared shapes only follows the majority of its row.
    """
    seen = np.flatnonzero((cp >= 0x400) & (cp < 0x530))
    if not len(seen):
        return cp
    rows = np.unique(np.searchsorted(bounds, seen, side="right") - 1)
    lengths = bounds[rows + 1] - bounds[rows]
    inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.repeat(bounds[rows], lengths) + inner
    row = np.repeat(np.arange(len(rows)), lengths)
    s = t["script"][cp[at]]
    letter = s > 0
    edge = np.r_[True, (letter[1:] != letter[:-1]) | (row[1:] != row[:-1])]
    word = np.cumsum(edge) - 1
    n = int(word[-1]) + 1
    only_cyr = np.bincount(word[s == _SCRIPT_CYRILLIC], minlength=n)
    only_other = np.bincount(word[s == _SCRIPT_OTHER], minlength=n)
    of = row[np.flatnonzero(edge)]
    row_cyr = np.bincount(of, only_cyr, len(rows)) > np.bincount(of, only_other, len(rows))
    use = ((only_cyr > 0) | (only_other == 0) & row_cyr[of])[word] & (s == _SCRIPT_SHARED)
    cp = cp.copy()
    cp[at[use]] = t["cyrillic"][cp[at[use]]]
    return cp


def one_form(texts: pa.Array, shapes: tuple[tuple[int, int], ...] | None = None) -> pa.Array:
    """The consistent form of every text of an Arrow string array; null stays null.

    The whole array is decoded into one code-point array; lookup tables give each code point's
    replacement or expansion, marks are composed by a search in the sorted pairs, and the offsets of the
    rows are moved along. There is no call per row. ``shapes`` are pairs of code points of equal shape, by
    default those of the public confusables data (``confusables.letter_shapes``).
    """
    t = tables(letter_shapes() if shapes is None else shapes)
    n = len(texts)
    if n == 0:
        return pa.array([], pa.large_string())
    valid = np.asarray(texts.is_valid().to_numpy(zero_copy_only=False))
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    if not len(raw):
        return pa.array(np.where(valid, "", None), pa.large_string())
    first = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    bounds = first[offsets - offsets[0]]
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.int32)
    at = np.flatnonzero(t["flag"][cp] & 1)
    start, length = t["to"][cp[at]], t["length"][cp[at]]
    cp = t["to"][cp]
    if len(at):
        cp, bounds = _expand(cp, bounds, at, start, length, t["pool"])
    cp, bounds = _compose(cp, bounds, t)
    cp = _respell(cp, bounds, t)
    wide = np.concatenate([[0], np.cumsum(1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000), dtype=np.int64)])
    data = cp.astype("<i4").tobytes().decode("utf-32-le").encode("utf-8")
    out = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(wide[bounds]), pa.py_buffer(data)])
    return out if valid.all() else pa.compute.if_else(pa.array(valid), out, pa.scalar(None, pa.large_string()))


def with_one_form(df: DataFrame, text: str = "text", out: str = "form", max_chars: int = 1 << 24) -> DataFrame:
    """``df`` with the consistent form of column ``text`` as ``out``.

    Rows keep their partitions; nothing is shuffled. Batches are cut so that about ``max_chars`` bytes
    are held at once, so very long texts are safe. Null stays null and the empty text stays empty; a
    text of invisible characters only becomes empty. A column named ``out`` is replaced.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    kept = [f for f in df.schema.fields if f.name != out]
    schema = StructType([*kept, StructField(out, StringType())])
    names = [f.name for f in kept]
    shapes = letter_shapes()  # read once, here, so that all executors use the same

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut_batches(batch, text, max_chars):
                col = part.column(part.schema.get_field_index(text))
                form = one_form(col, shapes).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), form], names=[*names, out])

    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, text])]).mapInArrow(run, schema)


def cut_batches(batch: pa.RecordBatch, text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``max_bytes`` of ``text``, at least one row each."""
    if not batch.num_rows:
        return
    size = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
    group = np.cumsum(np.asarray(size, np.int64)) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def look_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's class of equal looks: ``(<key>, class_id, text_id)``.

    ``class_id`` is the hash of the consistent form, ``text_id`` of the text as it stands; rows with
    null text have neither and are left out. Only keys and hashes leave the text's partition.
    """
    return with_one_form(df.select(key, text), text, "form").where(F.col(text).isNotNull()).select(
        key, F.unhex(F.sha2("form", 256)).alias("class_id"), F.unhex(F.sha2(F.col(text), 256)).alias("text_id")
    )


def class_members(classes: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(<key>, class_of, text_of)``: the least key that looks the same and the least that has the same text.

    The least keys are aggregated before the shuffle; a class that holds a third of all rows is a skewed
    join key that adaptive execution splits.
    """
    rows = checkpoint(classes)  # hashes only; the texts are read once
    looks = rows.groupBy("class_id").agg(F.min(key).alias("class_of"))
    texts = rows.groupBy("text_id").agg(F.min(key).alias("text_of"))
    return rows.join(looks, "class_id").join(texts, "text_id").select(key, "class_of", "text_of")


def look_pairs(classes: DataFrame, key: str = "doc_id", salt_texts: int = 4096) -> DataFrame:
    """Pairs ``(doc_a, doc_b)`` of one class whose texts differ, ``doc_a`` < ``doc_b``.

    Classes with one text only are dropped after a partial aggregation, before any pairing. Different texts
    of a class are paired first, each once, however many rows hold it; a class with more than ``salt_texts``
    texts is spread over salts. Only then rows come in, so nothing but pairs of the result is made, and one
    text that a third of all rows hold is a skewed join key that adaptive execution splits. A key that
    occurs twice with one text counts once. The full list of pairs is what the result asks for; use
    ``look_classes`` where membership is enough.
    """
    rows = checkpoint(classes.distinct())  # hashes only; the texts are read once
    texts = rows.select("class_id", "text_id").distinct()
    mixed = texts.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    mixed = mixed.withColumn("salts", F.ceil(F.col("n") / salt_texts).cast("int")).drop("n")
    texts = texts.join(mixed, "class_id")
    one = texts.select("class_id", F.col("text_id").alias("ta"), F.pmod(F.xxhash64("text_id"), F.col("salts")).cast("int").alias("salt"))
    two = texts.select("class_id", F.col("text_id").alias("tb"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    differing = one.join(two, ["class_id", "salt"]).where("ta <> tb").select("ta", "tb")
    a = rows.select(F.col(key).alias("doc_a"), F.col("text_id").alias("ta"))
    b = rows.select(F.col(key).alias("doc_b"), F.col("text_id").alias("tb"))
    return differing.join(a, "ta").join(b, "tb").where("doc_a < doc_b").select("doc_a", "doc_b").distinct()
