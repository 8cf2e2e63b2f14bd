"""Splitting oversized items at natural boundaries (problem 2)."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words on either side of a boundary whose vocabularies are compared.
BLOCK_WORDS = 60
#: Kinds of boundaries, the natural ones first.
HEADING, BLOCK, ITEM, LINE, WORD = 5, 4, 3, 2, 1

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|\Z)")
_FENCE = re.compile(r"\s{0,3}(?:```|~~~)")
_HEADING = re.compile(r"\s{0,3}#{1,6}\s")
_BULLET = re.compile(r"\s*(?:[-*+•]|\d{1,3}[.)])\s")
_SENTENCE = re.compile(r"[.!?;…]+[\"')\]]*\s+(?=\S)")
_WORDS = re.compile(r"\w+")


def token_estimate(n_chars: int) -> int:
    """The size of a text of ``n_chars`` code points in estimated tokens."""
    return max(1, n_chars // 4)


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places where ``text`` may be cut naturally, ascending, and the kind of each.

    A cut before a heading, between blocks (paragraphs, lists, tables, code), between list items, between
    lines of a table, of code or of a paragraph, or between sentences. Neither end of the text is listed.
    """
    at: list[int] = []
    kind: list[int] = []
    previous, in_code, blank = "", False, False
    for m in _LINE.finditer(text):
        line, start = m.group(), m.start()
        if not line:
            break
        body = line.strip()
        fence = bool(_FENCE.match(line))
        if not body and not in_code:
            now = "blank"
        elif in_code or fence:
            now = "code"
        elif _HEADING.match(line):
            now = "heading"
        elif body[0] == "|":
            now = "table"
        elif _BULLET.match(line):
            now = "list"
        else:
            now = "text"
        if start and now != "blank":
            opens = fence and not in_code
            if now == "heading" and previous != "heading":
                k = HEADING
            elif previous == "heading":
                k = LINE  # a heading stays with what follows it
            elif blank and not (now == "code" and not opens) or now != previous and not (now == "text" and previous == "list") or opens:
                k = BLOCK
            elif now == "list":
                k = ITEM
            else:
                k = LINE
            at.append(start)
            kind.append(k)
        if now in ("text", "list") and len(body) > 80:
            for s in _SENTENCE.finditer(text, start, m.end()):
                if start < s.end() < m.end():
                    at.append(s.end())
                    kind.append(LINE)
        if fence:
            in_code = not in_code
        blank = now == "blank"
        if now != "blank":
            previous = now
    return np.array(at, np.int64), np.array(kind, np.int8)


def cohesion_depths(text: str, at: np.ndarray, block_words: int = BLOCK_WORDS) -> np.ndarray:
    """How deep a valley of lexical cohesion each boundary lies in.

    The words of sliding blocks before and after each boundary are compared by the cosine of their counts;
    the depth of a boundary is the sum of its distances to the nearest peaks on both sides.
    """
    n = len(at)
    if n == 0:
        return np.zeros(0)
    edges = [0, *at.tolist(), len(text)]
    low = text.lower()
    source = low if len(low) == len(text) else text  # some letters are longer when small
    known: dict[str, int] = {}
    numbers: list[int] = []
    counts = []
    for a, b in zip(edges, edges[1:], strict=False):
        words = _WORDS.findall(source, a, b)
        numbers += [known.setdefault(w, len(known)) for w in words]
        counts.append(len(words))
    ids = np.array(numbers, np.int64)
    mid = np.cumsum(counts)[:n]  # words before boundary i
    similarity = np.empty(n)
    before, after = np.arange(-block_words, 0), np.arange(block_words)
    a = 0
    while a < n:  # a bounded part at a time, each with its own vocabulary
        b = min(a + 256, max(a + 1, int(np.searchsorted(mid, mid[a] + (1 << 14)))))
        m = mid[a:b]
        lo, hi = max(0, int(m[0]) - block_words), min(len(ids), int(m[-1]) + block_words)
        vocabulary, part = np.unique(ids[lo:hi], return_inverse=True)
        size = max(1, len(vocabulary))
        rows = np.arange(len(m))[:, None] * size

        def block(steps: np.ndarray) -> np.ndarray:
            place = (m - lo)[:, None] + steps
            inside = (place >= 0) & (place < len(part))
            cells = (rows + part[np.clip(place, 0, len(part) - 1)])[inside] if len(part) else np.zeros(0, np.int64)
            return np.bincount(cells, minlength=len(m) * size).reshape(len(m), size).astype(np.float32)

        left, right = block(before), block(after)
        norm = np.sqrt(np.einsum("ij,ij->i", left, left) * np.einsum("ij,ij->i", right, right))
        similarity[a:b] = np.where(norm > 0, np.einsum("ij,ij->i", left, right) / np.maximum(norm, 1e-9), 1.0)
        a = b
    s = similarity.tolist()
    left_peak, right_peak = s[:], s[:]
    for i in range(1, n):
        if s[i - 1] >= s[i]:
            left_peak[i] = left_peak[i - 1]
    for i in range(n - 2, -1, -1):
        if s[i + 1] >= s[i]:
            right_peak[i] = right_peak[i + 1]
    return np.array(left_peak) + np.array(right_peak) - 2 * similarity


def split_spans(
    n_chars: int, text: str, at: np.ndarray, kind: np.ndarray, depth: np.ndarray, max_tokens: int, overlap_tokens: int
) -> list[tuple[int, int]]:
    """The spans of the pieces of ``text``: each within ``max_tokens``, each sharing ``overlap_tokens`` with the last.

    In the second half of each size window the deepest valley among the block boundaries is cut (ties: the
    stronger, then the later boundary); if there is none, among lines and sentences; if there is none, the
    last natural boundary of the first half, then the last clause, the last space, the window's end.
    """
    limit = 4 * max_tokens + 3
    overlap = 4 * min(max(overlap_tokens, 0), max_tokens // 2)
    if n_chars <= limit:
        return [(0, n_chars)]
    places = at.tolist()
    out = []
    start = 0
    while n_chars - start > limit:
        # a piece must be longer than its overlap and leave a rest that is longer than the next one's
        low, high = start + max(limit // 2, overlap + 1), start + limit
        i, j = bisect.bisect_left(places, low), bisect.bisect_right(places, high)
        end = 0  # every cut lies after start + overlap, so each piece moves on
        if j > i:
            k, d = kind[i:j], depth[i:j]
            for group in (k >= ITEM, k == LINE):
                if group.any():
                    end = max(((float(d[x]), int(k[x]), places[i + x]) for x in np.flatnonzero(group)))[2]
                    break
        if not end:
            i = bisect.bisect_right(places, start + overlap)
            end = places[j - 1] if j > i else 0  # a natural boundary in the first half
        if not end:
            x = max(text.rfind(mark, low, high) + len(mark) - 1 for mark in (", ", "; ", "\n"))
            x = x if x >= low else text.rfind(" ", low, high)
            end = x + 1 if x >= low else high
        out.append((start, end))
        start = end - overlap
    out.append((start, n_chars))
    return out


def version_order(df: DataFrame, version: str) -> list[Column]:
    """What orders versions from old to new, nulls first: a column of numbers or times by itself, text by the time, then the number, then the text it is."""
    v = F.col(version)
    if dict(df.dtypes)[version] != "string":
        return [v]
    return [v.try_cast("timestamp"), v.try_cast("decimal(38,9)"), v]


_SPANS = "array<struct<profile:string,piece:int,pieces:int,begin:bigint,end:bigint>>"
_SPAN_TYPE = pa.list_(pa.struct([("profile", pa.string()), ("piece", pa.int32()), ("pieces", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())]))


def split_documents(
    df: DataFrame,
    profiles: DataFrame,
    key: str = "doc_id",
    text: str = "clean_markdown",
    version: str = "processed_at",
    with_text: bool = True,
) -> DataFrame:
    """Pieces of every text under every profile.

    ``profiles`` holds ``(profile, max_tokens, overlap_tokens)``, at most 1,000 rows (checked). Returns
    ``(profile, <key>, piece, pieces, begin, end, tokens[, text])``: ``begin``/``end`` are code points,
    ``tokens`` the estimate max(1, code points div 4) of the piece. A text within the limit is one piece;
    of a larger one, consecutive pieces share exactly ``overlap_tokens`` x 4 code points.

    Method: lexical-cohesion segmentation, see ``cohesion_depths`` and ``split_spans``; linear in the text.
    Without ``with_text`` texts are cut where they lie and only their spans are shuffled to find each
    key's latest version.

    Defined cases: of several rows with one key the latest ``version`` (``version_order``; of equals the
    greatest hash of the text) counts; null texts have no pieces, the empty text one empty piece; a profile with a null or
    non-positive limit is left out; an overlap of more than half the limit is taken as half; null keys are
    one key; empty tables give an empty result; other columns are ignored.
    """
    rows = profiles.select("profile", "max_tokens", "overlap_tokens").where("max_tokens > 0").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1,000 profiles")
    limits = [(r[0], int(r[1]), int(r[2] or 0)) for r in rows]
    types = dict(df.select(key).dtypes)
    order = [c.alias(f"v{i}") for i, c in enumerate(version_order(df, version))]
    named = [f"v{i}" for i in range(len(order))]
    texts = df.select(F.col(key).alias("k"), *order, F.xxhash64(text).alias("h"), F.col(text).alias("t")).where("t is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(batch.num_columns - 1):
                t = value.as_py()
                n = len(t)
                at = kind = depth = np.zeros(0)
                if any(n > 4 * m + 3 for _, m, _ in limits):
                    at, kind = boundaries(t)
                    depth = cohesion_depths(t, at)
                spans = []
                for name, m, overlap in limits:
                    own = split_spans(n, t, at, kind, depth, m, overlap)
                    spans += [{"profile": name, "piece": p, "pieces": len(own), "begin": a, "end": b} for p, (a, b) in enumerate(own)]
                out.append(spans)
            kept = batch.columns if with_text else batch.columns[:-1]
            names = batch.schema.names if with_text else batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, _SPAN_TYPE)], names=[*names, "s"])

    def latest(rows: DataFrame, what: str) -> DataFrame:
        return rows.groupBy("k").agg(F.max(F.struct(*named, "h", what)).alias("r")).select("k", F.col(f"r.{what}").alias(what))

    kinds = dict(texts.dtypes)
    if with_text:
        done = latest(texts, "t").select("k", "t").mapInArrow(cut, f"k {types[key]}, t string, s {_SPANS}")
    else:
        ddl = ", ".join(f"{c} {kinds[c]}" for c in ("k", *named, "h"))
        done = latest(texts.mapInArrow(cut, f"{ddl}, s {_SPANS}"), "s")
    pieces = done.select(*done.columns[:-1], F.inline("s"))
    size = F.col("end") - F.col("begin")
    tokens = F.greatest(F.lit(1).cast("long"), F.floor(size / 4)).alias("tokens")
    piece = [F.substr("t", (F.col("begin") + 1).cast("int"), size.cast("int")).alias("text")] if with_text else []
    return pieces.select("profile", F.col("k").alias(key), "piece", "pieces", "begin", "end", tokens, *piece)
