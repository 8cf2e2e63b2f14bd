"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Where the vocabulary files lie and which one sizes are measured in.
TOKENIZER = os.environ.get("FOLIOWORKS_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the public split pattern that belongs to the byte-level vocabularies.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


@functools.cache
def encoder(path: str = TOKENIZER):
    """The tokenizer of a rank file, loaded once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = TOKENIZER, chunk: int = 20_000) -> int:
    """Tokens of ``text``; null and empty texts have 0.

    Long texts are counted in pieces of about ``chunk`` characters, cut only at a single space between two
    ASCII letters: there the split pattern always begins a new piece, so the count is that of the whole
    text. Where no such place follows, the rest is counted as one.
    """
    if not text:
        return 0
    enc = encoder(path)
    n = start = 0
    while len(text) - start > chunk:
        cut = _CUT.search(text, start + chunk)
        if cut is None:
            break
        n += len(enc.encode_ordinary(text[start : cut.start()]))
        start = cut.start()
    return n + len(enc.encode_ordinary(text[start:]))


def with_tokens(df: DataFrame, text: str = "text", out: str = "tokens", path: str = TOKENIZER) -> DataFrame:
    """``df`` without column ``text``, with its size in tokens as ``out`` (bigint, 0 for null)."""
    kept = [f for f in df.schema.fields if f.name not in (text, out)]
    schema = StructType([*kept, StructField(out, LongType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(b.schema.get_field_index(text))
            sizes = pa.array([count_tokens(x.as_py(), path) for x in col], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), sizes], names=[*names, out])

    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*names, text])]).mapInArrow(run, schema)
