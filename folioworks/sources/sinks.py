"""Rows into files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.session import checkpoint


def write_pair(df: DataFrame, path: str, key: str, markdown: str) -> None:
    """Two datasets of one batch: the texts under ``text`` and everything else, as JSON, under ``meta``.

    Both are written whole and replaced whole, so a repeated run leaves the same files.
    """
    df.select(key, markdown).write.mode("overwrite").parquet(f"{path}/text")
    rest = [c for c in df.columns if c not in (key, markdown)]
    df.select(key, F.to_json(F.struct(*rest)).alias("meta")).write.mode("overwrite").parquet(f"{path}/meta")


def read_pair(spark, path: str, key: str) -> DataFrame:
    """What ``write_pair`` wrote, joined again."""
    return spark.read.parquet(f"{path}/text").join(spark.read.parquet(f"{path}/meta"), key)


def write_bounded(df: DataFrame, path: str, content: str, max_bytes: int) -> DataFrame:
    """Writes the rows within ``max_bytes`` and returns those beyond, which aren't written, with the reason."""
    size = F.octet_length(content)
    df.where(size <= max_bytes).write.mode("overwrite").parquet(path)
    return df.where(size > max_bytes).withColumn("error", F.lit(f"larger than {max_bytes} bytes"))


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Writes rows by the partitions of ``keys``, each partition that occurs replaced whole and the others kept.

    A job that is run again, or a batch of which a part failed, leaves the same files as one good run.
    """
    df.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def finish_jobs(jobs: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, key: str, problem: str = "error") -> None:
    """Runs ``work`` over reserved ``jobs`` and writes one artifact or one failure a job, never both.

    ``work`` gives a row per job with ``key`` and ``problem`` (null where the job went well). Artifacts lie under
    ``done``, failures under ``failed``, partitioned by job; a job without any row in the result has failed
    too. A job that succeeds after it had failed moves: its state is that of the last run in ``state``.
    """
    result = checkpoint(work(jobs))
    missing = jobs.select(key).join(result.select(key), key, "left_anti").withColumn(problem, F.lit("no result"))
    failed = result.where(F.col(problem).isNotNull()).select(key, problem).unionByName(missing)
    replace_partitions(result.where(F.col(problem).isNull()).drop(problem), f"{path}/done", [key])
    replace_partitions(failed, f"{path}/failed", [key])
    state = result.where(F.col(problem).isNull()).select(key, F.lit("done").alias("state")).unionByName(failed.select(key, F.lit("failed").alias("state")))
    replace_partitions(state, f"{path}/state", [key])


def safe_name(name):
    """A file name that stays in its folder: no separators, no parent references."""
    return F.regexp_replace(F.regexp_replace(name, r"[/\\]+", "_"), r"^\.+", "")


def append_events(df: DataFrame, path: str) -> None:
    """Appends to an event log; ``latest_state`` over it is the current table."""
    df.write.mode("append").parquet(path)


_DOCX_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
}
_NOT_XML = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def docx_bytes(text: str) -> bytes:
    """A Word file with a paragraph per line of ``text``; characters that XML can't hold are left out."""
    lines = re.split(r"\r\n|\r|\n", _NOT_XML.sub("", text))
    paragraphs = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in lines)
    body = f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{paragraphs}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in (*_DOCX_PARTS.items(), ("word/document.xml", body)):
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + content)
    return out.getvalue()


def as_docx():
    """A function of text to the bytes of a Word file, in Arrow batches; null for null."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else docx_bytes(t) for t in texts], dtype=object)

    return run
