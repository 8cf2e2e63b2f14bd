"""Files into rows: folders, decoding, delimited, JSON, YAML, markup, mail, plain text, Word, PDF and WAV."""

from __future__ import annotations

import email
import io
import json
import wave
import zipfile
from collections.abc import Callable, Iterator
from email import policy
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from folioworks.functions.text import lines, strip
from folioworks.operators import classify
from folioworks.operators.tables import text_tables, to_markdown
from folioworks.sources.pdf import pdf_markdown, pdf_text

_STRUCTURED = StructType(
    [StructField("markdown", StringType()), StructField("headers", ArrayType(StringType())), StructField("rows", ArrayType(ArrayType(StringType())))]
)
TABLE = "array<struct<table_index:int,headers:array<string>,rows:array<array<string>>,markdown:string,row_count:int,column_count:int>>"
PARSED = f"struct<markdown:string,tables:{TABLE}>"


def read_folder(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (), recursive: bool = False) -> DataFrame:
    """The files of a folder as ``(path, name, length, modified, content)``; only those with one of the suffixes, if given."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if suffixes:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(s.lstrip(".") for s in suffixes) + "}")
    return reader.load(path).select("path", classify.base_name(F.col("path")).alias("name"), "length", F.col("modificationTime").alias("modified"), "content")


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 where they are, Latin-1 otherwise; line ends become ``\\n``. A byte order mark stays."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, r"\r\n|\r", "\n")


def inspected(content: Column, size: Column, limit: int) -> Column:
    """``struct<text, truncated, error>`` of at most ``limit`` bytes; text without a mark, broken bytes replaced.

    A file whose length differs from its stated size is an error.
    """
    part = F.when(F.length(content) > limit, F.substring(content, 1, limit)).otherwise(content)
    text = F.regexp_replace(F.make_valid_utf8(part.cast("string")), "^﻿", "")
    error = F.when(F.length(content) != size, "stored size differs")
    return F.struct(F.when(error.isNull(), text).alias("text"), (F.length(content) > limit).alias("truncated"), error.alias("error"))


def file_stats(content: Column) -> dict[str, Column]:
    return {"sha256": F.sha2(content, 256), "size": F.length(content), "kilobytes": F.round(F.length(content) / 1024, 2)}


def _table(headers: Column, rows: Column) -> Column:
    md = to_markdown(headers, rows)
    one = F.struct(
        F.lit(1).alias("table_index"), headers.alias("headers"), rows.alias("rows"), md.alias("markdown"), F.size(rows).alias("row_count"),
        F.size(headers).alias("column_count"),
    )
    return F.array(one).cast(TABLE)


_NONE = lambda: F.array().cast(TABLE)


def parse_delimited(text: Column, separator: str = ",") -> Column:
    """Delimited text as one table: all strings, blank lines left out, ragged rows kept; quoted fields may hold separators.

    Line breaks inside quotes are kept by splitting only where the number of quotes so far is even.
    """
    q = '"'
    joined = F.aggregate(
        lines(text),
        F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open")),
        lambda a, x: _join_quoted(a, x),
        lambda a: F.when(a["open"].isNotNull(), F.array_append(a["done"], a["open"])).otherwise(a["done"]),
    )
    sep = "\\|" if separator == "|" else separator
    # a field is either quoted (doubled quotes inside) or free of separators
    pattern = rf'(?:^|{sep})("(?:[^"]|"")*"|[^{sep}]*)'

    def cells(line: Column) -> Column:
        found = F.regexp_extract_all(line, F.lit(pattern), F.lit(1))
        return F.transform(found, lambda c: F.when(c.startswith(q) & c.endswith(q) & (F.length(c) > 1), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit(q))).otherwise(c))

    rows = F.filter(F.transform(joined, cells), lambda r: F.exists(r, lambda c: strip(c) != ""))
    headers = F.coalesce(F.get(rows, F.lit(0)), F.array().cast("array<string>"))
    body = F.slice(rows, 2, F.greatest(F.lit(1), F.size(rows)))
    md = F.when(F.size(rows) > 0, to_markdown(headers, body)).otherwise("")
    return F.struct(md.alias("markdown"), F.when(F.size(rows) > 0, _table(headers, body)).otherwise(_NONE()).alias("tables"))


def _join_quoted(a: Column, x: Column) -> Column:
    line = F.when(a["open"].isNotNull(), F.concat(a["open"], F.lit("\n"), x)).otherwise(x)
    odd = (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1
    return F.struct(F.when(odd, a["done"]).otherwise(F.array_append(a["done"], line)).alias("done"), F.when(odd, line).alias("open"))


def parse_plain(text: Column, name: Column) -> Column:
    """Plain text as it is; a log within a heading and a fence."""
    s = strip(text)
    log = F.concat(F.lit("### 🪵 Ingested Log Telemetry\n\n```text\n"), s, F.lit("\n```"))
    return F.struct(F.when(classify.extension(name) == "log", log).otherwise(s).alias("markdown"), text_tables(s).cast(TABLE).alias("tables"))


def _as_text(x) -> str:
    return x if isinstance(x, str) else str(x)


def _rows_of(parsed: list[tuple[str, list]]) -> pd.DataFrame:
    return pd.DataFrame({"markdown": [p[0] for p in parsed], "headers": [p[1][0] if p[1] else None for p in parsed], "rows": [p[1][1] if p[1] else None for p in parsed]})


def _json(text: str | None) -> tuple[str | None, list]:
    if text is None:
        return None, []
    try:
        data = json.loads(text)
    except ValueError:
        return f"```\n{text.strip()}\n```", []
    shown = f"```json\n{json.dumps(data, indent=2)}\n```"
    if isinstance(data, list) and data and isinstance(data[0], dict) and data[0]:
        headers = list(data[0])
        return shown, [headers, [[_as_text(x.get(h, "")) for h in headers] for x in data if isinstance(x, dict)]]
    return shown, []


def _yaml(text: str | None) -> tuple[str | None, list]:
    if text is None:
        return None, []
    try:
        import yaml
    except ImportError:
        return f"```text\n{text.strip()}\n```", []
    try:
        return f"```yaml\n{yaml.dump(yaml.safe_load(text), sort_keys=False, default_flow_style=False)}\n```", []
    except yaml.YAMLError:
        return f"```text\n{text.strip()}\n```", []


def _markup(text: str | None) -> tuple[str | None, list]:
    if text is None:
        return None, []
    if "<!ENTITY" in text:  # entities are not expanded
        return text.strip(), []
    try:
        return f"```xml\n{ElementTree.tostring(ElementTree.fromstring(text), encoding='unicode').strip()}\n```", []
    except (ElementTree.ParseError, ValueError):
        return text.strip(), []


def _mail(text: str | None) -> tuple[str | None, list]:
    if text is None:
        return None, []
    m = email.message_from_string(text, policy=policy.default)
    head = "\n".join(f"- **{h}:** {m.get(h.lower(), 'N/A')}" for h in ("From", "To", "Date", "Subject"))
    parts = [p for p in m.walk() if p.get_content_type() in ("text/plain", "text/html")] if m.is_multipart() else [m]
    body = "\n\n".join(_as_text(p.get_content()) for p in parts).strip()
    return f"### 📧 Email Metadata\n{head}\n\n### ✉️ Message Content\n\n{body}", []


def _docx(content: bytes) -> str:
    """The text of a Word file from its own XML: styles as headings and bullets, tables in place."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{ns}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{ns}t"))
    out = []
    for e in body if body is not None else ():
        if e.tag == f"{ns}p":
            style = next((s.get(f"{ns}val", "") for s in e.iter(f"{ns}pStyle")), "").lower().replace(" ", "")
            text = words(e).strip()
            if not text:
                continue
            level = next((k for k in (1, 2, 3, 4) if style == f"heading{k}"), 1 if style == "title" else 0)
            out.append("#" * level + " " + text if level else f"- {text}" if style.startswith("list") else text)
        elif e.tag == f"{ns}tbl":
            rows = [[words(c).strip() for c in r.iter(f"{ns}tc")] for r in e.iter(f"{ns}tr")]
            if rows:
                out.append("\n".join(["| " + " | ".join(rows[0]) + " |", "|" + "---|" * len(rows[0]), *("| " + " | ".join(r) + " |" for r in rows[1:])]))
    return "\n\n".join(out)


def _guarded(parse: Callable, *args):
    try:
        return parse(*args)
    except Exception:
        return None


_KINDS: dict[str, Callable] = {"json": _json, "yaml": _yaml, "markup": _markup, "email": _mail}

#: Readers of further formats: extension -> function from bytes to text. Register your own here.
BINARY_READERS: dict[str, Callable[[bytes], str]] = {"docx": _docx, "pdf": pdf_markdown}


def register_reader(suffix: str, read: Callable[[bytes], str]) -> None:
    """Adds a reader of a binary format; it runs on the executors, once per file, and may raise to give null."""
    BINARY_READERS[suffix.lstrip(".").lower()] = read


def binary_text(readers: dict[str, Callable[[bytes], str]] | None = None):
    """A function of (name, content) to the text of files in binary formats; null where no reader knows the format."""
    known = dict(BINARY_READERS if readers is None else readers)

    @F.pandas_udf(StringType())
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, contents in batches:
            yield pd.Series(
                [
                    _guarded(known[e], bytes(c)) if (e := (n or "").rpartition(".")[2].lower()) in known and c is not None else None
                    for n, c in zip(names, contents, strict=True)
                ],
                dtype=object,
            )

    return read


def docx_paragraphs(content: bytes) -> list[str]:
    """The paragraphs of a Word file's body, empty ones too, without those of tables."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{ns}body")
    return ["".join(t.text or "" for t in p.iter(f"{ns}t")) for p in (body.findall(f"{ns}p") if body is not None else ())]


def _inspected(name: str | None, content: bytes | None) -> tuple:
    """(text, pages, paragraphs, characters, error) of one file."""
    suffix = (name or "").rpartition(".")[2].lower()
    try:
        if content is None or suffix not in ("pdf", "docx"):
            return None, None, None, None, "no inspector for this file"
        if suffix == "pdf":
            text, pages = pdf_text(bytes(content))
            return text, pages, None, len(text or ""), None
        paragraphs = docx_paragraphs(bytes(content))
        text = "\n".join(paragraphs).strip()
        return text or None, None, len(paragraphs), len(text), None
    except Exception:
        return None, None, None, None, f"{suffix.upper()} file is malformed or unreadable"


def inspect_documents(df: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """Adds ``text``, ``page_count``, ``paragraph_count``, ``char_count`` and ``error`` to rows of PDF and Word files, in Arrow batches."""
    schema = "text string, page_count int, paragraph_count int, char_count int, error string"

    @F.pandas_udf(schema)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, contents in batches:
            rows = [_inspected(n, c) for n, c in zip(names, contents, strict=True)]
            frame = pd.DataFrame(rows, columns=["text", "page_count", "paragraph_count", "char_count", "error"])
            yield frame.astype({"page_count": "Int32", "paragraph_count": "Int32", "char_count": "Int32"})

    return df.withColumn("__i", run(name, content)).select("*", "__i.*").drop("__i")


def structured(kind: str):
    """A function of text to ``struct<markdown, headers, rows>`` for ``json``, ``yaml``, ``markup`` or ``email``."""
    parse = _KINDS[kind]

    @F.pandas_udf(_STRUCTURED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield _rows_of([_guarded(parse, t) or ((t or "").strip(), []) if t is not None else (None, []) for t in texts])

    return run


def parse_files(df: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """Adds ``parser``, ``markdown`` and ``tables`` to rows of decoded files, each by the parser of its extension.

    Only YAML, mail, markup and JSON leave the JVM, each in a branch of its own over its own rows.
    """
    rows = df.withColumn("parser", classify.parser_of(F.col(name)))
    t = F.col(text)
    plain = F.when(F.col("parser") == "delimited", F.when(classify.extension(F.col(name)) == "tsv", parse_delimited(t, "\t")).otherwise(parse_delimited(t)))
    plain = plain.when(F.col("parser") == "plain", parse_plain(t, F.col(name)))
    plain = plain.otherwise(F.struct(strip(t).alias("markdown"), text_tables(t).cast(TABLE).alias("tables")))
    out = rows.where(~F.col("parser").isin(*_KINDS)).withColumn("__p", plain)
    for kind in _KINDS:
        own = rows.where(F.col("parser") == kind).withColumn("__s", structured(kind)(t))
        made = _table(F.col("__s.headers"), F.col("__s.rows"))
        has = F.col("__s.headers").isNotNull()
        md = F.when(has, F.concat(made[0]["markdown"], F.lit("\n\n"), F.col("__s.markdown"))).otherwise(F.col("__s.markdown"))
        found = text_tables(F.col("__s.markdown") if kind == "email" else t).cast(TABLE) if kind in ("email", "markup") else _NONE()
        p = F.struct(md.alias("markdown"), F.when(has, made).otherwise(found).alias("tables"))
        out = out.unionByName(own.withColumn("__p", p).drop("__s"))
    return out.select(*rows.columns, F.col("__p.markdown").alias("markdown"), F.col("__p.tables").alias("tables"))


def wav_header(content: Column) -> Column:
    """Channels, rate, width and duration of canonical WAV bytes, read in the JVM; null for other bytes."""
    def number(at: int, n: int) -> Column:
        parts = [F.conv(F.hex(F.substring(content, at + k, 1)), 16, 10).cast("long") * (256**k) for k in range(n)]
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return out

    ok = (F.hex(F.substring(content, 1, 4)) == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57415645") & (F.hex(F.substring(content, 37, 4)) == "64617461")
    rate, width, channels = number(25, 4), number(35, 2) / 8, number(23, 2)
    seconds = F.try_divide(number(41, 4).cast("double"), rate * width * channels)
    return F.when(
        ok, F.struct(channels.cast("int").alias("channels"), rate.cast("int").alias("rate"), width.cast("int").alias("width"), F.round(seconds, 2).alias("seconds"))
    )


def wav_details(content: bytes) -> tuple[int, int, int, float]:
    """The same through the standard library, for files with further chunks."""
    with wave.open(io.BytesIO(content)) as w:
        return w.getnchannels(), w.getframerate(), w.getsampwidth(), round(w.getnframes() / w.getframerate(), 2)
