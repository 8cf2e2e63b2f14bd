"""Classification of files, uploads, keyframes and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioworks.functions.text import lines, strip, word_count

# The category of every file extension and MIME type.
EXTENSIONS = {
    "3gp": "video", "aac": "audio", "avi": "video", "avif": "image", "bmp": "image", "cfg": "text", "conf": "text", "csv": "text", "doc": "document",
    "docx": "document", "flac": "audio", "flv": "video", "gif": "image", "heic": "image", "heif": "image", "htm": "text", "html": "text",
    "ico": "image", "ini": "text", "jpeg": "image", "jpg": "image", "json": "text", "key": "presentation", "log": "text", "m4a": "audio",
    "m4v": "video", "markdown": "text", "md": "text", "mid": "audio", "midi": "audio", "mkv": "video", "mov": "video", "mp3": "audio", "mp4": "video",
    "mpeg": "video", "mpg": "video", "odp": "presentation", "ods": "document", "odt": "document", "oga": "audio", "ogg": "audio", "opus": "audio",
    "pages": "document", "pdf": "document", "png": "image", "ppt": "presentation", "pptx": "presentation", "rst": "text", "rtf": "document",
    "svg": "image", "tex": "text", "tif": "image", "tiff": "image", "ts": "video", "tsv": "text", "txt": "text", "wav": "audio", "weba": "audio",
    "webm": "video", "webp": "image", "wma": "audio", "wmv": "video", "xls": "document", "xlsm": "document", "xlsx": "document", "xml": "text",
    "yaml": "text", "yml": "text",
}
MIME_TYPES = {
    "application/json": "text", "application/msword": "document", "application/pdf": "document", "application/rtf": "document",
    "application/vnd.ms-excel": "document", "application/vnd.ms-powerpoint": "presentation",
    "application/vnd.oasis.opendocument.presentation": "presentation", "application/vnd.oasis.opendocument.spreadsheet": "document",
    "application/vnd.oasis.opendocument.text": "document",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "presentation",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "document",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "document", "application/xml": "text", "audio/aac": "audio",
    "audio/flac": "audio", "audio/mp4": "audio", "audio/mpeg": "audio", "audio/ogg": "audio", "audio/opus": "audio", "audio/wav": "audio",
    "audio/webm": "audio", "audio/x-m4a": "audio", "audio/x-ms-wma": "audio", "audio/x-wav": "audio", "image/avif": "image", "image/bmp": "image",
    "image/gif": "image", "image/heic": "image", "image/heif": "image", "image/jpeg": "image", "image/png": "image", "image/svg+xml": "image",
    "image/tiff": "image", "image/vnd.microsoft.icon": "image", "image/webp": "image", "text/csv": "text", "text/html": "text",
    "text/markdown": "text", "text/plain": "text", "text/xml": "text", "video/3gpp": "video", "video/mp4": "video", "video/mpeg": "video",
    "video/quicktime": "video", "video/webm": "video", "video/x-flv": "video", "video/x-ms-wmv": "video", "video/x-msvideo": "video",
}
UPLOAD_TYPES = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pdf": "application/pdf",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "txt": "text/plain",
}
#: Extensions that the text pipeline takes.
ACCEPTED = ("csv", "docx", "json", "log", "markdown", "md", "pdf", "tsv", "txt")
#: Parsers by extension.
PARSERS = {
    "cfg": "plain", "conf": "plain", "csv": "delimited", "eml": "email", "htm": "markup", "html": "markup", "ini": "plain", "json": "json",
    "log": "plain", "markdown": "markdown", "md": "markdown", "msg": "email", "tsv": "delimited", "txt": "plain", "xml": "markup", "yaml": "yaml",
    "yml": "yaml",
}
#: Kinds of uploads by extension; everything else is text.
UPLOAD_KINDS = {
    "avi": "video", "flac": "audio", "flv": "video", "jpeg": "image", "jpg": "image", "m4a": "audio", "mkv": "video", "mov": "video", "mp3": "audio",
    "mp4": "video", "ogg": "audio", "png": "image", "wav": "audio", "webm": "video", "webp": "image",
}
#: Inspectors in the order in which they are asked: name, category, extension, MIME type. Add your own here.
INSPECTORS = [
    ("text", "text", "txt", "text/plain"),
    ("pdf", "document", "pdf", "application/pdf"),
    ("docx", "document", "docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
]
NO_INSPECTOR = "no inspector registered for media category"
OUTPUT_KEYS = {
    "advisory": "advisory",
    "exec_summary": "exec_summary",
    "executive_summary": "exec_summary",
    "incident_report": "incident_report",
    "infographic": "playbook",
    "linkedin": "linkedin_post",
    "linkedin_post": "linkedin_post",
    "playbook": "playbook",
    "presentation": "slide_deck",
    "press_release": "press_release",
    "slide_deck": "slide_deck",
    "social_thread": "social_thread",
    "twitter": "social_thread",
    "video_package": "video_script",
    "video_script": "video_script",
}
TERMINAL = (
    r"[$#]\s+[a-zA-Z0-9_\-]+",
    r"(?i)root@[a-zA-Z0-9_\-]+",
    r"(?i)[A-Z]:\\[a-zA-Z0-9_\\]+",
    r"(?i)\b(?:sudo|chmod|nmap|curl|wget|python3?|docker|kubectl|ssh|grep|cat|ls|cd|dir)\b",
    r"(?i)\b(?:STDIN|STDOUT|STDERR|bash|powershell|cmd\.exe|zsh)\b",
)
DIAGRAM_WORDS = (
    "architecture",
    "attacker",
    "c2",
    "cloud",
    "database",
    "dmz",
    "egress",
    "firewall",
    "flowchart",
    "gateway",
    "ingress",
    "mitre",
    "orchestrator",
    "pipeline",
    "proxy",
    "router",
    "switch",
    "target",
    "topology",
    "vpc",
)
SLIDE_WORDS = (
    "agenda",
    "conclusion",
    "impact",
    "key takeaways",
    "mitigation",
    "objective",
    "overview",
    "recommendations",
    "summary",
    "timeline",
    "vulnerability details",
)


def _lookup(table: dict[str, str]) -> Column:
    """``table`` as a literal map, folded once by the optimizer."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def base_name(name: Column) -> Column:
    """The last part of a path with either kind of slash; ``upload`` if nothing is left."""
    last = F.regexp_extract(F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), r"/+\z", ""), r"([^/]*)\z", 1)
    return F.coalesce(F.nullif(strip(last), F.lit("")), F.lit("upload"))


def extension(name: Column) -> Column:
    """The extension without its dot, small; null if there is none (a leading dot doesn't count)."""
    return F.lower(F.nullif(F.regexp_extract(base_name(name), r"[^.]\.([^.]+)\z", 1), F.lit("")))


def mime_type(content_type: Column) -> Column:
    """A MIME type without parameters, small; null if empty."""
    return F.nullif(F.lower(strip(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"^([^;]*)", 1))), F.lit(""))


def media_category(name: Column, content_type: Column) -> Column:
    """The category by extension or, failing that, by MIME type; ``unknown`` if they contradict each other."""
    a = F.try_element_at(_lookup(EXTENSIONS), extension(name))
    b = F.try_element_at(_lookup(MIME_TYPES), mime_type(content_type))
    return F.when(a.isNotNull() & b.isNotNull() & (a != b), "unknown").otherwise(F.coalesce(a, b, F.lit("unknown")))


def upload_check(name: Column, content_type: Column) -> Column:
    """``struct<content_type, extension, error>``: the extension decides; another allowed MIME type is an error."""
    ext, sent = extension(name), F.coalesce(mime_type(content_type), F.lit(""))
    canonical = F.try_element_at(_lookup(UPLOAD_TYPES), ext)
    clash = sent.isin(*UPLOAD_TYPES.values()) & (sent != canonical)
    error = F.when(canonical.isNull(), "file type not supported").when(clash, "content type does not match file extension")
    return F.struct(F.when(error.isNull(), canonical).alias("content_type"), F.when(error.isNull(), ext).alias("extension"), error.alias("error"))


def parser_of(name: Column) -> Column:
    """The parser that reads a file; ``text`` for unknown extensions."""
    return F.coalesce(F.try_element_at(_lookup(PARSERS), extension(name)), F.lit("text"))


def accepted(name: Column) -> Column:
    return F.coalesce(extension(name).isin(*ACCEPTED), F.lit(False))


def upload_kind(name: Column) -> Column:
    """image, audio, video or text."""
    return F.coalesce(F.try_element_at(_lookup(UPLOAD_KINDS), extension(name)), F.lit("text"))


def inspector_of(category: Column, ext: Column, mime: Column) -> Column:
    """The first inspector of a file's category that knows its extension or its MIME type; null if none does."""
    known = [F.when((category == c) & (F.coalesce(ext == e, F.lit(False)) | F.coalesce(mime == m, F.lit(False))), n) for n, c, e, m in INSPECTORS]
    return F.coalesce(*known, F.lit(None).cast("string"))


def only_inspector(category: Column) -> Column:
    """The inspector of a bare category; null where it has none or several."""
    names: dict[str, list[str]] = {}
    for n, c, _, _ in INSPECTORS:
        names.setdefault(c, []).append(n)
    one = {c: ns[0] for c, ns in names.items() if len(ns) == 1}
    return F.try_element_at(_lookup(one), category) if one else F.lit(None).cast("string")


def output_key(alias: Column) -> Column:
    """The key of an output type; unknown aliases stay as they are."""
    return F.coalesce(F.try_element_at(_lookup(OUTPUT_KEYS), alias), alias)


def hits(text: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns occur."""
    out = F.lit(0)
    for p in patterns:
        out = out + text.rlike(p).cast("int")
    return out


def mentions_of(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur, in any case, anywhere."""
    return F.size(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("(?i)(" + "|".join(words) + ")"), F.lit(1)), F.lower)))


def visual_type(text: Column, brightness: Column, boxes: Column) -> Column:
    """TERMINAL, DIAGRAM, SLIDE or OTHER, the first whose rule holds, from a frame's text and two image features."""
    words = word_count(text)
    terminal = hits(text, TERMINAL)
    dark = (brightness < 110) & ((terminal >= 1) | text.rlike("(?i)powershell|root@") | text.contains("$ "))
    bullets = F.exists(lines(text), lambda x: strip(x).rlike(r"^(?:[-*•]|[123]\.)"))
    return (
        F.when(dark | (terminal >= 2) & (words > 5), "TERMINAL")
        .when((boxes >= 4) & (words < 60) | (boxes >= 2) & (mentions_of(text, DIAGRAM_WORDS) >= 2), "DIAGRAM")
        .when((words >= 15) | (mentions_of(text, SLIDE_WORDS) >= 1) | bullets, "SLIDE")
        .otherwise("OTHER")
    )
