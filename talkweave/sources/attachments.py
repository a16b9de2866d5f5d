"""Uploaded files: decoding, types, size limits, text extraction, message text."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.functions._util import blank_to_null, first_filled, lookup, strip, text_or_blank
from talkweave.functions.prompts import ATTACHED_END, ATTACHED_START
from talkweave.functions.records import clip_block

# --- fixed values: media types, extensions, kinds, notes ---------------------
KIND_OF_MIME = {
    "image/jpeg": "image", "image/jpg": "image", "image/png": "image",
    "image/gif": "image", "image/webp": "image", "image/svg+xml": "image",
    "audio/mpeg": "audio", "audio/mp3": "audio", "audio/wav": "audio", "audio/wave": "audio",
    "audio/ogg": "audio", "audio/mp4": "audio", "audio/m4a": "audio", "audio/webm": "audio",
    "audio/flac": "audio", "audio/x-flac": "audio", "audio/x-wav": "audio", "video/webm": "audio",
    "application/pdf": "document",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "document",
    "application/msword": "document",
    "text/plain": "text", "text/csv": "text", "text/markdown": "text", "text/xml": "text",
    "application/xml": "text", "text/html": "text", "application/json": "text", "application/csv": "text",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "spreadsheet",
    "application/vnd.ms-excel.sheet.macroenabled.12": "spreadsheet",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "presentation",
}
MIME_OF_EXTENSION = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif",
    ".webp": "image/webp", ".mp3": "audio/mpeg", ".wav": "audio/wav", ".ogg": "audio/ogg",
    ".m4a": "audio/m4a", ".webm": "audio/webm", ".flac": "audio/flac", ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".doc": "application/msword",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".xlsm": "application/vnd.ms-excel.sheet.macroenabled.12",
    ".xls": "application/vnd.ms-excel",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".ppt": "application/vnd.ms-powerpoint",
    ".txt": "text/plain", ".csv": "text/csv", ".md": "text/markdown", ".json": "application/json",
    ".xml": "text/xml", ".html": "text/html", ".htm": "text/html",
}
OCTETS = "application/octet-stream"
LEGACY_NOTES = {
    "application/vnd.ms-excel": "Legacy .xls files are not supported yet; upload .xlsx or .csv",
    "application/vnd.ms-powerpoint": "Legacy .ppt files are not supported yet; upload .pptx",
}
BLOCK_LABELS = {"document": "Document", "spreadsheet": "Spreadsheet", "presentation": "Presentation", "text": "File"}
TEXT_NOTES = {
    "document": "Text extracted from Word document", "spreadsheet": "Text extracted from spreadsheet",
    "presentation": "Text extracted from presentation", "text": "Text decoded as UTF-8",
}
EMPTY_NOTES = {
    "spreadsheet": "Spreadsheet contained no extractable text",
    "presentation": "Presentation contained no extractable text",
}
MAX_FILE_BYTES = 30 * 1024 * 1024
MAX_TOTAL_BYTES = 60 * 1024 * 1024
# --- end of fixed values ----------------------------------------------------

# With a length that is a multiple of four, this is all of strict base64.
BASE64_PATTERN = r"^[A-Za-z0-9+/]*+={0,2}$"
PDF = "application/pdf"


def parsed_documents(requests: DataFrame) -> Column:
    """A request's documents as array<struct(position, filename, mime, body, reason, size)>.

    Document fields, all optional text: base64, fileBase64, filename, fileName, name,
    extension, mimeType, mime_type, contentType.  A request's legacy single-file
    columns (file_base64, file_name, file_mime_type) become one more document.  ``reason``
    tells why a document cannot be decoded; ``size`` is its decoded length.
    """
    given = [f.name for f in requests.schema["documents"].dataType.elementType.fields]

    def named(d: Column, i: Column) -> Column:
        def pick(*names: str) -> Column:
            return F.coalesce(*[blank_to_null(d[n]) for n in names if n in given], F.lit(None).cast("string"))

        extension = F.ltrim(strip(F.coalesce(pick("extension"), F.lit(""))), F.lit("."))
        fallback = F.when(extension != "", F.concat(F.lit("upload."), extension)).otherwise(
            F.concat(F.lit("upload-"), (i + 1).cast("string"))
        )
        return F.struct(
            (i + 1).cast("long").alias("position"),
            F.coalesce(pick("filename", "fileName", "name"), fallback).alias("filename"),
            pick("mimeType", "mime_type", "contentType").alias("mime"),
            pick("base64", "fileBase64").alias("encoded"),
        )

    given_type = requests.schema["documents"].dataType
    documents = F.transform(F.coalesce(F.col("documents"), F.array().cast(given_type)), named)
    if "file_base64" in requests.columns:
        legacy = F.struct(
            (F.greatest(F.size("documents"), F.lit(0)) + 1).cast("long").alias("position"),
            F.coalesce(blank_to_null("file_name"), F.lit("upload")).alias("filename"),
            blank_to_null("file_mime_type").alias("mime"), blank_to_null("file_base64").alias("encoded"),
        )
        documents = F.concat(documents, F.filter(F.array(legacy), lambda x: x["encoded"].isNotNull()))

    def with_body(d: Column) -> Column:
        raw = d["encoded"]
        is_data = F.lower(F.substring(raw, 1, 5)).eqNullSafe("data:") & raw.contains(",")
        body = F.when(is_data, F.substring(raw, F.instr(raw, F.lit(",")) + 1, F.length(raw))).otherwise(raw)
        return F.struct(d["position"].alias("position"), d["filename"].alias("filename"), d["mime"].alias("mime"), body.alias("body"))

    def judged(d: Column) -> Column:
        body = d["body"]
        valid = body.rlike(BASE64_PATTERN) & (F.length(body) % 4 == 0)
        padding = F.when(body.endswith("=="), 2).when(body.endswith("="), 1).otherwise(0)
        reason = F.when(body.isNull(), "base64 is required").when(~valid, "base64 must be valid base64")
        size = (F.length(body) / 4).cast("long") * 3 - padding
        return F.struct(
            d["position"].alias("position"), d["filename"].alias("filename"), d["mime"].alias("mime"), body.alias("body"),
            reason.alias("reason"), size.alias("size"),
        )

    return F.transform(F.transform(documents, with_body), judged)


def decode_documents(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, rejects) of requests with a ``documents`` array."""
    rows = requests.select("request_id", F.explode(parsed_documents(requests)).alias("d")).select("request_id", "d.*")
    files = rows.filter(F.col("reason").isNull()).select(
        "request_id", "position", "filename", "mime", F.unbase64("body").alias("bytes")
    )
    return files, rows.filter(F.col("reason").isNotNull()).select("request_id", "position", "filename", "reason")


def infer_mime(filename: Column, declared: Column) -> Column:
    """Declared type unless empty or generic, else by extension."""
    given = blank_to_null(declared)
    sensible = given.isNotNull() & (given != OCTETS)
    dot = F.regexp_extract(F.lower(filename), r"[^./]+(?:\.[^./]*)*?(\.[^./]*)$", 1)
    return F.when(sensible, F.lower(strip(F.substring_index(given, ";", 1)))).otherwise(
        F.coalesce(lookup(MIME_OF_EXTENSION, dot), F.lit(OCTETS))
    )


def attachment_kind(mime: Column) -> Column:
    """Image, audio, document, spreadsheet, presentation, text or unsupported."""
    return F.coalesce(lookup(KIND_OF_MIME, mime), F.lit("unsupported"))


def unsupported_note(mime: Column) -> Column:
    """The note of an unsupported type."""
    other = F.concat(F.lit("Unsupported file type '"), mime, F.lit("' — skipped"))
    return F.coalesce(lookup(LEGACY_NOTES, mime), other)


def total_upload_bytes(files: DataFrame) -> DataFrame:
    """A9."""
    return files.groupBy("request_id").agg(F.sum(F.length("bytes")).alias("total_bytes"))


def _size_reason(file_name: Column, total: Column, max_file: int, max_total: int) -> Column:
    mb = 1024 * 1024
    return F.when(
        file_name.isNotNull(),
        F.concat(F.lit("File '"), file_name, F.lit(f"' exceeds the {max_file // mb} MB upload limit")),
    ).when(total > max_total, F.lit(f"combined upload size exceeds the {max_total // mb} MB upload limit"))


def upload_reason(documents: Column, max_file: int = MAX_FILE_BYTES, max_total: int = MAX_TOTAL_BYTES) -> Column:
    """P18 inside a request row, over :func:`parsed_documents`: null when everything fits."""
    big = F.try_element_at(F.filter(documents, lambda d: d["size"] > max_file), F.lit(1))
    total = F.aggregate(documents, F.lit(0).cast("long"), lambda acc, d: acc + F.coalesce(d["size"], F.lit(0)))
    return _size_reason(big["filename"], total, max_file, max_total)


def check_upload_sizes(
    files: DataFrame, max_file: int = MAX_FILE_BYTES, max_total: int = MAX_TOTAL_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(files of accepted requests, rejected requests with the reason).

    Sizes are added up per request before the shuffle; only the few rejected
    requests meet the files again.
    """
    size = F.length("bytes")
    too_big = F.when(size > max_file, F.struct(F.col("position"), F.col("filename")))
    per_request = files.groupBy("request_id").agg(F.min(too_big).alias("_file"), F.sum(size).alias("_total"))
    reason = _size_reason(F.col("_file.filename"), F.col("_total"), max_file, max_total)
    rejected = per_request.select("request_id", reason.alias("reason")).filter(F.col("reason").isNotNull())
    return files.join(rejected.select("request_id"), "request_id", "left_anti"), rejected


# --- office files ------------------------------------------------------------------
def natural_key(name: str) -> str:
    """a text that sorts digit runs as numbers, since all of them are padded to one width."""
    return re.sub(r"\d+", lambda run: run[0].zfill(24), name)


def _numbered(archive: zipfile.ZipFile, prefix: str, label: str, lines: Callable[[Iterator[ET.Element]], Iterator[str]]) -> str:
    """Lines of every part below ``prefix`` under a numbered heading; parts without lines are left out."""
    names = sorted((n for n in archive.namelist() if n.startswith(prefix) and n.endswith(".xml")), key=natural_key)
    out = []
    for number, name in enumerate(names, 1):
        with archive.open(name) as part:
            found = "\n".join(line for line in lines(node for _, node in ET.iterparse(part)) if line)
        if found:
            out.append(f"{label} {number}:\n{found}")
    return "\n\n".join(out)


def _local(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2]


def _runs(node: ET.Element) -> list[str]:
    return [t.text or "" for t in node.iter() if _local(t) == "t"]


def workbook_text(archive: zipfile.ZipFile) -> str:
    """Cells of a row joined by a bar, rows by newlines, empty cells and rows left out."""
    strings: dict[str, str] = {}
    if "xl/sharedStrings.xml" in archive.namelist():
        with archive.open("xl/sharedStrings.xml") as part:
            items = (node for _, node in ET.iterparse(part) if _local(node) == "si")
            strings = {str(i): "".join(_runs(item)) for i, item in enumerate(items)}

    def rows(nodes: Iterator[ET.Element]) -> Iterator[str]:
        # A cell's value comes before its end, and its row's end after all of them.
        cells: list[str] = []
        value = ""
        for node in nodes:
            name = _local(node)
            if name == "v":
                value = (node.text or "").strip()
            elif name == "c":
                kind = node.get("t")
                text = " ".join(_runs(node)) if kind == "inlineStr" else strings.get(value, value) if kind == "s" else value
                cells.append(text.strip())
                value = ""
            elif name == "row":
                yield " | ".join(c for c in cells if c)
                cells = []

    return _numbered(archive, "xl/worksheets/", "Sheet", rows)


def slides_text(archive: zipfile.ZipFile) -> str:
    """Text runs of every slide, one per line."""
    return _numbered(
        archive, "ppt/slides/slide", "Slide", lambda nodes: ((n.text or "").strip() for n in nodes if _local(n) == "t")
    )


def document_text(archive: zipfile.ZipFile) -> str:
    """Non-blank body paragraphs, one per line."""
    body = ET.fromstring(archive.read("word/document.xml")).find("{*}body")
    marks = {"t": None, "tab": "\t", "br": "\n", "cr": "\n"}

    def paragraph(node: ET.Element) -> str:
        local = ((child, child.tag.rpartition("}")[2]) for child in node.iter())
        return "".join((child.text or "") if tag == "t" else marks[tag] for child, tag in local if tag in marks)

    texts = (paragraph(p) for p in (body.iterfind("{*}p") if body is not None else ()))
    return "\n".join(t for t in texts if t.strip())


_READERS = {"spreadsheet": ("XLSX", workbook_text), "presentation": ("PPTX", slides_text), "document": ("DOCX", document_text)}


def office_text(kind: str, data: bytes) -> str:
    """Text of one office file; a broken file gives its error as text."""
    label, read = _READERS[kind]
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            return read(archive)
    except Exception as exc:  # any damage in an upload is a data error of that row
        return f"[{label} extraction error: {exc}]"


def _office_udf(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for kinds, blobs in pairs:
        yield pd.Series(
            [office_text(k, b) if k in _READERS and b is not None else None for k, b in zip(kinds, blobs)],
            dtype=object,
        )


def extract_text(files: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per file with block text, kind, characters and note; only a given ``limit`` cuts texts.

    Plain text is decoded in the JVM; only office files are sent to Python.  Images, audio
    and PDF need a model or a parser of their own and keep a null block.
    """
    mime = infer_mime(F.col("filename"), F.col("mime"))
    rows = files.withColumn("mime_type", mime).withColumn("kind", attachment_kind(F.col("mime_type")))
    readable = F.col("kind").isin(*_READERS) & (F.col("mime_type") != PDF)
    office = F.pandas_udf(_office_udf, "string")(
        F.when(readable, F.col("kind")), F.when(readable, F.col("bytes"))
    )
    plain = strip(F.make_valid_utf8(F.col("bytes").cast("string")))
    rows = rows.withColumn("_text", F.when(F.col("kind") == "text", plain).otherwise(office))
    empty = F.col("kind").isin(*EMPTY_NOTES) & (strip(text_or_blank("_text")) == "")
    label = lookup(BLOCK_LABELS, F.col("kind"))
    block = F.concat(F.lit("["), label, F.lit(": "), F.col("filename"), F.lit("]\n"), F.col("_text"))
    clipped = clip_block(F.when(~empty, block), lookup(TEXT_NOTES, F.col("kind")), limit)
    rows = rows.withColumn("_clip", F.when(F.col("_text").isNotNull() & ~empty, clipped))
    note = (
        F.when(F.col("kind") == "unsupported", unsupported_note(F.col("mime_type")))
        .when(empty, lookup(EMPTY_NOTES, F.col("kind")))
        .otherwise(F.coalesce("_clip.note", F.lit("")))
    )
    return rows.select(
        *[c for c in files.columns if c not in ("bytes", "mime")], "mime_type", "kind",
        F.col("_clip.block").alias("block"),
        F.coalesce("_clip.chars_extracted", F.lit(0).cast("long")).alias("chars_extracted"),
        note.alias("note"),
    )


def build_message(requests: DataFrame, blocks: DataFrame) -> DataFrame:
    """The message with its attachment blocks; unchanged when there are none.

    Run it after :func:`check_upload_sizes`, which bounds what one request gathers.
    """
    gathered = blocks.filter(F.col("block").isNotNull()).groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "block"))).alias("_b")
    )
    joined = requests.join(gathered, "request_id", "left")
    text = F.array_join(F.transform("_b", lambda b: b["block"]), "\n\n")
    return joined.withColumn("message", with_blocks(F.col("message"), text)).drop("_b")


def with_blocks(message: Column, blocks: Column) -> Column:
    """The message with the joined blocks after it; null or '' blocks leave it unchanged."""
    merged = F.concat(message, F.lit(f"\n\n{ATTACHED_START}\n"), blocks, F.lit(f"\n{ATTACHED_END}"))
    return F.when(F.coalesce(blocks, F.lit("")) == "", message).otherwise(merged)


def image_records(images: DataFrame) -> DataFrame:
    """Index rows (id, content, metadata) of described images; the id derives from content."""

    def cell(name: str, default: str = "") -> Column:
        if name not in images.columns:
            return F.lit(default)
        return F.coalesce(F.col(name).cast("string"), F.lit(default))

    content = F.concat_ws(
        " ",
        F.concat(F.lit("Description: "), cell("image_description")),
        F.concat(F.lit("Caption: "), cell("image_caption")),
        F.concat(F.lit("Prompt: "), cell("image_prompt")),
    )
    metadata = {
        "level": cell("level", "Class_10"), "subject": cell("subject"), "board": cell("board", "CBSE"),
        "medium": cell("medium", "English"), "course_type": cell("course_type", "School"),
        "chapter_number": cell("chapter_number"),
        "topic_name": first_filled(cell("topic_name"), cell("topic")),
        "subtopic_name": first_filled(cell("subtopic_name"), cell("subtopic")),
        "content_type": F.lit("image"), "image_caption": cell("image_caption"), "image_url": cell("image_url"),
    }
    entries = F.create_map(*[x for k, v in metadata.items() for x in (F.lit(k), v)])
    return images.select(
        F.xxhash64(content, metadata["image_url"]).alias("id"), content.alias("content"), entries.alias("metadata")
    )
