"""Symbols and texts of documents: JSON, JSON lines, XML, Markdown, HTML, Parquet, Office archives and PDF."""

from __future__ import annotations

import html.parser
import io
import json
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

PREVIEW, SIGNATURE = 200, 100
#: A symbol of a document: name, kind, line, col, signature; documents are always exported.
Symbol = tuple[str, str, int, int, str | None]


def _preview(text: str) -> str | None:
    return text[:PREVIEW] or None


def json_keys(text: str) -> list[Symbol]:
    """Top-level keys in alphabetical order, each at the first line that quotes it; none if the text is no JSON object."""
    try:
        data = json.loads(text)
    except (ValueError, RecursionError):
        return []
    if not isinstance(data, dict):
        return []
    lines = text.split("\n")

    def line(key: str) -> int:
        return next((n for n, x in enumerate(lines, 1) if f'"{key}"' in x), 1)

    return [(k, "property", line(k), 1, None) for k in sorted(data)]


def jsonl_keys(text: str) -> list[Symbol]:
    """Keys of the first line that is not blank."""
    first = next((x for x in text.split("\n") if x.strip()), "")
    return [(k, kind, 1, col, s) for k, kind, _, col, s in json_keys(first)]


def xml_elements(text: str) -> list[Symbol]:
    """Distinct element names in order of first occurrence; what follows malformed text is left out."""
    parser, found = ElementTree.XMLPullParser(("start",)), {}
    try:
        parser.feed(text)
    except ElementTree.ParseError:
        pass
    try:
        for _, element in parser.read_events():
            found.setdefault(element.tag.rpartition("}")[2])
    except ElementTree.ParseError:
        pass
    spot = {name: re.search(rf"<(?:[\w.-]+:)?{re.escape(name)}\b", text) for name in found}
    return [(n, "module", text.count("\n", 0, m.start()) + 1 if m else 1, 1, None) for n, m in spot.items()]


class _Tags(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[Symbol] = []

    def handle_starttag(self, tag, attrs):  # noqa: ANN001
        if tag not in ("script", "style"):
            line, col = self.getpos()
            self.found.append((tag, "module", line, col + 1, self.get_starttag_text()))

    def handle_startendtag(self, tag, attrs):  # noqa: ANN001
        pass


def html_elements(text: str) -> list[Symbol]:
    """Every element with a start tag, in order, repeats kept; self-closing ones, scripts and styles are left out."""
    parser = _Tags()
    parser.feed(text)
    return parser.found


def markdown_headings(docs: DataFrame, key: str = "path") -> DataFrame:
    """(key, name, line, col, signature) of lines of 1 to 6 #, by built-in functions over each text's own lines.

    col is the level plus one. The signature is the next line that is not blank, cut at 100 characters, unless that is a
    heading too.
    """
    lines = docs.select(key, F.split("text", "\n").alias("lines")).select(key, "lines", F.posexplode("lines").alias("n", "line"))
    level = F.length(F.regexp_extract(F.ltrim("line"), r"^(#+)", 1))
    heads = lines.withColumn("level", level).where("level between 1 and 6")
    name = F.trim(F.regexp_replace(F.ltrim("line"), r"^#+", ""))
    after = F.trim(F.get(F.filter(F.slice("lines", F.col("n") + 2, F.size("lines")), lambda x: F.trim(x) != ""), F.lit(0)))
    cut = F.when(F.length(after) > SIGNATURE, F.concat(F.substring(after, 1, SIGNATURE), F.lit("…"))).otherwise(after)
    signature = F.when(~after.startswith("#"), cut)
    return heads.select(key, name.alias("name"), (F.col("n") + 1).alias("line"), (F.col("level") + 1).alias("col"), signature.alias("signature")).where("name <> ''")


def markdown_symbols(text: str) -> list[Symbol]:
    lines, found = text.split("\n"), []
    for n, line in enumerate(lines):
        head = re.match(r"\s*(#{1,6})(?!#)(.*)", line)
        if head and head[2].strip():
            after = next((x.strip() for x in lines[n + 1 :] if x.strip()), "")
            cut = after[:SIGNATURE] + "…" if len(after) > SIGNATURE else after
            found.append((head[2].strip(), "module", n + 1, len(head[1]) + 1, cut if after and not after.startswith("#") else None))
    return found


def parquet_columns(data: bytes) -> list[Symbol]:
    import pyarrow.parquet as pq

    schema = pq.read_schema(io.BytesIO(data))
    fields = [(f.name, str(f.type)) for f in schema]
    whole = ", ".join(f"{n}: {t}" for n, t in fields)
    return [("Parquet Schema", "module", 1, 1, _preview(whole)), *[(n, "property", i, 1, t) for i, (n, t) in enumerate(fields, 2)]]


def _runs(xml: bytes, tag: str) -> str:
    """Texts of all elements of this local name, joined; as far as the XML can be read."""
    out = []
    try:
        for _, e in ElementTree.iterparse(io.BytesIO(xml)):
            if e.tag.rpartition("}")[2] == tag:
                out.append(e.text or "")
    except ElementTree.ParseError:
        pass
    return "".join(out)


def docx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return _runs(z.read("word/document.xml"), "t")


def pptx_slides(data: bytes) -> list[str]:
    """Texts of the slides in order of their file names as strings, so slide10 comes before slide2."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [_runs(z.read(n), "t") for n in sorted(z.namelist()) if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]


def xlsx_sheets(data: bytes) -> tuple[list[str], str]:
    """Names of the sheets, and the text of the shared strings."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        names = [e.get("name", "") for e in book.iter() if e.tag.rpartition("}")[2] == "sheet"]
        shared = _runs(z.read("xl/sharedStrings.xml"), "t") if "xl/sharedStrings.xml" in z.namelist() else ""
    return names, shared


_PDF_STRING = r"\((?:\\.|[^\\()])*\)"
_PDF_SHOW = re.compile(rf"(?P<one>{_PDF_STRING})\s*(?:Tj|'|\")|\[(?P<many>(?:\s*(?:{_PDF_STRING}|[-\d.]+|<[^>]*>)\s*)*)\]\s*TJ|(?P<end>\bET\b)", re.S)


def pdf_text(data: bytes) -> str:
    """Best effort: strings shown by Tj, ', \" and TJ in plain or deflated streams, a newline after each text object."""
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[1]
        try:
            body = zlib.decompressobj().decompress(body)
        except zlib.error:
            pass
        for s in _PDF_SHOW.finditer(body.decode("latin-1")):
            if s["end"]:
                out.append("\n")
            else:
                out += [re.sub(r"\\([()\\])", r"\1", x[1:-1]) for x in re.findall(_PDF_STRING, s["one"] or s["many"])]
    return "".join(out)


def pdf_pages(data: bytes) -> int:
    return len(re.findall(rb"/Type\s*/Page(?!s)", data)) or 1


def document_symbols(language: str, data: bytes) -> list[Symbol] | None:
    """Symbols of a document of this language; None if the language is no document. Unreadable files have none."""
    text_of = {"json": json_keys, "jsonl": jsonl_keys, "xml": xml_elements, "markdown": markdown_symbols, "html": html_elements, "xaml": xml_elements}
    try:
        if language in text_of:
            return text_of[language](data.decode("utf-8"))
        if language == "parquet":
            return parquet_columns(data)
        if language == "docx":
            return [("Word Document", "module", 1, 1, _preview(docx_text(data)))]
        if language == "pptx":
            return [(f"Slide {n}", "module", n, 1, _preview(t)) for n, t in enumerate(pptx_slides(data), 1)]
        if language == "xlsx":
            names, shared = xlsx_sheets(data)
            return [(f"Sheet: {n}", "module", i, 1, _preview(shared)) for i, n in enumerate(names, 1)]
        if language == "pdf":
            preview = _preview(pdf_text(data))
            return [(f"Page {n}", "module", n, 1, preview if n == 1 else None) for n in range(1, pdf_pages(data) + 1)]
    except (OSError, ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
        return []
    return None


def document_text(language: str, data: bytes) -> str | None:
    """The text that BM25 reads: extracted from archives and PDF, decoded otherwise; None if it cannot be read."""
    try:
        if language == "docx":
            return docx_text(data)
        if language == "pptx":
            return "\n".join(pptx_slides(data))
        if language == "xlsx":
            return xlsx_sheets(data)[1]
        return pdf_text(data) if language == "pdf" else data.decode("utf-8")
    except (OSError, ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
        return None


def tag_counts(pages: DataFrame, key: str = "page_id", body: str = "html") -> DataFrame:
    """(key, tag, n) of elements with a start tag, by built-in functions: comments, scripts and styles are taken out first."""
    bare = F.regexp_replace(body, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    tags = F.regexp_extract_all(bare, F.lit(r"<([A-Za-z][A-Za-z0-9-]*)(?:\s[^<>]*[^<>/]|\s*)?>"), F.lit(1))
    return pages.select(key, F.explode(F.transform(tags, F.lower)).alias("tag")).groupBy(key, "tag").agg(F.count(F.lit(1)).alias("n"))
