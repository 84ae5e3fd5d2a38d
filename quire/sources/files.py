"""Files as tables: listings, text decoding, Office documents, e-mails and markup, all from binary content.

Listings prune the content. Readers are Arrow-batched and use the standard library only, one file per row;
a file that can't be read gives one row with its error and no content, so no file is lost silently.
"""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: encodings in the order they are tried.
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "big5")


def listing(spark: SparkSession, folder: str, extensions: list[str] | None = None, recursive: bool = True, hidden: bool = False) -> DataFrame:
    """Files of a folder without their content: path, name, extension, length, time. Lock files are skipped."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    rows = reader.load(folder).select("path", "modificationTime", "length")
    name = F.element_at(F.split("path", "/"), -1)
    rows = rows.withColumn("name", F.url_decode(F.regexp_replace(name, r"\+", "%2B"))).withColumn("extension", F.lower(F.regexp_extract("name", r"(\.[A-Za-z0-9]+)$", 1)))
    rows = rows.filter(~F.col("name").rlike(r"^~\$|^(?i:thumbs\.db|desktop\.ini|\.ds_store)$"))
    if not hidden:
        rows = rows.filter(~F.col("name").startswith("."))
    if extensions:
        rows = rows.filter(F.col("extension").isin([e.lower() if e.startswith(".") else "." + e.lower() for e in extensions]))
    return rows


def selected(files: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files that were asked for, each once; asked names that aren't there or try to leave the folder)."""
    asked = wanted.select("name").distinct()
    safe = asked.filter(~F.col("name").rlike(r"(^|[\\/])\.\.([\\/]|$)"))
    return files.join(safe, "name", "left_semi"), asked.join(files.select("name"), "name", "left_anti")


def decode_bytes(content: bytes) -> tuple[str, str]:
    """Text and the encoding that read it; the last resort replaces what can't be read."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        try:
            return content.decode("utf-16"), "utf-16"
        except UnicodeDecodeError:
            pass
    for name in ENCODINGS:
        try:
            return content.decode(name), name
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", errors="replace"), "replace"


def decoded(content: Column) -> Column:
    """``struct<text, encoding>`` of binary content."""

    @F.pandas_udf("struct<text:string,encoding:string>")
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if v is None else decode_bytes(bytes(v)) for v in values], columns=["text", "encoding"])

    return run(content)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _paragraph_text(p: ElementTree.Element) -> str:
    out = []
    for node in p.iter():
        name = _local(node.tag)
        if name == "t":
            out.append(node.text or "")
        elif name in ("tab",):
            out.append("\t")
        elif name in ("br", "cr"):
            out.append("\n")
    return "".join(out)


def _docx_part(root: ElementTree.Element) -> Iterator[tuple[str, str]]:
    """(kind, text) in document order: paragraphs outside tables, then rows of tables as one line each."""

    def walk(node: ElementTree.Element) -> Iterator[tuple[str, str]]:
        for child in node:
            name = _local(child.tag)
            if name == "p":
                yield "paragraph", _paragraph_text(child)
            elif name == "tbl":
                for row in child.iter():
                    if _local(row.tag) == "tr":
                        cells = [" ".join(_paragraph_text(p) for p in cell.iter() if _local(p.tag) == "p") for cell in row if _local(cell.tag) == "tc"]
                        yield "row", "\t".join(cells)
            elif name in ("body", "sdt", "sdtContent", "footnote", "endnote", "comment", "hdr", "ftr"):
                if child.get(f"{{{_W}}}type") in ("separator", "continuationSeparator"):
                    continue
                yield from walk(child)

    yield from walk(root)


_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx_items(content: bytes) -> Iterator[tuple[str, str, str, bool, int]]:
    """(kind, label, text, is_extra, position) of a DOCX: body first, then headers, footers, notes and comments."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        parts = [("word/document.xml", "body", False)] + [(n, kind, True) for kind, pat in (("header", r"word/header\d*\.xml"), ("footer", r"word/footer\d*\.xml"), ("footnote", r"word/footnotes\.xml"), ("endnote", r"word/endnotes\.xml"), ("comment", r"word/comments\.xml")) for n in sorted(names) if re.fullmatch(pat, n)]
        for part, kind, extra in parts:
            if part not in names:
                continue
            for i, (form, text) in enumerate(_docx_part(ElementTree.fromstring(z.read(part)))):
                if text.strip():
                    yield ("table" if form == "row" else kind), part, text, extra, i


def docx_cells(content: bytes) -> Iterator[tuple[int, int, int, str]]:
    """(table, row, column, text) of the cells of a DOCX body's tables, from 0 and in order; a cell's paragraphs are its lines."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    for t, table in enumerate(e for e in body.iter() if _local(e.tag) == "tbl"):
        for r, row in enumerate(e for e in table if _local(e.tag) == "tr"):
            for c, cell in enumerate(e for e in row if _local(e.tag) == "tc"):
                lines = ["".join(x.text or "" for x in p.iter() if _local(x.tag) == "t") for p in cell if _local(p.tag) == "p"]
                yield t, r, c, "\n".join(lines).strip()


CELLS = "path string, table_no int, row_no int, column_no int, text string"


def read_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Table cells of all DOCX files under a folder; files that can't be read have none (``read_items`` tells why)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(path, *cell) for cell in docx_cells(bytes(content))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    rows = []
                yield pd.DataFrame(rows, columns=["path", "table_no", "row_no", "column_no", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(folder)
    return files.select("path", "content").mapInPandas(run, CELLS)


def pdf_listing(spark: SparkSession, folder: str) -> DataFrame:
    """PDF files in natural order of their paths with their pages, null where they can't be told.

    Pages are counted by the page objects of the file, which compressed object streams hide; such files have no count.
    """

    @F.pandas_udf("int")
    def pages(contents: pd.Series) -> pd.Series:
        found = [len(re.findall(rb"/Type\s*/Page(?![A-Za-z])", bytes(c))) if bytes(c[:5]) == b"%PDF-" else 0 for c in contents]
        return pd.Series([n or None for n in found], dtype="Int32")

    from quire.operators.relational import natural_key

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return files.select("path", "length", pages("content").alias("page_count"), natural_key(F.col("path")).alias("order_key"))


def xlsx_cells(content: bytes) -> Iterator[tuple[str, str, str, bool, int]]:
    """("cell", "sheet!A1", value, False, position) of an XLSX: shared and inline strings, numbers as written."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(si.tag) == "si"]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        targets = {}
        if (rels := "xl/_rels/workbook.xml.rels") in names:
            targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read(rels))}
        numbered = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        at = 0
        for no, sheet in enumerate(s for s in book.iter() if _local(s.tag) == "sheet"):
            # a sheet's part is named by the workbook's relations; only books without them go by number
            target = targets.get(next((v for k, v in sheet.items() if _local(k) == "id"), None))
            part = (target.lstrip("/") if target.startswith("/") else f"xl/{target}") if target else numbered[no] if no < len(numbered) else ""
            if part not in names:
                continue
            title = sheet.get("name")
            for c in ElementTree.fromstring(z.read(part)).iter():
                if _local(c.tag) != "c":
                    continue
                kind, value = c.get("t"), None
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                elif (v := next((x for x in c if _local(x.tag) == "v"), None)) is not None:
                    value = shared[int(v.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}.get(v.text, v.text) if kind == "b" else v.text
                if value and value.strip():
                    yield "cell", f"{title}!{c.get('r')}", value.strip(), False, at
                    at += 1


def pptx_items(content: bytes) -> Iterator[tuple[str, str, str, bool, int]]:
    """("slide" or "notes", part, text, is_extra, position) of a PPTX, one item per paragraph with text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        at = 0
        for pattern, kind, extra in ((r"ppt/slides/slide\d+\.xml", "slide", False), (r"ppt/notesSlides/notesSlide\d+\.xml", "notes", True)):
            for part in sorted((n for n in z.namelist() if re.fullmatch(pattern, n)), key=lambda n: int(re.findall(r"\d+", n)[-1])):
                for p in ElementTree.fromstring(z.read(part)).iter():
                    if _local(p.tag) == "p" and (text := "".join(t.text or "" for t in p.iter() if _local(t.tag) == "t")).strip():
                        yield kind, part, text, extra, at
                        at += 1


def text_items(content: bytes) -> Iterator[tuple[str, str, str, bool, int]]:
    text = decode_bytes(content)[0]
    if text.strip():
        yield "body", "text", text, False, 0


def mail_items(content: bytes) -> Iterator[tuple[str, str, str, bool, int]]:
    """Headers, the best body (HTML as text before plain text) and attachment names of an EML."""
    message = email.message_from_bytes(content, policy=email.policy.default)
    for i, header in enumerate(("From", "To", "Cc", "Date", "Subject")):
        if message[header]:
            yield "header", header, str(message[header]), True, i
    body = message.get_body(preferencelist=("html", "plain"))
    if body is not None:
        text = body.get_content()
        yield "body", body.get_content_type(), html_to_text(text) if body.get_content_type() == "text/html" else text, False, 10
    for i, part in enumerate(message.iter_attachments()):
        yield "attachment", part.get_content_type(), part.get_filename() or f"part-{i}", True, 20 + i


READERS: dict[str, Callable[[bytes], Iterator[tuple[str, str, str, bool, int]]]] = {".docx": docx_items, ".xlsx": xlsx_cells, ".pptx": pptx_items, ".txt": text_items, ".md": text_items, ".eml": mail_items}

ITEMS = "path string, kind string, label string, text string, is_extra boolean, position int, error string"


def read_items(spark: SparkSession, folder: str) -> DataFrame:
    """Text items of all readable files under a folder; a file that fails gives one row with the reason."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "kind", "label", "text", "is_extra", "position", "error"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                reader = READERS[path[path.rindex(".") :].lower()]
                try:
                    rows = [(path, *item, None) for item in reader(bytes(content))]
                except Exception as e:  # noqa: BLE001 - any broken file is a row of the result
                    rows = [(path, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200])]
                yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.filter(F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1)).isin(sorted(READERS))).select("path", "content").mapInPandas(run, ITEMS)


# --- markup --------------------------------------------------------------------------------------------

_SKIP = {"script", "style", "head", "title", "template", "noscript"}
#: Tags that stand for an end of the head, which may be left out.
_BODY = {"body", "main", "a", "b", "i", "em", "strong", "span", "img", "br"}
_BLOCK = {"p", "div", "section", "article", "li", "ul", "ol", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "header", "footer", "figure", "form", "hr"}


def _closed(markup: str) -> str:
    """Markup without the start of a style or script that never ends; else all that follows would belong to it."""
    for name in ("style", "script"):
        opens = list(re.finditer(rf"(?i)<{name}\b[^>]*>", markup))
        if opens and not re.search(rf"(?i)</{name}\s*>", markup[opens[-1].end() :]):
            rest = markup[opens[-1].end() :]
            markup = markup[: opens[-1].start()] + (rest[rest.index("<") :] if "<" in rest else "")
    return markup


class _Skipping(HTMLParser):
    """Knows whether it is inside elements that are left out."""

    left_out = frozenset(_SKIP)

    def __init__(self, **how) -> None:
        super().__init__(**how)
        self.out: list[str] = []
        self.open: list[str] = []

    def enter(self, tag: str) -> bool:
        """Whether a start tag is to be passed over."""
        if self.open and self.open[-1] == "head" and (tag in _BLOCK or tag in _BODY):
            self.open.pop()
        if tag in self.left_out:
            self.open.append(tag)
        return bool(self.open)

    def leave(self, tag: str) -> bool:
        """Whether an end tag is to be passed over."""
        inside = bool(self.open) or tag in self.left_out
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        return inside


class _Text(_Skipping):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)

    def handle_starttag(self, tag, attrs):
        if self.enter(tag):
            return
        if tag == "br" or tag in _BLOCK:
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append("\t")
        elif tag == "page_break":
            self.out.append("\f")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.leave(tag) and tag in _BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.open:
            self.out.append(data)


def html_to_text(markup: str) -> str:
    """Visible text: blocks and line breaks as lines, cells after tabs, blanks squeezed, page breaks kept as form feeds."""
    parser = _Text()
    parser.feed(_closed(markup))
    parser.close()
    text = re.sub(r"[^\S\n\t\f]+", " ", "".join(parser.out))
    text = re.sub(r" ?([\n\f]) ?", r"\1", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


# What stays of foreign markup.
SAFE_TAGS = frozenset("a b blockquote br code div em h1 h2 h3 h4 h5 h6 hr i img li ol p pre span strong sub sup table tbody td th thead tr u ul".split())
SAFE_ATTRIBUTES = frozenset("alt class colspan height href rowspan src style title width".split())
SAFE_LINKS = ("", "http", "https", "mailto", "tel")
#: Pictures come from the message itself; any other would tell its sender that it is read.
SAFE_PICTURES = ("cid", "data")
#: Elements that go with all they hold, and those of them that hold nothing.
DANGEROUS = frozenset("script iframe frameset object applet form button textarea select option video audio canvas svg math foreignobject".split())
EMPTY_DANGEROUS = frozenset("frame embed input source track base link meta".split())
_IMPORT = re.compile(r"""(?i)@import\s+(?:url\([^)]*\)|'[^']*'|"[^"]*")[^;]*;?""")
_ACTIVE = re.compile(r"(?i)(?:expression\s*\(|(?:java|vb)script\s*:|behavior\s*:|-moz-binding\s*:)")
_URL = re.compile(r"""(?is)url\(\s*(['"]?)(.*?)\1\s*\)""")


def safe_style(css: str) -> str:
    """A style without imports, code and foreign resources."""
    return _URL.sub("none", _ACTIVE.sub("blocked(", _IMPORT.sub("", css)))


def scheme_of(link: str) -> str:
    """The scheme of a link as a browser sees it: without the blanks and control characters that may hide it."""
    lean = re.sub(r"[\s\x00-\x1f]", "", link).lower()
    m = re.match(r"([a-z][a-z0-9+.-]*):", lean)
    return "//" if lean.startswith("//") else m.group(1) if m else ""


def _quoted(value: str) -> str:
    return value.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;")


class _Safe(_Skipping):
    left_out = frozenset(_SKIP) | DANGEROUS

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)

    def handle_starttag(self, tag, attrs):
        if tag in EMPTY_DANGEROUS or self.enter(tag) or tag not in SAFE_TAGS:
            return
        named = {n: v or "" for n, v in attrs}
        if tag == "img" and scheme_of(named.get("src", "")) not in SAFE_PICTURES:
            source, text = named.get("src", ""), named.get("alt", "")
            linked = scheme_of(source) in ("http", "https")  # a link tells nobody anything until it is followed
            self.out.append(f'<a href="{_quoted(source)}">{_quoted(text or source)}</a>' if linked else _quoted(text))
            return
        kept = []
        for name, value in named.items():
            if name not in SAFE_ATTRIBUTES or name == "href" and scheme_of(value) not in SAFE_LINKS:
                continue
            kept.append(f' {name}="{_quoted(safe_style(value) if name == "style" else value)}"')
        self.out.append(f"<{tag}{''.join(kept)}>")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.open and self.open[-1] == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        if not self.leave(tag) and tag in SAFE_TAGS and tag not in ("br", "hr", "img"):
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.open:
            self.out.append(data.replace("<", "&lt;").replace(">", "&gt;"))

    def handle_entityref(self, name):
        if not self.open:
            self.out.append(f"&{name};")

    def handle_charref(self, name):
        if not self.open:
            self.out.append(f"&#{name};")


def sanitized(markup: str) -> str:
    """Markup with listed tags, attributes and link schemes only. Scripts, frames, forms and the like go with their content;
    pictures from elsewhere become links with their text; styles keep no imports, code or resources."""
    parser = _Safe()
    parser.feed(_closed(markup))
    parser.close()
    return "".join(parser.out)


def as_udf(f: Callable[[str], str]) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f(v) for v in values], dtype="object")

    return run
