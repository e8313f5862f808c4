"""Files become documents of blocks: format detection, one parser for each format, rendering.

Parsers are pure functions of bytes and run in ``mapInPandas`` over Spark's binaryFile source. None raises: what a
parser cannot read is kept as plain text with the error in its metadata.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import accumulate, zip_longest
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

BLOCKS = "array<struct<kind:string,text:string,level:int,locator:struct<kind:string,label:string,index:int>>>"
SCHEMA = f"path string, format string, title string, sha256 string, size long, parser_error string, metadata string, blocks {BLOCKS}, markdown string"
#: Extensions of the formats, locator titles, the row cap of a sheet (a parameter wherever it is used).
EXTENSIONS = {"pdf": "pdf", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "csv": "csv", "tsv": "tsv", "html": "html", "htm": "html", "md": "markdown", "markdown": "markdown", "txt": "text"}
LOCATOR_TITLES = {"page": "Page", "slide": "Slide", "sheet": "Sheet", "line": "Line"}
MAX_ROWS = 2000
ZIP_PARTS = {"word/document.xml": "docx", "ppt/presentation.xml": "pptx", "xl/workbook.xml": "xlsx"}
CHROME = {"nav", "header", "footer", "aside", "script", "style", "noscript"}


def block(kind: str, text: str, level: int | None = None, locator: dict | None = None) -> dict:
    return {"kind": kind, "text": text, "level": level, "locator": locator}


def locator(kind: str, label: str, index: int) -> dict:
    return {"kind": kind, "label": label, "index": index}


def detect(name: str, data: bytes) -> str:
    """The format by extension, else by magic bytes, else text."""
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if ext in EXTENSIONS:
        return EXTENSIONS[ext]
    if data[:5] == b"%PDF-":
        return "pdf"
    if data[:4] == b"PK\x03\x04":
        try:
            names = set(zipfile.ZipFile(io.BytesIO(data)).namelist())
        except zipfile.BadZipFile:
            names = set()
        return next((f for part, f in ZIP_PARTS.items() if part in names), "text")
    head = data[:1024].lstrip().lower()
    return "html" if head.startswith((b"<!doctype html", b"<html")) else "text"


#: Encodings of East Asia that are tried, and very common characters that tell them apart.
EAST_ASIAN = ("gb18030", "big5", "shift_jis", "euc_jp", "euc_kr")
COMMON = frozenset("的一是不了在人有我他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可她里后这個來說們為時會過學對後國の日本語した。、，이다는은을를에가하고의한로지사기어도서나그것있수들만")


def decode_text(data: bytes) -> str:
    """UTF-8 (with or without a mark), UTF-16 by its mark, else an encoding of East Asia where the high bytes come in runs, else Windows-1252.

    Of those that can be decoded without error, the one whose text has most kana and common characters is taken.
    """
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        pass
    high = sum(x >= 0x80 for x in data)
    found: list[tuple[float, str]] = []
    if sum(map(len, re.findall(rb"[\x80-\xff].(?:[\x80-\xff].)+", data, re.S))) > high * 0.7:
        for name in EAST_ASIAN:
            try:
                text = data.decode(name)
            except UnicodeDecodeError:
                continue
            wide = [c for c in text if c >= "\x80"]
            good = sum(1.0 if c in COMMON or "\u3041" <= c <= "\u30fe" else 0.3 if "\u4e00" <= c <= "\u9fff" or "\uac00" <= c <= "\ud7a3" else 0.1 if "\u3000" <= c <= "\u303f" or "\uff01" <= c <= "\uff5e" else -1.0 for c in wide)
            found.append((good / max(1, len(wide)), text))
    best = max(found, key=lambda x: x[0], default=(0.0, ""))
    return best[1] if best[0] > 0.2 else data.decode("cp1252", "replace")


def paragraphs(text: str) -> list[str]:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return [p.strip("\n") for p in re.split(r"\n\s*\n", text) if p.strip()]


def parse_text(data: bytes) -> tuple[str | None, dict, list[dict]]:
    return None, {}, [block("paragraph", p) for p in paragraphs(decode_text(data))]


def parse_markdown(data: bytes) -> tuple[str | None, dict, list[dict]]:
    """Headings, fences, list items and paragraphs; the first heading of level one is the title."""
    blocks: list[dict] = []
    run: list[str] = []
    fence: str | None = None
    code: list[str] = []

    def flush() -> None:
        if any(x.strip() for x in run):
            blocks.append(block("paragraph", "\n".join(run).strip("\n")))
        run.clear()

    for line in decode_text(data).replace("\r\n", "\n").split("\n"):
        mark = re.match(r"\s{0,3}(```+|~~~+)", line)
        if fence is not None:
            if mark and mark.group(1)[:3] == fence:
                blocks.append(block("code", "\n".join(code)))
                fence, code = None, []
            else:
                code.append(line)
        elif mark:
            flush()
            fence = mark.group(1)[:3]
        elif m := re.match(r"(#{1,6})\s+(.*?)(?:\s+#+)?\s*$", line):
            flush()
            blocks.append(block("heading", m.group(2), len(m.group(1))))
        elif m := re.match(r"\s*(?:[-*+]|\d+[.)])\s+(.*)$", line):
            flush()
            blocks.append(block("list_item", m.group(1)))
        elif line.strip():
            run.append(line)
        else:
            flush()
    if fence is not None:
        blocks.append(block("code", "\n".join(code)))
    flush()
    return next((b["text"] for b in blocks if b["kind"] == "heading" and b["level"] == 1), None), {}, blocks


def table_block(rows: list[list[str]], at: dict | None = None) -> dict:
    """A pipe table; the first row is the header, short rows are padded."""
    cell = lambda c: re.sub(r"\||\n", lambda m: "\\|" if m.group() == "|" else " ", str(c)).strip()
    columns = list(zip_longest(*rows, fillvalue="")) or [()]
    lines = [[cell(c) for c in row] for row in zip(*columns, strict=True)]
    lines[1:1] = [["---"] * len(columns)] if rows else []
    return block("table", "\n".join(f"| {' | '.join(line)} |" for line in lines), None, at)


def _capped(rows: list[list[str]], most: int | None) -> tuple[list[list[str]], int]:
    """The header and at most ``most`` rows (all without it), and how many are left out."""
    kept = rows if most is None else rows[: most + 1]
    return kept, len(rows) - len(kept)


def parse_delimited(data: bytes, delimiter: str | None = None, name: str = "", max_rows: int | None = MAX_ROWS) -> tuple[str | None, dict, list[dict]]:
    """A sheet of values with a given or a sniffed delimiter (S17); blank rows stay."""
    text, name = decode_text(data), name.rsplit("/", 1)[-1]
    if delimiter is None:
        try:
            delimiter = csv.Sniffer().sniff(decode_text(data[:4096]), ",;|\t").delimiter
        except csv.Error:
            delimiter = ","
    rows, dropped = _capped(list(csv.reader(io.StringIO(text), delimiter=delimiter)), max_rows)
    return None, {"truncated_rows": {name: dropped}} if dropped else {}, [table_block(rows, locator("sheet", name, 1))] if rows else []


class _Page(HTMLParser):
    """A light tree of an HTML page: nodes are [tag, attributes, children]."""

    VOID = {"br", "hr", "img", "input", "link", "meta", "wbr", "col", "source"}
    CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["", {}, []]
        self.stack = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while len(self.stack) > 1 and self.stack[-1][0] in self.CLOSES.get(tag, ()):
            self.stack.pop()
        node = [tag, dict(attrs), []]
        self.stack[-1][2].append(node)
        if tag not in self.VOID:
            self.stack.append(node)

    def handle_endtag(self, tag: str) -> None:
        if any(n[0] == tag for n in self.stack[1:]):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.stack[-1][2].append(data)


def _find(node: list, test: Callable[[list], bool]) -> list | None:
    for c in node[2]:
        if isinstance(c, list):
            if test(c):
                return c
            if (found := _find(c, test)) is not None:
                return found
    return None


def _strings(node: list) -> Iterator[str]:
    for c in node[2]:
        if isinstance(c, str):
            yield c
        elif c[0] not in CHROME:
            yield from _strings(c)


def _text(node: list, raw: bool = False) -> str:
    """The text in an element: as it stands, or its parts without white space around them, set apart by blanks."""
    return "".join(_strings(node)) if raw else " ".join(t for x in _strings(node) if (t := x.strip()))


def _rows(node: list) -> list[list[str]]:
    out: list[list[str]] = []
    for c in node[2]:
        if isinstance(c, list):
            if c[0] == "tr":
                out.append([_text(x) for x in c[2] if isinstance(x, list) and x[0] in ("td", "th")])
            elif c[0] != "table":
                out += _rows(c)
    return out


def parse_html(data: bytes) -> tuple[str | None, dict, list[dict]]:
    """The content of main, role=main, article or body, without page chrome; headings open sections, nested blocks come once, of tables the outermost."""
    page = _Page()
    page.feed(decode_text(data))
    page.close()
    tag = lambda name: lambda n: n[0] == name
    tests = (tag("main"), lambda n: n[1].get("role") == "main", tag("article"), tag("body"))
    root = next((r for t in tests if (r := _find(page.root, t)) is not None), page.root)
    titled = _find(page.root, tag("title"))
    title = _text(titled) if titled else None
    blocks: list[dict] = []
    section: list[dict | None] = [None]
    loose: list[str] = []

    def flush() -> None:
        t = re.sub(r"\s+", " ", "".join(loose)).strip()
        loose.clear()
        if t:
            blocks.append(block("paragraph", t, None, section[0]))

    def walk(node: list) -> None:
        for c in node[2]:
            if isinstance(c, str):
                loose.append(c)
                continue
            name = c[0]
            if name in CHROME or name in ("head", "title"):
                continue
            if re.fullmatch("h[1-6]", name):
                flush()
                if t := _text(c):
                    section[0] = locator("section", t, sum(b["kind"] == "heading" for b in blocks) + 1)
                    blocks.append(block("heading", t, int(name[1]), section[0]))
            elif name == "table":
                flush()
                if rows := [r for r in _rows(c) if r]:
                    blocks.append(table_block(rows, section[0]))
            elif name == "pre":
                flush()
                blocks.append(block("code", _text(c, True).strip("\n"), None, section[0]))
            elif name in ("p", "li"):  # what lies in it is told with it
                flush()
                if t := _text(c):
                    blocks.append(block("list_item" if name == "li" else "paragraph", t, None, section[0]))
            elif name in ("a", "b", "i", "em", "strong", "span", "code", "sup", "sub", "u", "small", "abbr", "time", "mark", "cite", "q", "br", "img"):
                loose.append(" " if name == "br" else f" {_text(c, True)} ")
            else:
                flush()
                walk(c)
                flush()
        return None

    walk(root)
    flush()
    if title is None:
        title = next((b["text"] for b in blocks if b["kind"] == "heading"), None)
    return title, {}, blocks


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _attr(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _runs(e: ElementTree.Element) -> str:
    return "".join((x.text or "") if _local(x) == "t" else "\t" if _local(x) == "tab" else "\n" if _local(x) == "br" else "" for x in e.iter())


def _core(z: zipfile.ZipFile) -> dict:
    root = _xml(z, "docProps/core.xml")
    return {} if root is None else {_local(e): e.text for e in root if e.text and _local(e) in ("title", "creator", "created", "modified", "subject", "keywords")}


def parse_docx(data: bytes) -> tuple[str | None, dict, list[dict]]:
    """Paragraphs, heading styles with levels 1 to 6, tables, core metadata."""
    z = zipfile.ZipFile(io.BytesIO(data))
    body = next(e for e in _xml(z, "word/document.xml").iter() if _local(e) == "body")
    blocks: list[dict] = []
    for e in body:
        if _local(e) == "p":
            text = _runs(e).strip()
            if not text:
                continue
            style = next((_attr(s, "val") or "" for s in e.iter() if _local(s) == "pStyle"), "")
            m = re.match(r"[Hh]eading\s*(\d+)", style)
            if m or style == "Title":
                blocks.append(block("heading", text, min(6, max(1, int(m.group(1)))) if m else 1))
            else:
                blocks.append(block("list_item" if style.startswith("List") or any(_local(s) == "numPr" for s in e.iter()) else "paragraph", text))
        elif _local(e) == "tbl":
            blocks.append(table_block([[_runs(c).strip() for c in r if _local(c) == "tc"] for r in e if _local(r) == "tr"]))
    meta = _core(z)
    return meta.get("title") or next((b["text"] for b in blocks if b["kind"] == "heading"), None), meta, blocks


def parse_pptx(data: bytes) -> tuple[str | None, dict, list[dict]]:
    """Slides in the order of their numbers; a title placeholder is a heading."""
    z = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((int(m.group(1)), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    blocks: list[dict] = []
    for i, (number, name) in enumerate(slides, 1):
        at = locator("slide", str(number), i)
        for shape in (e for e in _xml(z, name).iter() if _local(e) in ("sp", "tbl")):
            if _local(shape) == "tbl":
                blocks.append(table_block([[_runs(c).strip() for c in r if _local(c) == "tc"] for r in shape if _local(r) == "tr"], at))
                continue
            is_title = any(_local(p) == "ph" and _attr(p, "type") in ("title", "ctrTitle") for p in shape.iter())
            for p in (x for x in shape.iter() if _local(x) == "p"):
                if t := _runs(p).strip():
                    blocks.append(block("heading" if is_title else "paragraph", t, 2 if is_title else None, at))
    meta = _core(z)
    return meta.get("title") or next((b["text"] for b in blocks if b["kind"] == "heading"), None), meta, blocks


def parse_xlsx(data: bytes, max_rows: int | None = MAX_ROWS) -> tuple[str | None, dict, list[dict]]:
    """A table for each sheet with at most ``max_rows`` rows below the header (all with None); whole floats read as integers."""
    z = zipfile.ZipFile(io.BytesIO(data))
    strings = _xml(z, "xl/sharedStrings.xml")
    shared = [_runs(e) for e in strings if _local(e) == "si"] if strings is not None else []
    rels = {_attr(e, "Id"): _attr(e, "Target") for e in _xml(z, "xl/_rels/workbook.xml.rels")}
    blocks, names, dropped = [], [], {}
    for i, s in enumerate((e for e in _xml(z, "xl/workbook.xml").iter() if _local(e) == "sheet"), 1):
        target = next(v for k, v in s.attrib.items() if k.endswith("}id"))
        root = _xml(z, "xl/" + rels[target].lstrip("/").removeprefix("xl/"))
        rows = []
        for r in (e for e in root.iter() if _local(e) == "row"):
            cells: list[str] = []
            for c in (x for x in r if _local(x) == "c"):
                col = 0
                for ch in re.match("[A-Z]*", c.get("r", "")).group():
                    col = 26 * col + ord(ch) - 64
                value = next((x.text or "" for x in c if _local(x) == "v"), None)
                kind = c.get("t")
                if kind == "s" and value is not None:
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = _runs(c)
                elif value is not None and re.fullmatch(r"-?\d+\.0+", value):
                    value = value.split(".")[0]
                cells += [""] * (max(col, len(cells) + 1) - 1 - len(cells)) + [value or ""]
            if any(cells):
                rows.append(cells)
        names.append(s.get("name"))
        rows, more = _capped(rows, max_rows)
        if more:
            dropped[s.get("name")] = more
        if rows:
            blocks.append(table_block(rows, locator("sheet", s.get("name"), i)))
    return _core(z).get("title"), {"sheet_names": names} | ({"truncated_rows": dropped} if dropped else {}), blocks


def parse_pdf(data: bytes) -> tuple[str | None, dict, list[dict]]:
    """Paragraphs of each page with page locators (S13); needs the optional pypdf."""
    from pypdf import PdfReader

    reader = PdfReader(io.BytesIO(data))
    info = {k.lstrip("/"): str(v) for k, v in (reader.metadata or {}).items()}
    blocks = [block("paragraph", p, None, locator("page", str(i), i)) for i, page in enumerate(reader.pages, 1) for p in paragraphs(page.extract_text() or "")]
    return info.get("Title"), info, blocks


Parsed = tuple[str | None, dict, list[dict]]
PARSERS: dict[str, Callable[..., Parsed]] = {
    "text": lambda data, **_: parse_text(data), "markdown": lambda data, **_: parse_markdown(data), "html": lambda data, **_: parse_html(data), "csv": lambda data, **o: parse_delimited(data, **o), "tsv": lambda data, **o: parse_delimited(data, "\t", **o),
    "docx": lambda data, **_: parse_docx(data), "pptx": lambda data, **_: parse_pptx(data), "xlsx": lambda data, max_rows=MAX_ROWS, **_: parse_xlsx(data, max_rows), "pdf": lambda data, **_: parse_pdf(data),
}


def register(name: str, parser: Callable[[bytes], Parsed], *extensions: str) -> None:
    """Add a format."""
    PARSERS[name] = lambda data, **_: parser(data)
    EXTENSIONS.update(dict.fromkeys(extensions, name))


def from_row(x: dict) -> dict:
    """A block of a row as pandas gives it: absent numbers may come as NaN or as floats."""
    number = lambda v: None if v is None or v != v else int(v)
    at = x["locator"]
    return block(x["kind"], x["text"] or "", number(x["level"]), None if at is None else locator(at["kind"], at["label"], number(at["index"])))


#: How a block of each kind stands in a document's text.
FORMS = {"heading": "{marks} {text}", "list_item": "- {text}", "code": "```\n{text}\n```"}


def locator_heading(at: dict | None) -> str | None:
    """The heading that tells where the next blocks come from; sections have their own headings."""
    title = LOCATOR_TITLES.get((at or {}).get("kind"))
    return title and f"## {title} {at['label']}"


def rendering(blocks: list[dict]) -> list[str]:
    """The text of each block as it stands in the document's, with the heading of its place where that changes."""
    known = [None, *accumulate((b["locator"] for b in blocks), lambda last, at: last if at is None else at)]
    out = []
    for b, before in zip(blocks, known, strict=False):
        text = FORMS.get(b["kind"], "{text}").format(marks="#" * (b["level"] or 1), text=b["text"] or "")
        head = locator_heading(b["locator"]) if b["locator"] != before else None  # headings aren't repeated
        out.append(f"{head}\n\n{text}" if head else text)
    return out


def to_markdown(blocks: list[dict]) -> str:
    return "\n\n".join(rendering(blocks)) + "\n" if blocks else ""


def parse_bytes(name: str, data: bytes, max_rows: int | None = MAX_ROWS) -> dict:
    """One document of a file; a parser's failure falls back to text with the error kept (S12). ``max_rows``: of a sheet, None for all."""
    form, error = detect(name, data), None
    try:
        title, meta, blocks = PARSERS[form](data, name=name, max_rows=max_rows)
    except Exception as e:  # noqa: BLE001 - any file may come in
        error = f"{form}: {type(e).__name__}: {e}"[:500]
        title, meta, blocks = parse_text(data)
    return {"path": name, "format": form, "title": title, "sha256": hashlib.sha256(data).hexdigest(), "size": len(data), "parser_error": error, "metadata": json.dumps(meta, ensure_ascii=False, sort_keys=True), "blocks": blocks, "markdown": to_markdown(blocks)}


def read_documents(spark: SparkSession, path: str, max_rows: int | None = MAX_ROWS) -> DataFrame:
    """Every file under ``path`` as a document."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([parse_bytes(p, bytes(c), max_rows) for p, c in zip(pdf["path"], pdf["content"], strict=True)], columns=["path", "format", "title", "sha256", "size", "parser_error", "metadata", "blocks", "markdown"])

    return files.mapInPandas(run, SCHEMA)
