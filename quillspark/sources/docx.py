"""Word files as a Spark data source, read and written with the standard library's zip and XML.

spark.dataSource.register(Docx) makes it known; scan() and write() do. Elements of a file's body come in order, from 0:

    heading, level from 1 (a style named "heading n", or an outline level), list (its level from 0), paragraph, table (cells)

A cell that spans columns stands in each, one that spans rows in each row, so a table's rows have one width. Deleted text and the
fallbacks of drawings are left out. A file that isn't a readable Word file is one row of kind `broken` with the fault's
name in `error`; a store that can't be reached is a failed task, which Spark repeats. One file is held in memory at a time.
"""

from __future__ import annotations

import io
import posixpath
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from itertools import groupby
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

ELEMENTS = "file string, ordinal long, kind string, level int, style string, text string, cells array<array<string>>, error string"

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
FALLBACK = "{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback"
FAULTS = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, EOFError, NotImplementedError, RuntimeError, ValueError, zlib.error)
#: What XML 1.0 can't hold.
FORBIDDEN = f"[\x00-\x08\x0b\x0c\x0e-\x1f{chr(0xFFFE)}{chr(0xFFFF)}]"


def _store(path: str):
    """pyarrow's file system for a path as Spark writes it (file:/a, /a, hdfs://h/a), and the path in it."""
    from pyarrow import fs

    if re.match(r"file:/(?!//)", path):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _text(node) -> str:
    """The text that a paragraph shows; paragraphs inside it (text boxes) on lines of their own."""
    out = []

    def walk(at):
        for child in at:
            if child.tag == f"{W}t":
                out.append(child.text or "")
            elif child.tag in (f"{W}tab", f"{W}ptab"):
                out.append("\t")
            elif child.tag in (f"{W}br", f"{W}cr"):
                out.append("\n")
            elif child.tag == f"{W}noBreakHyphen":
                out.append("-")
            elif child.tag == f"{W}p":
                out.append("\n")
                walk(child)
            elif child.tag not in (f"{W}pPr", f"{W}rPr", FALLBACK):
                walk(child)

    walk(node)
    return "".join(out)


def _value(node, path: str) -> str | None:
    found = node.find(path) if node is not None else None
    return None if found is None else found.get(f"{W}val", "")


def _number(text: str | None, other: int) -> int:
    return int(text) if text and re.fullmatch(r"\d{1,4}", text) else other


def _styles(document: zipfile.ZipFile) -> dict[str, tuple[str, int | None, bool]]:
    """Style id to (name, heading level, whether it is a list), with what a style inherits."""
    if "word/styles.xml" not in document.namelist():
        return {}
    own = {}
    for style in ElementTree.fromstring(document.read("word/styles.xml")).iter(f"{W}style"):
        name, outline = _value(style, f"{W}name") or "", _value(style, f"{W}pPr/{W}outlineLvl")
        heading = re.fullmatch(r"heading (\d)", name.lower())
        level = int(heading[1]) if heading else _number(outline, 9) + 1 if outline is not None else None
        own[style.get(f"{W}styleId", "")] = (name, level, style.find(f"{W}pPr/{W}numPr") is not None, _value(style, f"{W}basedOn"))

    found = {}
    for key, (name, _, _, _) in own.items():
        level, listed, at, seen = None, False, key, set()
        while at in own and at not in seen:
            seen.add(at)
            level, listed = own[at][1] if level is None else level, listed or own[at][2]
            at = own[at][3]
        found[key] = (name, level if level is not None and level <= 9 else None, listed)
    return found


def _paragraph(node, styles: dict) -> tuple[str, int | None, str | None, str]:
    """(kind, level, style, text)."""
    properties = node.find(f"{W}pPr")
    key = _value(properties, f"{W}pStyle")
    guessed = re.fullmatch(r"heading(\d)", (key or "").lower())
    name, level, listed = styles.get(key, (key, int(guessed[1]) if guessed else None, False))
    outline = _value(properties, f"{W}outlineLvl")
    if outline is not None:
        level = _number(outline, 9) + 1 if _number(outline, 9) < 9 else None
    if level is not None:
        return "heading", level, name, _text(node)
    numbered = properties.find(f"{W}numPr") if properties is not None else None
    if listed or (numbered is not None and _value(numbered, f"{W}numId") != "0"):
        return "list", _number(_value(numbered, f"{W}ilvl"), 0), name, _text(node)
    return "paragraph", None, name, _text(node)


def _below(node, tag: str) -> Iterator:
    """Children with a tag, also inside content controls and marked insertions."""
    for child in node:
        if child.tag == tag:
            yield child
        elif child.tag in (f"{W}sdt", f"{W}sdtContent", f"{W}ins", f"{W}customXml"):
            yield from _below(child, tag)


def _inside(node) -> Iterator[str]:
    for child in node:
        if child.tag == f"{W}p":
            yield _text(child)
        elif child.tag == f"{W}tbl":
            yield from ("\t".join(row) for row in _cells(child))
        elif child.tag in (f"{W}sdt", f"{W}sdtContent", f"{W}ins", f"{W}customXml"):
            yield from _inside(child)


def _cells(table) -> list[list[str]]:
    rows, above = [], []
    for row in _below(table, f"{W}tr"):
        line = [""] * _number(_value(row, f"{W}trPr/{W}gridBefore"), 0)
        for cell in _below(row, f"{W}tc"):
            merge = cell.find(f"{W}tcPr/{W}vMerge")
            goes_on = merge is not None and merge.get(f"{W}val", "continue") == "continue"
            text = above[len(line)] if goes_on and len(line) < len(above) else "\n".join(_inside(cell))
            line += [text] * max(1, _number(_value(cell, f"{W}tcPr/{W}gridSpan"), 1))
        rows.append(line)
        above = line
    width = max(map(len, rows), default=0)
    return [line + [""] * (width - len(line)) for line in rows]


def elements(content: bytes) -> list[tuple[str, int | None, str | None, str | None, list[list[str]] | None]]:
    """A file's body: (kind, level, style, text, cells). Raises one of FAULTS where it isn't a readable Word file."""
    with zipfile.ZipFile(io.BytesIO(content)) as document:
        styles, found, inside = _styles(document), [], None
        with document.open("word/document.xml") as xml:
            for event, node in ElementTree.iterparse(xml, events=("start", "end")):
                if event == "start":
                    if inside is None and node.tag in (f"{W}p", f"{W}tbl"):
                        inside = node
                elif node is inside:
                    found.append((*_paragraph(node, styles), None) if node.tag == f"{W}p" else ("table", None, _value(node, f"{W}tblPr/{W}tblStyle"), None, _cells(node)))
                    node.clear()
                    inside = None
        return found


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class DocxReader(DataSourceReader):
    """Files in groups of `group_bytes` or `group_files` by name, each a partition; a file belongs to one group."""

    def __init__(self, options):
        self.path, self.most, self.many = options["path"], int(options.get("group_bytes", 16 << 20)), int(options.get("group_files", 250))

    def partitions(self):
        from pyarrow import fs

        store, root = _store(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        there = store.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info]
        groups, size = [[]], 0
        hidden = ("~$", ".", "_")  # locks of open files, and files that are being written
        for file in sorted((f for f in there if f.is_file and f.path.lower().endswith(".docx") and not f.base_name.startswith(hidden)), key=lambda f: f.path):
            if groups[-1] and (size + file.size > self.most or len(groups[-1]) == self.many):
                groups, size = [*groups, []], 0
            groups[-1].append(file.path)
            size += file.size
        return [Files(g) for g in groups]

    def read(self, partition):
        store, root = _store(self.path)
        for name in partition.names:
            with store.open_input_stream(name) as file:
                content = file.read()
            short = posixpath.relpath(name, root) if name != root else posixpath.basename(name)
            try:
                found = elements(content)
            except FAULTS as fault:
                yield short, None, "broken", None, None, None, None, type(fault).__name__
                continue
            for n, element in enumerate(found):
                yield short, n, *element, None


def _run(text: str | None) -> str:
    text = re.sub(FORBIDDEN, "�", text or "")
    parts = re.split(r"([\t\n])", text)
    marks = {"\t": "<w:tab/>", "\n": "<w:br/>"}
    return "<w:r>" + "".join(marks.get(p) or f'<w:t xml:space="preserve">{escape(p, {chr(13): "&#13;"})}</w:t>' for p in parts if p) + "</w:r>"


def _body(row) -> str:
    if row["kind"] == "table":
        cells = row["cells"] or []
        lines = ("<w:tr>" + "".join(f"<w:tc><w:p>{_run(c)}</w:p></w:tc>" for c in line) + "</w:tr>" for line in cells)
        return f"<w:tbl><w:tblPr/><w:tblGrid/>{''.join(lines)}</w:tbl>"
    level = row["level"]
    properties = ""
    if row["kind"] == "heading":
        properties = f'<w:pPr><w:pStyle w:val="Heading{min(max(level or 1, 1), 9)}"/></w:pPr>'
    elif row["kind"] == "list":
        properties = f'<w:pPr><w:numPr><w:ilvl w:val="{min(max(level or 0, 0), 8)}"/><w:numId w:val="1"/></w:numPr></w:pPr>'
    return f"<w:p>{properties}{_run(row['text'])}</w:p>"


HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
NAMESPACE = W.strip("{}")
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml"


def _parts(levels: set[int], lists: bool) -> dict[str, str]:
    """The parts of a package beside its body: styles and numbering only where the body uses them."""
    used = {"styles": bool(levels), "numbering": lists}
    names = [n for n, u in used.items() if u]
    types = "".join(f'<Override PartName="/word/{n}.xml" ContentType="{TYPE}.{k}+xml"/>' for n, k in [("document", "document.main"), *((n, n) for n in names)])
    relation = lambda i, kind, target: f'<Relationship Id="r{i}" Type="{OFFICE}/{kind}" Target="{target}"/>'
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{types}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships">{relation(1, "officeDocument", "word/document.xml")}</Relationships>',
    }
    if names:
        parts["word/_rels/document.xml.rels"] = f'<Relationships xmlns="{PACKAGE}/relationships">{"".join(relation(i, n, f"{n}.xml") for i, n in enumerate(names))}</Relationships>'
    if levels:
        styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{i}"><w:name w:val="heading {i}"/><w:pPr><w:outlineLvl w:val="{i - 1}"/></w:pPr></w:style>' for i in sorted(levels))
        parts["word/styles.xml"] = f'<w:styles xmlns:w="{NAMESPACE}">{styles}</w:styles>'
    if lists:
        steps = "".join(f'<w:lvl w:ilvl="{i}"><w:numFmt w:val="decimal"/><w:lvlText w:val="%{i + 1}."/></w:lvl>' for i in range(9))
        parts["word/numbering.xml"] = f'<w:numbering xmlns:w="{NAMESPACE}"><w:abstractNum w:abstractNumId="0">{steps}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>'
    return parts


def document(rows) -> bytes:
    """A Word file of rows with kind, level, text and cells; equal rows give equal bytes."""
    out, levels, lists = io.BytesIO(), set(), False
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
        body = zipfile.ZipInfo("word/document.xml")
        body.compress_type = zipfile.ZIP_DEFLATED
        with made.open(body, "w") as xml:
            xml.write(f'{HEAD}<w:document xmlns:w="{NAMESPACE}"><w:body>'.encode())
            for row in rows:
                xml.write(_body(row).encode("utf-8", "replace"))
                lists = lists or row["kind"] == "list"
                if row["kind"] == "heading":
                    levels.add(min(max(row["level"] or 1, 1), 9))
            xml.write(b"<w:sectPr/></w:body></w:document>")
        for name, part in _parts(levels, lists).items():
            made.writestr(zipfile.ZipInfo(name), HEAD + part, zipfile.ZIP_DEFLATED)
    return out.getvalue()


class Written(WriterCommitMessage):
    pass


class DocxWriter(DataSourceWriter):
    """Rows sorted by file within partitions, a file in one partition; or a row a file with its elements in an array.
    A file is moved into place whole; a repeated task writes the same."""

    def __init__(self, options, whole: bool):
        self.path, self.whole = options["path"], whole

    def write(self, iterator):
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        files = ((r["file"], r["elements"] or []) for r in iterator) if self.whole else groupby(iterator, key=lambda r: r["file"])
        for file, rows in files:
            if file is None:
                raise ValueError("a row has no file")
            part = f"{root}/_{uuid.uuid4().hex}.part"
            with store.open_output_stream(part) as out:
                out.write(document(rows))
            store.move(part, f"{root}/{file}")
        return Written()

    def commit(self, messages):
        pass

    def abort(self, messages):
        pass


class Docx(DataSource):
    @classmethod
    def name(cls):
        return "docx"

    def schema(self):
        return ELEMENTS

    def reader(self, schema):
        return DocxReader(self.options)

    def writer(self, schema, overwrite):
        return DocxWriter(self.options, "elements" in schema.names)


def scan(spark: SparkSession, path: str, group_bytes: int = 16 << 20) -> DataFrame:
    """The elements of all .docx files below a folder, or of one file; `file` is the name below the folder."""
    spark.dataSource.register(Docx)
    return spark.read.format("docx").option("group_bytes", group_bytes).load(path)


def file_name(key: Column) -> Column:
    """A file's name for any key: what isn't a letter, a digit, or one of `_.-~` is percent-encoded, so it can't lead out of the folder."""
    return F.concat(F.lit("d"), F.replace(F.url_encode(key.cast("string")), F.lit("+"), F.lit("%20")), F.lit(".docx"))


def write(rows: DataFrame, path: str) -> None:
    """Elements (file, ordinal, kind, level, text, cells) as a Word file for each `file`, in order of the ordinals; or a row a file
    (file, elements: an array of kind, level, text, cells), which needs no shuffle.

    Files that are there already are replaced. Characters that XML can't hold become U+FFFD. A document is written by one task.
    """
    rows.sparkSession.dataSource.register(Docx)
    if "elements" in rows.columns:
        ready = rows.select("file", "elements")
    else:
        ready = rows.select("file", "ordinal", "kind", "level", "text", "cells").repartition("file").sortWithinPartitions("file", "ordinal")
    ready.write.format("docx").option("path", path).mode("append").save()


def sound(rows: DataFrame) -> DataFrame:
    """Elements of readable files."""
    return rows.where("kind <> 'broken'")


def broken(rows: DataFrame) -> DataFrame:
    """Files that couldn't be read, with the fault's name."""
    return rows.where("kind = 'broken'").select("file", "error")
