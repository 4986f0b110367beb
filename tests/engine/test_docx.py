import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.sources import docx

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
ROW = ("kind", "level", "text", "cells")


def packed(body, styles=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        if styles:
            z.writestr("word/styles.xml", f"<w:styles {NS}>{styles}</w:styles>")
    return out.getvalue()


def text(t):
    return f"<w:r><w:t>{t}</w:t></w:r>"


def test_what_word_writes():
    styles = (
        '<w:style w:styleId="berschrift2"><w:name w:val="heading 2"/></w:style>'
        '<w:style w:styleId="Own"><w:name w:val="Own"/><w:basedOn w:val="berschrift2"/></w:style>'
        '<w:style w:styleId="Loop"><w:name w:val="Loop"/><w:basedOn w:val="Loop"/></w:style>'
        '<w:style w:styleId="Bullets"><w:name w:val="List Bullet"/><w:pPr><w:numPr/></w:pPr></w:style>'
    )
    para = lambda props, inner: f"<w:p><w:pPr>{props}</w:pPr>{inner}</w:p>"
    body = (
        para('<w:pStyle w:val="Own"/>', text("A") + "<w:r><w:tab/></w:r>" + text("B"))
        + para('<w:outlineLvl w:val="3"/>', text("outline"))
        + para('<w:pStyle w:val="Bullets"/>', text("point"))
        + para('<w:numPr><w:ilvl w:val="2"/><w:numId w:val="5"/></w:numPr>', text("deep"))
        + para('<w:numPr><w:numId w:val="0"/></w:numPr>', text("no list"))
        + para('<w:pStyle w:val="Loop"/>', f"<w:ins>{text('new')}</w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del>")
        + f"<w:sdt><w:sdtContent><w:p>{text('control')}</w:p></w:sdtContent></w:sdt>"
        + f"<w:p>{text('shape')}<mc:AlternateContent><mc:Choice><w:p>{text('box')}</w:p></mc:Choice><mc:Fallback><w:p>{text('box')}</w:p></mc:Fallback></mc:AlternateContent></w:p>"
        + "<w:p/>"
    )
    assert [e[:2] + e[3:4] for e in docx.elements(packed(body, styles))] == [
        ("heading", 2, "A\tB"), ("heading", 4, "outline"), ("list", 0, "point"), ("list", 2, "deep"), ("paragraph", None, "no list"),
        ("paragraph", None, "new"), ("paragraph", None, "control"), ("paragraph", None, "shape\nbox"), ("paragraph", None, ""),
    ]


def test_tables_have_one_width():
    cell = lambda t, props="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p>{text(t)}</w:p></w:tc>"
    nested = f"<w:tc><w:p>{text('x')}</w:p><w:tbl><w:tr>{cell('y')}{cell('z')}</w:tr></w:tbl></w:tc>"
    body = (
        f"<w:tbl><w:tr>{cell('wide', '<w:gridSpan w:val=\"2\"/>')}{cell('tall', '<w:vMerge w:val=\"restart\"/>')}</w:tr>"
        f"<w:tr>{cell('a')}{nested}{cell('', '<w:vMerge/>')}</w:tr><w:tr>{cell('b')}</w:tr></w:tbl>"
    )
    assert docx.elements(packed(body)) == [("table", None, None, None, [["wide", "wide", "tall"], ["a", "x\ny\tz", "tall"], ["b", "", ""]])]
    assert docx.elements(packed("<w:tbl/>"))[0][4] == []


LINE = st.text(st.characters(exclude_categories=["Cs"]), max_size=20)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(
    st.tuples(st.just("heading"), st.integers(1, 9), LINE, st.none()), st.tuples(st.just("list"), st.integers(0, 8), LINE, st.none()),
    st.tuples(st.just("paragraph"), st.none(), LINE, st.none()),
    st.integers(1, 3).flatmap(lambda w: st.tuples(st.just("table"), st.none(), st.none(), st.lists(st.lists(LINE, min_size=w, max_size=w), max_size=3))),
), max_size=6))
def test_round_trip(rows):
    import re

    clean = lambda t: None if t is None else re.sub(docx.FORBIDDEN, "�", t)
    made = docx.document(dict(zip(ROW, r, strict=True)) for r in rows)
    want = [(kind, level, clean(t), cells and [[clean(c) for c in line] for line in cells]) for kind, level, t, cells in rows]
    assert [(e[0], e[1], e[3], e[4] or None) for e in docx.elements(made)] == [(k, v, t, c or None) for k, v, t, c in want]
    assert made == docx.document(dict(zip(ROW, r, strict=True)) for r in rows)


def test_scan_and_write(spark, tmp_path):
    at = f"file://{tmp_path}/made"
    keys = [f"a/../{i} ü" for i in range(30)]
    rows = spark.createDataFrame([(k, n, "paragraph", None, f"{k} {n}", None) for k in keys for n in range(40)], "k string, ordinal long, kind string, level int, text string, cells array<array<string>>")
    docx.write(rows.withColumn("file", docx.file_name(F.col("k"))), at)
    folder = tmp_path / "made"
    assert len(list(folder.iterdir())) == 30 and not [p for p in tmp_path.rglob("*") if p.is_file() and p.parent != folder]
    item = F.struct("ordinal", "kind", "level", "text", "cells")
    whole = rows.groupBy("k").agg(F.array_sort(F.collect_list(item)).alias("elements")).withColumn("file", docx.file_name(F.col("k")))
    docx.write(whole.unionByName(whole.limit(1).withColumns({"file": F.lit("none.docx"), "elements": F.lit(None).cast(whole.schema["elements"].dataType)})), f"file://{tmp_path}/whole")
    bytes_of = lambda at: {p.name: p.read_bytes() for p in at.iterdir()}
    again = bytes_of(tmp_path / "whole")
    assert docx.elements(again.pop("none.docx")) == [] and again == bytes_of(folder)
    (folder / "broken.docx").write_bytes(b"no zip")
    (folder / "cut.docx").write_bytes(next(folder.glob("d*")).read_bytes()[:-100])
    (folder / "empty.DOCX").write_bytes(b"")
    (folder / "~$lock.docx").write_bytes(b"x")
    (folder / "notes.txt").write_bytes(b"x")
    with zipfile.ZipFile(folder / "other.docx", "w") as z:
        z.writestr("a", "b")
    (folder / "xml.docx").write_bytes(packed("<w:p>"))
    found = docx.scan(spark, at, group_bytes=20_000)
    assert found.rdd.getNumPartitions() > 1
    texts = sorted((r.text, r.ordinal) for r in docx.sound(found).collect())
    assert texts == sorted((f"{k} {n}", n) for k in keys for n in range(40))
    assert {tuple(r) for r in docx.broken(found).collect()} == {("broken.docx", "BadZipFile"), ("cut.docx", "BadZipFile"), ("empty.DOCX", "BadZipFile"), ("other.docx", "KeyError"), ("xml.docx", "ParseError")}
    one = docx.scan(spark, f"{at}/broken.docx")
    assert [r.file for r in one.collect()] == ["broken.docx"]
    docx.write(rows.where("k = ''").withColumn("file", F.lit("x.docx")), f"file://{tmp_path}/none")
    (tmp_path / "bare").mkdir()
    assert docx.scan(spark, f"file://{tmp_path}/bare").count() == 0
    with pytest.raises(Exception, match="FileNotFoundError"):
        docx.scan(spark, f"file://{tmp_path}/absent").count()
