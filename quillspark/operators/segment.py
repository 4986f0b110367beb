"""Segmentation (X1, X2, X4, X5, X7, X8, X10, X11, X14, W11): per-row expressions over arrays, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import is_heading


def strip(text: Column) -> Column:
    """Without white space at both ends (trim knows spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def let(value: Column, body) -> Column:
    """body(value), the value computed once: what a lambda uses is bound outside it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(items: Column, start: Column, step, kind: str, size: int = 512) -> Column:
    """The state after each item, as array<kind>: start, then step(state, item) for one after the other.

    An array that grows item by item costs the square of its length. Here states are gathered in blocks of `size`, and the
    blocks joined once, so a text of millions of lines costs time in proportion. items must be bound (see let).
    """
    none, initial = F.array().cast(f"array<{kind}>"), start.cast(kind)

    def block(state, first, stop):
        grown = lambda acc, i: let(step(acc["at"], F.get(items, i)).cast(kind), lambda new: F.struct(new.alias("at"), F.concat(acc["out"], F.array(new)).alias("out")))
        return F.aggregate(F.sequence(first, stop - 1), F.struct(state.alias("at"), none.alias("out")), grown)

    def outer(acc, b):
        first = b * size
        return let(block(acc["at"], first, F.least(first + size, F.size(items))), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int"))
    begun = F.struct(initial.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.when(F.size(items) > 0, F.aggregate(blocks, begun, outer, lambda acc: F.flatten(acc["out"]))).otherwise(none)


def part(items: Column, first: Column, stop: Column) -> Column:
    """The items [first, stop) of a bound array of strings, each taken by its place (slice would copy the whole array each time)."""
    return F.when(first < stop, F.transform(F.sequence(first, stop - 1), lambda i: F.get(items, i))).otherwise(F.array().cast("array<string>"))


def places(items: Column, test) -> Column:
    """The places of the items of a bound array that pass the test."""
    return F.filter(F.transform(items, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())


def lines_to_passages(docs: DataFrame, doc: str, text: Column, least: int = 30, most: int = 5000) -> DataFrame:
    """(doc, n, section, text): lines under the heading before them. Headings are found first, and the lines between them joined."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))

    def sections(v):
        heads = F.concat(F.array(F.lit(-1)), places(v, is_heading))
        return let(heads, lambda h: F.transform(h, lambda at, i: F.struct(F.when(at >= 0, F.get(v, at)).otherwise("").alias("section"), F.trim(F.array_join(part(v, at + 1, F.coalesce(F.get(h, i + 1), F.size(v))), " ")).alias("text"))))

    kept = F.filter(let(lines, sections), lambda s: F.char_length(s["text"]) >= least)
    each = docs.select(doc, F.posexplode(kept).alias("n", "p"))
    return each.select(doc, (F.col("n") + 1).alias("n"), "p.section", F.substring("p.text", 1, most).alias("text"))


# The source's eight patterns of a numbered section, each with an id and a title, in its order.
NUMBERED = (
    r"^(\d+(?:\.\d+)+)\s+(.+?)$",
    r"^(\d+(?:\.\d+)*)\s+([A-Z][^.]{3,100})$",
    r"^Section\s+(\d+(?:\.\d+)*)\s*[:–-]\s*(.+?)$",
    r"^(\d+\.\d+)\s+(.+?)$",
    r"^(\d+)\)\s+(.+?)$",
    r"^(\d+)\.\s+([A-Za-z].+?)$",
    r"^([A-Z]\d+)\s+(.+?)$",
    r"^(\d+)\s+([A-Z][^.]{3,100})$",
)


def section_heading(line: Column) -> Column:
    """struct<id, title> by the first pattern with a valid match, else null. As in the source, a bare number is no valid id."""

    def matched(pattern):
        number, title = (F.regexp_extract(line, "(?Ud)" + pattern, i) for i in (1, 2))
        title = strip(title)
        size = F.char_length(title)
        valid = (F.char_length(number) < 20) & (size > 3) & (size < 200) & ~F.lower(title).startswith("page") & ~number.rlike(r"(?U)^\d+$")
        return F.when(valid, F.struct(number.alias("id"), title.alias("title")))

    return F.coalesce(*map(matched, NUMBERED))


def numbered_sections(docs: DataFrame, doc: str, text: Column, least: int = 20, whole: int = 50) -> DataFrame:
    """(doc, n, id, title, text): the lines from each numbered heading on, heading first, where longer than `least`.

    Lines before the first heading belong to no section; a text without any section is one, if longer than `whole`.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: x != "")
    kind = "array<struct<id:string,title:string,text:string>>"
    numbered = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), section_heading(x).alias("head"))), lambda x: x["head"].isNotNull())
    each = docs.select(doc, lines.alias("_lines"), numbered.alias("_heads"))

    def section(head, i):
        end = F.coalesce(F.get("_heads", i + 1)["at"], F.size("_lines"))
        body = F.array_join(F.slice("_lines", head["at"] + 1, end - head["at"]), "\n")
        return F.struct(head["head"]["id"].alias("id"), head["head"]["title"].alias("title"), body.alias("text"))

    found = F.filter(F.transform("_heads", section), lambda s: F.char_length(s["text"]) > least)
    full = F.array_join("_lines", "\n")
    one = F.when(F.char_length(full) > whole, F.array(F.struct(F.lit("1").alias("id"), F.lit("Full Document").alias("title"), full.alias("text")))).otherwise(F.array().cast(kind))
    return each.select(doc, F.posexplode(F.when(F.size(found) > 0, found).otherwise(one)).alias("n", "s")).select(doc, (F.col("n") + 1).alias("n"), "s.id", "s.title", "s.text")


def markdown_sections(docs: DataFrame, doc: str, text: Column) -> DataFrame:
    """(doc, n, section, text) at ``#`` headings; what comes before the first has an empty section."""
    parts = F.filter(F.split(text, r"(?m)(?=^#{1,6}\s)"), lambda p: F.trim(p) != "")
    each = docs.select(doc, F.posexplode(parts).alias("n", "part"))
    head = r"(?s)^#{1,6}\s+([^\n]*)\n?(.*)$"
    titled = F.col("part").rlike(r"^#{1,6}\s")
    return each.select(doc, (F.col("n") + 1).alias("n"), F.when(titled, F.trim(F.regexp_extract("part", head, 1))).otherwise("").alias("section"), strip(F.when(titled, F.regexp_extract("part", head, 2)).otherwise(F.col("part"))).alias("text"))


def chunk_numbers(items: Column, limit: int) -> Column:
    """The chunk of each item, where a chunk starts when its characters would pass the limit."""

    def step(at, x):
        n = F.coalesce(F.char_length(x), F.lit(0))
        new = (at["size"] > 0) & (at["size"] + n > limit)
        return F.struct(F.when(new, n).otherwise(at["size"] + n).alias("size"), (at["chunk"] + new.cast("int")).alias("chunk"))

    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("chunk"))
    return let(items, lambda v: F.transform(fold(v, start, step, "struct<size: int, chunk: int>"), lambda at: at["chunk"]))


def chunks(docs: DataFrame, doc: str, text: Column, limit: int = 1000, by: str = r"\n") -> DataFrame:
    """(doc, chunk, n_items, text): paragraphs packed in order up to the limit; a longer one is cut to it."""
    items = F.filter(F.split(text, by), lambda p: F.trim(p) != "")
    each = docs.select(doc, items.alias("items")).select(doc, F.explode(F.arrays_zip(chunk_numbers(F.col("items"), limit).alias("chunk"), F.col("items").alias("item"), F.sequence(F.lit(1), F.greatest(F.size("items"), F.lit(1))).alias("o"))).alias("x")).where("x.item is not null")
    ordered = F.array_sort(F.collect_list(F.struct("x.o", "x.item")))
    return each.groupBy(doc, F.col("x.chunk").alias("chunk")).agg(F.count("*").alias("n_items"), F.substring(F.array_join(F.transform(ordered, lambda i: i["item"]), "\n"), 1, limit).alias("text"))


def id_blocks(docs: DataFrame, doc: str, text: Column, pattern: str = r"[MT]\d+\.\d+\.\d+") -> DataFrame:
    """(doc, n, id, text): a block from each id to the next."""
    parts = F.filter(F.split(text, rf"(?=\b{pattern}\b)"), lambda p: p.rlike(rf"^{pattern}\b"))
    each = docs.select(doc, F.posexplode(parts).alias("n", "part"))
    return each.select(doc, (F.col("n") + 1).alias("n"), F.regexp_extract("part", rf"^({pattern})", 1).alias("id"), strip(F.regexp_replace("part", rf"^{pattern}", "")).alias("text"))


def between(text: Column, start: str, *ends: str) -> Column:
    """What stands between a marker and the next one (or the end)."""
    return strip(F.regexp_extract(text, rf"(?is){start}\s*:?\s*(.*?)(?=(?:{'|'.join(ends)})\s*:?|\z)" if ends else rf"(?is){start}\s*:?\s*(.*)", 1))


def inline_matches(docs: DataFrame, doc: str, text: Column, pattern: str) -> DataFrame:
    """(doc, match) for every match in the text."""
    return docs.select(doc, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("match"))


def nested_list(text: Column) -> Column:
    """X11: numbered lines with the lettered lines under them, as array<struct<text, sub>>."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    bare = lambda line: F.regexp_replace(line, r"^(?:\d+|[a-z])[.)]\s+", "")

    def items(v):
        def item(tops, at, i):
            under = F.filter(part(v, at + 1, F.coalesce(F.get(tops, i + 1), F.size(v))), lambda x: x.rlike(r"^[a-z][.)]\s"))
            return F.struct(bare(F.get(v, at)).alias("text"), F.transform(under, bare).alias("sub"))

        return let(places(v, lambda x: x.rlike(r"^\d+[.)]\s")), lambda tops: F.transform(tops, lambda at, i: item(tops, at, i)))

    return let(lines, items)


def control_passages(controls: DataFrame) -> DataFrame:
    """The main text, every sub-control and the guidelines of (control_id, description, sub_controls, guidelines) as passages."""
    main = F.array(F.struct(F.lit("main").alias("kind"), F.col("description").alias("text")))
    subs = F.transform(F.coalesce("sub_controls", F.array().cast("array<string>")), lambda s: F.struct(F.lit("sub").alias("kind"), s.alias("text")))
    guide = F.array(F.struct(F.lit("guidelines").alias("kind"), F.col("guidelines").alias("text")))
    return controls.select("control_id", F.posexplode(F.filter(F.concat(main, subs, guide), lambda p: F.trim(p["text"]) != "")).alias("n", "p")).select("control_id", "n", "p.kind", "p.text")


def paragraph_chunks(docs: DataFrame, doc: str, text: Column, most: int = 2000, least: int = 50, shortest: int = 20, size: str | None = None) -> DataFrame:
    """X4 as the source has it: paragraphs between blank lines, those under `shortest` characters skipped, packed in order while
    their characters stay within `most`, joined by a space; chunks under `least` are dropped. (doc, n, text); a longer
    paragraph is a chunk of its own, whole. `size` names a further column: the characters of all the text's paragraphs together."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), strip), lambda p: F.char_length(p) >= shortest)

    def step(at, p):
        full = at["some"] & (at["size"] + F.char_length(p) > most)
        return F.struct(F.when(full, F.char_length(p)).otherwise(at["size"] + F.char_length(p)).alias("size"), F.lit(True).alias("some"), (full | ~at["some"]).alias("new"))

    def texts(v):
        start = F.struct(F.lit(0).alias("size"), F.lit(False).alias("some"), F.lit(False).alias("new"))
        states = fold(v, start, step, "struct<size: int, some: boolean, new: boolean>")
        return let(places(states, lambda at: at["new"]), lambda starts: F.transform(starts, lambda at, i: F.array_join(part(v, at, F.coalesce(F.get(starts, i + 1), F.size(v))), " ")))

    own = [F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n + F.char_length(p)).alias(size)] if size else []
    kept = F.filter(let(parts, texts), lambda t: F.char_length(t) >= least)
    return docs.select(doc, *own, F.posexplode(kept).alias("n", "text")).select(doc, (F.col("n") + 1).cast("long").alias("n"), "text", *([size] if size else []))


def element_passages(elements: DataFrame, doc: str, ordinal: str, least: int = 50) -> DataFrame:
    """(doc, section, text): typed elements (category, text) in order; a Title, or a Header under 150 characters, begins a passage.

    Blank elements are skipped, passages under `least` characters dropped; parts are joined by a blank line.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    rows = elements.withColumn("_t", text).where("_t <> ''")
    head = (F.col("category") == "Title") | ((F.col("category") == "Header") & (F.char_length("_t") < 150))
    marked = rows.withColumn("_h", F.coalesce(head, F.lit(False)))
    placed = marked.withColumn("_n", F.sum(F.col("_h").cast("int")).over(Window.partitionBy(doc).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct(F.col(ordinal).alias("o"), F.col("_t").alias("t")))))
    grouped = placed.groupBy(doc, "_n").agg(F.max(F.when(F.col("_h"), F.col("_t"))).alias("section"), F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("text"))
    return grouped.where(F.char_length("text") >= least).select(doc, "section", "text")


def hierarchical_passages(docs: DataFrame, doc: str, text: Column, obligations) -> DataFrame:
    """(doc, n, section_id, section_title, content, obligations, role, scope, exception) of numbered sections, in order.

    A line ``5.1 Title`` (or a short one ``5) ...``) begins a section, others are joined by a space; a line before the first
    has no section, a heading without a number keeps the id before it. obligations(content) is an array (P19). A section's
    role, scope and exception flags come from its title. Sections without text are left out.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: x != "")
    numbered = r"^(\d+(?:\.\d+)*)\s+(.+)$"
    is_head = lambda line: line.rlike(numbered) | ((F.char_length(line) < 100) & line.rlike(r"^\d+[.)]"))

    def sections(v):
        def named(at, place):
            line = F.get(v, place)
            number = F.regexp_extract(line, numbered, 1)
            return F.struct(place.alias("place"), F.when(number != "", number).otherwise(at["id"]).alias("id"), F.when(number != "", F.regexp_extract(line, numbered, 2)).otherwise(line).alias("title"))

        kind = "struct<place: int, id: string, title: string>"
        start = F.struct(F.lit(-1).alias("place"), F.lit("").alias("id"), F.lit("").alias("title")).cast(kind)
        heads = let(places(v, is_head), lambda at: F.concat(F.array(start), fold(at, start, named, kind)))
        return let(heads, lambda h: F.transform(h, lambda x, i: F.struct(x["id"].alias("id"), x["title"].alias("title"), part(v, x["place"] + 1, F.coalesce(F.get(h, i + 1)["place"], F.size(v))).alias("body"))))

    some = F.filter(let(lines, sections), lambda s: F.size(s["body"]) > 0)
    each = docs.select(doc, F.posexplode(some).alias("n", "s")).select(doc, (F.col("n") + 1).cast("long").alias("n"), F.col("s.id").alias("section_id"), F.coalesce(F.nullif("s.title", F.lit("")), F.lit("Section")).alias("section_title"), F.array_join("s.body", " ").alias("content"))
    title = F.lower("section_title")
    return each.select("*", obligations(F.col("content")).alias("obligations"), title.rlike("role|responsib").alias("role"), title.rlike("scope|applicab").alias("scope"), title.rlike("exception|exemption|waiver").alias("exception"))


def structured_text(passages: DataFrame, doc: str, section: str, ordinal: str, text: str) -> DataFrame:
    """(doc, section, section_id, n, text): a document's passages by section, joined in order, with the id its heading begins with."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(text).alias("t"))))
    grouped = passages.groupBy(doc, F.coalesce(section, F.lit("")).alias("section")).agg(F.count("*").alias("n"), F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("text"))
    return grouped.select(doc, "section", F.regexp_extract("section", r"^(\d+(?:\.\d+)*)", 1).alias("section_id"), "n", "text")
