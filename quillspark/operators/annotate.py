"""Annotation round trip and judge replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.synthesize import filled


def tasks(rows: DataFrame, data: list[str], meta: list[str]) -> DataFrame:
    """L1: task records."""
    return rows.select(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in data)).alias("data"), F.struct(*meta).alias("meta"))


def picked(result: Column, name: str, field: str, last: bool = True) -> Column:
    """The value of the last (or first) answer whose field name holds `name`."""
    found = F.filter(result, lambda r: F.contains(r["from_name"], F.lit(name)))
    return F.when(F.size(found) > 0, F.element_at(found, -1 if last else 1)["value"][field])


def annotations(export: DataFrame) -> DataFrame:
    """L2: the first annotation's answers of each task (readers' EXPORT schema); tasks without one are dropped."""
    some = export.where(F.size("annotations") > 0).withColumn("_r", F.col("annotations")[0]["result"])
    status = F.get(picked(F.col("_r"), "status", "choices"), F.lit(0))
    return some.select("data", status.alias("status"), choice_digit(F.get(picked(F.col("_r"), "confidence", "choices"), F.lit(0))).alias("confidence"), F.get(picked(F.col("_r"), "comment", "text"), F.lit(0)).alias("comment"), leaves(picked(F.col("_r"), "reason", "taxonomy")).alias("reasons"))


def choice_digit(choice: Column) -> Column:
    """The number that a choice begins with."""
    return F.nullif(F.regexp_extract(choice, r"^\s*(\d+)", 1), F.lit("")).try_cast("int")


def leaves(paths: Column) -> Column:
    """P48."""
    return F.transform(paths, lambda p: F.element_at(p, -1))


def hard_negative(status: Column, reason: Column, confidence: Column) -> Column:
    """Negative with a reason (an ``ok`` or correct match is none), or negative with confidence."""
    real = F.coalesce(~F.lower(F.trim(reason)).isin("", "ok", "correct match"), F.lit(False))
    return (status == "Not Addressed") & (real | (F.coalesce(confidence, F.lit(0)) >= 4))


def keyed_line(reply: Column, key: str) -> Column:
    """The rest of a reply's line ``KEY: ...``; null if it has none."""
    return F.nullif(F.trim(F.regexp_extract(reply, rf"(?im)^[ \t]*{key}[ \t]*:[ \t]*(.*)$", 1)), F.lit(""))


def judge_reply(reply: Column) -> Column:
    """Verdict, reason and assignment; without an ASSIGNMENT line it follows from the verdict, an empty reply is WRONG."""
    verdict = F.upper(keyed_line(reply, "VERDICT"))
    assignment = F.upper(keyed_line(reply, "ASSIGNMENT"))
    derived = F.when(verdict.rlike("^(FULLY|PARTIALLY)"), "CORRECT").otherwise("WRONG")
    return F.struct(verdict.alias("verdict"), keyed_line(reply, "REASON").alias("reason"), F.when(assignment.rlike("CORRECT") & ~assignment.rlike("INCORRECT"), "CORRECT").when(assignment.isNotNull(), "WRONG").otherwise(derived).alias("assignment"))


def checklist_reply(reply: Column, questions: int = 3) -> Column:
    """The number of questions Q1, Q2 ... answered yes, and the verdict that follows."""
    yes = sum((F.coalesce(F.upper(keyed_line(reply, f"Q{i}")).rlike("^YES"), F.lit(False)).cast("int") for i in range(1, questions + 1)), F.lit(0))
    return F.struct(yes.alias("yes"), F.when(yes == questions, "Fully Addressed").when(yes > 0, "Partially Addressed").otherwise("Not Addressed").alias("verdict"))


def free_reply(reply: Column) -> Column:
    """The verdict line first, then the whole reply; "not fully addressed" reads as Fully, as in the source."""
    def scan(t):
        return F.when(t.rlike("(?i)fully"), "Fully Addressed").when(t.rlike("(?i)partial"), "Partially Addressed").when(t.rlike(r"(?i)not\s+addressed"), "Not Addressed")

    return F.coalesce(scan(keyed_line(reply, "VERDICT")), scan(reply), F.lit("Not Addressed"))


def token_reply(reply: Column, tokens: dict[str, str], default: str) -> Column:
    """The first known token of a reply, else the safe default."""
    found = F.upper(F.regexp_extract(reply, "(?i)\\b(" + "|".join(tokens) + ")\\b", 1))
    case = None
    for k, v in tokens.items():
        case = F.when(found == k.upper(), v) if case is None else case.when(found == k.upper(), v)
    return case.otherwise(default)


def keep_judged(rows: DataFrame, verdict: str, drop: bool = True) -> DataFrame:
    """The kept flag; rows judged not addressed go, or stay flagged."""
    flagged = rows.withColumn("kept", F.coalesce(F.col(verdict) != "Not Addressed", F.lit(False)))
    return flagged.where("kept") if drop else flagged


def negative_sets(replies: DataFrame, key: str, reply: str, n: int = 4) -> DataFrame:
    """Up to n records ``CONTROL_ID: ... REASON: ...`` of a reply."""
    parts = F.filter(F.split(F.col(reply), r"(?i)(?=CONTROL_ID:)"), lambda p: p.rlike(r"(?i)^CONTROL_ID:\s*\S"))
    each = replies.select(key, F.posexplode(F.slice(parts, 1, n)).alias("n", "p"))
    return each.select(key, "n", F.regexp_extract("p", r"(?i)^CONTROL_ID:\s*([^\s,;]+)", 1).alias("control_id"), keyed_line(F.col("p"), "REASON").alias("reason"))


def assignment_reply(reply: Column) -> Column:
    """L5, the whole reply: topic and control requirement (without square brackets), evidence, partial (null if unreadable),
    assignment, status and reason. The last line of a key counts. Without a readable ASSIGNMENT line it follows from
    EVIDENCE and PARTIAL; "PARTIALLY CORRECT" reads as CORRECT, as in the source."""
    lines = F.transform(F.split(F.coalesce(reply, F.lit("")), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))

    def said(key, readable=None):
        own = F.filter(lines, lambda x: F.startswith(F.upper(x), F.lit(f"{key}:")))
        values = F.transform(own, lambda x: F.trim(F.substr(x, F.lit(len(key) + 2), F.char_length(x))))
        some = values if readable is None else F.filter(values, lambda v: F.upper(v).rlike(readable))
        return F.when(F.size(some) > 0, F.element_at(some, -1))

    def yes_no(key):
        v = F.upper(said(key))
        return F.when(F.startswith(v, F.lit("YES")), True).when(F.startswith(v, F.lit("NO")), False)

    bare = lambda c: F.coalesce(F.regexp_replace(c, r"^[\[\]]+|[\[\]]+$", ""), F.lit(""))
    evidence, partial, told = yes_no("EVIDENCE"), yes_no("PARTIAL"), F.upper(said("ASSIGNMENT", "CORRECT|PARTIAL|WRONG"))
    derived = F.when(evidence, "CORRECT").when(~evidence & partial, "PARTIAL").otherwise("WRONG")
    assignment = F.when(F.contains(told, F.lit("CORRECT")), "CORRECT").when(F.contains(told, F.lit("PARTIAL")), "PARTIAL").when(F.contains(told, F.lit("WRONG")), "WRONG").otherwise(derived)
    status = F.when(assignment == "CORRECT", "Fully Addressed").when(assignment == "PARTIAL", "Partially Addressed").otherwise("Not Addressed")
    return F.struct(bare(said("PASSAGE_ABOUT")).alias("topic"), bare(said("CONTROL_REQUIRES")).alias("requires"), evidence.alias("evidence"), partial.alias("partial"), assignment.alias("assignment"), status.alias("status"), F.coalesce(said("REASON"), F.lit("")).alias("reason"))


def judge_prompts(pairs: DataFrame, controls: DataFrame, template: str, cut_description: int = 600, cut_passage: int = 1200, most: int = 5) -> DataFrame:
    """L4: (control_id, passage_id, prompt). pairs: control_id, passage_id, passage; controls: control_id, name, description,
    sub_controls (array). Unknown controls stand under their id; the prompt takes the starts that the source takes."""
    known = controls.groupBy("control_id").agg(*(F.first(c).alias(c) for c in ("name", "description", "sub_controls")))
    both = pairs.join(known, "control_id", "left")
    name = F.coalesce(F.nullif("name", F.lit("")), "control_id")
    values = {
        "control_id": F.col("control_id"), "control_name": name, "control_description": F.substring(F.coalesce(F.nullif("description", F.lit("")), name), 1, cut_description),
        "sub_requirements": F.array_join(F.slice(F.coalesce("sub_controls", F.array().cast("array<string>")), 1, most), "\n"), "passage": F.substring(F.coalesce("passage", F.lit("")), 1, cut_passage),
    }
    return both.select("control_id", "passage_id", filled(F.lit(template), values).alias("prompt"))


def judge_run(prompts: DataFrame, client, reply: str = "reply") -> DataFrame:
    """Prompts with a model's replies, in Arrow batches, and what they say. client: a list of prompts to as many replies;
    it is called on the workers (an endpoint, a local model, or a stub)."""
    def run(frames):
        for frame in frames:
            yield frame.assign(**{reply: client(frame["prompt"].tolist())})

    return prompts.mapInPandas(run, prompts.withColumn(reply, F.lit("")).schema).withColumn("judged", assignment_reply(F.col(reply)))


def document_tasks(documents: DataFrame, passages: DataFrame, doc: str) -> DataFrame:
    """Annotation tasks of a mapping document: one row for the document (n 0), then one per passage, numbered from 1.

    documents: doc, title; passages: doc, ordinal, section_id, section_title, content.
    """
    heads = documents.select(doc, F.lit(0).cast("long").alias("n"), F.lit("document").alias("kind"), F.coalesce("title", F.lit("")).alias("heading"), F.lit("").alias("text"))
    place = F.row_number().over(Window.partitionBy(doc).orderBy("ordinal"))
    heading = F.trim(F.concat_ws(" ", "section_id", "section_title"))
    return heads.unionByName(passages.select(doc, place.cast("long").alias("n"), F.lit("passage").alias("kind"), heading.alias("heading"), F.coalesce("content", F.lit("")).alias("text")))
