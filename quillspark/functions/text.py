"""Column functions over text (P1 to P26, F1 to F3, F7, F12, F13, F16) and over missing values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

# Defaults of the two general filters below. (The source's own word rules are in obligations.py.)
OBLIGATION_WORDS = ["must", "shall", "should", "required", "mandatory", "obligation"]
NOISE_HEADINGS = ["purpose", "scope", "definitions", "references", "introduction", "overview", "table of contents"]


def tokens(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def snippet(text: Column, n: int) -> Column:
    """The first n characters, with an ellipsis only where something is left."""
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def first_words(text: Column, n: int) -> Column:
    """P4."""
    words = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return F.when(F.size(words) > n, F.array_join(F.slice(words, 1, n), " ")).otherwise(text)


def document_id(passage_id: Column) -> Column:
    """P5: a passage id without its ``_passage_<n>``; ``_unknown_`` for none."""
    found = F.regexp_replace(passage_id, r"_passage_\d+$", "")
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("_unknown_"))


def safe_name(text: Column, default: str = "unnamed") -> Column:
    """Letters, digits, dot, dash and underscore only."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._\- ]", "_"), r"\s+", "_"))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(default))


def ancestor(dotted: Column, depth: int) -> Column:
    """The first `depth` parts of a dotted id (1 the family, 2 the subfamily)."""
    return F.array_join(F.slice(F.split(dotted, r"\."), 1, depth), ".")


def first_id(text: Column, pattern: str) -> Column:
    """The first id in free text, else the trimmed text."""
    return F.coalesce(F.nullif(F.regexp_extract(text, pattern, 0), F.lit("")), F.trim(text))


def references(text: Column, pattern: str, own: Column) -> Column:
    """The distinct ids that a text mentions, sorted, without its own."""
    return F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), F.array(own)))


def reference_list(text: Column, pattern: str) -> Column:
    """P10: a list written with commas, ampersands or semicolons; items that look like ids stay."""
    return F.filter(F.transform(F.split(text, "[,&;]"), lambda x: F.trim(x)), lambda x: x.rlike(f"^(?:{pattern})$"))


def without_prefix(text: Column, prefix: str) -> Column:
    """P11."""
    return F.regexp_replace(text, f"^(?:{prefix})", "")


def clean_space(text: Column, *noise: str) -> Column:
    """Noise (page footers, running headers) out, white space as one space, trimmed."""
    return F.trim(F.regexp_replace(reduce(lambda t, p: F.regexp_replace(t, p, " "), noise, text), r"\s+", " "))


def canonical_name(text: Column, abbreviations: dict[str, str]) -> Column:
    """A file name without extension, version and suffixes, abbreviations written out."""
    stem = F.lower(F.regexp_replace(F.regexp_replace(text, r"\.[A-Za-z0-9]{1,5}$", ""), r"(?i)[_ -]*(v\d+(\.\d+)*|corrected|final|draft)(?=[_ -]|$)", ""))
    full = reduce(lambda t, kv: F.regexp_replace(t, rf"\b{kv[0]}\b", kv[1]), abbreviations.items(), F.regexp_replace(stem, r"[_-]+", " "))
    return clean_space(full)


def number_and_name(text: Column) -> Column:
    """``NUM - NAME`` or ``NUM NAME`` as a struct; text without a number is a name."""
    pattern = r"^\s*([A-Z]?\d+(?:\.\d+)*)\s*(?:[-:]\s*)?(.*)$"
    number = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return F.struct(number.alias("number"), F.when(number.isNull(), F.trim(text)).otherwise(F.trim(F.regexp_extract(text, pattern, 2))).alias("name"))


def once_if_doubled(text: Column) -> Column:
    """A text that is its first half twice, as that half."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    left, right = F.trim(F.substr(text, F.lit(1), half)), F.trim(F.substr(text, half + 1))
    return F.when((F.char_length(text) > 1) & (left == right), left).otherwise(text)


def sentences(text: Column) -> Column:
    """P17."""
    return F.split(text, r"[.!?]\s+")


def obligation_text(text: Column, pattern: str) -> Column:
    """The sentences that match, else the first sentence."""
    parts = sentences(text)
    hits = F.filter(parts, lambda s: F.lower(s).rlike(pattern))
    return F.when(F.size(hits) > 0, F.array_join(hits, " ")).otherwise(F.get(parts, F.lit(0)))


def typed_obligations(text: Column, patterns: dict[str, str], least: int = 15) -> Column:
    """Every sentence under every type whose pattern it matches (obligations.typed has P19's patterns)."""
    parts = F.filter(F.transform(sentences(text), lambda x: F.trim(x)), lambda s: F.char_length(s) >= least)
    # A second parameter of a lambda would be the index, so the pattern is bound by a function.
    of_type = lambda k, p: F.transform(F.filter(parts, lambda s: F.lower(s).rlike(p)), lambda s: F.struct(s.alias("text"), F.lit(k).alias("type")))
    typed = [of_type(k, p) for k, p in patterns.items()]
    return F.concat(*typed)


def answer(text: Column, patterns: list[str], prefix: int = 200) -> Column:
    """P20: the first pattern's match longer than 15 characters, else the first sentence longer than that, else the start."""
    found = [F.trim(F.regexp_extract(text, p, 0)) for p in patterns]
    first = F.trim(F.get(sentences(text), F.lit(0)))
    return F.coalesce(*(F.when(F.char_length(f) > 15, f) for f in [*found, first]), F.substring(text, 1, prefix))


def first_keyword(text: Column, words: dict[str, str], default: str) -> Column:
    """The value of the first word, in the given order, that the text holds."""
    cases = reduce(lambda acc, kv: (F.when if acc is None else acc.when)(F.contains(F.lower(text), F.lit(kv[0])), F.lit(kv[1])), words.items(), None)
    return cases.otherwise(F.lit(default))


def letter_numbered(items: Column, own: Column) -> Column:
    """A, b, c ... for the items that aren't blank; blank items use no letter."""
    kept = F.filter(items, lambda x: F.trim(x) != "")
    return F.transform(kept, lambda x, i: F.concat(own, F.lit("."), F.chr(i + 97), F.lit(": "), x))


def length_ratio(a: Column, b: Column) -> Column:
    """Shorter over longer; 1 for two empty texts."""
    x, y = F.char_length(a), F.char_length(b)
    return F.when(F.greatest(x, y) == 0, F.lit(1.0)).otherwise(F.least(x, y) / F.greatest(x, y))


def markdown_tables(text: Column) -> Column:
    """P25: runs of two or more lines that begin and end with a bar."""
    return F.regexp_extract_all(text, F.lit(r"(?m)(?:^\|[^\n]*\|[ \t]*(?:\n|\z)){2,}"), F.lit(0))


def first_filled(*columns: Column) -> Column:
    """The first that isn't null or blank."""
    return F.coalesce(*(F.when(F.trim(c.cast("string")) != "", c) for c in columns))


def safe_double(x: Column) -> Column:
    """P28."""
    return F.coalesce(F.try_to_number(x, F.lit("S999999999999D999999")).cast("double"), x.try_cast("double"), F.lit(0.0))


def longest(*columns: Column) -> Column:
    """The longest non-empty value; the first of equals."""
    n = len(columns)
    options = F.array(*(F.struct(F.coalesce(F.char_length(c), F.lit(-1)).alias("n"), F.lit(n - i).alias("o"), c.alias("v")) for i, c in enumerate(columns)))
    return F.array_max(options)["v"]


def threshold_label(score: Column, full: float, partial: float) -> Column:
    """P32."""
    return F.when(score >= full, "Fully Addressed").when(score >= partial, "Partially Addressed").otherwise("Not Addressed")


def unit_confidence(c: Column) -> Column:
    """1 to 5 as 0 to 1; missing or 0 counts as 3."""
    return (F.coalesce(F.nullif(c, F.lit(0)), F.lit(3)) - 1) / 4


def ratio(a: Column, b: Column) -> Column:
    """0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def bucket_id(text: Column, prefix: str, n: int = 10_000) -> Column:
    """A reproducible id."""
    return F.concat(F.lit(prefix), F.pmod(keyed_hash(text), F.lit(n)).cast("string"))


def keyed_hash(*parts: Column, seed: int | None = None) -> Column:
    """32 bits of the md5 of the parts, after the seed, joined by colons: the same number in every run, engine and partitioning."""
    key = F.concat_ws(":", *([] if seed is None else [F.lit(str(seed))]), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def labelled_text(parts: dict[str, Column], glue: str = "\n") -> Column:
    """``label: value`` of every part that isn't blank."""
    return F.concat_ws(glue, *(F.when(F.trim(c) != "", F.concat(F.lit(f"{k}: "), c)) for k, c in parts.items()))


def has_obligation(text: Column, words: list[str] | None = None) -> Column:
    """Any of the words, as a substring (obligations.holds_any has F1's and F3's words)."""
    return F.lower(text).rlike("|".join(words or OBLIGATION_WORDS))


def is_obligation(text: Column, words: list[str] | None = None, noise: list[str] | None = None, least: int = 20) -> Column:
    """A whole word of the list, no noise heading at the start, and long enough (obligations.by_rule is F2)."""
    low = F.lower(F.trim(text))
    return (F.char_length(F.trim(text)) >= least) & ~low.rlike("^(?:" + "|".join(noise or NOISE_HEADINGS) + r")\b") & low.rlike(r"\b(?:" + "|".join(words or OBLIGATION_WORDS) + r")\b")


def is_heading(line: Column, longest_: int = 100, most_words: int = 12) -> Column:
    """F16: numbered, in upper case or a markdown heading; short, without a final full stop."""
    t = F.trim(line)
    short = (F.char_length(t) > 0) & (F.char_length(t) <= longest_) & (F.size(tokens(t)) <= most_words) & ~F.endswith(t, F.lit("."))
    return short & (t.rlike(r"^\d+(\.\d+)*[.)]?\s+\S") | ((F.upper(t) == t) & t.rlike("[A-Z]")) | t.rlike(r"^#{1,6}\s"))


def min_max(score: Column, over: WindowSpec) -> Column:
    """A group's scores between 0 and 1; all 0 where they are equal."""
    low, high = F.min(score).over(over), F.max(score).over(over)
    return F.when(high == low, F.lit(0.0)).otherwise((score - low) / (high - low))


def of_greatest(score: Column, over: WindowSpec) -> Column:
    """Scores over the group's greatest; 0 where that is 0."""
    return ratio(score, F.max(score).over(over))


def first_of_enum(values: Column, order: list[str]) -> Column:
    """Of a group's values the first listed one that occurs, else the first value."""
    return F.coalesce(*(F.when(F.array_contains(values, v), F.lit(v)) for v in order), F.get(values, F.lit(0)))


def by_status(status: Column, values: dict[str, object], default: object = None) -> Column:
    """A status to its score, label or code, whatever its case; the default for any other."""
    known = F.create_map(*(x for k, v in values.items() for x in (F.lit(k.lower()), F.lit(v))))
    found = F.element_at(known, F.lower(F.trim(status)))
    return found if default is None else F.coalesce(found, F.lit(default))


def status_of_score(score: Column, full: float = 0.9, partial: float = 0.05) -> Column:
    """P31 backwards: at least `full`, more than `partial`, else not addressed."""
    return F.when(score >= full, "Fully Addressed").when(score > partial, "Partially Addressed").otherwise("Not Addressed")


def applicability_list(text: Column) -> Column:
    """Items between commas and semicolons, without blank ones; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def applicability_found(text: Column, default: str = "P1") -> Column:
    """The first priority in free text, and "always" if it says so; the default where it says neither."""
    priority = F.nullif(F.regexp_extract(text, r"(?i)Priority\s+(P\d+)", 1), F.lit(""))
    found = F.array_compact(F.array(priority, F.when(text.rlike(r"(?i)\balways\s+(?:applicable)?"), "always")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def last_updated(*dates: Column, default: str = "") -> Column:
    """The first date that isn't blank, as text; the default (such as a run's own date) is a parameter, so results repeat."""
    return F.coalesce(first_filled(*(d.cast("string") for d in dates)), F.lit(default))


def short_id(*parts: Column, prefix: str = "", length: int = 8) -> Column:
    """A short id from the content, the same in every run."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *(p.cast("string") for p in parts)), 256), 1, length))


def head_joined(items: Column, n: int, glue: str = "\n") -> Column:
    """The first n items as one text."""
    return F.array_join(F.slice(items, 1, n), glue)


def sub_items(criteria: Column) -> Column:
    """The lettered items of all numbered ones (nested_list's result), in order."""
    return F.flatten(F.transform(criteria, lambda c: c["sub"]))


def as_text(items: Column) -> Column:
    """A list's items that aren't empty, a line each."""
    return F.trim(F.array_join(F.filter(items, lambda x: x != ""), "\n"))


def as_list(text: Column) -> Column:
    """The lines that aren't blank, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def roles_text(roles: Column) -> Column:
    """P50: array<struct<role, responsibility>> as lines ``role: responsibility``."""
    return F.array_join(F.transform(roles, lambda r: F.concat(F.coalesce(r["role"], F.lit("")), F.lit(": "), F.coalesce(r["responsibility"], F.lit("")))), "\n")


def roles_of(text: Column) -> Column:
    """P50 backwards: a line's part before its first colon or dash is the role; a line without one has none."""
    def role(line):
        parts = F.split(line, r"\s*[:–\-]\s*", 2)
        two = F.size(parts) == 2
        return F.struct(F.when(two, F.trim(F.get(parts, F.lit(0)))).otherwise("").alias("role"), F.when(two, F.trim(F.get(parts, F.lit(1)))).otherwise(line).alias("responsibility"))

    return F.transform(as_list(text), role)


def xml_escape(text: Column) -> Column:
    """P24."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def id_depth(dotted: Column, dots: int = 2) -> Column:
    """whether an id has exactly so many dots (2: a leaf)."""
    return dotted.rlike(rf"^[^.]+(?:\.[^.]+){{{dots}}}$")


def has_words(text: Column, least: int) -> Column:
    """F13."""
    return F.size(tokens(F.coalesce(text, F.lit("")))) >= least


def like_glob(name: Column, pattern: str) -> Column:
    """a file name against a glob of *, ? and [...]."""
    import fnmatch

    return name.rlike("^" + fnmatch.translate(pattern).replace("\\z", "$").replace("\\Z", "$"))
