"""Secret scans, in DataFrame functions only: three patterns, and two character Markov models.

The models give a string's log-likelihood as a random string and as an ordinary identifier, letter by letter;
a run of 20 or more token characters whose log-likelihood ratio is high enough is a secret too. They are
trained from labelled samples: random strings (digests written in base 64, base 32 and base 16) and ordinary
identifiers (words of the corpus as they are, capitalised, and joined by "", "_" and "-").
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._spark import free_name

# Kinds in the order in which they are listed, and their patterns.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

SPAN = "struct<start: int, kind: int, end: int>"
NONE = f"cast(array() as array<{SPAN}>)"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: an expression inside a lambda would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blocks_of(items: Column, size: int) -> Column:
    """An array as an array of arrays of `size` items. items must be cheap (a column or a bound variable)."""
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")), lambda b: F.slice(items, b * size + 1, F.lit(size))))


def running(items: Column, step, emit, kind: str, size: int = 256) -> Column:
    """emit(at, item) of every item, `at` being an int that starts at 0 and becomes step(at, item).

    An array grown item by item costs the square of its length, so items are folded in blocks, and blocks joined at last.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")

    def inner(at, block):
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(emit(acc["at"], x))).alias("out")))

    outer = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("out"))
    folded = lambda v: F.aggregate(blocks_of(v, size), outer, lambda acc, block: let(inner(acc["at"], block), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out"))), lambda acc: F.flatten(acc["out"]))
    return F.coalesce(let(items, folded), none)


def found(text: Column, pattern: str, kind: int, value: int = 0, least: int = 1, likely: Column | None = None) -> Column:
    """(start, kind, end, match) of the leftmost non-overlapping matches whose group `value` has `least` characters or more; offsets in code points.

    The text between matches (split) and the matches (regexp_extract_all) alternate, so their lengths give the offsets.
    `likely`, a cheap condition, is true wherever the pattern matches.
    """
    p = F.lit(pattern)
    matches = F.regexp_extract_all(text, p, F.lit(0))
    values = F.regexp_extract_all(text, p, F.lit(value)) if value else matches
    steps = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.char_length).alias("gap"), matches.alias("match"), F.transform(values, F.char_length).alias("value"))
    shape = f"{SPAN[:-1]}, match: string, value: int>"

    def span(at, x):
        start = at + x["gap"]
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.char_length(x["match"])).alias("end"), x["match"].alias("match"), x["value"].alias("value"))

    spans = running(steps, lambda at, x: at + x["gap"] + F.coalesce(F.char_length(x["match"]), F.lit(0)), span, shape)
    here = F.rlike(text, p) if likely is None else likely & F.rlike(text, p)
    return F.when(here, F.filter(spans, lambda x: x["value"] >= least)).otherwise(F.expr(f"cast(array() as array<{shape}>)"))


def bare(spans: Column) -> Column:
    """Spans without their matches."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def labelled_samples(docs: DataFrame, text_col: str, rows: int) -> DataFrame:
    """(value, random): a sample of about `rows` documents' words as ordinary identifiers, and as many random strings.

    The sample is taken by a hash of the text against a bound of 64 bits, so its size is about `rows` at any number of
    documents; copies of one text count once.
    """
    spark = docs.sparkSession
    share = min(1.0, rows / max(1, docs.count()))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bound = min((1 << 63) - 1, int((share - 0.5) * (1 << 64)))
    # Words of texts that match no pattern: a text with a secret isn't a sample of ordinary words.
    clean = docs.where(F.xxhash64(text) <= F.lit(bound)).select(text.alias("t")).distinct().where(reduce(lambda a, b: a & b, (~F.rlike("t", F.lit(p)) for p in (ASSIGN, ACCESS, HEX))))
    words = F.regexp_extract_all("t", F.lit(r"[A-Za-z]{3,}"), F.lit(0))
    paired = let(words, lambda v: F.transform(v, lambda w, i: F.struct(w.alias("a"), F.coalesce(F.get(v, i + 1), w).alias("b"))))
    pairs = clean.select(F.explode(paired).alias("p")).select("p.a", "p.b")
    a, b = F.col("a"), F.col("b")
    ordinary = pairs.select(F.explode(F.array(a, F.lower(F.concat(a, F.lit("_"), b)), F.concat(F.initcap(a), F.initcap(b)), F.lower(F.concat_ws("-", a, b)), F.upper(F.concat_ws("_", a, b)), F.concat(F.lower(a), F.lit("_"), F.length(b).cast("string")))).alias("value"))
    digest = F.sha2(F.concat(F.lit("random "), F.col("id").cast("string")), 256)
    base32 = F.upper(F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z2-7]", ""))
    random = spark.range(20_000).select(F.explode(F.array(F.regexp_replace(F.base64(F.unhex(digest)), "=", ""), F.translate(F.base64(F.unhex(digest)), "+/=", "-_"), base32, F.substring(digest, 1, 40))).alias("value"))
    return ordinary.withColumn("random", F.lit(False)).union(random.withColumn("random", F.lit(True)))


def train(samples: DataFrame, smooth: float = 0.5) -> list[float]:
    """The log-likelihood ratio (random over ordinary) of each character after each other, row by row of ALPHABET.

    The table has a fixed size (67 x 67), whatever the samples. Characters outside ALPHABET are passed over.
    """
    n = len(ALPHABET)
    each = samples.where(F.length("value") > 1).select("random", F.explode(F.expr("transform(sequence(1, length(value) - 1), i -> substr(value, i, 2))")).alias("pair"))
    counts = each.groupBy("random", "pair").count().collect()
    table = {True: [[smooth] * n for _ in range(n)], False: [[smooth] * n for _ in range(n)]}
    for r in counts:
        i, j = ALPHABET.find(r["pair"][0]), ALPHABET.find(r["pair"][1])
        if i >= 0 <= j:
            table[r["random"]][i][j] += r["count"]
    sums = {k: [sum(row) for row in t] for k, t in table.items()}
    return [math.log(table[True][i][j] / sums[True][i]) - math.log(table[False][i][j] / sums[False][i]) for i in range(n) for j in range(n)]


def ratio(value: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string over ALPHABET, in one pass over its letters."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    n = len(ALPHABET)
    letters = F.filter(F.split(value, ""), lambda c: c != "")
    zero = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(acc, c):
        code = F.instr(F.lit(ALPHABET), c) - 1
        more = F.when(acc["last"] < 0, F.lit(0.0)).otherwise(F.get(table, acc["last"] * n + code))
        return F.struct(code.alias("last"), (acc["sum"] + more).alias("sum"))

    return F.aggregate(letters, zero, step, lambda acc: acc["sum"])


def scan(docs: DataFrame, *, text_col: str = "text", out_col: str = "secrets", sample_rows: int = 300, least: float = 12.0, per_letter: float = 0.6, model: list[float] | None = None) -> DataFrame:
    """docs with an array of spans (start, kind, end; kind an index of KINDS) in out_col, sorted by start, then kind.

    Pattern matches come first; a Markov span is kept where it overlaps none of them. The models are trained on
    about sample_rows documents (a documented bound) unless a model is given. A null text is empty and has no span.
    Repeated rows are scanned each; an empty table gives an empty one. Columns of docs other than out_col stay.
    The work grows with a text's length and with the number of its matches, however long either is.
    """
    model = model or train(labelled_samples(docs, text_col, sample_rows))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = let(F.lower(text), lambda low: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in ("passw", "secret", "token", "api"))))
    runs_col = free_name(docs, "_runs")
    runs = docs.withColumn(runs_col, found(text, RUN, 3))
    base_col = free_name(runs, "_base")
    base = runs.withColumn(base_col, F.concat(bare(found(text, ASSIGN, 0, 2, 8, named)), bare(found(text, ACCESS, 1, likely=F.contains(text, F.lit("AKIA")))), bare(found(text, HEX, 2, likely=F.size(runs_col) > 0))))

    def secret(s):
        return ratio(s["match"], model) >= F.greatest(F.lit(least), F.lit(per_letter) * F.char_length(s["match"]))

    # Only strings that the models take for random are held against the pattern matches.
    random_col = free_name(base, "_random")
    random = base.withColumn(random_col, F.when(F.size(runs_col) > 0, bare(F.filter(runs_col, secret))).otherwise(F.expr(NONE)))
    return random.withColumn(out_col, F.array_sort(F.concat(base_col, apart(F.col(random_col), F.col(base_col))))).drop(base_col, runs_col, random_col)


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others: one pass up and one down over both, sorted by their places."""
    mark = lambda xs, own: F.transform(xs, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["kind"].alias("kind"), s["end"].alias("end")))
    kind = "struct<start: int, own: int, kind: int, end: int, free: boolean>"
    both = F.array_sort(F.concat(mark(others, 0), mark(spans, 1)))
    told = lambda x, free: F.struct(x["start"].alias("start"), x["own"].alias("own"), x["kind"].alias("kind"), x["end"].alias("end"), free.alias("free"))
    # Up: no pattern match that begins at or before the span ends after its start. Places count down in the second pass.
    up = running(both, lambda at, x: F.when(x["own"] == 0, F.greatest(at, x["end"])).otherwise(at), lambda at, x: told(x, at <= x["start"]), kind)
    far = (1 << 31) - 1
    down = running(F.reverse(up), lambda at, x: F.when(x["own"] == 0, far - x["start"]).otherwise(at), lambda at, x: told(x, x["free"] & ((at == 0) | (far - at >= x["end"]))), kind)
    kept = bare(F.filter(F.reverse(down), lambda x: (x["own"] == 1) & x["free"]))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), kept).otherwise(spans)


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """docs with every secret of text_col replaced by mark (touching or overlapping spans by one). Null texts stay null."""
    spans = free_name(docs, "_spans")
    scanned = scan(docs, text_col=text_col, out_col=spans, **options)
    t = F.col(text_col)

    def cut(at, s):
        return F.struct(at.alias("prev"), F.greatest(at, s["start"]).alias("stop"), ((s["start"] > at) | ((at == 0) & (s["start"] == 0))).alias("new"))

    cuts = running(F.col(spans), lambda at, s: F.greatest(at, s["end"]), cut, "struct<prev: int, stop: int, new: boolean>")

    def pieces(block):
        """What stays before each of a block's secrets, cut out of the block's own part of the text."""
        low = F.get(block, F.lit(0))["prev"]
        part = F.substr(t, low + 1, F.element_at(block, -1)["stop"] - low)
        return let(part, lambda own: F.transform(block, lambda c: F.concat(F.substr(own, c["prev"] - low + 1, c["stop"] - c["prev"]), F.when(c["new"], F.lit(mark)).otherwise(F.lit("")))))

    rest = F.substr(t, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.char_length(t))
    joined = F.array_join(F.flatten(let(cuts, lambda v: F.transform(blocks_of(v, 64), pieces))), "")
    return scanned.withColumn(text_col, F.when(F.size(spans) > 0, F.concat(joined, rest)).otherwise(t)).drop(spans)
