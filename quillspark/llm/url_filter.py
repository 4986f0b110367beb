"""URL filters over a Bloom filter cascade, in DataFrame functions only.

Level 0 encodes the listed keys, level 1 the corpus keys that level 0 takes for listed, level 2 the listed keys
that level 1 takes for those, and so on until no error is left. Over the corpus's complete key universe membership
is then exact: a key is listed if and only if the first level without it is an odd one (or, where no level is
without it, if the last level is an even one). A level's words are one row of a small table, which the plan holds
once as a scalar subquery: nothing is joined to the corpus. A list too large for one cascade is dealt by a hash of
the key to several, and the corpus passes them one after the other.

A key is a tag and a host suffix with a path prefix. Only suffixes with as many labels and prefixes of as many
characters as some listed key has are formed; the corpus passes lists of very many such shapes in groups of them.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._spark import free_name, materialize

# The rules in force, and hosts that are refused where no rule fits.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
REFUSED = ("ads-track.example.com", "adult-x.example.com", "casino-win.example.net", "cheap-pills.example.net", "free-bets.example.net", "spam-farm.example.org")

#: Bits of one level at most (16 MB): what a cascade broadcasts is bounded, whatever the list.
MOST_BITS = 1 << 27


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, by a lambda: however long the list of shapes or levels, the generated code stays small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hashes(number: Column, key: Column) -> Column:
    """The two hashes of a key at a level."""
    a = F.shiftrightunsigned(F.xxhash64(key, number), 3)
    b = F.shiftrightunsigned(F.xxhash64(key, number, F.lit("step")), 8)
    return F.struct(a.alias("a"), b.alias("b"))


class Level:
    """One Bloom filter: m bits in 64-bit words, k probes by double hashing."""

    def __init__(self, number: int, bits: int, probes: int):
        self.number, self.bits, self.probes = number, bits, probes
        self.words: Column | None = None

    def hashes(self, key: Column) -> Column:
        return hashes(F.lit(self.number), key)

    def place(self, h: Column, i: Column) -> Column:
        return F.pmod(h["a"] + i * h["b"], F.lit(self.bits))

    def turns(self) -> Column:
        return F.array(*(F.lit(i).cast("long") for i in range(self.probes)))

    def fill(self, keys: DataFrame) -> None:
        """The words are built by partial bitwise ORs and kept as one row; no key and no word passes through the driver's code."""
        at = keys.select(F.explode(let(self.hashes(F.col("key")), lambda h: F.transform(self.turns(), lambda i: self.place(h, i)))).alias("at"))
        word = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bits"))
        every = keys.sparkSession.range(self.bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
        whole = word.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        row = whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))
        self.words = materialize(row, "level").scalar()

    def put(self, hashes: list[tuple[int, int]]) -> None:
        """The same words from few keys' hashes: constants of the plan."""
        words = [0] * (self.bits // 64)
        for at in {at for h in hashes for at in self.places(h)}:
            words[at >> 6] |= 1 << (at & 63)
        self.words = F.array(*(F.lit(wrapped(w)).cast("long") for w in words))

    def places(self, hashes: tuple[int, int]) -> set[int]:
        return {wrapped(hashes[0] + i * hashes[1]) % self.bits for i in range(self.probes)}

    def hit(self, at: Column, words: Column) -> Column:
        return F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1

    def has(self, key: Column, words: Column | None = None) -> Column:
        """Whether a key passes. words is the level's row as a bound column; without it the subquery stands in the expression once a probe."""
        if words is None:
            places = let(self.hashes(key), lambda h: F.transform(self.turns(), lambda i: self.place(h, i)))
            return reduce(Column.__and__, (self.hit(F.get(places, F.lit(i)), self.words) for i in range(self.probes)))
        return let(self.hashes(key), lambda h: F.forall(self.turns(), lambda i: self.hit(self.place(h, i), words)))

    def passing(self, keys: DataFrame) -> DataFrame:
        bound, words = bind(keys.select("key"), self.words)
        return bound.where(let(words, lambda w: self.has(F.col("key"), w))).select("key")


def bind(rows: DataFrame, words: Column) -> tuple[DataFrame, Column]:
    """rows with words as a column, which a lambda can use (a subquery can't stand in one). The optimizer puts it where its one use is, so no row holds it."""
    name = free_name(rows, "_words")
    return rows.withColumn(name, words), F.col(name)


def wrapped(x: int) -> int:
    """x as a signed 64-bit number."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


class Cascade:
    """Exact membership of `listed` within `universe` (DataFrames with a string column `key`; nulls are no keys).

    The first filter's error rate is chosen so that about as many foreign keys pass it as there are listed
    ones; later levels err on one key in two. An empty list gives a cascade that holds nothing. A list of at most `few` keys
    takes an error rate of 2^-20 unseen; if no more than `few` corpus keys pass that, the levels behind are built from
    their hashes alone, as constants. Otherwise each level is built by jobs, as a row of a table.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame, most: int = 60, few: int = 1024):
        self.levels: list[Level] = []
        self.most, self.few = most, few
        listed = listed.where("key is not null").select("key").distinct()
        known = self.hashed(listed)
        if known is None:
            self.build(listed, universe)
        elif known:
            self.close(known, universe, listed)

    def hashed(self, keys: DataFrame) -> dict[str, list] | None:
        """Each of few keys with its hashes at every level; None where there are more than few."""
        every = F.transform(F.sequence(F.lit(0), F.lit(self.most - 1)), lambda i: hashes(i, F.col("key")))
        rows = keys.select("key", every.alias("h")).limit(self.few + 1).collect()
        return None if len(rows) > self.few else {r["key"]: r["h"] for r in rows}

    def close(self, known: dict[str, list], universe: DataFrame, listed: DataFrame) -> None:
        """Few listed keys: the first level errs on one key in 2^20. Where it takes few others, their hashes give all levels behind it."""
        level = Level(0, bits_for(len(known), 2.0**-20), 20)
        level.put([h[0] for h in known.values()])
        others = level.passing(universe).where(~F.col("key").isin(list(known))).distinct()
        wrong = self.hashed(others)
        if wrong is None:
            return self.build(listed, universe)
        sides = [list(wrong.values()), list(known.values())]
        while sides[0]:
            self.levels.append(level)
            if len(self.levels) == self.most:
                raise ValueError("the cascade did not close")
            inside, outside = sides
            level = Level(len(self.levels), bits_for(len(inside), 0.5), 1)
            own = [h[level.number] for h in inside]
            level.put(own)
            places = {place for h in own for place in level.places(h)}
            sides = [[h for h in outside if places.issuperset(level.places(h[level.number]))], inside]
        self.levels.append(level)

    def build(self, listed: DataFrame, universe: DataFrame) -> None:
        """Each level by jobs, as a row of a table."""
        listed = materialize(listed, "listed")
        r = listed.count()
        error = first_error(r, max(1, universe.agg(F.approx_count_distinct("key").alias("n")).first()["n"] - r))
        inside, outside = listed, universe
        for number in range(self.most):
            bits = bits_for(r, error)
            if bits > MOST_BITS:
                raise ValueError(f"{r} keys need {bits} bits: deal them to several cascades (see pieces_for)")
            level = Level(number, bits, max(1, round(-math.log2(error))))
            level.fill(inside)
            self.levels.append(level)
            # Those of the other side that this level takes for its own. The first time they come out of the whole corpus.
            wrong = level.passing(outside).distinct()
            if number == 0:
                wrong = wrong.join(listed, "key", "left_anti")
            wrong = materialize(wrong, "wrong")
            inside, outside, error, r = wrong, inside, 0.5, wrong.count()
            if not r:
                return
        raise ValueError("the cascade did not close")

    def words(self) -> Column:
        """Every level's words, to be bound once with let."""
        return F.struct(*(level.words.alias(f"w{level.number}") for level in self.levels))

    def has(self, key: Column, words: Column | None = None) -> Column:
        """Whether a key of the universe is listed. words: the bound words(), needed inside a lambda."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            own = words[f"w{level.number}"] if words is not None else None
            out = F.when(level.has(key, own), out).otherwise(F.lit(level.number % 2 == 1))
        return out


def first_error(listed: int, foreign: int) -> float:
    return min(0.5, math.sqrt(0.5) * listed / foreign)


def bits_for(keys: int, error: float) -> int:
    return max(64, math.ceil(-max(1, keys) * math.log(error) / math.log(2) ** 2 / 64) * 64)


def pieces_for(keys: int, foreign: int, most_bits: int) -> int:
    """How many cascades a list needs, with room for uneven hashes and for a second level as large as the first."""
    return max(1, math.ceil(1.25 * bits_for(keys, first_error(keys, max(1, foreign))) / most_bits))


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for a null or one without ``://``."""
    rest = F.substr(url, F.instr(url, "://") + 3, F.char_length(url))
    full = F.instr(url, "://") > 0
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(full, host).otherwise(F.lit("")), F.when(full, path).otherwise(F.lit(""))


def as_table(spark: SparkSession, rows, *names: str) -> DataFrame:
    """A list of tuples (or of strings) as string columns; a DataFrame as it is, by its own columns in order."""
    if isinstance(rows, DataFrame):
        return rows.select(*(F.col(c).cast("string").alias(n) for c, n in zip(rows.columns, names, strict=False)))
    made = [r if isinstance(r, tuple) else (r,) for r in rows]
    return spark.createDataFrame(made, ", ".join(f"{n} string" for n in names))


def keys_of(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """A URL's keys (m, key) of the given shapes (labels of the suffix, characters of the path; -1: of a host)."""
    every = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(m).alias("m")) for n, m in shapes))
    parts_of = F.struct(F.split(host, r"\.", -1).alias("labels"), path.alias("path"))

    def key(v, s):
        suffix = F.array_join(F.slice(v["labels"], -s["n"], s["n"]), ".")
        text = F.when(s["m"] < 0, F.concat(F.lit("h:"), suffix)).otherwise(F.concat(F.lit("r:"), suffix, F.substr(v["path"], F.lit(1), F.greatest(s["m"], F.lit(0)))))
        return F.struct(s["m"].alias("m"), text.alias("key"))

    def fits(v, s):
        return (F.size(v["labels"]) >= s["n"]) & (F.char_length(v["path"]) >= s["m"])

    return let(parts_of, lambda v: F.transform(F.filter(every, lambda s: fits(v, s)), lambda s: key(v, s)))


def judge(pages: DataFrame, *, url_col: str = "url", rules=RULES, refused=REFUSED, most_bits: int = MOST_BITS, group: int = 64) -> DataFrame:
    """pages with host, path, rule, verdict.

    A rule (host and path prefix, "allow" or "block") fits its host and all subdomains where the path starts with
    the rule's; the longest wins (equal lengths: the longer host; block before allow). Where none fits, `rule` is null
    and the verdict is block for a refused host or its subdomains, else allow. rules (rule, verdict) and refused (host)
    are lists or tables of any length; null entries are none. Null URLs have empty parts and are allowed. Repeated rows
    are judged each, an empty table gives an empty one. Input columns named as an output are replaced, all others stay.
    """
    spark = pages.sparkSession
    rule = as_table(spark, rules, "rule", "verdict").where("rule is not null")
    # A rule without a path fits every path: its prefix is "/", as if it ended there.
    rule = rule.withColumn("rule", F.when(F.contains("rule", F.lit("/")), F.col("rule")).otherwise(F.concat("rule", F.lit("/"))))
    at = F.substring_index("rule", "/", 1)
    label_count = lambda h: F.size(F.split(h, r"\.", -1))
    of_rules = rule.select(F.concat(F.lit("r:"), "rule").alias("key"), label_count(at).alias("n"), (F.char_length("rule") - F.char_length(at)).alias("m"), (F.col("verdict") == "block").alias("blocks"))
    of_hosts = as_table(spark, refused, "host").where("host is not null").select(F.concat(F.lit("h:"), "host").alias("key"), label_count(F.col("host")).alias("n"), F.lit(-1).alias("m"), F.lit(True).alias("blocks"))
    every = of_rules.unionByName(of_hosts)
    if isinstance(rules, DataFrame) or isinstance(refused, DataFrame):
        every = materialize(every, "rules")
    shapes = sorted(tuple(r) for r in every.select("n", "m").distinct().collect())
    host, path = parts(F.col(url_col).cast("string"))
    named = pages.drop("rule", "verdict").withColumns({"host": host, "path": path})
    best, bad, blocks = (free_name(named, name) for name in ("_best", "_bad", "_blocks"))
    told = named.withColumns({best: F.lit(None).cast("struct<size: int, host: int, rule: string>"), bad: F.lit(False)})
    groups = [shapes[i : i + group] for i in range(0, len(shapes), group)]

    def better(k):
        n = F.char_length(k["key"]) - 2
        return F.struct(n.alias("size"), (n - k["m"]).alias("host"), F.substr(k["key"], F.lit(3)).alias("rule"))

    def of_hits(hits, best, bad):
        own = lambda h: F.array_max(F.transform(F.filter(h, lambda k: k["m"] >= 0), better))
        return let(hits, lambda h: F.struct(F.greatest(best, own(h)).alias("best"), (bad | F.exists(h, lambda k: k["m"] < 0)).alias("bad")))

    for own in groups:
        listed = every if len(groups) == 1 else every.join(F.broadcast(spark.createDataFrame(own, "n int, m int")), ["n", "m"], "left_semi")
        keys = keys_of(F.col("host"), F.col("path"), own)
        universe = named.select(F.explode(keys).alias("k")).select("k.key")
        for inside in cascades(listed, universe, most_bits):
            bound, words = bind(told, inside.cascade.words())
            told = bound.withColumn(best, of_hits(inside.of(keys, words), F.col(best), F.col(bad))).drop(words)
            told = told.withColumns({best: F.col(f"{best}.best"), bad: F.col(f"{best}.bad")})
            if len(groups) > 1 or inside.pieces > 1:
                told = materialize(told, "judged")
    # Among the rules, those that block: one more cascade, whose universe is the list.
    told = told.withColumn(blocks, F.lit(False))
    for inside in cascades(every.where("blocks and m >= 0"), every.where("m >= 0"), most_bits):
        bound, words = bind(told, inside.cascade.words())
        told = bound.withColumn(blocks, F.col(blocks) | F.coalesce(inside(F.concat(F.lit("r:"), f"{best}.rule"), words), F.lit(False))).drop(words)
        told = materialize(told, "judged") if inside.pieces > 1 else told
    is_blocked = F.when(F.col(best).isNotNull(), F.col(blocks)).otherwise(F.col(bad))
    return told.withColumns({"rule": F.col(f"{best}.rule"), "verdict": F.when(is_blocked, "block").otherwise("allow")}).drop(best, bad, blocks)


class Piece:
    """Membership in one cascade of several: false for keys that another one is for, null for null keys."""

    def __init__(self, cascade: Cascade, piece: int, pieces: int):
        self.cascade, self.piece, self.pieces = cascade, piece, pieces

    def mine(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit("piece")), F.lit(self.pieces)) == self.piece

    def bound(self, key: Column, words: Column) -> Column:
        return self.cascade.has(key, words) if self.pieces == 1 else self.mine(key) & self.cascade.has(key, words)

    def of(self, keys: Column, words: Column) -> Column:
        """The listed ones of an array of (m, key)."""
        return let(words, lambda w: F.filter(keys, lambda k: self.bound(k["key"], w)))

    def __call__(self, key: Column, words: Column) -> Column:
        return F.when(key.isNotNull(), let(words, lambda w: self.bound(key, w)))


def cascades(listed: DataFrame, universe: DataFrame, most_bits: int):
    """The cascades that a list needs, one after the other."""
    n = listed.limit(most_bits // 64 + 1).count()
    pieces = pieces_for(listed.count(), universe.agg(F.approx_count_distinct("key").alias("n")).first()["n"], most_bits) if 64 * n > most_bits else 1
    for i in range(pieces):
        mine = Piece(None, i, pieces).mine(F.col("key")) if pieces > 1 else F.lit(True)
        cascade = Cascade(listed.where(mine).select("key"), universe.where(mine).select("key"))
        if cascade.levels:
            yield Piece(cascade, i, pieces)
