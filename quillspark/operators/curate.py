"""Curation and training sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import keyed_hash
from quillspark.sources.sinks import materialize, small


def vote(rows: DataFrame, key: list[str], label: str, ranks: dict[str, int], ordinal: str) -> DataFrame:
    """Each key's commonest label (a higher rank wins a tie), on the first row that has it."""
    rank = F.coalesce(F.element_at(F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))]), F.col(label)), F.lit(-1))
    winner = rows.groupBy(*key, label).agg(F.count("*").alias("votes"), F.min(ordinal).alias(ordinal)).withColumn("rank", rank)
    best = winner.groupBy(*key).agg(F.max_by(F.struct(label, "votes", ordinal), F.struct("votes", "rank", label)).alias("b"))
    return best.select(*key, f"b.{label}", "b.votes", f"b.{ordinal}")


def cap(rows: DataFrame, by: list[str], where: Column, order: list[str], n: int) -> DataFrame:
    """Of the rows where the condition holds, the first n of each group; all others stay."""
    flagged = rows.withColumn("_w", F.coalesce(where, F.lit(False)))
    kept = flagged.where("_w").withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
    return kept.unionByName(flagged.where("not _w")).drop("_w")


def keep_best(rows: DataFrame, key: list[str], score: str, order: str) -> DataFrame:
    """The row with the highest score of each key, the first on a tie. Aggregated before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    # max_by of (score, -order) combines partially, which a ranking window does not.
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), (-F.col(order)).alias("o"))).alias("b"))
    return best.select(*key, *(F.col(f"b.{c}") for c in rest))


def group_nested(rows: DataFrame, by: str, fields: list[str], score: str, name: str) -> DataFrame:
    """Each group's rows as an array by falling score, and their number."""
    item = F.struct((-F.col(score)).alias("_s"), *fields)
    return rows.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias(name), F.count("*").alias("n"))


def concatenate(rows: DataFrame, by: list[str], ordinal: str, text: str, glue: str = "\n") -> DataFrame:
    """The texts of a group in their order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(parts, lambda x: x["t"]), glue).alias(text))


def split_by_hash(rows: DataFrame, key: list[str], seed: int, shares: dict[str, int]) -> DataFrame:
    """A split by a keyed hash: per mille shares, the same for a key wherever it comes; no sort, no shuffle."""
    place = F.pmod(keyed_hash(*map(F.col, key), seed=seed), F.lit(1000))
    names, upto, case = list(shares), 0, None
    for name in names[:-1]:
        upto += shares[name]
        case = F.when(place < upto, name) if case is None else case.when(place < upto, name)
    return rows.withColumn("split", case.otherwise(names[-1]) if case is not None else F.lit(names[-1]))


def sample_per_group(rows: DataFrame, by: list[str], key: str, seed: int, n: int) -> DataFrame:
    """N rows of each group in the order of a keyed hash."""
    order = keyed_hash(F.col(key), seed=seed)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order, key))).where(F.col("_n") <= n).drop("_n")


def replicate(rows: DataFrame, weight: Column) -> DataFrame:
    """Every row as often as its weight says."""
    return rows.withColumn("copy", F.explode(F.when(weight > 0, F.sequence(F.lit(1), weight.cast("int")))))


def round_robin(rows: DataFrame, order: str, names: list[str], out: str) -> DataFrame:
    """Names dealt out by the row's number."""
    return rows.withColumn(out, F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.col(order), F.lit(len(names))) + 1).cast("int")))


def fill_gaps(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The first table's rows, and those of the second whose key the first lacks."""
    return first.unionByName(second.join(first.select(keys).distinct(), keys, "left_anti"))


def upsert(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Changed columns win where they aren't null; unseen keys are appended."""
    b, c = base.alias("b"), changes.alias("c")
    return b.join(c, F.col(f"b.{key}") == F.col(f"c.{key}"), "full_outer").select(F.coalesce(f"b.{key}", f"c.{key}").alias(key), *(F.coalesce(f"c.{x}", f"b.{x}").alias(x) for x in columns))


def met_in_blocks(first: DataFrame, second: DataFrame, key: str, few: int = 16, many: int = 256, stretch: int = 256) -> DataFrame:
    """The rows of an equality join of (key, x) and (key, y) where few keys have very many rows on both sides: (key, x, y).

    Rows of a key are dealt by their value to blocks, of `few` rows on the first side and of `many` on the second, and blocks meet.
    A cell is a block of the second with up to `stretch` blocks of the first; cells are what tasks get, so a key is many tasks' work.
    Two blocks that meet make about few * many rows, as Spark holds what one row of a join is exploded to. A sorted join
    has the rows of a cell in sequence: a block of the second comes out again and again, which a compressed file holds in a
    fraction of the rows' size. Copies of a row are dealt one by one. Rows with a null key meet none.
    """
    x, y = (next(c for c in rows.columns if c != key) for rows in (first, second))
    each = [rows.groupBy(key).agg(F.ceil(F.count("*") / size).alias(n)) for rows, size, n in ((first, few, "_an"), (second, many, "_bn"))]
    sizes = materialize(each[0].join(each[1], key).withColumn("_sn", F.ceil(F.col("_an") / stretch)), "sizes")
    cells = sizes.agg(F.sum(F.col("_sn") * F.col("_bn"))).first()[0] or 0
    tasks = min(2_000, max(first.sparkSession.sparkContext.defaultParallelism, cells // 4))
    sizes = small(sizes)

    def blocks(rows, value, n, name):
        copies = rows.groupBy(key, value).agg(F.count("*").alias("_n")).withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
        dealt = copies.join(sizes, key).withColumn(name, F.pmod(F.xxhash64(value, "_n"), F.col(n)))
        # Structs, as a list of values would lose the nulls.
        return dealt.groupBy(key, "_bn", "_sn", name).agg(F.collect_list(F.struct(value)).alias("_rows")).withColumn("_rows", F.col(f"_rows.{value}"))

    def numbers(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    left = blocks(first, x, "_an", "_a").select(key, (F.col("_a") % F.col("_sn")).alias("_s"), numbers("_bn").alias("_b"), F.col("_rows").alias("_x"))
    right = blocks(second, y, "_bn", "_b").select(key, numbers("_sn").alias("_s"), "_b", F.col("_rows").alias("_y"))
    cell = [key, "_s", "_b"]
    met = left.repartition(tasks, *cell).join(right.repartition(tasks, *cell).hint("merge"), cell)
    return met.select(key, F.explode("_x").alias(x), "_y").select(key, x, F.explode("_y").alias(y))


def overlaps(items: DataFrame, owner: str, item: str, near: float = 0.9) -> DataFrame:
    """Pairs of owners with shared items: exact if the sets are equal, near from 0.9 of the smaller one.

    Owners are files or sources (a catalogue), items join by equality.
    """
    sets = items.select(owner, item).distinct()
    n = sets.groupBy(owner).agg(F.count("*").alias("n"))
    pairs = sets.alias("x").join(sets.alias("y"), (F.col(f"x.{item}") == F.col(f"y.{item}")) & (F.col(f"x.{owner}") < F.col(f"y.{owner}"))).groupBy(F.col(f"x.{owner}").alias("a"), F.col(f"y.{owner}").alias("b")).agg(F.count("*").alias("shared"))
    both = pairs.join(n.select(F.col(owner).alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col(owner).alias("b"), F.col("n").alias("nb")), "b")
    kind = F.when((F.col("shared") == F.col("na")) & (F.col("na") == F.col("nb")), "exact").when(F.col("shared") >= near * F.least("na", "nb"), "near").otherwise("partial")
    return both.select("a", "b", "shared", "na", "nb", kind.alias("kind"))


def near_duplicates(items: DataFrame, owner: str, item: str, near: int = 90) -> DataFrame:
    """(a, b, shared, na, nb, kind) of the pairs of owners that share `near` percent of the smaller set's items: exact or near.

    Owners with equal sets are one class; classes meet, and pairs of owners are made of the classes' pairs at the end. Items are
    ordered by how many owners have them, rarest first. A smaller set of n items that shares need = near percent of them, rounded
    up, has one shared item among its first n - need + 1: only those look for larger sets, so an item that all owners have
    makes no candidates unless a set has hardly another. Candidates' items are then counted exactly, as arrays of numbers:
    a candidate is a row with its smaller set, never a row for each of its items. Null owners and items are none.
    """
    sets = materialize(items.select(F.col(owner).alias("o"), F.col(item).alias("i")).dropna().distinct(), "sets")
    frequency = materialize(sets.groupBy("i").agg(F.count("*").alias("df")).withColumn("c", F.monotonically_increasing_id()), "items")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("df", "c"))), lambda x: x["c"])
    coded = materialize(sets.join(frequency, "i").groupBy("o").agg(ordered.alias("items")), "coded")
    classes = materialize(coded.groupBy("items").agg(F.min("o").alias("r"), F.count("*").alias("m")).withColumn("n", F.size("items").cast("long")), "classes")
    members = materialize(coded.join(classes, "items").select("r", "o", "n", "m"), "members")
    need = F.floor((F.col("n") * near + 99) / 100)
    probes = classes.select(F.explode(F.slice("items", F.lit(1), (F.col("n") - need + 1).cast("int"))).alias("c"), F.col("r").alias("a"), F.col("n").alias("na"))
    larger = classes.select(F.explode("items").alias("c"), F.col("r").alias("b"), F.col("n").alias("nb"))
    found = probes.join(larger, "c").where((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
    found = materialize(found.select("a", "b", "na", "nb").distinct(), "candidates")
    held = found.join(classes.select(F.col("r").alias("a"), F.col("items").alias("_a")), "a").join(classes.select(F.col("r").alias("b"), F.col("items").alias("_b")), "b")
    shared = held.select("a", "b", "na", "nb", F.size(F.array_intersect("_a", "_b")).cast("long").alias("shared")).where(F.col("shared") * 100 >= F.col("na") * near)
    own = lambda side: members.select(F.col("r").alias(side), F.col("o").alias(f"_{side}"))
    pairs = materialize(shared, "near").join(own("a"), "a").join(own("b"), "b")
    first = F.col("_a") < F.col("_b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    apart = pairs.select(pick("_a", "_b").alias("a"), pick("_b", "_a").alias("b"), "shared", pick("na", "nb").alias("na"), pick("nb", "na").alias("nb"), F.lit("near").alias("kind"))
    copies = members.where("m > 1")
    same = copies.select("r", F.col("o").alias("a"), "n").join(copies.select("r", F.col("o").alias("b")), "r").where("a < b")
    return apart.unionByName(same.select("a", "b", F.col("n").alias("shared"), F.col("n").alias("na"), F.col("n").alias("nb"), F.lit("exact").alias("kind")))


def training_pairs(labels: DataFrame, queries: DataFrame, passages: DataFrame, scores: dict[str, float]) -> DataFrame:
    """Label rows with texts (the stored snippet where a text is missing) and the status's score."""
    score = F.element_at(F.create_map(*[x for k, v in scores.items() for x in (F.lit(k), F.lit(v))]), F.col("status"))
    joined = labels.join(queries.select("control_id", F.col("text").alias("_q")), "control_id", "left").join(passages.select("passage_id", F.col("text").alias("_p")), "passage_id", "left")
    return joined.select("control_id", "passage_id", F.coalesce("_q", "query_snippet").alias("query"), F.coalesce("_p", "passage_snippet").alias("passage"), score.alias("score")).where("query is not null and passage is not null and score is not null")


def triplets(pairs: DataFrame, query: str, item: str, positive: Column, hard: Column, n: int = 3, seed: int = 0) -> DataFrame:
    """C11: up to n negatives for each positive of a query, hard ones first, the rest in the order of a keyed hash."""
    order = keyed_hash(F.col(item), seed=seed)
    negatives = pairs.where(~positive).select(query, F.col(item).alias("negative"), F.row_number().over(Window.partitionBy(query).orderBy(hard.desc(), order, item)).alias("place")).where(F.col("place") <= n)
    return pairs.where(positive).select(query, F.col(item).alias("positive")).join(negatives, query).select(query, "positive", "negative", "place")


def smooth(label: Column, high: float = 0.95, low: float = 0.05) -> Column:
    """C12, P38."""
    return F.when(label >= 1, high).when(label <= 0, low).otherwise(label)


def conversation(system: Column, user: Column, assistant: Column) -> Column:
    """C13."""
    return F.array(*(F.struct(F.lit(k).alias("from"), v.alias("value")) for k, v in (("system", system), ("human", user), ("gpt", assistant))))


def fill_down(rows: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The last value that isn't null, up to and with the row."""
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def keep_or_archive(parts: DataFrame, gold: DataFrame, group: str, file: str, item: str, recency: str, distinct_share: float = 0.85) -> DataFrame:
    """(group, file, n_gold, n_items, kept). Files of a group that hold mostly different items are parts of one
    document and all stay; of duplicates the one with most gold items stays (the most recent on a tie), the rest are archived.

    Null items count for nothing; a group without items keeps all its files. Two files of a group share no item exactly
    if its distinct items are as many as its files' items together, so no pair of files is formed.
    """
    files = parts.groupBy(group, file).agg(F.max(recency).alias("recency"))
    items = parts.where(F.col(item).isNotNull()).select(group, file, item).distinct()
    marked = items.join(gold.select(item, F.lit(1).alias("_g")).distinct(), item, "left")
    sizes = marked.groupBy(group, file).agg(F.count("*").alias("n_items"), F.count("_g").alias("n_gold"))
    spread = items.groupBy(group, item).agg(F.count("*").alias("c")).groupBy(group).agg((F.count("*") / F.sum("c")).alias("share"))
    each = files.join(sizes, [group, file], "left").join(spread, group, "left").na.fill(0, ["n_items", "n_gold"])
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n_gold"), F.desc("recency"), file))
    return each.select(group, file, "n_gold", "n_items", (F.coalesce(F.col("share") > distinct_share, F.lit(True)) | (place == 1)).alias("kept"))


def matching_or_first(rows: DataFrame, by: list[str], where: Column, order: str, n: int = 3) -> DataFrame:
    """the rows of a group for which the condition holds, else its first n rows; null counts as false.

    Only groups without a match are ranked, and of those no more than n rows a task: no group is gathered whole.
    """
    matched = rows.where(F.coalesce(where, F.lit(False)))
    some = matched.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by))).distinct()
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)))
    lacking = rows.join(some, same, "left_anti")
    first = lacking.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_n") <= n).drop("_n")
    return matched.unionByName(first)


def sections(rows: DataFrame, by: list[str], order: str, starts: Column, text: str, glue: str = "\n") -> DataFrame:
    """(by, section, n, text): rows joined in order; a section begins where the condition holds (0: before the first)."""
    numbered = rows.withColumn("section", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return numbered.groupBy(*by, "section").agg(F.count("*").alias("n"), F.array_join(F.transform(parts, lambda x: x["t"]), glue).alias(text))


def before_and_after(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """How many rows each group had and has; a group that one side lacks counts 0 there."""
    a, b = (x.groupBy(*by).agg(F.count("*").alias(n)) for x, n in ((before, "before"), (after, "after")))
    return a.join(b, by, "full_outer").na.fill(0, ["before", "after"])


def scores_of_labels(mappings: DataFrame, labels: DataFrame, keys: tuple[str, str], ordinal: str, columns: list[str]) -> DataFrame:
    """Mappings (control_id, passage_id, ...) with the label of the original id, else of the corrected one; others go.

    keys: labels' original and corrected id. Of several labels with one original id the last counts, with one corrected
    id the first.
    """
    packed = F.struct(*columns)
    side = lambda key, best, name: labels.where(F.trim(key) != "").groupBy(F.trim(key).alias("control_id"), "passage_id").agg(best(packed, F.col(ordinal)).alias(name))
    both = mappings.join(side(keys[0], F.max_by, "_o"), ["control_id", "passage_id"], "left").join(side(keys[1], F.min_by, "_c"), ["control_id", "passage_id"], "left")
    return both.withColumn("_l", F.coalesce("_o", "_c")).where("_l is not null").select(*mappings.columns, *(F.col(f"_l.{c}").alias(c) for c in columns))


def by_prefix(labels: DataFrame, documents: DataFrame, key: str, doc: str, lengths: list[int] | None = None) -> DataFrame:
    """Labels with the document whose id begins theirs, by equality of prefixes of the lengths that document ids have."""
    sizes = lengths or sorted(r[0] for r in documents.select(F.char_length(doc)).distinct().collect())
    cut = labels.withColumn("_p", F.explode(F.array(*(F.when(F.char_length(key) >= n, F.substring(key, 1, n)) for n in sizes)))).where("_p is not null")
    return cut.join(documents.select(F.col(doc).alias("_p"), doc), "_p").drop("_p")


def merged_catalogue(rows: DataFrame, others: list[DataFrame], key: str, texts: list[str], status: str, ordinal: str) -> DataFrame:
    """One record of each id: the longest text of every field over its own rows and the other sources (the first of
    equals), the preferred status, how many rows it had. rows: key, texts, status, ordinal; others: key, texts."""
    def longest(c, order):
        return F.max_by(F.col(c), F.struct(F.coalesce(F.char_length(c), F.lit(-1)), -order)).alias(c)

    statuses = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(status).alias("s")))), lambda x: x["s"])
    own = rows.groupBy(key).agg(*(longest(c, F.col(ordinal)) for c in texts), statuses.alias("_s"), F.count("*").alias("source_rows"))
    out = own
    for i, other in enumerate(others):
        once = other.groupBy(key).agg(*(F.max_by(c, F.struct(F.coalesce(F.char_length(c), F.lit(-1)), c)).alias(f"_{i}_{c}") for c in texts))
        out = out.join(once, key, "left")
    best = lambda c: reduce(lambda a, b: F.when(F.coalesce(F.char_length(b), F.lit(0)) > F.coalesce(F.char_length(a), F.lit(0)), b).otherwise(a), (F.col(f"_{i}_{c}") for i in range(len(others))), F.col(c))
    kept = F.coalesce(F.when(F.array_contains("_s", "Complete"), "Complete"), F.when(F.array_contains("_s", "Incomplete"), "Incomplete"), F.get("_s", F.lit(0)))
    return out.select(key, *(best(c).alias(c) for c in texts), kept.alias(status), "source_rows")


def breakdown_matrix(results: DataFrame, policy: str, breakdown: str, tp: str) -> DataFrame:
    """A4: (policy, family, n) from a stored map of family to count; results without one count their true positives under ``??``."""
    stored = F.when(F.size(F.coalesce(breakdown, F.create_map().cast("map<string,bigint>"))) > 0, F.col(breakdown)).otherwise(F.create_map(F.lit("??"), F.coalesce(tp, F.lit(0)).cast("long")))
    return results.select(policy, F.explode(stored).alias("family", "n")).groupBy(policy, "family").agg(F.sum("n").alias("n"))


def passage_groups(rows: DataFrame, passage: str, control: str, positive: Column, fields: list[str], ordinal: str) -> DataFrame:
    """Of each passage the fields of its first row whose first field isn't empty, its positive controls as a sorted set, and their number."""
    known = F.coalesce(F.col(fields[0]) != "", F.lit(False))
    first = F.min_by(F.struct(*fields), F.struct(~known, F.col(ordinal)))
    hits = F.array_sort(F.collect_set(F.when(positive, F.col(control))))
    grouped = rows.where(F.col(passage).isNotNull()).groupBy(passage).agg(first.alias("f"), hits.alias("positives"))
    return grouped.select(passage, *(F.col(f"f.{c}").alias(c) for c in fields), "positives", F.size("positives").cast("long").alias("n_positives"))


def numbered(rows: DataFrame, by: list[str], order: list[str], prefix: str, out: str = "number") -> DataFrame:
    """Sequential ids ``prefix<n>`` by position inside each group (a document: groups are ranked apart)."""
    return rows.withColumn(out, F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("string")))


# How often a training row of each kind is repeated, and the lower scores of synthetic rows.
STATUS_WEIGHTS = {"real_fa": 3, "real_pa": 3, "real_na": 2, "confusable_na": 3, "synthetic": 1}
SYNTHETIC_SCORES = {"Fully Addressed": 0.85, "Partially Addressed": 0.55, "Not Addressed": 0.0}


def synthetic_rows(rows: DataFrame, query: str, passage: str, status: str, least_words: int = 10, cut_query: int = 512, cut_passage: int = 2000) -> DataFrame:
    """Synthetic pairs as training rows with the lower scores; blank or short ones go, texts take the starts that the source takes."""
    score = F.element_at(F.create_map(*[x for k, v in SYNTHETIC_SCORES.items() for x in (F.lit(k), F.lit(v))]), F.initcap(F.trim(status)))
    words = F.size(F.filter(F.split(F.trim(passage), r"\s+"), lambda w: w != ""))
    kept = rows.withColumn("score", score).where((F.trim(query) != "") & (words >= least_words) & F.col("score").isNotNull())
    return kept.withColumns({query: F.substring(F.trim(query), 1, cut_query), passage: F.substring(F.trim(passage), 1, cut_passage), "is_synthetic": F.lit(True)})


def training_split(real: DataFrame, synthetic: DataFrame, key: list[str], kind: str, seed: int = 42, dev: int = 150) -> tuple[DataFrame, DataFrame]:
    """(train, dev): dev takes `dev` per mille of the real rows by a keyed hash, once each and never a synthetic one; the
    other rows, real and synthetic, stand in train as often as their kind weighs (other kinds once)."""
    split = split_by_hash(real, key, seed, {"dev": dev, "train": 1000 - dev})
    both = split.where("split = 'train'").unionByName(synthetic.withColumn("split", F.lit("train")), allowMissingColumns=True)
    weight = F.coalesce(F.element_at(F.create_map(*[x for k, v in STATUS_WEIGHTS.items() for x in (F.lit(k), F.lit(v))]), F.col(kind)), F.lit(1))
    return replicate(both, weight), split.where("split = 'dev'")
