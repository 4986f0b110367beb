"""Evaluation and calibration (A1 to A16, A26, A29, J5 to J10, W13). Both precisions have names of their own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import f1, ratio, tokens
from quillspark.sources.sinks import in_ranges, materialize

POSITIVE = ["Fully Addressed", "Partially Addressed"]


def with_total(counts: DataFrame, n: str = "n") -> DataFrame:
    """A2: percent of the whole, to 4 places."""
    return counts.withColumn("percent", F.round(100 * F.col(n) / counts.agg(F.sum(n)).scalar(), 4))


def running_sums(counts: DataFrame, order: str, values: list[str], by: list[str], falling: bool = False, few: int = 100_000) -> DataFrame:
    """counts with ``<value>_upto``: sums over the rows up to and with this one, by `order` (distinct in each group of `by`).

    counts is computed once. Its rows are dealt to ranges of (group, order); each range is summed by itself, and what its
    group has in the ranges before (one row for a range and group) is added. No task takes a group that spans ranges whole.
    """
    sort = F.desc(order) if falling else F.asc(order)
    dealt = in_ranges(counts, [*by, sort], few=few)
    sums = dealt.groupBy("_range", *by).agg(*(F.sum(v).alias(f"_{v}") for v in values))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("_range").alias("_r"), *(F.col(c).alias(f"_by_{c}") for c in by), *(F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}_before") for v in values))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by), F.col("_range") == F.col("_r"))
    inside = Window.partitionBy("_range", *by).orderBy(sort)
    own = dealt.join(F.broadcast(base) if not by else base, same)
    return own.withColumns({f"{v}_upto": F.col(f"_{v}_before") + F.sum(v).over(inside) for v in values}).select(*counts.columns, *(f"{v}_upto" for v in values))


def matrix(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """A1, A3, K5: counts of row by column with zero fill, total and how many columns are in use."""
    wide = rows.groupBy(row).pivot(column, values).count().na.fill(0, values)
    total = reduce(lambda a, b: a + b, map(F.col, values))
    used = reduce(lambda a, b: a + b, ((F.col(v) > 0).cast("int") for v in values))
    return wide.withColumns({"total": total, "active": used})


def label_pairs(labels: DataFrame, key: str, passage: str, status: str) -> DataFrame:
    """Distinct labelled pairs with `positive` and `negative` flags; a pair may have both."""
    yes = F.col(status).isin(POSITIVE)
    return labels.groupBy(F.col(key).alias("control_id"), F.col(passage).alias("passage_id")).agg(F.bool_or(yes).alias("positive"), F.bool_or(~yes).alias("negative"))


def confusion(predictions: DataFrame, labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and both precisions from distinct pairs. predictions and labels need control_id, passage_id (and by)."""
    keys = ["control_id", "passage_id", *(by or [])]
    predicted = predictions.select(keys).distinct().withColumn("p", F.lit(1))
    joined = predicted.join(labels.select(*keys, "positive", "negative"), keys, "full_outer")
    count = lambda c: F.count_if(c)
    p = F.col("p").isNotNull()
    counts = joined.groupBy(*(by or [])).agg(
        count(p).alias("n_predicted"), count(p & F.coalesce("positive", F.lit(False))).alias("tp"),
        count(p & F.coalesce("negative", F.lit(False))).alias("fp"), count(~p & F.coalesce("positive", F.lit(False))).alias("fn"),
    )
    tp = F.col("tp")
    scored = counts.withColumns({"precision_all": ratio(tp, F.col("n_predicted")), "precision_judged": ratio(tp, tp + F.col("fp")), "recall": ratio(tp, tp + F.col("fn"))})
    out = scored.withColumn("f1_judged", f1(F.col("precision_judged"), F.col("recall")))
    return out.withColumns({c: F.round(c, 6) for c in ("precision_all", "precision_judged", "recall", "f1_judged")})


def hit_rate(log: DataFrame, gold: DataFrame, ks: list[int], query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """(k, n_queries, hits, hit_rate_at_k): a query counts if any gold row is among its first k; one that the log lacks is a miss."""
    best = gold.select(query, doc).distinct().join(log.select(query, doc, "rank"), [query, doc], "left").groupBy(query).agg(F.min("rank").alias("best"))
    each = best.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    out = each.groupBy("k").agg(F.count("*").alias("n_queries"), F.count_if(F.col("best") <= F.col("k")).alias("hits"))
    return out.withColumn("hit_rate_at_k", F.round(ratio(F.col("hits"), F.col("n_queries")), 6))


def per_class(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall, F1 and support of every class."""
    both = rows.select(F.explode(F.array(F.struct(F.col(truth).alias("class"), F.lit(1).alias("t"), (F.col(truth) == F.col(guess)).cast("int").alias("hit"), F.lit(0).alias("g")), F.struct(F.col(guess).alias("class"), F.lit(0).alias("t"), F.lit(0).alias("hit"), F.lit(1).alias("g")))).alias("x")).select("x.*")
    sums = both.groupBy("class").agg(F.sum("t").alias("support"), F.sum("hit").alias("tp"), F.sum("g").alias("guessed"))
    out = sums.withColumns({"precision": ratio(F.col("tp"), F.col("guessed")), "recall": ratio(F.col("tp"), F.col("support"))})
    out = out.withColumn("f1", f1(F.col("precision"), F.col("recall")))
    return out.select("class", "support", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def distribution(rows: DataFrame, by: str, value: str) -> DataFrame:
    """N, least, greatest, mean, median and sample deviation (null for one row); nulls don't count.

    The median is exact: values are counted, the counts summed in ranges, and those looked up that hold the middle one or two.
    """
    v = F.col(value)
    told = rows.groupBy(by).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("deviation"))
    middle = medians(rows, by, value).withColumnsRenamed({by: "_by", "median": "_median"})
    return told.join(middle, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "n", "least", "greatest", "mean", F.round("_median", 6).alias("median"), "deviation")


def medians(rows: DataFrame, by: str, value: str, few: int = 100_000) -> DataFrame:
    """(by, median) of every group with a value: no task lists or sorts a group of more than `few` different values whole."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    sums = materialize(running_sums(counts, "_v", ["_n"], [by], few=few), "sums")
    totals = sums.groupBy(by).agg(F.max("_n_upto").alias("_all")).withColumnRenamed(by, "_by")
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    holds = lambda place: (F.col("_n_upto") >= place) & (F.col("_n_upto") - F.col("_n") < place)
    middle = sums.join(totals, F.col(by).eqNullSafe(F.col("_by"))).where(holds(low) | holds(high))
    return middle.groupBy(by).agg((F.avg(F.col("_v").cast("double"))).alias("median"))


def threshold_sweep(rows: DataFrame, score: str, positive: str, by: list[str] | None = None) -> DataFrame:
    """For every distinct score as threshold: tp, fp, fn, precision, recall, F1.

    One pass: counts per distinct score, computed once, then running sums over falling scores.
    """
    by = by or []
    counts = rows.groupBy(*by, F.col(score).alias("threshold")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    sums = running_sums(counts, "threshold", ["p", "n"], by, falling=True).withColumnsRenamed({"p_upto": "tp", "n_upto": "fp"})
    sums = materialize(sums, "sums")
    every = sums.groupBy(*by).agg(F.max("tp").alias("all"))
    sums = sums.join(every, by) if by else sums.withColumn("all", every.scalar())
    swept = sums.withColumn("fn", F.col("all") - F.col("tp"))
    swept = swept.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("all"))})
    return swept.select(*by, "threshold", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall")), F.round(f1(F.col("precision"), F.col("recall")), 6).alias("f1"))


def grid_sweep(rows: DataFrame, score: str, positive: str, grid: list[float], by: list[str] | None = None) -> DataFrame:
    """The same counts at fixed thresholds, judged precision."""
    by = by or []
    each = rows.select(*by, score, positive, F.explode(F.array(*map(F.lit, grid))).alias("threshold"))
    hit = F.col(score) >= F.col("threshold")
    out = each.groupBy(*by, "threshold").agg(F.count_if(hit & F.col(positive)).alias("tp"), F.count_if(hit & ~F.col(positive)).alias("fp"), F.count_if(~hit & F.col(positive)).alias("fn"))
    tp = F.col("tp")
    out = out.withColumns({"precision_judged": ratio(tp, tp + F.col("fp")), "recall": ratio(tp, tp + F.col("fn"))}).withColumn("f1", f1(F.col("precision_judged"), F.col("recall")))
    return out.withColumns({c: F.round(c, 6) for c in ("precision_judged", "recall", "f1")})


def best_threshold(swept: DataFrame, by: list[str], default: float = 3.0) -> DataFrame:
    """The best threshold of each group by (F1, recall), the lowest on a tie; the default where nothing was found right."""
    best = swept.groupBy(*by).agg(F.max_by(F.struct("threshold", "f1", "recall"), F.struct("f1", "recall", (-F.col("threshold")).alias("low"))).alias("b"))
    return best.select(*by, F.when(F.col("b.f1") > 0, F.col("b.threshold")).otherwise(F.lit(default)).alias("threshold"), F.col("b.f1").alias("f1"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Mean absolute error and rank correlation (average ranks)."""
    def average_rank(c):
        counts = rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_n"))
        return running_sums(counts, c, ["_n"], []).select(c, (F.col("_n_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(f"_rank_{c}"))

    rows = materialize(rows.select(a, b), "pairs")
    both = rows.join(average_rank(a), a).join(average_rank(b), b)
    return both.agg(F.round(F.avg(F.abs(F.col(a) - F.col(b))), 4).alias("mae"), F.round(F.corr(f"_rank_{a}", f"_rank_{b}"), 6).alias("spearman"), F.count("*").alias("n"))


def composite(rows: DataFrame, entailment: str, coverage: str, stability: str) -> DataFrame:
    """0.5 entailment + 0.35 coverage + 0.15 stability; the average and how many lie under 0.5."""
    score = 0.5 * F.col(entailment) + 0.35 * F.col(coverage) + 0.15 * F.col(stability)
    return rows.select(F.round(score, 9).alias("s")).agg(F.round(F.avg("s"), 6).alias("composite"), F.count_if(F.col("s") < 0.5).alias("alerts"), F.count("*").alias("n"))


def blocked_pairs(labels: DataFrame, key: str, passage: str, status: str) -> DataFrame:
    """Negative pairs that are positive nowhere."""
    p = label_pairs(labels, key, passage, status)
    return p.where("negative and not positive").select("control_id", "passage_id")


def macro(rates: DataFrame, where: Column | None = None) -> DataFrame:
    """Plain means over groups (documents); groups that failed or were skipped are left out by `where`."""
    some = rates if where is None else rates.where(where)
    return some.agg(F.count("*").alias("n_groups"), *(F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision_judged", "recall", "f1_judged")))


def obligation_coverage(parts: Column, passage: Column) -> Column:
    """The share of the parts of which the passage holds any of the first five alphabetic words longer than four
    letters from "shall" on (from the start where there is none); 0 without parts or passage."""
    low = F.lower(F.coalesce(passage, F.lit("")))

    def hit(part):
        t = F.lower(part)
        words = F.filter(tokens(F.substr(t, F.greatest(F.instr(t, "shall"), F.lit(1)))), lambda w: w.rlike(r"^\p{L}{5,}$"))
        return F.exists(F.slice(words, 1, 5), lambda w: F.contains(low, w))

    return F.when((F.size(parts) > 0) & (low != ""), F.round(F.size(F.filter(parts, hit)) / F.size(parts), 3)).otherwise(0.0)


def field_coverage(rows: DataFrame, fields: list[str]) -> DataFrame:
    """For every field how many rows fill it (neither null nor blank), and the share."""
    filled = [F.count_if(F.trim(F.col(f).cast("string")) != "").alias(f) for f in fields]
    wide = rows.agg(F.count("*").alias("n"), *filled)
    long = wide.select("n", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in fields))).alias("x"))
    return long.select("x.field", "x.filled", F.round(ratio(F.col("x.filled"), F.col("n")), 6).alias("share"))


def judge_agreement(rows: DataFrame, right: Column, verdict: Column) -> DataFrame:
    """How many right rows were kept, how many wrong ones were dropped, and the accuracy of both together."""
    counts = rows.agg(F.count_if(right).alias("n_right"), F.count_if(~right).alias("n_wrong"), F.count_if(right & verdict).alias("right_kept"), F.count_if(~right & ~verdict).alias("wrong_dropped"))
    n = F.col("n_right") + F.col("n_wrong")
    return counts.withColumns({"wrong_rate": F.round(ratio(F.col("wrong_dropped"), F.col("n_wrong")), 6), "accuracy": F.round(ratio(F.col("right_kept") + F.col("wrong_dropped"), n), 6)})
