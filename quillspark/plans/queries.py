"""The engine's operators as queries over the tables of TESTDATA.md, each with the same result as DuckDB SQL.

Stand-ins: benchmark items are the queries, documents the passages (grouped by source), part, orders and lineitem the
places where several rows share a key. Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import annotate, curate, evaluate, retrieve, route, score, segment
from quillspark.plans import mapping
from quillspark.sources.sinks import materialize
from quillspark.streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

Read = Callable[[str], DataFrame]


def query(sql: str | None = None):
    """Register a function of a table reader under its own name."""

    def register(f: Callable[[Read], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: counted(f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def counted(df: DataFrame) -> DataFrame:
    """Ranks, sizes and lengths as long, which is what SQL counts in."""
    return df.withColumns({c: F.col(c).cast("long") for c, kind in df.dtypes if kind == "int" and c in ("rank", "n_query", "n_text", "n_shared", "length")})


# Parts of the SQL that several oracles share.
WORDS = "list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda x: x <> '')"
BM25 = """
p AS (SELECT {g} doc_id, term, count(*) AS tf FROM (SELECT {g} doc_id, unnest(""" + WORDS.format("text") + """) AS term FROM documents) GROUP BY ALL),
l AS (SELECT {g} doc_id, len(""" + WORDS.format("text") + """) AS dl FROM documents),
s AS (SELECT {g} count(*) AS n, avg(dl) AS avgdl FROM l {by}),
i0 AS (SELECT {g} term, ln(n - df + 0.5) - ln(df + 0.5) AS raw, avgdl FROM (SELECT {g} term, count(*) AS df FROM p GROUP BY ALL) {join} s {using}),
i AS (SELECT {g} term, avgdl, CASE WHEN raw < 0 THEN floor_ ELSE raw END AS idf FROM i0 {join} (SELECT {g} 0.25 * avg(raw) AS floor_ FROM i0 {by}) {using}),
q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest(""" + WORDS.format("text") + """) AS term FROM benchmark) GROUP BY ALL),
b AS (
  SELECT item_id, {g} doc_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM p JOIN q USING (term) JOIN i USING ({g} term) JOIN l USING ({g} doc_id) GROUP BY ALL HAVING round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) > 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id{pg} ORDER BY score DESC, doc_id) AS rank FROM b)"""
ALL = BM25.format(g="", by="", join="CROSS JOIN", using="", pg="")
GROUPED = BM25.format(g="source, ", by="GROUP BY source", join="JOIN", using="USING (source)", pg=", source")


def top(t: Read, k: int, group: list[str] | None = None) -> DataFrame:
    return retrieve.bm25(t("documents"), t("benchmark"), doc="doc_id", text=F.col("text"), query="item_id", query_text=F.col("text"), group=group, k=k)


@query(f"WITH {ALL} SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 5")
def r1_bm25_topk(t):
    return top(t, 5)


@query(f"WITH {GROUPED} SELECT item_id, source, doc_id, score, rank FROM r WHERE rank <= 2")
def a25_bm25_per_group(t):
    return top(t, 2, ["source"])


@query("WITH " + ALL + " SELECT term, df, n, round(avgdl, 6) AS avgdl FROM (SELECT term, count(*) AS df FROM p GROUP BY term) CROSS JOIN s")
def a24_bm25_statistics(t):
    _, terms, stats = retrieve.bm25_index(t("documents"), "doc_id", F.col("text"))
    return terms.crossJoin(F.broadcast(stats)).select("term", "df", "n", F.round("avgdl", 6).alias("avgdl"))


COSINE = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.e, v.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v.e, v.e)) + 1e-9), 6) AS score FROM v JOIN v q ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM c WHERE score > 0)"""


@query(f"WITH {COSINE} SELECT query_id, vec_id, score, rank FROM d WHERE rank <= 5")
def r2_cosine_topk(t):
    rows = t("embeddings")
    return retrieve.cosine(rows, rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), doc="vec_id", query="query_id")


OVERLAP = f"""
o AS (SELECT item_id, doc_id, round(len(list_intersect(list_distinct({WORDS.format('q.text')}), list_distinct({WORDS.format('d.text')}))) / len(list_distinct({WORDS.format('q.text')})), 6) AS score FROM r JOIN benchmark q USING (item_id) JOIN documents d USING (doc_id) WHERE rank <= 10)"""


def rescored(t: Read, found: DataFrame | None = None) -> DataFrame:
    found = materialize(top(t, 10), "found") if found is None else found
    return score.score_found(found.select("item_id", "doc_id", F.col("rank").alias("found")), t("benchmark"), t("documents"), "item_id", "doc_id")


@query(f"WITH {ALL}, {OVERLAP}, x AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM o) SELECT item_id, doc_id, score, rank, CASE WHEN score >= 0.6 THEN 'Fully Addressed' WHEN score >= 0.35 THEN 'Partially Addressed' ELSE 'Not Addressed' END AS status FROM x WHERE rank <= 5")
def r9_rescore_label_topk(t):
    return score.label_and_cut(rescored(t), ["item_id"], "doc_id", 0.6, 0.35, 5).select("item_id", "doc_id", "score", "rank", "status")


ARMS = f"WITH {ALL}, {OVERLAP}, a AS (SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 10), e AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM o)"


def arms(t: Read) -> tuple[DataFrame, DataFrame]:
    found = materialize(top(t, 10), "found")
    return found, retrieve.ranked(rescored(t, found), ["item_id"], "score", "doc_id", 6)


@query(ARMS + ", f AS (SELECT item_id, doc_id, round(coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + e.rank), 0), 9) AS score FROM a FULL JOIN (SELECT * FROM e WHERE rank <= 6) e USING (item_id, doc_id)) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 5")
def r3_rank_fusion(t):
    a, b = arms(t)
    return retrieve.fuse(a, b, ["item_id", "doc_id"], ["item_id"], "doc_id", 5)


@query(ARMS + ", x AS (SELECT item_id, doc_id, score / max(score) OVER (PARTITION BY item_id) AS sa FROM a), y AS (SELECT item_id, doc_id, score / max(score) OVER (PARTITION BY item_id) AS sb FROM e WHERE rank <= 6), f AS (SELECT item_id, doc_id, round(0.5 * coalesce(sa, 0) + 0.5 * coalesce(sb, 0), 6) AS score FROM x FULL JOIN y USING (item_id, doc_id)) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 5")
def r6_weighted_hybrid(t):
    a, b = arms(t)
    return retrieve.hybrid(a, b, ["item_id", "doc_id"], ["item_id"], "doc_id")


@query(f"WITH {ALL}, f AS (SELECT item_id, doc_id, rank FROM r WHERE rank <= 3 AND item_id % 2 = 0), z AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS rank FROM documents) SELECT * FROM f UNION ALL SELECT item_id, doc_id, rank FROM benchmark CROSS JOIN z WHERE rank <= 3 AND item_id NOT IN (SELECT item_id FROM f)")
def r5_fallback(t):
    found = top(t, 3).where("item_id % 2 = 0")
    return retrieve.with_fallback(found, t("benchmark"), t("documents"), "item_id", "doc_id", "n_chars", 3)


@query(ARMS + ", g AS (SELECT item_id, doc_id, score FROM e WHERE rank <= 6), u AS (SELECT item_id, doc_id, 0 AS phase, score, 0 AS o FROM g UNION ALL SELECT item_id, doc_id, 1, 0, rank FROM a ANTI JOIN g USING (item_id, doc_id)) SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY phase, score DESC, o, doc_id) AS rank FROM u")
def r14_retrieval_log(t):
    a, b = arms(t)
    return retrieve.retrieval_log(b, a.withColumnRenamed("rank", "o"), "item_id", "doc_id", "o")


@query(f"WITH {ALL}, f AS (SELECT item_id, doc_id FROM r WHERE rank <= 2), h AS (SELECT DISTINCT item_id, source FROM f JOIN documents USING (doc_id)), n AS (SELECT item_id, doc_id FROM h JOIN documents USING (source) ANTI JOIN f USING (item_id, doc_id)) SELECT * FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM n) WHERE rank <= 4")
def r15_neighbour_expansion(t):
    return retrieve.neighbours(top(t, 2), t("documents").select("doc_id", "source"), "item_id", "doc_id", "source", 4)


LABELS = "g AS (SELECT o_custkey % 50 AS control_id, o_orderkey % 200 AS passage_id, CASE o_orderstatus WHEN 'F' THEN 'Fully Addressed' WHEN 'P' THEN 'Partially Addressed' ELSE 'Not Addressed' END AS status, o_orderkey AS ordinal FROM orders)"
PREDICTED = "p AS (SELECT l_partkey % 50 AS control_id, l_orderkey % 200 AS passage_id, round(max(l_discount), 2) AS score, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2)"
FLAGS = "k AS (SELECT control_id, passage_id, bool_or(status <> 'Not Addressed') AS positive, bool_or(status = 'Not Addressed') AS negative FROM g GROUP BY 1, 2)"
STATUS = {"Not Addressed": 0, "Partially Addressed": 1, "Fully Addressed": 2}


def labels(t: Read) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "Fully Addressed").when(F.col("o_orderstatus") == "P", "Partially Addressed").otherwise("Not Addressed")
    return t("orders").select((F.col("o_custkey") % 50).alias("control_id"), (F.col("o_orderkey") % 200).alias("passage_id"), status.alias("status"), F.col("o_orderkey").alias("ordinal"))


def predicted(t: Read) -> DataFrame:
    return t("lineitem").groupBy((F.col("l_partkey") % 50).alias("control_id"), (F.col("l_orderkey") % 200).alias("passage_id")).agg(F.round(F.max("l_discount"), 2).alias("score"), F.min("l_returnflag").alias("flag"))


def flags(t: Read) -> DataFrame:
    return evaluate.label_pairs(labels(t), "control_id", "passage_id", "status")


CONFUSION = "count(p1) AS n_predicted, count(*) FILTER (p1 AND positive) AS tp, count(*) FILTER (p1 AND negative) AS fp, count(*) FILTER (p1 IS NULL AND positive) AS fn"
RATES = "round(tp / nullif(n_predicted, 0), 6) AS precision_all, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision_judged, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_judged"


@query(f"WITH {LABELS}, {PREDICTED}, {FLAGS} SELECT *, {RATES} FROM (SELECT {CONFUSION} FROM (SELECT control_id, passage_id, true AS p1 FROM p) FULL JOIN k USING (control_id, passage_id))")
def a5_confusion(t):
    return evaluate.confusion(predicted(t), flags(t))


@query(f"WITH {LABELS}, {PREDICTED}, {FLAGS} SELECT *, {RATES} FROM (SELECT control_id, {CONFUSION} FROM (SELECT control_id, passage_id, true AS p1 FROM p WHERE score >= 0.1) FULL JOIN k USING (control_id, passage_id) GROUP BY control_id)".replace("round(tp / nullif(n_predicted, 0), 6)", "round(coalesce(tp / nullif(n_predicted, 0), 0), 6)"))
def a7_confusion_per_policy(t):
    """By control: the grouping column is a part of the pair already, so it comes in under another name."""
    p, k = (x.withColumn("by", F.col("control_id")) for x in (predicted(t).where("score >= 0.1"), flags(t)))
    return evaluate.confusion(p, k, ["by"]).withColumnRenamed("by", "control_id")


@query(f"WITH {LABELS}, {FLAGS} SELECT control_id, passage_id FROM k WHERE negative AND NOT positive")
def j10_blocked_pairs(t):
    return evaluate.blocked_pairs(labels(t), "control_id", "passage_id", "status")


@query(f"WITH {LABELS}, {PREDICTED}, {FLAGS} SELECT control_id, passage_id, score FROM p ANTI JOIN (SELECT * FROM k WHERE negative AND NOT positive) USING (control_id, passage_id)")
def j8_without_blocked_pairs(t):
    return predicted(t).join(evaluate.blocked_pairs(labels(t), "control_id", "passage_id", "status"), ["control_id", "passage_id"], "left_anti").select("control_id", "passage_id", "score")


GOLD = "w AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(f"WITH {ALL}, {GOLD}, m AS (SELECT item_id, min(rank) AS best FROM w LEFT JOIN (SELECT * FROM r WHERE rank <= 20) USING (item_id, doc_id) GROUP BY 1) SELECT k, count(*) AS n_queries, count(*) FILTER (best <= k) AS hits, round(count(*) FILTER (best <= k) / count(*), 6) AS hit_rate_at_k FROM m CROSS JOIN (VALUES (1), (5), (10), (20)) v(k) GROUP BY k")
def a10_hit_rate(t):
    heads = t("benchmark").select("item_id", F.col("text").alias("head"))
    hits = route.keyword_hits(t("documents"), "doc_id", F.col("text"), heads, "item_id", "head")
    gold = hits.join(t("documents").select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("head")))
    return evaluate.hit_rate(top(t, 20), gold, [1, 5, 10, 20], query="item_id")


SCORED = f"{LABELS}, {PREDICTED}, {FLAGS}, c AS (SELECT score, positive, flag FROM p JOIN k USING (control_id, passage_id))"
F1 = "round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS {p}, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"


def judged(t: Read) -> DataFrame:
    return predicted(t).join(flags(t), ["control_id", "passage_id"]).select("score", "positive", "flag")


@query(f"WITH {SCORED}, z AS (SELECT score AS threshold, sum(count(*) FILTER (positive)) OVER w AS tp, sum(count(*) FILTER (NOT positive)) OVER w AS fp, sum(count(*) FILTER (positive)) OVER () - sum(count(*) FILTER (positive)) OVER w AS fn FROM c GROUP BY score WINDOW w AS (ORDER BY score DESC)) SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, {F1.format(p='precision')} FROM z")
def a14_threshold_sweep(t):
    return evaluate.threshold_sweep(judged(t), "score", "positive")


GRID = f"WITH {SCORED}, z AS (SELECT flag, threshold::DOUBLE AS threshold, count(*) FILTER (score >= threshold AND positive) AS tp, count(*) FILTER (score >= threshold AND NOT positive) AS fp, count(*) FILTER (score < threshold AND positive) AS fn FROM c CROSS JOIN (VALUES (0.02::DOUBLE), (0.05), (0.08), (0.1)) v(threshold) GROUP BY 1, 2), y AS (SELECT *, {F1.format(p='precision_judged')} FROM z)"


@query(GRID + " SELECT * FROM y")
def a15_grid_sweep(t):
    return evaluate.grid_sweep(judged(t), "score", "positive", [0.02, 0.05, 0.08, 0.1], ["flag"])


@query(GRID + " SELECT flag, CASE WHEN f1 > 0 THEN threshold ELSE 3.0 END AS threshold, f1 FROM y QUALIFY row_number() OVER (PARTITION BY flag ORDER BY f1 DESC, recall DESC, threshold) = 1")
def a16_best_threshold(t):
    return evaluate.best_threshold(a15_grid_sweep(t), ["flag"])


@query(f"WITH {SCORED} SELECT positive, count(score) AS n, min(score) AS least, max(score) AS greatest, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(stddev_samp(score), 6) AS deviation FROM c GROUP BY positive")
def a13_distribution(t):
    return evaluate.distribution(judged(t), "positive", "score")


@query("WITH x AS (SELECT l_returnflag AS a, CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'R' END AS b FROM lineitem), y AS (SELECT a AS class, 1 AS s, (a = b)::INT AS h, 0 AS g FROM x UNION ALL SELECT b, 0, 0, 1 FROM x) SELECT class, sum(s)::BIGINT AS support, round(coalesce(sum(h) / nullif(sum(g), 0), 0), 6) AS precision, round(coalesce(sum(h) / nullif(sum(s), 0), 0), 6) AS recall, round(coalesce(2 * sum(h) / nullif(sum(g) + sum(s), 0), 0), 6) AS f1 FROM y GROUP BY class")
def a9_per_class(t):
    return evaluate.per_class(t("lineitem").select("l_returnflag", F.when(F.col("l_linestatus") == "O", "N").otherwise("R").alias("guess")), "l_returnflag", "guess")


@query("SELECT o_orderpriority, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM orders GROUP BY 1")
def a2_percent_of_total(t):
    return evaluate.with_total(t("orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")))


@query("SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS \"A\", count(*) FILTER (l_returnflag = 'N') AS \"N\", count(*) FILTER (l_returnflag = 'R') AS \"R\", count(*) AS total, (count(*) FILTER (l_returnflag = 'A') > 0)::INT + (count(*) FILTER (l_returnflag = 'N') > 0)::INT + (count(*) FILTER (l_returnflag = 'R') > 0)::INT AS active FROM lineitem GROUP BY 1")
def a3_coverage_matrix(t):
    return evaluate.matrix(t("lineitem"), "l_suppkey", "l_returnflag", ["A", "N", "R"])


@query("WITH s AS (SELECT round(0.5 * (l_quantity / 50) + 0.35 * (l_discount * 10) + 0.15 * (l_tax * 10), 9) AS s FROM lineitem) SELECT round(avg(s), 6) AS composite, count(*) FILTER (s < 0.5) AS alerts, count(*) AS n FROM s")
def a11_composite(t):
    return evaluate.composite(t("lineitem").select((F.col("l_quantity") / 50).alias("e"), (F.col("l_discount") * 10).alias("c"), (F.col("l_tax") * 10).alias("s")), "e", "c", "s")


@query("WITH x AS (SELECT l_quantity AS a, l_discount AS b FROM lineitem), r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM x) SELECT round(avg(abs(a - b)), 4) AS mae, round(corr(ra, rb), 6) AS spearman, count(*) AS n FROM r")
def a29_rank_correlation(t):
    return evaluate.spearman(t("lineitem"), "l_quantity", "l_discount")


@query(f"WITH {LABELS}, v AS (SELECT control_id, passage_id, status, count(*) AS votes, min(ordinal) AS ordinal, CASE status WHEN 'Fully Addressed' THEN 2 WHEN 'Partially Addressed' THEN 1 ELSE 0 END AS rank FROM g GROUP BY ALL) SELECT control_id, passage_id, status, votes, ordinal FROM v QUALIFY row_number() OVER (PARTITION BY control_id, passage_id ORDER BY votes DESC, rank DESC) = 1")
def a17_majority_vote(t):
    return curate.vote(labels(t), ["control_id", "passage_id"], "status", STATUS, "ordinal")


@query(f"WITH {LABELS} SELECT * FROM g WHERE status <> 'Not Addressed' UNION ALL SELECT * FROM (SELECT * FROM g WHERE status = 'Not Addressed' QUALIFY row_number() OVER (PARTITION BY passage_id ORDER BY ordinal) <= 2)")
def w4_negative_cap(t):
    return curate.cap(labels(t), ["passage_id"], F.col("status") == "Not Addressed", ["ordinal"], 2)


@query("SELECT l_partkey, l_extendedprice, l_orderkey * 10 + l_linenumber AS o FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) = 1")
def w5_keep_best(t):
    return curate.keep_best(t("lineitem").select("l_partkey", "l_extendedprice", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o")), ["l_partkey"], "l_extendedprice", "o")


@query("SELECT n_regionkey, string_agg(n_name || ':' || n_nationkey, ',' ORDER BY n_nationkey DESC) AS nations, count(*) AS n FROM nation GROUP BY 1")
def a21_group_nested(t):
    nested = curate.group_nested(t("nation"), "n_regionkey", ["n_name", "n_nationkey"], "n_nationkey", "nations")
    return nested.withColumn("nations", F.array_join(F.transform("nations", lambda x: F.concat_ws(":", x["n_name"], x["n_nationkey"].cast("string"))), ","))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def a22_concatenate(t):
    return curate.concatenate(t("conversations"), ["conv_id"], "turn", "text")


@query("WITH s AS (SELECT DISTINCT source, lang || ':' || (n_chars // 50) AS item FROM documents), n AS (SELECT source, count(*) AS n FROM s GROUP BY 1), p AS (SELECT x.source AS a, y.source AS b, count(*) AS shared FROM s x JOIN s y ON x.item = y.item AND x.source < y.source GROUP BY 1, 2) SELECT a, b, shared, na.n AS na, nb.n AS nb, CASE WHEN shared = na.n AND na.n = nb.n THEN 'exact' WHEN shared >= 0.9 * least(na.n, nb.n) THEN 'near' ELSE 'partial' END AS kind FROM p JOIN n na ON na.source = a JOIN n nb ON nb.source = b")
def j19_file_overlaps(t):
    return curate.overlaps(t("documents").select("source", F.concat_ws(":", "lang", F.floor(F.col("n_chars") / 50).cast("string")).alias("item")), "source", "item")


@query("SELECT p_partkey, copy FROM part, unnest(generate_series(1, p_size % 4)) u(copy)")
def o10_replicate(t):
    return curate.replicate(t("part").select("p_partkey", "p_size"), F.col("p_size") % 4).select("p_partkey", F.col("copy").cast("long").alias("copy"))


@query("SELECT c_custkey, ['a', 'b', 'c'][(c_custkey % 3) + 1] AS domain FROM customer")
def o13_round_robin(t):
    return curate.round_robin(t("customer").select("c_custkey"), "c_custkey", ["a", "b", "c"], "domain")


@query("WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN c ON c_custkey = o_custkey")
def j5_left_first_match(t):
    n = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t("customer").select("c_custkey").join(n, "c_custkey", "left").na.fill(0, ["n"])


@query("SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)")
def j15_fill_gaps(t):
    return curate.fill_gaps(t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), t("part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name")), ["k"])


@query("SELECT coalesce(c_custkey, p_partkey) AS k, coalesce(p_name, c_name) AS name FROM customer FULL JOIN part ON c_custkey = p_partkey")
def j14_upsert(t):
    return curate.upsert(t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), t("part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name")), "k", ["name"])


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS latest FROM events")
def w10_fill_down(t):
    rows = t("events").withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return curate.fill_down(rows, ["user_id"], ["ts", "event_id"], "v", "latest").select("event_id", "user_id", "latest")


@query(r"SELECT doc_id, u.n AS n, u.s AS sentence FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?]\s+') AS a FROM documents), LATERAL (SELECT unnest(generate_series(1, len(a))) AS n, unnest(a) AS s) u")
def p17_sentences(t):
    return t("documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence")).select("doc_id", (F.col("n") + 1).cast("long").alias("n"), "sentence")


@query(f"SELECT doc_id, len({WORDS.format('text')})::BIGINT AS n_tokens, len(list_distinct({WORDS.format('text')}))::BIGINT AS n_distinct FROM documents")
def p1_tokens(t):
    words = T.tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '...' ELSE text END AS snippet, substr(text, 1, 200) AS head FROM documents")
def p3_snippet(t):
    return t("documents").select("doc_id", T.snippet(F.col("text"), 40).alias("snippet"), F.substring("text", 1, 200).alias("head"))


@query("SELECT doc_id, regexp_matches(lower(text), 'the|that') AS has_word, length(text) BETWEEN 50 AND 5000 AS fits FROM documents")
def f1_keyword_filter(t):
    return t("documents").select("doc_id", T.has_obligation(F.col("text"), ["the", "that"]).alias("has_word"), F.char_length("text").between(50, 5000).alias("fits"))


@query(r"SELECT doc_id, array_to_string(CASE WHEN len(h) > 0 THEN h ELSE a[1:1] END, ' ') AS text FROM (SELECT doc_id, a, list_filter(a, lambda s: regexp_matches(lower(s), 'that')) AS h FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?]\s+') AS a FROM documents))")
def p18_obligation_sentences(t):
    return t("documents").select("doc_id", T.obligation_text(F.col("text"), "that").alias("text"))


@query("SELECT DISTINCT doc_id, 'l' || (n_regionkey) AS owner, substr(lower(n_name), 1, 2) AS word, 2 AS size FROM documents JOIN nation ON contains(lower(text), substr(lower(n_name), 1, 2))")
def j17_keyword_hits(t):
    words = t("nation").select(F.concat(F.lit("l"), F.col("n_regionkey").cast("string")).alias("owner"), F.substring(F.lower("n_name"), 1, 2).alias("word")).distinct()
    return route.keyword_hits(t("documents"), "doc_id", F.col("text"), words, "owner", "word")


TYPES = "VALUES ('A', 'the'), ('A', 'there'), ('B', 'tion'), ('B', 'ing'), ('C', 'ungkeit'), ('C', 'und')"


def types(t: Read) -> DataFrame:
    return t("region").limit(1).select(F.explode(F.array(*(F.struct(F.lit(f).alias("family"), F.lit(n).alias("name")) for f, n in (("A", "the"), ("A", "there"), ("B", "tion"), ("B", "ing"), ("C", "ungkeit"), ("C", "und"))))).alias("x")).select("x.*")


@query(f"WITH h AS (SELECT doc_id, family, max(length(name)) AS size FROM documents JOIN ({TYPES}) v(family, name) ON contains(lower(split_part(text, chr(10), 1)), name) GROUP BY 1, 2) SELECT doc_id, family, round(size / max(size) OVER (PARTITION BY doc_id), 6) AS confidence FROM h")
def r16_title_routes(t):
    """The documents have no title column: a document's title is its first line."""
    return route.title_routes(t("documents"), "doc_id", F.substring_index("text", "\n", 1), types(t))


@query(f"WITH {COSINE}, f AS (SELECT d.query_id, e.label::VARCHAR AS family, max(score) AS score FROM d JOIN embeddings e USING (vec_id) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, family) AS rank FROM f) SELECT query_id, family, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.0::DOUBLE ELSE round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 6) END AS confidence FROM k WHERE rank <= 3 WINDOW w AS (PARTITION BY query_id)")
def r17_embedding_routes(t):
    rows = t("embeddings")
    named = rows.withColumn("family", F.col("label").cast("string"))
    best = retrieve.cosine(named, rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), doc="vec_id", query="query_id", by="family")
    return route.embedding_routes(best, "query_id")


@query(f"WITH {ALL} SELECT item_id, doc_id, len(list_distinct({WORDS.format('q.text')})) AS n_query, len(list_distinct({WORDS.format('d.text')})) AS n_text, len(list_intersect(list_distinct({WORDS.format('q.text')}), list_distinct({WORDS.format('d.text')}))) AS n_shared, contains(lower(d.text), lower(q.text)) AS contains, length(d.text) AS length FROM r JOIN benchmark q USING (item_id) JOIN documents d USING (doc_id) WHERE rank <= 10")
def r20_features(t):
    pairs = top(t, 10).join(t("benchmark").select("item_id", F.col("text").alias("q")), "item_id").join(t("documents").select("doc_id", F.col("text").alias("d")), "doc_id")
    return route.features(pairs, F.col("q"), F.col("d")).select("item_id", "doc_id", "n_query", "n_text", "n_shared", "contains", "length")


@query("SELECT window_start AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, * FROM events) GROUP BY 1, 2")
def s0_event_windows(t):
    return events.windowed_counts(t("events"))


@query("WITH x AS (SELECT user_id, list(DISTINCT event_type ORDER BY event_type) AS kinds FROM events GROUP BY 1) SELECT user_id, array_to_string(kinds, ',') AS kinds FROM x")
def a20_union_per_document(t):
    return t("events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("SELECT 'doc_' || doc_id AS passage, 'doc_' || doc_id AS document FROM documents")
def p5_document_id(t):
    rows = t("documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("passage"))
    return rows.select("passage", T.document_id(F.concat("passage", F.lit("_passage_12"))).alias("document"))


@query("SELECT c_custkey, round(CASE WHEN c_nationkey % 6 = 0 THEN 0.5 ELSE (c_nationkey % 6 - 1) / 4 END, 6) AS confidence, CASE WHEN c_acctbal >= 6000 THEN 'Fully Addressed' WHEN c_acctbal >= 3500 THEN 'Partially Addressed' ELSE 'Not Addressed' END AS status FROM customer")
def p32_labels_and_confidence(t):
    return t("customer").select("c_custkey", F.round(T.unit_confidence(F.col("c_nationkey") % 6), 6).alias("confidence"), T.threshold_label(F.col("c_acctbal"), 6000, 3500).alias("status"))


@query(f"""WITH l AS (SELECT doc_id, unnest(generate_series(1, len(a))) AS i, trim(unnest(a)) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
h AS (SELECT *, length(line) BETWEEN 1 AND 100 AND len({WORDS.format('line')}) <= 12 AND NOT ends_with(line, '.') AND (regexp_matches(line, '^[0-9]+([.][0-9]+)*[.)]?\\s+\\S') OR (upper(line) = line AND regexp_matches(line, '[A-Z]')) OR regexp_matches(line, '^#{{1,6}}\\s')) AS head FROM l),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM h),
g AS (SELECT doc_id, s, coalesce(max(line) FILTER (head), '') AS section, trim(coalesce(string_agg(line, ' ' ORDER BY i) FILTER (NOT head), '')) AS text FROM s GROUP BY 1, 2)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS n, section, substr(text, 1, 5000) AS text FROM g WHERE length(text) >= 30""")
def x1_line_passages(t):
    return segment.lines_to_passages(t("documents"), "doc_id", F.col("text"))


@query("""WITH RECURSIVE x AS (SELECT doc_id, line, length(line) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (SELECT doc_id, unnest(a) AS line, unnest(generate_series(1, len(a))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)) WHERE trim(line) <> ''),
f AS (SELECT doc_id, i, n AS size, 0 AS chunk FROM x WHERE i = 1 UNION ALL SELECT x.doc_id, x.i, CASE WHEN f.size > 0 AND f.size + x.n > 1000 THEN x.n ELSE f.size + x.n END, f.chunk + (f.size > 0 AND f.size + x.n > 1000)::INT FROM f JOIN x ON x.doc_id = f.doc_id AND x.i = f.i + 1)
SELECT doc_id, chunk, count(*) AS n_items, substr(string_agg(line, chr(10) ORDER BY i), 1, 1000) AS text FROM f JOIN x USING (doc_id, i) GROUP BY 1, 2""")
def x4_chunks(t):
    return segment.chunks(t("documents"), "doc_id", F.col("text"))


HASH = "('0x' || substr(md5('{0}:' || {1}), 1, 8))::BIGINT"


@query(f"SELECT doc_id, CASE WHEN {HASH.format(42, 'doc_id')} % 1000 < 800 THEN 'train' WHEN {HASH.format(42, 'doc_id')} % 1000 < 900 THEN 'dev' ELSE 'test' END AS split FROM documents")
def o11_hash_split(t):
    return curate.split_by_hash(t("documents").select("doc_id"), ["doc_id"], 42, {"train": 800, "dev": 100, "test": 100})


@query(f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {HASH.format(42, 'doc_id')}, doc_id) <= 5")
def o12_group_sample(t):
    return curate.sample_per_group(t("documents").select("doc_id", "source"), ["source"], "doc_id", 42, 5)


@query(f"WITH {LABELS}, n AS (SELECT control_id, ordinal AS negative, row_number() OVER (PARTITION BY control_id ORDER BY status = 'Partially Addressed' DESC, {HASH.format(0, 'ordinal')}, ordinal) AS place FROM g WHERE status <> 'Fully Addressed' QUALIFY place <= 3) SELECT control_id, ordinal AS positive, negative, place FROM g JOIN n USING (control_id) WHERE status = 'Fully Addressed'")
def c11_triplets(t):
    rows = labels(t).withColumn("item", F.col("ordinal"))
    return curate.triplets(rows, "control_id", "item", F.col("status") == "Fully Addressed", F.col("status") == "Partially Addressed")


SCORE = f"round(len(list_intersect(list_distinct({WORDS.format('q.text')}), list_distinct({WORDS.format('d.text')}))) / len(list_distinct({WORDS.format('q.text')})), 6)"
LABEL = "CASE WHEN score >= 0.6 THEN 'Fully Addressed' WHEN score >= 0.35 THEN 'Partially Addressed' ELSE 'Not Addressed' END"


@query(f"WITH {GROUPED}, o AS (SELECT item_id, d.source, doc_id, {SCORE} AS score FROM r JOIN benchmark q USING (item_id) JOIN documents d USING (doc_id) WHERE rank <= 10), c AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) <= 3), k AS (SELECT item_id, source, doc_id, {LABEL} AS status, score FROM c ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)) SELECT item_id AS query_id, source AS doc_id, doc_id AS passage_id, status, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, k.doc_id) AS rank FROM k WHERE status <> 'Not Addressed' QUALIFY rank <= 10")
def r11_control_centric(t):
    asks = t("benchmark").select(F.col("item_id").alias("query_id"), "text")
    passages = t("documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("passage_id"), "text", F.col("doc_id").alias("ordinal"))
    blocked = t("labels").where("toxic = 1").select(F.col("doc_id").alias("passage_id"))
    return mapping.control_centric(asks, passages, mapping.Options(), blocked_passages=blocked)[0]


def swapped(sql: str) -> str:
    """The SQL with documents and benchmark in each other's place."""
    for a, b in (("documents", "benchmark"), ("doc_id", "item_id")):
        sql = sql.replace(a, "@").replace(b, a).replace("@", b)
    return sql


@query(f"WITH {swapped(ALL)}, o AS (SELECT doc_id, item_id, {SCORE} AS score FROM r JOIN benchmark q USING (item_id) JOIN documents d USING (doc_id) WHERE rank <= 10), c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS rank FROM o) SELECT doc_id AS passage_id, item_id AS control_id, {LABEL} AS status, score, rank FROM c WHERE score >= 0.35 AND rank <= 10")
def r12_passage_centric(t):
    controls = t("benchmark").select(F.col("item_id").alias("control_id"), "text", F.lit("all").alias("family"))
    passages = t("documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("passage_id"), "text")
    return mapping.passage_centric(passages, controls, mapping.Options())


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FULLY' ELSE 'NOT' END AS verdict, 'x' AS reason, CASE o_orderstatus WHEN 'F' THEN 'CORRECT' ELSE 'WRONG' END AS assignment FROM orders")
def l5_judge_replies(t):
    reply = F.concat(F.lit("VERDICT: "), F.when(F.col("o_orderstatus") == "F", "Fully").otherwise("Not"), F.lit("\nREASON: x\n"))
    return t("orders").select("o_orderkey", annotate.judge_reply(reply).alias("j")).select("o_orderkey", "j.*")
