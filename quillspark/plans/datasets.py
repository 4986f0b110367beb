"""Queries of joins, windows, training sets, annotation and segmentation, with DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import obligations as O
from quillspark.functions import text as T
from quillspark.operators import annotate, curate, evaluate, retrieve, route, score, segment, synthesize
from quillspark.plans.coverage import SHALL, literal, query, shall
from quillspark.plans.inventory import FAMILIES, MEMBERS, menu
from quillspark.plans.queries import ALL, ARMS, FLAGS, LABELS, PREDICTED, STATUS, WORDS, Read, arms, flags, labels, predicted, rescored, top

# Joins.

ROUTES = "('F', 'A'), ('F', 'B'), ('O', 'B')"


@query(f"SELECT c_custkey, doc FROM customer JOIN (VALUES {ROUTES}) v(doc, family) ON CASE c_nationkey % 2 WHEN 0 THEN 'A' ELSE 'B' END = family")
def j1_routed_pairs(t):
    """Queries with the documents that are routed to their family."""
    asks = t("customer").select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, "A").otherwise("B").alias("family"))
    return asks.join(literal(t, ROUTES, "doc, family"), "family").select("c_custkey", "doc")


@query(f"WITH {ALL} SELECT item_id, doc_id, term, tf, qf FROM p JOIN q USING (term)")
def j2_postings(t):
    asked = t("benchmark").select("item_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("qf"))
    postings, _, _ = retrieve.bm25_index(t("documents"), "doc_id", F.col("text"), only=asked)
    return postings.join(asked, "term").select("item_id", "doc_id", "term", "tf", "qf")


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT q.vec_id AS query_id, count(*) AS n, round(max(round(list_inner_product(q.e, v.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v.e, v.e)) + 1e-9), 6)), 6) AS best FROM v JOIN v q ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id WHERE round(list_inner_product(q.e, v.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v.e, v.e)) + 1e-9), 6) > 0 GROUP BY 1")
def j3_positive_cosines(t):
    rows = t("embeddings")
    found = retrieve.cosine(rows, rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), doc="vec_id", query="query_id", k=None)
    return found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("best"))


@query(ARMS + " SELECT item_id, doc_id, a.rank AS ra, e.rank AS rb FROM a FULL JOIN (SELECT * FROM e WHERE rank <= 6) e USING (item_id, doc_id)")
def j4_both_arms(t):
    a, b = arms(t)
    return a.select("item_id", "doc_id", F.col("rank").alias("ra")).join(b.select("item_id", "doc_id", F.col("rank").alias("rb")), ["item_id", "doc_id"], "full_outer")


ORIGINAL = "g6 AS (SELECT (o_custkey % 40)::VARCHAR AS orig, (o_custkey % 60)::VARCHAR AS corr, o_orderkey % 200 AS passage_id, o_orderstatus AS status, o_orderkey AS o FROM orders), m6 AS (SELECT DISTINCT (l_partkey % 50)::VARCHAR AS control_id, l_orderkey % 200 AS passage_id FROM lineitem)"


@query(f"WITH {ORIGINAL}, a AS (SELECT orig, passage_id, arg_max(status, o) AS s FROM g6 GROUP BY 1, 2), b AS (SELECT corr, passage_id, arg_min(status, o) AS s FROM g6 GROUP BY 1, 2) SELECT m6.control_id, m6.passage_id, coalesce(a.s, b.s) AS status FROM m6 LEFT JOIN a ON a.orig = control_id AND a.passage_id = m6.passage_id LEFT JOIN b ON b.corr = control_id AND b.passage_id = m6.passage_id WHERE coalesce(a.s, b.s) IS NOT NULL")
def j6_label_scores(t):
    rows = t("orders").select((F.col("o_custkey") % 40).cast("string").alias("orig"), (F.col("o_custkey") % 60).cast("string").alias("corr"), (F.col("o_orderkey") % 200).alias("passage_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("o"))
    found = t("lineitem").select((F.col("l_partkey") % 50).cast("string").alias("control_id"), (F.col("l_orderkey") % 200).alias("passage_id")).distinct()
    return curate.scores_of_labels(found, rows, ("orig", "corr"), "o", ["status"])


@query(f"WITH {LABELS}, {PREDICTED}, {FLAGS} SELECT 'both' AS side, count(*) AS n FROM p SEMI JOIN k USING (control_id, passage_id) UNION ALL SELECT 'predicted', count(*) FROM p ANTI JOIN k USING (control_id, passage_id) UNION ALL SELECT 'labelled', count(*) FROM k ANTI JOIN p USING (control_id, passage_id)")
def j7_set_sizes(t):
    p, k, on = predicted(t), flags(t), ["control_id", "passage_id"]
    sides = {"both": p.join(k, on, "left_semi"), "predicted": p.join(k, on, "left_anti"), "labelled": k.join(p, on, "left_anti")}
    return reduce(DataFrame.unionByName, (x.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n") for name, x in sides.items()))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j9_without_blocked_passages(t):
    return t("documents").join(t("labels").where("toxic = 1"), "doc_id", "left_anti").select("doc_id")


@query("SELECT o_orderkey, coalesce(text, o_orderstatus || '?') AS query FROM orders LEFT JOIN benchmark ON item_id = o_custkey % 300")
def j12_text_or_snippet(t):
    rows = t("orders").select((F.col("o_custkey") % 300).alias("control_id"), F.col("o_orderkey").alias("passage_id"), F.concat("o_orderstatus", F.lit("?")).alias("query_snippet"), F.lit("p").alias("passage_snippet"), F.lit("s").alias("status"))
    none = t("documents").select(F.col("doc_id").alias("passage_id"), "text").limit(0)
    return curate.training_pairs(rows, t("benchmark").select(F.col("item_id").alias("control_id"), "text"), none, {"s": 1.0}).select(F.col("passage_id").alias("o_orderkey"), "query")


@query("SELECT c_custkey, c_name, p FROM customer JOIN (VALUES ('Customer#00000000'), ('Customer#0000001'), ('Customer#00')) v(p) ON starts_with(c_name, p)")
def j13_prefix(t):
    docs = literal(t, "('Customer#00000000'), ('Customer#0000001'), ('Customer#00')", "p")
    return curate.by_prefix(t("customer").select("c_custkey", "c_name"), docs, "c_name", "p")


CATALOGUE = "own AS (SELECT o_custkey AS id, o_orderpriority AS text, CASE o_orderstatus WHEN 'F' THEN 'Complete' WHEN 'P' THEN 'Incomplete' ELSE 'Open' END AS status, o_orderkey AS o FROM orders)"


@query(f"WITH {CATALOGUE}, a AS (SELECT id, arg_max(text, length(text) * 10000000000 - o) AS text, CASE WHEN bool_or(status = 'Complete') THEN 'Complete' WHEN bool_or(status = 'Incomplete') THEN 'Incomplete' ELSE 'Open' END AS status, count(*) AS source_rows FROM own GROUP BY 1) SELECT id, CASE WHEN length(c_mktsegment) > length(text) THEN c_mktsegment ELSE text END AS text, status, source_rows FROM a LEFT JOIN customer ON c_custkey = id")
def c3_catalogue_merge(t):
    """C3, J16."""
    status = F.when(F.col("o_orderstatus") == "F", "Complete").when(F.col("o_orderstatus") == "P", "Incomplete").otherwise("Open")
    own = t("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("text"), status.alias("status"), F.col("o_orderkey").alias("o"))
    other = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("text"))
    return curate.merged_catalogue(own, [other], "id", ["text"], "status", "o")


@query("SELECT p_partkey, p_name || '/' || p_brand AS text FROM part")
def j16_enrichment(t):
    a, b = t("part").select("p_partkey", "p_name"), t("part").select("p_partkey", "p_brand")
    return a.join(b, "p_partkey", "left").select("p_partkey", F.concat_ws("/", "p_name", "p_brand").alias("text"))


PAIRS18 = "VALUES ('A', 'shall'), ('A', 'must not'), ('B', 'shall'), ('B', 'required')"


@query(f"WITH s AS (SELECT doc_id, lower({SHALL}) AS t FROM documents), a AS (SELECT DISTINCT doc_id, word FROM s JOIN ({PAIRS18}) v(o, word) ON contains(t, word) WHERE o = 'A'), b AS (SELECT DISTINCT doc_id, word FROM s JOIN ({PAIRS18}) v(o, word) ON contains(t, word) WHERE o = 'B') SELECT doc_id, a.word AS first, b.word AS second FROM a JOIN b USING (doc_id)")
def j18_cross_pairs(t):
    words = literal(t, PAIRS18.removeprefix("VALUES "), "o, word")
    hits = route.keyword_hits(t("documents"), "doc_id", shall(), words, "o", "word")
    sides = [hits.where(f"o = '{o}'").select("doc_id", F.col("word").alias("owner")) for o in "AB"]
    return route.crosswalk(*sides, "doc_id").where("first <> 'none' and second <> 'none'")


@query("WITH f AS (SELECT DISTINCT c_custkey % 20 AS q, c_nationkey AS d FROM customer), h AS (SELECT DISTINCT q, n_regionkey AS g FROM f JOIN nation ON n_nationkey = d), n AS (SELECT q, n_nationkey AS d FROM h JOIN nation ON n_regionkey = g ANTI JOIN (SELECT q, d AS n_nationkey FROM f) USING (q, n_nationkey)) SELECT q, d::BIGINT AS d, row_number() OVER (PARTITION BY q ORDER BY d) AS rank FROM n QUALIFY rank <= 3")
def j20_neighbours(t):
    found = t("customer").select((F.col("c_custkey") % 20).alias("q"), F.col("c_nationkey").alias("d")).distinct()
    return retrieve.neighbours(found, t("nation").select(F.col("n_nationkey").alias("d"), F.col("n_regionkey").alias("g")), "q", "d", "g", 3)


@query("WITH x AS (SELECT c_custkey, 'M' || c_nationkey AS id FROM customer UNION ALL SELECT 100000 + c_custkey, 'M' || c_nationkey || '.' || c_custkey FROM customer) SELECT a.c_custkey AS child, b.c_custkey AS parent FROM x a JOIN x b ON regexp_replace(a.id, '[.][^.]*$', '') = b.id AND a.id <> b.id")
def j21_parents(t):
    """A dotted id with the rows of its parent."""
    nation = F.concat(F.lit("M"), F.col("c_nationkey").cast("string"))
    own = t("customer").select("c_custkey", nation.alias("id")).union(t("customer").select(F.col("c_custkey") + 100000, F.concat(nation, F.lit("."), F.col("c_custkey").cast("string"))))
    parent = F.when(F.contains("id", F.lit(".")), F.substring_index("id", ".", 1))
    return curate.met_in_blocks(own.select(parent.alias("id"), F.col("c_custkey").alias("child")), own.select("id", F.col("c_custkey").alias("parent")), "id").select("child", "parent")


@query("WITH a AS (SELECT o_custkey % 9 AS k, count(*) AS b FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 9 < 6 GROUP BY 1), z AS (SELECT o_custkey % 9 AS k, count(*) AS a FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 9 > 2 GROUP BY 1) SELECT k, coalesce(b, 0) AS before, coalesce(a, 0) AS after FROM a FULL JOIN z USING (k)")
def j22_full_outer(t):
    rows = t("orders").withColumn("k", F.col("o_custkey") % 9)
    return curate.before_and_after(rows.where("o_orderstatus = 'F' and k < 6"), rows.where("o_orderstatus = 'O' and k > 2"), ["k"])


# Aggregations and windows.


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) AS total, (count(*) FILTER (o_orderstatus = 'F') > 0)::BIGINT + (count(*) FILTER (o_orderstatus = 'O') > 0)::BIGINT AS active FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def a1_status_counts(t):
    return evaluate.matrix(t("orders").where("o_orderstatus <> 'P'"), "o_custkey", "o_orderstatus", ["F", "O"])


@query("WITH s AS (SELECT l_suppkey, CASE WHEN l_suppkey % 3 = 0 THEN '??' ELSE l_returnflag END AS family FROM lineitem) SELECT l_suppkey, family, count(*) AS n FROM s GROUP BY 1, 2")
def a4_breakdown_matrix(t):
    counts = t("lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n")).groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("b"), F.sum("n").alias("tp"))
    return curate.breakdown_matrix(counts.withColumn("b", F.when(F.col("l_suppkey") % 3 != 0, F.col("b"))), "l_suppkey", "b", "tp")


@query("WITH g AS (SELECT o_orderkey % 200 AS passage, o_custkey % 50 AS control, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS name, o_orderkey AS o, o_orderstatus <> 'O' AS yes FROM orders) SELECT passage, arg_min(name, CASE WHEN name = '' THEN 100000000000 + o ELSE o END) AS name, array_to_string(list_sort(list_distinct(list(control) FILTER (yes))), ',') AS positives, count(DISTINCT control) FILTER (yes) AS n_positives FROM g GROUP BY 1")
def a23_passage_groups(t):
    name = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderpriority"))
    rows = t("orders").select((F.col("o_orderkey") % 200).alias("passage"), (F.col("o_custkey") % 50).alias("control"), name.alias("name"), F.col("o_orderkey").alias("o"), (F.col("o_orderstatus") != "O").alias("yes"))
    grouped = curate.passage_groups(rows, "passage", "control", F.col("yes"), ["name"], "o")
    return grouped.withColumn("positives", F.nullif(F.array_join(F.transform("positives", lambda x: x.cast("string")), ","), F.lit("")))


@query("SELECT count(DISTINCT c_custkey) AS customers, count(DISTINCT o_custkey) AS buyers, count(DISTINCT CASE WHEN o_custkey IS NOT NULL THEN c_custkey END) AS both_ FROM customer FULL JOIN orders ON c_custkey = o_custkey")
def a30_distinct_ids(t):
    a, b = t("customer").select(F.col("c_custkey").alias("k")), t("orders").select(F.col("o_custkey").alias("k")).distinct()
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "k", "full_outer")
    return both.agg(F.count("a").alias("customers"), F.count("b").alias("buyers"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both_"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def w1_rank(t):
    return retrieve.ranked(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey").drop("o_totalprice")


@query("SELECT l_suppkey, l_returnflag, l_orderkey * 10 + l_linenumber AS line FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) <= 2")
def w2_topk_per_document(t):
    rows = t("lineitem").select("l_suppkey", "l_returnflag", "l_extendedprice", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    return retrieve.ranked(rows, ["l_suppkey", "l_returnflag"], "l_extendedprice", "line", 2).select("l_suppkey", "l_returnflag", "line")


@query("WITH a AS (SELECT *, l_orderkey * 10 + l_linenumber AS line FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) <= 2) SELECT l_suppkey, line, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, line) AS rank FROM a WHERE l_discount > 0.02 QUALIFY rank <= 3")
def w3_topk_after_filters(t):
    rows = t("lineitem").select("l_suppkey", "l_returnflag", "l_extendedprice", "l_discount", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    cut = retrieve.ranked(rows, ["l_suppkey", "l_returnflag"], "l_extendedprice", "line", 2).drop("rank")
    return retrieve.ranked(cut.where("l_discount > 0.02"), ["l_suppkey"], "l_extendedprice", "line", 3).select("l_suppkey", "line", "rank")


@query("SELECT o_orderpriority, arg_max(o_custkey, n * 10000000000 - o_custkey) AS o_custkey, max(n) AS n FROM (SELECT o_orderpriority, o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2) GROUP BY 1")
def w7_best_document(t):
    n = t("orders").where("o_orderstatus = 'F'").groupBy("o_orderpriority", "o_custkey").agg(F.count("*").alias("n"))
    return curate.keep_best(n, ["o_orderpriority"], "n", "o_custkey")


FOLD = "WITH RECURSIVE x AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), f AS (SELECT conv_id, turn, i, n AS size, 0 AS chunk FROM x WHERE i = 1 UNION ALL SELECT x.conv_id, x.turn, x.i, CASE WHEN f.size > 0 AND f.size + x.n > 200 THEN x.n ELSE f.size + x.n END, f.chunk + (f.size > 0 AND f.size + x.n > 200)::INT FROM f JOIN x ON x.conv_id = f.conv_id AND x.i = f.i + 1)"


@query(f"{FOLD} SELECT conv_id, turn, chunk::BIGINT AS chunk FROM f")
def w11_bounded_chunks(t):
    """Turns packed in order while their characters stay within 200."""
    parts = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    numbers = parts.withColumn("c", segment.chunk_numbers(F.transform("p", lambda x: x["text"]), 200))
    return numbers.select("conv_id", F.explode(F.arrays_zip(F.transform("p", lambda x: x["turn"]).alias("turn"), F.col("c").alias("chunk"))).alias("x")).select("conv_id", F.col("x.turn").alias("turn"), F.col("x.chunk").alias("chunk"))


@query("SELECT o_custkey, o_orderkey, 'P' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS number FROM orders")
def w12_numbered(t):
    return curate.numbered(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "P").drop("o_orderdate")


@query("WITH c AS (SELECT l_returnflag, l_discount AS threshold, count(*) FILTER (l_tax > 0.04) AS p, count(*) FILTER (NOT l_tax > 0.04) AS n FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, threshold, (sum(p) OVER w)::BIGINT AS tp, (sum(n) OVER w)::BIGINT AS fp FROM c WINDOW w AS (PARTITION BY l_returnflag ORDER BY threshold DESC)")
def w13_running_counts(t):
    rows = t("lineitem").select("l_returnflag", "l_discount", (F.col("l_tax") > 0.04).alias("yes"))
    return evaluate.threshold_sweep(rows, "l_discount", "yes", ["l_returnflag"]).select("l_returnflag", "threshold", "tp", "fp")


@query("SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS ordinal FROM nation")
def w15_ordinals(t):
    from quillspark.sources import readers

    return readers.with_ordinal(t("nation").select("n_name"), ["n_name"])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS ordinal FROM orders")
def w15_ordinals_of_all(t):
    """A large table, with one order date for many rows."""
    from quillspark.sources import readers

    return readers.with_ordinal(t("orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_orderkey) AS place FROM orders")
def o1_stable_sort(t):
    """O1: by falling score (one of five, so ties abound); rows that tie stay in their input order."""
    rows = t("orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return retrieve.ranked(rows, ["o_custkey"], "o_orderpriority", "o_orderkey", name="place").drop("o_orderpriority")


@query("SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20)")
def o2_top_rows(t):
    """O1, O2: a top-k report with a stated tie-break."""
    return t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey")


@query(f"WITH {ALL} SELECT item_id, count(*) AS n, min(score) > 0 AS positive FROM r WHERE rank <= 4 GROUP BY 1")
def o3_positive_scores(t):
    return top(t, 4).groupBy("item_id").agg(F.count("*").alias("n"), (F.min("score") > 0).alias("positive"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 30")
def o4_first_rows(t):
    return t("orders").orderBy("o_orderkey").limit(30).select("o_orderkey")


@query("SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY 'M' || c_nationkey, c_acctbal DESC, c_custkey) AS place FROM customer")
def o5_several_keys_of_all(t):
    """Ids sort as text; all customers, each segment in its own order."""
    from pyspark.sql import Window

    id_ = F.concat(F.lit("M"), F.col("c_nationkey").cast("string"))
    order = Window.partitionBy("c_mktsegment").orderBy(id_, F.desc("c_acctbal"), "c_custkey")
    return t("customer").select("c_mktsegment", "c_custkey", F.row_number().over(order).alias("place"))


@query("SELECT n_nationkey::BIGINT AS key, n_name AS name, NULL::VARCHAR AS segment FROM nation UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer")
def o6_union_all(t):
    a = t("nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    return a.unionByName(t("customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)


# Retrieval.


@query(ARMS + ", f AS (SELECT item_id, doc_id, round(coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + e.rank), 0), 9) AS score FROM a FULL JOIN (SELECT * FROM e WHERE rank <= 6) e USING (item_id, doc_id)) SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 2")
def r4_search(t):
    """Both arms within their own depth, fused, the first two."""
    a, b = arms(t)
    return retrieve.fuse(a, b, ["item_id", "doc_id"], ["item_id"], "doc_id", 2)


@query("SELECT p_partkey, p_partkey || ': ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' ' || p_type ELSE '' END AS text FROM part")
def r7_control_text(t):
    """Id, name and the first 400 characters of the text, where there is one."""
    text = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("")
    return t("part").select("p_partkey", retrieve.search_text(F.col("p_partkey"), F.col("p_name"), text).alias("text"))


@query(f"""WITH d AS (SELECT doc_id, {SHALL} AS t FROM documents), c AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[.!?]\\s+'), lambda s: regexp_matches(lower(s), 'shall')) AS h FROM d) SELECT doc_id, sha256(CASE WHEN len(h) > 0 THEN array_to_string(h, ' ') ELSE t END) AS query FROM c""")
def r8_query_choice(t):
    """The obligation sentences, else the full text."""
    return t("documents").select("doc_id", F.sha2(retrieve.query_text(F.array_join(F.filter(T.sentences(shall()), lambda s: F.lower(s).rlike("shall")), " "), shall()), 256).alias("query"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax * 10 > l_discount * 10 THEN 'Not Addressed' WHEN l_discount * 10 >= 0.6 THEN 'Fully Addressed' WHEN l_discount * 10 >= 0.35 THEN 'Partially Addressed' ELSE 'Not Addressed' END AS label FROM lineitem")
def r10_nli_label(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", score.nli_label(F.col("l_discount") * 10, F.col("l_tax") * 10, 0.6, 0.35).alias("label"))


# Segmentation.


@query(f"""WITH d AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({SHALL}, '\\n\\s*\\n'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: length(p) >= 20) AS a FROM documents)
SELECT doc_id, 1::BIGINT AS n, sha256(array_to_string(a, ' ')) AS text FROM d WHERE list_sum(list_transform(a, lambda p: length(p))) <= 100000 AND length(array_to_string(a, ' ')) >= 50""")
def x4_paragraph_chunks(t):
    """X4 of the documents whose paragraphs keep to 100,000 characters together, and so are one chunk (the fold over more is tested by hand)."""
    chunks = segment.paragraph_chunks(t("documents"), "doc_id", shall(), 100_000, size="size")
    return chunks.where("size <= 100000").select("doc_id", "n", F.sha2("text", 256).alias("text"))


@query("SELECT conv_id, 'Turn' || min(turn) AS section, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations) WHERE trim(text) <> '' GROUP BY conv_id, s HAVING length(string_agg(text, chr(10) || chr(10) ORDER BY turn)) >= 50 AND bool_or(role = 'user')")
def x3_element_passages(t):
    """Every user turn begins with a title element."""
    part = lambda at, kind, text: F.struct((F.col("turn") * 2 + at).alias("o"), F.lit(kind).alias("category"), text.alias("text"))
    both = F.when(F.col("role") == "user", F.array(part(0, "Title", F.concat(F.lit("Turn"), F.col("turn").cast("string"))), part(1, "NarrativeText", F.col("text")))).otherwise(F.array(part(1, "NarrativeText", F.col("text"))))
    rows = t("conversations").select("conv_id", F.explode(both).alias("x")).select("conv_id", "x.*")
    return segment.element_passages(rows, "conv_id", "o").where("section is not null")


SECTIONED = "SELECT o_custkey, row_number() OVER w AS n, '3.' || o_orderkey AS id, o_orderpriority || ' work' AS title, o_orderstatus || ' holds here, and more of it' AS body, o_orderkey FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"


def sectioned(t: Read) -> DataFrame:
    """A text per customer: a numbered heading and a line for each order."""
    part = F.concat(F.lit("3."), F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderpriority", F.lit(" work\n  "), "o_orderstatus", F.lit(" holds here, and more of it \n"))
    return t("orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", part.alias("p")))), lambda x: x["p"]), "\n").alias("text"))


@query(f"WITH s AS ({SECTIONED}) SELECT o_custkey, n, id, title, id || ' ' || title || chr(10) || body AS text FROM s")
def x5_numbered_sections(t):
    return segment.numbered_sections(sectioned(t), "o_custkey", F.col("text"))


@query(f"WITH s AS ({SECTIONED}) SELECT o_custkey, n, id AS section_id, title AS section_title, body AS content, 0::BIGINT AS n_obligations, false AS role, false AS scope, false AS exception FROM s")
def x6_hierarchical_passages(t):
    found = segment.hierarchical_passages(sectioned(t), "o_custkey", F.col("text"), O.typed)
    return found.withColumn("n_obligations", F.size("obligations")).drop("obligations")


@query("SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, 'M1.' || o_orderkey % 9 || '.' || o_orderkey AS id, o_orderpriority AS text FROM orders")
def x7_id_blocks(t):
    part = F.concat(F.lit("M1."), (F.col("o_orderkey") % 9).cast("string"), F.lit("."), F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderpriority", F.lit(" \n"))
    texts = t("orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", part.alias("p")))), lambda x: x["p"]), "").alias("text"))
    return segment.id_blocks(texts.withColumn("text", F.concat(F.lit("preface "), "text")), "o_custkey", F.col("text"))


@query("SELECT p_partkey, p_name AS description, p_type AS guidance FROM part")
def x8_between_markers(t):
    text = F.concat(F.lit("Control: x Description: "), "p_name", F.lit("\nGuidance : "), "p_type", F.lit("\n"))
    return t("part").select("p_partkey", segment.between(text, "Description", "Guidance", "Priority").alias("description"), segment.between(text, "Guidance", "Priority").alias("guidance"))


@query("SELECT p_partkey, p_name || '[' || p_brand || '+' || p_type || ']' || p_name || ' more[]' AS items FROM part")
def x11_nested_list(t):
    text = F.concat(F.lit("intro\n1. "), "p_name", F.lit("\n a) "), "p_brand", F.lit("\nb. "), "p_type", F.lit("\n2) "), "p_name", F.lit(" more"))
    shown = F.transform(segment.nested_list(text), lambda x: F.concat(x["text"], F.lit("["), F.array_join(x["sub"], "+"), F.lit("]")))
    return t("part").select("p_partkey", F.array_join(shown, "").alias("items"))


@query(f"WITH s AS ({SECTIONED}) SELECT c_custkey AS o_custkey, 0::BIGINT AS n, 'document' AS kind, c_name AS heading, '' AS text FROM customer UNION ALL SELECT o_custkey, n, 'passage', id || ' ' || title, body FROM s")
def x15_document_tasks(t):
    passages = t("orders").select("o_custkey", F.col("o_orderkey").alias("ordinal"), F.concat(F.lit("3."), F.col("o_orderkey").cast("string")).alias("section_id"), F.concat("o_orderpriority", F.lit(" work")).alias("section_title"), F.concat("o_orderstatus", F.lit(" holds here, and more of it")).alias("content"))
    return annotate.document_tasks(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("title")), passages, "o_custkey")


@query("SELECT o_custkey, o_orderpriority AS section, regexp_extract(o_orderpriority, '^[0-9]+') AS section_id, count(*) AS n, string_agg(o_orderstatus, chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY 1, 2")
def x16_structured_text(t):
    return segment.structured_text(t("orders"), "o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus")


# Training sets.


@query(f"WITH {LABELS} SELECT control_id, passage_id, status FROM (SELECT control_id, passage_id, status, count(*) AS votes, CASE status WHEN 'Fully Addressed' THEN 2 WHEN 'Partially Addressed' THEN 1 ELSE 0 END AS r FROM g GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY control_id, passage_id ORDER BY votes DESC, r DESC) = 1")
def c1_dedup_by_vote(t):
    return curate.vote(labels(t), ["control_id", "passage_id"], "status", STATUS, "ordinal").select("control_id", "passage_id", "status")


@query(f"WITH {LABELS} SELECT passage_id, count(*) AS n FROM (SELECT * FROM g WHERE status <> 'Not Addressed' UNION ALL SELECT * FROM (SELECT * FROM g WHERE status = 'Not Addressed' QUALIFY row_number() OVER (PARTITION BY passage_id ORDER BY ordinal) <= 3)) GROUP BY 1")
def c2_negative_cap(t):
    return curate.cap(labels(t), ["passage_id"], F.col("status") == "Not Addressed", ["ordinal"], 3).groupBy("passage_id").agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT DISTINCT 's' || c_nationkey % 4 AS f, c_nationkey AS i FROM customer UNION SELECT 't' || s_nationkey % 4, s_nationkey FROM supplier), n AS (SELECT f, count(*) AS n FROM s GROUP BY 1), p AS (SELECT x.f AS a, y.f AS b, count(*) AS shared FROM s x JOIN s y ON x.i = y.i AND x.f < y.f GROUP BY 1, 2) SELECT a, b, CASE WHEN shared = na.n AND na.n = nb.n THEN 'exact' WHEN shared >= 0.9 * least(na.n, nb.n) THEN 'near' ELSE 'partial' END AS kind FROM p JOIN n na ON na.f = a JOIN n nb ON nb.f = b")
def c4_duplicate_files(t):
    a = t("customer").select(F.concat(F.lit("s"), (F.col("c_nationkey") % 4).cast("string")).alias("f"), F.col("c_nationkey").cast("long").alias("i"))
    b = t("supplier").select(F.concat(F.lit("t"), (F.col("s_nationkey") % 4).cast("string")).alias("f"), F.col("s_nationkey").cast("long").alias("i"))
    return curate.overlaps(a.union(b), "f", "i").select("a", "b", "kind")


@query("WITH f AS (SELECT o_orderpriority AS name, o_orderstatus AS file, o_custkey % 30 AS item, max(o_orderkey) OVER (PARTITION BY o_orderpriority, o_orderstatus) AS recency FROM orders), i AS (SELECT DISTINCT name, file, item, recency FROM f), u AS (SELECT name, count(DISTINCT item) / count(*) AS share FROM i GROUP BY 1), s AS (SELECT name, file, recency, count(*) FILTER (item < 10) AS n_gold FROM i GROUP BY ALL) SELECT name, file, n_gold, share > 0.85 OR row_number() OVER (PARTITION BY name ORDER BY n_gold DESC, recency DESC, file) = 1 AS kept FROM s JOIN u USING (name)")
def c5_canonical_groups(t):
    parts = t("orders").select(F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("file"), (F.col("o_custkey") % 30).alias("item"), F.col("o_orderkey").alias("recency"))
    return curate.keep_or_archive(parts, parts.where("item < 10").select("item"), "name", "file", "item", "recency").select("name", "file", "n_gold", "kept")


@query(f"WITH {LABELS} SELECT control_id, passage_id, sha256(b.text) AS query, sha256(d.text) AS passage, CASE status WHEN 'Fully Addressed' THEN 1.0::DOUBLE WHEN 'Partially Addressed' THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS score FROM g JOIN benchmark b ON b.item_id = control_id JOIN documents d ON d.doc_id = passage_id")
def c7_reranker_rows(t):
    none = labels(t).withColumns({"query_snippet": F.lit(None).cast("string"), "passage_snippet": F.lit(None).cast("string")})
    scores = {"Fully Addressed": 1.0, "Partially Addressed": 0.7, "Not Addressed": 0.0}
    rows = curate.training_pairs(none, t("benchmark").select(F.col("item_id").alias("control_id"), "text"), t("documents").select(F.col("doc_id").alias("passage_id"), "text"), scores)
    return rows.withColumns({"query": F.sha2("query", 256), "passage": F.sha2("passage", 256)})


@query(f"SELECT doc_id, sha256(substr(trim(text), 1, 2000)) AS passage, CASE doc_id % 3 WHEN 0 THEN 0.85::DOUBLE WHEN 1 THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END AS score, true AS is_synthetic FROM documents WHERE doc_id % 5 <> 0 AND len({WORDS.format('text')}) >= 10")
def c8_synthetic_rows(t):
    status = F.when(F.col("doc_id") % 3 == 0, "Fully addressed").when(F.col("doc_id") % 3 == 1, "Partially Addressed").otherwise("Not addressed")
    rows = t("documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, " ").otherwise("q").alias("query"), F.col("text").alias("passage"), status.alias("status"))
    return curate.synthetic_rows(rows, "query", "passage", "status").select("doc_id", F.sha2("passage", 256).alias("passage"), "score", "is_synthetic")


@query("SELECT sha256(substr(text, 1, 200)) AS head, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def c9_conflicts(t):
    """Of rows that agree in their first 200 characters (the source's key) one stays: here all score alike, so the first."""
    rows = t("documents").select(F.sha2(F.substring("text", 1, 200), 256).alias("head"), F.lit(1.0).alias("score"), "doc_id")
    return curate.keep_best(rows, ["head"], "score", "doc_id").select("head", "doc_id")


@query("WITH k AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'real_fa' WHEN 'P' THEN 'real_pa' ELSE 'real_na' END AS kind FROM orders) SELECT kind, count(*) AS rows_, count(*) * CASE kind WHEN 'real_na' THEN 2 WHEN 'synthetic' THEN 1 ELSE 3 END AS copies FROM (SELECT * FROM k UNION ALL SELECT p_partkey, 'synthetic' FROM part) GROUP BY kind")
def c10_weighted_split(t):
    """Train and dev together hold every row; a dev row counts here as often as it would in train."""
    kind = F.when(F.col("o_orderstatus") == "F", "real_fa").when(F.col("o_orderstatus") == "P", "real_pa").otherwise("real_na")
    real = t("orders").select(F.col("o_orderkey").alias("key"), kind.alias("kind"))
    train, dev = curate.training_split(real, t("part").select(F.col("p_partkey").alias("key"), F.lit("synthetic").alias("kind")), ["key"], "kind")
    counts = train.groupBy("kind").agg(F.count("*").alias("copies"), F.count_if(F.col("copy") == 1).alias("rows_"))
    held = dev.groupBy("kind").agg(F.count("*").alias("dev"))
    weight = F.element_at(F.create_map(*[x for k, v in curate.STATUS_WEIGHTS.items() for x in (F.lit(k), F.lit(v))]), F.col("kind"))
    each = counts.join(held, "kind", "left").na.fill(0, ["dev"])
    return each.select("kind", (F.col("rows_") + F.col("dev")).alias("rows_"), (F.col("copies") + F.col("dev") * weight).alias("copies"))


@query("SELECT doc_id, greatest(least(quality, 0.95), 0.05)::DOUBLE AS label, copy FROM labels, unnest(generate_series(1, 1 + toxic * 2)) u(copy)")
def c12_pointwise_rows(t):
    rows = t("labels").select("doc_id", curate.smooth(F.col("quality")).cast("double").alias("label"), "toxic")
    return curate.replicate(rows, 1 + F.col("toxic") * 2).select("doc_id", "label", "copy")


# Annotation and judging.


@query("SELECT n_nationkey::BIGINT AS n_nationkey, '{\"name\":\"' || n_name || '\",\"none\":\"\"}' AS data, n_regionkey::BIGINT AS region FROM nation")
def l1_tasks(t):
    rows = t("nation").select("n_nationkey", F.col("n_name").alias("name"), F.lit(None).cast("string").alias("none"), "n_regionkey")
    return annotate.tasks(rows, ["name", "none"], ["n_nationkey", "n_regionkey"]).select("meta.n_nationkey", F.to_json("data").alias("data"), F.col("meta.n_regionkey").alias("region"))


@query("SELECT n_name AS name, 'Fully Addressed' AS status, (n_nationkey % 5)::BIGINT AS confidence, 'b' AS reasons FROM nation WHERE n_nationkey % 3 <> 0")
def l2_exports(t):
    """L2: the first annotation's answers; tasks without one are dropped."""
    value = lambda text, choices, taxonomy: F.struct(text.cast("array<string>").alias("text"), choices.cast("array<string>").alias("choices"), taxonomy.cast("array<array<string>>").alias("taxonomy"))
    none = F.lit(None)
    answer = lambda name, v: F.struct(F.lit(name).alias("from_name"), v.alias("value"))
    result = F.array(answer("status", value(none, F.array(F.lit("Fully Addressed")), none)), answer("confidence", value(none, F.array(F.concat((F.col("n_nationkey") % 5).cast("string"), F.lit(" - x"))), none)), answer("reason", value(none, none, F.array(F.array(F.lit("a"), F.lit("b"))))))
    done = F.struct(result.alias("result"))
    some = F.when(F.col("n_nationkey") % 3 == 0, F.slice(F.array(done), 1, 0)).otherwise(F.array(done, done))
    export = t("nation").select(F.create_map(F.lit("name"), "n_name").alias("data"), some.alias("annotations"))
    return annotate.annotations(export).select(F.col("data")["name"].alias("name"), "status", "confidence", F.array_join("reasons", ",").alias("reasons"))


TEMPLATE = "Control {control_id} ({control_name}): {control_description} {sub_requirements} | {passage}"


@query("SELECT o_custkey AS control_id, o_orderkey AS passage_id, 'Control ' || o_custkey || ' (' || coalesce(n_name, o_custkey::VARCHAR) || '): ' || coalesce(n_name || ' rules', o_custkey::VARCHAR) || ' ' || CASE WHEN n_name IS NULL THEN '' ELSE 'a' || chr(10) || 'b' END || ' | ' || o_orderpriority AS prompt FROM orders LEFT JOIN nation ON n_nationkey = o_custkey")
def l4_judge_prompts(t):
    pairs = t("orders").select(F.col("o_custkey").cast("string").alias("control_id"), F.col("o_orderkey").alias("passage_id"), F.col("o_orderpriority").alias("passage"))
    controls = t("nation").select(F.col("n_nationkey").cast("string").alias("control_id"), F.col("n_name").alias("name"), F.concat("n_name", F.lit(" rules")).alias("description"), F.array(F.lit("a"), F.lit("b")).alias("sub_controls"))
    return annotate.judge_prompts(pairs, controls, TEMPLATE).withColumn("control_id", F.col("control_id").cast("long"))


@query("""SELECT o_orderkey, o_orderpriority AS topic, 'x' AS requires, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS evidence, o_orderkey % 4 = 1 AS partial,
CASE WHEN o_orderstatus = 'F' THEN 'CORRECT' WHEN o_orderstatus = 'P' THEN 'PARTIAL' WHEN o_orderkey % 4 = 0 THEN 'CORRECT' WHEN o_orderkey % 4 = 1 THEN 'PARTIAL' ELSE 'WRONG' END AS assignment,
CASE WHEN o_orderstatus = 'F' THEN 'Fully Addressed' WHEN o_orderstatus = 'P' THEN 'Partially Addressed' WHEN o_orderkey % 4 = 0 THEN 'Fully Addressed' WHEN o_orderkey % 4 = 1 THEN 'Partially Addressed' ELSE 'Not Addressed' END AS status, 'because: ' || o_orderstatus AS reason FROM orders""")
def l5_assignment_replies(t):
    """All keys of a reply, with and without its ASSIGNMENT line."""
    k = F.col("o_orderkey") % 4
    evidence = F.when(k == 0, "Yes, it is").when(k == 3, "unclear").otherwise("no")
    told = F.when(F.col("o_orderstatus") == "F", "\nassignment: correct.").when(F.col("o_orderstatus") == "P", "\nASSIGNMENT: [partial]").otherwise("\nASSIGNMENT: ?")
    reply = F.concat(F.lit("Let me see.\nPASSAGE_ABOUT: ["), "o_orderpriority", F.lit("]\n  control_requires: x\nEVIDENCE: "), evidence, F.lit("\nPARTIAL: "), F.when(k == 1, "YES").otherwise("NO"), told, F.lit("\nREASON: because: "), "o_orderstatus")
    return t("orders").select("o_orderkey", annotate.assignment_reply(reply).alias("j")).select("o_orderkey", "j.*")


@query("SELECT o_orderkey, 'Fully Addressed' AS verdict, true AS kept FROM orders WHERE o_orderstatus = 'F'")
def l9_kept(t):
    verdict = F.when(F.col("o_orderstatus") == "F", "Fully Addressed").when(F.col("o_orderstatus") == "P", "Not Addressed")
    return annotate.keep_judged(t("orders").select("o_orderkey", verdict.alias("verdict")), "verdict")


@query("SELECT count(*) FILTER (item_id % 3 <> 0) AS n_right, count(*) FILTER (item_id % 3 = 0) AS n_wrong, count(*) FILTER (item_id % 3 <> 0 AND length(text) % 2 = 0) AS right_kept, count(*) FILTER (item_id % 3 = 0 AND length(text) % 2 <> 0) AS wrong_dropped FROM benchmark")
def l11_judge_run(t):
    """A judge (a stub) over all prompts, and its agreement with what is known."""
    def client(prompts):
        return ["ASSIGNMENT: CORRECT" if len(p) % 2 == 0 else "ASSIGNMENT: WRONG" for p in prompts]

    judged = annotate.judge_run(t("benchmark").select("item_id", F.col("text").alias("prompt")), client)
    return evaluate.judge_agreement(judged, F.col("item_id") % 3 != 0, F.col("judged.status") != "Not Addressed").select("n_right", "n_wrong", "right_kept", "wrong_dropped")


@query(f"WITH {ALL}, o AS (SELECT item_id, doc_id, round(len(list_intersect(list_distinct({WORDS.format('q.text')}), list_distinct({WORDS.format('d.text')}))) / len(list_distinct({WORDS.format('q.text')})), 6) AS score FROM r JOIN benchmark q USING (item_id) JOIN documents d USING (doc_id) WHERE rank <= 10) SELECT item_id, doc_id, score FROM o")
def r9_rescored(t):
    """The pairs that BM25 found, scored anew, before any cut."""
    return rescored(t).select("item_id", "doc_id", "score")


@query(f"WITH {ALL}, w AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), m AS (SELECT item_id, min(rank) AS best FROM w LEFT JOIN (SELECT * FROM r WHERE rank <= 20) USING (item_id, doc_id) GROUP BY 1) SELECT k, count(*) AS n_queries, count(*) FILTER (best <= k) AS hits, round(count(*) FILTER (best <= k) / count(*), 6) AS hit_rate_at_k FROM m CROSS JOIN (VALUES (1), (5), (10), (20)) v(k) GROUP BY k")
def a10_hit_rate_of_whole_items(t):
    """A10: the gold documents hold the whole text of the item, not its first 60 characters."""
    hits = route.keyword_hits(t("documents"), "doc_id", F.col("text"), t("benchmark"), "item_id", "text").withColumnRenamed("text", "item")
    gold = hits.join(t("documents").select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("item")))
    return evaluate.hit_rate(top(t, 20), gold, [1, 5, 10, 20], query="item_id")


# Dictionaries and sets that grow with the tables.

DICTIONARY = "dict AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest(" + WORDS.format("text") + ") AS w FROM benchmark) WHERE length(w) >= 7)"


@query(f"WITH {DICTIONARY}, u AS (SELECT DISTINCT w FROM dict), h AS (SELECT doc_id, w FROM documents JOIN u ON contains(lower(text), w)) SELECT doc_id, count(*) AS n_hits, count(DISTINCT item_id) AS n_items, max(length(w)) AS longest FROM h JOIN dict USING (w) GROUP BY 1")
def j17_long_dictionary(t):
    """J17 with every word of seven letters or more of all items as the dictionary."""
    words = t("benchmark").select("item_id", F.explode(T.tokens(F.col("text"))).alias("w")).where("length(w) >= 7")
    hits = route.keyword_hits(t("documents"), "doc_id", F.col("text"), words, "item_id", "w")
    return hits.groupBy("doc_id").agg(F.count("*").alias("n_hits"), F.count_distinct("item_id").alias("n_items"), F.max(F.col("size").cast("long")).alias("longest"))


@query(f"WITH s AS (SELECT DISTINCT doc_id AS f, i FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS i FROM documents) WHERE length(i) >= 8), n AS (SELECT f, count(*) AS n FROM s GROUP BY 1), p AS (SELECT x.f AS a, y.f AS b, count(*) AS shared FROM s x JOIN s y ON x.i = y.i AND x.f < y.f GROUP BY 1, 2) SELECT a, b, shared, x.n AS na, y.n AS nb, CASE WHEN shared = x.n AND x.n = y.n THEN 'exact' ELSE 'near' END AS kind FROM p JOIN n x ON x.f = a JOIN n y ON y.f = b WHERE shared * 100 >= 90 * least(x.n, y.n)")
def c4_near_files(t):
    """C4: documents as files, their words of eight letters or more as items."""
    rows = t("documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("i")).where("length(i) >= 8")
    return curate.near_duplicates(rows, "doc_id", "i")


# Packed by a fold over structs: the parts so far, the chunk at hand and its size.
SEVERAL = """
d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: length(p) >= 20) AS a FROM documents),
e AS (SELECT doc_id, list_reduce(list_transform(a, lambda p: {'size': length(p)::BIGINT, 'now': [p], 'past': []::VARCHAR[][]}), lambda s, x: CASE WHEN s.size + x.size > 600 THEN {'size': x.size, 'now': x.now, 'past': list_append(s.past, s.now)} ELSE {'size': s.size + x.size, 'now': list_concat(s.now, x.now), 'past': s.past} END) AS s FROM d WHERE len(a) > 0),
c AS (SELECT doc_id, list_filter(list_transform(list_append(s.past, s.now), lambda g: array_to_string(g, ' ')), lambda t: length(t) >= 50) AS c FROM e)"""


@query(f"WITH {SEVERAL} SELECT doc_id, unnest(generate_series(1, len(c))) AS n, sha256(unnest(c)) AS text FROM c")
def x4_several_chunks(t):
    """X4 with every line a paragraph and a limit of 600 characters: most documents come to several chunks."""
    found = segment.paragraph_chunks(t("documents"), "doc_id", F.regexp_replace("text", "\n", "\n\n"), 600)
    return found.select("doc_id", "n", F.sha2("text", 256).alias("text"))
