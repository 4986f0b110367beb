"""Further operators as queries with DuckDB SQL, registered with those of queries.py. Every query reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import annotate, curate, evaluate, extract, rank, retrieve, route, segment, synthesize
from quillspark.plans.queries import ALL, FLAGS, LABELS, ORACLE, PREDICTED, QUERIES, STATUS, WORDS, Read, a7_confusion_per_policy, flags, labels, predicted, query, top

from quillspark.sources.readers import spread
from quillspark.sources.sinks import materialize

__all__ = ["ORACLE", "QUERIES"]


def literal(t: Read, values: str, names: str) -> DataFrame:
    """A small dictionary as a table; the oracle uses the same VALUES."""
    return t("region").sparkSession.sql(f"SELECT * FROM {values} AS v({names})")


# Column functions.


@query(f"SELECT doc_id, CASE WHEN len(w) > 20 THEN array_to_string(w[1:20], ' ') ELSE text END AS head FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)")
def p4_first_words(t):
    return t("documents").select("doc_id", T.first_words(F.col("text"), 20).alias("head"))


@query(r"SELECT p_partkey, coalesce(nullif(trim(regexp_replace(regexp_replace(p_name || '/' || p_type, '[^A-Za-z0-9._\- ]', '_', 'g'), '\s+', '_', 'g')), ''), 'unnamed') AS name FROM part")
def p6_safe_name(t):
    return t("part").select("p_partkey", T.safe_name(F.concat_ws("/", "p_name", "p_type")).alias("name"))


@query("SELECT o_orderkey, 'M' || o_custkey % 7 AS family, 'M' || o_custkey % 7 || '.' || o_custkey AS subfamily FROM orders")
def p7_ancestor(t):
    dotted = F.concat_ws(".", F.concat(F.lit("M"), (F.col("o_custkey") % 7).cast("string")), F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))
    return t("orders").select("o_orderkey", T.ancestor(dotted, 1).alias("family"), T.ancestor(dotted, 2).alias("subfamily"))


@query("SELECT doc_id, coalesce(nullif(regexp_extract(text, '[0-9]{3,}'), ''), trim(text)) AS id FROM documents")
def p8_first_id(t):
    return t("documents").select("doc_id", T.first_id(F.col("text"), "[0-9]{3,}").alias("id"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[0-9]{2,}'), lambda x: x <> doc_id::VARCHAR))), ',') AS refs FROM documents")
def p9_references(t):
    return t("documents").select("doc_id", F.array_join(T.references(F.col("text"), "[0-9]{2,}", F.col("doc_id").cast("string")), ",").alias("refs"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(p_brand || ' & ' || p_type || '; ' || p_partkey, '[,&;]'), lambda x: trim(x)), lambda x: regexp_full_match(x, '[A-Za-z#]*[0-9]+')), ',') AS ids FROM part")
def p10_reference_list(t):
    text = F.concat("p_brand", F.lit(" & "), "p_type", F.lit("; "), F.col("p_partkey").cast("string"))
    return t("part").select("p_partkey", F.array_join(T.reference_list(text, "[A-Za-z#]*[0-9]+"), ",").alias("ids"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, 'Page [0-9]+ of [0-9]+', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM documents")
def p12_clean_space(t):
    return t("documents").select("doc_id", T.clean_space(F.col("text"), "Page [0-9]+ of [0-9]+").alias("text"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::VARCHAR END AS number, n_name AS name FROM nation")
def p15_number_and_name(t):
    line = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.col("n_nationkey").cast("string"), F.lit(" - "), "n_name")).otherwise(F.col("n_name"))
    return t("nation").select("n_nationkey", T.number_and_name(line).alias("x")).select("n_nationkey", "x.*")


@query("SELECT p_partkey, p_name AS once, p_name || 'x ' || p_name AS other FROM part")
def p16_once_if_doubled(t):
    name = F.col("p_name")
    return t("part").select("p_partkey", T.once_if_doubled(F.concat(name, F.lit(" "), name)).alias("once"), T.once_if_doubled(F.concat(name, F.lit("x "), name)).alias("other"))


SENTENCES = r"s AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '[.!?]\s+'))) AS text FROM documents)"


@query(f"WITH {SENTENCES} SELECT doc_id, text, type FROM s JOIN (VALUES ('that', 'that'), ('with', 'with'), ('und', 'und')) v(type, word) ON contains(lower(text), word) WHERE length(text) >= 15")
def p19_typed_obligations(t):
    return t("documents").select("doc_id", F.explode(T.typed_obligations(F.col("text"), {w: w for w in ("that", "with", "und")})).alias("x")).select("doc_id", "x.*")


@query(r"SELECT doc_id, CASE WHEN length(a) > 15 THEN a WHEN length(b) > 15 THEN b WHEN length(s) > 15 THEN s ELSE substr(text, 1, 200) END AS answer FROM (SELECT doc_id, text, trim(regexp_extract(text, 'that [^.]*\.')) AS a, trim(regexp_extract(text, 'und [^.]*\.')) AS b, trim(regexp_split_to_array(text, '[.!?]\s+')[1]) AS s FROM documents)")
def p20_answer(t):
    return t("documents").select("doc_id", T.answer(F.col("text"), [r"that [^.]*\.", r"und [^.]*\."]).alias("answer"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'password') THEN 'access' WHEN contains(lower(text), 'und') THEN 'german' WHEN contains(lower(text), 'the') THEN 'english' ELSE 'other' END AS question FROM documents")
def p22_first_keyword(t):
    return t("documents").select("doc_id", T.first_keyword(F.col("text"), {"password": "access", "und": "german", "the": "english"}, "other").alias("question"))


@query("SELECT n_nationkey, round(CASE WHEN greatest(length(n_name), length(r_name)) = 0 THEN 1 ELSE least(length(n_name), length(r_name)) / greatest(length(n_name), length(r_name)) END, 6) AS ratio FROM nation JOIN region ON n_regionkey = r_regionkey")
def p26_length_ratio(t):
    return t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.round(T.length_ratio(F.col("n_name"), F.col("r_name")), 6).alias("ratio"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS filled, CASE WHEN length(c_mktsegment) > length(c_name) THEN c_mktsegment ELSE c_name END AS longest FROM customer")
def p27_first_filled(t):
    name = F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).otherwise("  ")
    return t("customer").select("c_custkey", T.first_filled(name, F.col("c_mktsegment")).alias("filled"), T.longest(F.col("c_name"), F.col("c_mktsegment")).alias("longest"))


@query("SELECT c_custkey, coalesce(try_cast(CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_custkey || '.5' END AS DOUBLE), 0) AS value FROM customer")
def p28_safe_double(t):
    return t("customer").select("c_custkey", T.safe_double(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat(F.col("c_custkey").cast("string"), F.lit(".5")))).alias("value"))


@query("SELECT o_orderkey, round(CASE WHEN max(o_totalprice) OVER w = min(o_totalprice) OVER w THEN 0 ELSE (o_totalprice - min(o_totalprice) OVER w) / (max(o_totalprice) OVER w - min(o_totalprice) OVER w) END, 6) AS min_max, round(o_totalprice / max(o_totalprice) OVER w, 6) AS of_greatest FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def p34_rescale(t):
    w = Window.partitionBy("o_custkey")
    price = F.col("o_totalprice")
    return t("orders").select("o_orderkey", F.round(T.min_max(price, w), 6).alias("min_max"), F.round(T.of_greatest(price, w), 6).alias("of_greatest"))


@query("SELECT doc_id, CASE WHEN quality >= 1 THEN 0.95::DOUBLE ELSE 0.05::DOUBLE END AS label FROM labels")
def p38_smooth(t):
    return t("labels").select("doc_id", curate.smooth(F.col("quality")).cast("double").alias("label"))


@query("SELECT p_partkey, 'name: ' || p_name || chr(10) || 'brand: ' || p_brand AS text FROM part")
def p44_labelled_text(t):
    return t("part").select("p_partkey", T.labelled_text({"name": F.col("p_name"), "none": F.lit(" "), "brand": F.col("p_brand")}).alias("text"))


@query("SELECT c_custkey, chr(97 + 0) AS a, c_custkey || '.a: ' || c_name || ' ' || c_custkey || '.b: ' || c_mktsegment AS items FROM customer")
def p45_letter_numbered(t):
    return t("customer").select("c_custkey", F.lit("a").alias("a"), F.array_join(T.letter_numbered(F.array("c_name", F.lit(" "), "c_mktsegment"), F.col("c_custkey").cast("string")), " ").alias("items"))


# RE2's word boundary knows ASCII only, the engine's (and the source's) all letters: the SQL spells it out.
EDGE = r"(?:[^\p{L}\p{N}_]|$)"


@query(f"SELECT doc_id, length(trim(text)) >= 20 AND NOT regexp_matches(lower(trim(text)), '^(?:la|the){EDGE}') AND regexp_matches(lower(trim(text)), '(?:^|[^\\p{{L}}\\p{{N}}_])(?:that|which){EDGE}') AS obligation FROM documents")
def f2_obligation(t):
    return t("documents").select("doc_id", T.is_obligation(F.col("text"), ["that", "which"], ["la", "the"]).alias("obligation"))


# Filters, joins, sets and windows.


@query("WITH m AS (SELECT doc_id, source, contains(lower(text), 'password') AS m, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n, lang FROM documents), a AS (SELECT *, bool_or(m) OVER (PARTITION BY source, lang) AS found FROM m) SELECT doc_id, source FROM a WHERE m OR (NOT found AND n <= 3)")
def f4_matching_or_first(t):
    return curate.matching_or_first(t("documents"), ["source", "lang"], F.contains(F.lower("text"), F.lit("password")), "doc_id").select("doc_id", "source")


@query("SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders")
def o7_union_of_keys(t):
    return t("customer").select("c_custkey").union(t("orders").select("o_custkey")).distinct()


@query("SELECT 'both' AS side, c_nationkey AS k FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'first', c_nationkey FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def o8_intersect_and_except(t):
    a, b = t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).select(F.lit("both").alias("side"), "k").union(a.subtract(b).select(F.lit("first"), "k"))


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def o9_ordered_distinct(t):
    return t("documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j11_left_semi(t):
    return t("customer").join(t("orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT user_id, first(event_type ORDER BY ts, event_id) AS earliest, last(event_type ORDER BY ts, event_id) AS latest FROM events GROUP BY 1")
def w6_first_and_last(t):
    place = F.struct("ts", "event_id")
    return t("events").groupBy("user_id").agg(F.min_by("event_type", place).alias("earliest"), F.max_by("event_type", place).alias("latest"))


ITEMS = "f AS (SELECT lang AS name, source AS file, doc_id AS recency, n_chars // 40 AS item FROM documents), gold AS (SELECT DISTINCT d.n_chars // 40 AS item FROM documents d JOIN labels USING (doc_id) WHERE quality = 1)"


@query(f"WITH {ITEMS}, i AS (SELECT DISTINCT name, file, item FROM f), r AS (SELECT name, file, max(recency) AS recency FROM f GROUP BY 1, 2), s AS (SELECT name, file, count(*) AS n_items, count(gold.item) AS n_gold FROM i LEFT JOIN gold USING (item) GROUP BY 1, 2), u AS (SELECT name, count(DISTINCT item) / count(*) AS share FROM i GROUP BY 1) SELECT name, file, n_gold, n_items, share > 0.85 OR row_number() OVER (PARTITION BY name ORDER BY n_gold DESC, recency DESC, file) = 1 AS kept FROM s JOIN r USING (name, file) JOIN u USING (name)")
def w8_keep_or_archive(t):
    item = F.floor(F.col("n_chars") / 40).alias("item")
    parts = t("documents").select(F.col("lang").alias("name"), F.col("source").alias("file"), F.col("doc_id").alias("recency"), item)
    gold = t("documents").join(t("labels").where("quality = 1").select("doc_id"), "doc_id").select(item)
    return curate.keep_or_archive(parts, gold, "name", "file", "item", "recency")


@query("WITH s AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS section FROM conversations) SELECT conv_id, section, count(*) AS n, string_agg(text, chr(10) ORDER BY turn) AS text FROM s GROUP BY 1, 2")
def w9_sections(t):
    return curate.sections(t("conversations"), ["conv_id"], "turn", F.col("role") == "user", "text")


@query("SELECT l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY round(l_quantity / 20) * 20) AS level FROM lineitem")
def w14_indent_levels(t):
    return extract.indent_levels(t("lineitem"), ["l_orderkey"], "l_quantity").select("l_orderkey", "l_linenumber", F.col("level").cast("long").alias("level"))


# Aggregations.


@query("SELECT count(*) AS n_groups, round(avg(precision_judged), 6) AS macro_precision_judged, round(avg(recall), 6) AS macro_recall, round(avg(f1_judged), 6) AS macro_f1_judged FROM (" + ORACLE["a7_confusion_per_policy"] + ") WHERE tp > 0")
def a6_macro(t):
    return evaluate.macro(a7_confusion_per_policy(t), F.col("tp") > 0)


@query(f"WITH {LABELS}, {PREDICTED}, {FLAGS} SELECT coalesce(flag, '') AS reason, count(*) AS n FROM p JOIN k USING (control_id, passage_id) WHERE negative GROUP BY 1")
def a8_false_positive_reasons(t):
    return predicted(t).join(flags(t).where("negative"), ["control_id", "passage_id"]).groupBy(F.coalesce("flag", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


COVER = r"len(list_filter({p}, lambda s: len(list_filter(list_filter(list_filter(regexp_split_to_array(substr(lower(s), greatest(strpos(lower(s), 'shall'), 1)), '\s+'), lambda w: w <> ''), lambda w: regexp_full_match(w, '\p{{L}}{{5,}}'))[1:5], lambda w: contains(lower({t}), w))) > 0))"


@query(f"WITH {ALL}, x AS (SELECT item_id, doc_id, regexp_split_to_array(b.text, '[.!?]\\s+') AS parts, d.text FROM r JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id) WHERE rank <= 5) SELECT item_id, doc_id, round(" + COVER.format(p="parts", t="text") + " / len(parts), 3) AS coverage FROM x")
def a12_obligation_coverage(t):
    pairs = top(t, 5).join(t("benchmark").select("item_id", F.col("text").alias("ask")), "item_id").join(t("documents").select("doc_id", "text"), "doc_id")
    return pairs.select("item_id", "doc_id", evaluate.obligation_coverage(T.sentences(F.col("ask")), F.col("text")).alias("coverage"))


@query(f"WITH {LABELS} SELECT passage_id, count(*) FILTER (status <> 'Not Addressed') AS positives FROM g GROUP BY 1")
def a18_positives_per_passage(t):
    return labels(t).groupBy("passage_id").agg(F.count_if(F.col("status").isin(evaluate.POSITIVE)).alias("positives"))


@query(f"WITH {LABELS} SELECT passage_id, count(*) AS negatives FROM g WHERE status = 'Not Addressed' GROUP BY 1 HAVING count(*) >= 2")
def a19_repeated_negatives(t):
    return labels(t).where("status = 'Not Addressed'").groupBy("passage_id").agg(F.count("*").alias("negatives")).where("negatives >= 2")


@query("WITH x AS (SELECT text, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)), c AS (SELECT count(*) AS n, count(*) FILTER (trim(text) <> '') AS text, count(*) FILTER (trim(lang) <> '') AS lang, count(quality) AS quality, count(toxic) AS toxic FROM x) SELECT field, filled, round(filled / n, 6) AS share FROM (UNPIVOT c ON text, lang, quality, toxic INTO NAME field VALUE filled)")
def a26_field_coverage(t):
    return evaluate.field_coverage(t("documents").join(t("labels"), "doc_id", "left"), ["text", "lang", "quality", "toxic"])


@query(f"WITH {LABELS}, b AS (SELECT passage_id, count(*) AS before FROM g GROUP BY 1), a AS (SELECT passage_id, count(*) AS after FROM g WHERE status = 'Fully Addressed' GROUP BY 1) SELECT passage_id, coalesce(before, 0) AS before, coalesce(after, 0) AS after FROM b FULL JOIN a USING (passage_id)")
def a27_before_and_after(t):
    rows = labels(t)
    return curate.before_and_after(rows, rows.where("status = 'Fully Addressed'"), ["passage_id"])


@query("SELECT *, round(coalesce(wrong_dropped / nullif(n_wrong, 0), 0), 6) AS wrong_rate, round((right_kept + wrong_dropped) / (n_right + n_wrong), 6) AS accuracy FROM (SELECT count(*) FILTER (toxic = 0) AS n_right, count(*) FILTER (toxic <> 0) AS n_wrong, count(*) FILTER (toxic = 0 AND quality = 1) AS right_kept, count(*) FILTER (toxic <> 0 AND quality <> 1) AS wrong_dropped FROM labels)")
def a28_judge_agreement(t):
    return evaluate.judge_agreement(t("labels"), F.col("toxic") == 0, F.col("quality") == 1)


# Retrieval and routing.


@query(f"WITH {ALL}, n AS (SELECT doc_id, item_id, score FROM r WHERE rank <= 5 AND score >= 5) SELECT doc_id, string_agg(item_id::VARCHAR, ',' ORDER BY score DESC, item_id) AS items, count(*) AS n FROM n GROUP BY 1")
def r13_regroup(t):
    nested = curate.group_nested(top(t, 5).where("score >= 5"), "doc_id", ["item_id"], "score", "items")
    return nested.withColumn("items", F.array_join(F.transform("items", lambda x: x["item_id"].cast("string")), ","))


FAMILIES = "VALUES ('A', 'password'), ('A', 'that'), ('B', 'und'), ('B', 'tion'), ('C', 'dans')"
MEMBERS = "VALUES ('A', 'a1'), ('A', 'a2'), ('A', 'a3'), ('B', 'b1'), ('B', 'b2'), ('B', 'b3'), ('C', 'c1')"
HITS = f"h AS (SELECT doc_id, family, count(*) AS hits FROM documents JOIN ({FAMILIES}) v(family, word) ON contains(lower(text), word) GROUP BY 1, 2)"
# The documents have no title column: a document's title is its first line.
TITLE_HITS = f"h AS (SELECT doc_id, family, count(*) AS hits FROM documents JOIN ({FAMILIES}) v(family, word) ON contains(lower(split_part(text, chr(10), 1)), word) GROUP BY 1, 2)"


@query(f"WITH {TITLE_HITS}, e AS (SELECT doc_id, lang AS family, 0.5::DOUBLE AS confidence FROM documents WHERE lang <> 'fr'), x AS (SELECT doc_id, family, 1.0::DOUBLE AS confidence, 'title' AS method FROM h UNION ALL SELECT *, 'embedding' FROM e ANTI JOIN h USING (doc_id)) SELECT * FROM x UNION ALL SELECT doc_id, NULL, NULL, 'none' FROM documents ANTI JOIN x USING (doc_id)")
def r18_routes(t):
    docs = t("documents")
    hits = route.keyword_hits(docs, "doc_id", F.substring_index("text", "\n", 1), literal(t, FAMILIES, "family, word"), "family", "word")
    titled = hits.select("doc_id", "family", F.lit(1.0).alias("confidence")).distinct()
    return route.routes(docs, "doc_id", titled, docs.where("lang <> 'fr'").select("doc_id", F.col("lang").alias("family"), F.lit(0.5).alias("confidence")))


def menu(t: Read) -> DataFrame:
    docs = t("documents")
    return route.family_menu(docs, "doc_id", F.col("text"), literal(t, FAMILIES, "family, word"), literal(t, MEMBERS, "family, member"), positives(t), 2)


def positives(t: Read) -> DataFrame:
    return t("documents").where("doc_id % 2 = 0").select("doc_id", F.lit("a1").alias("member"))


MENU = f"{HITS}, o AS (SELECT * FROM h UNION ALL SELECT doc_id, family, 0 FROM documents ANTI JOIN h USING (doc_id) CROSS JOIN (SELECT DISTINCT family FROM ({MEMBERS}) v(family, member))), m AS (SELECT doc_id, family, member, hits, row_number() OVER (PARTITION BY doc_id, family ORDER BY member) AS place FROM o JOIN ({MEMBERS}) v(family, member) USING (family) WHERE NOT (doc_id % 2 = 0 AND member = 'a1') QUALIFY place <= 2)"


@query(f"WITH {MENU} SELECT doc_id, family, member, hits, place FROM m")
def r19_family_menu(t):
    return menu(t).select("doc_id", "family", "member", "hits", F.col("place").cast("long").alias("place"))


@query(f"WITH {ALL}, x AS (SELECT item_id, doc_id, list_distinct({WORDS.format('b.text')}) AS q, regexp_split_to_array(d.text, '[.!?]\\s+') AS a, d.text FROM r JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id) WHERE rank <= 2), sn AS (SELECT item_id, doc_id, q, text, unnest(generate_series(1, len(a))) AS i, unnest(a) AS s FROM x), y AS (SELECT item_id, doc_id, text, i, s, len(list_intersect(q, list_distinct({WORDS.format('s')}))) AS n FROM sn), k AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY n DESC, i) AS place FROM y) SELECT item_id, doc_id, coalesce(string_agg(s, '. ' ORDER BY i) FILTER (n > 0 AND place <= 3), substr(any_value(text), 1, 300)) AS answer FROM k GROUP BY 1, 2")
def r22_extract_answer(t):
    pairs = top(t, 2).join(t("benchmark").select("item_id", F.col("text").alias("ask")), "item_id").join(t("documents").select("doc_id", "text"), "doc_id")
    return route.extract_answer(pairs, ["item_id", "doc_id"], F.col("ask"), F.col("text"))


@query(f"WITH {ALL} SELECT item_id, doc_id, contains(lower(d.text), lower(b.text)) OR contains(lower(b.text), lower(d.text)) AS same FROM r JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id) WHERE rank <= 5")
def r23_contains_either(t):
    pairs = top(t, 5).join(t("benchmark").select("item_id", F.col("text").alias("ask")), "item_id").join(t("documents").select("doc_id", "text"), "doc_id")
    return pairs.select("item_id", "doc_id", route.contains_either(F.col("ask"), F.col("text")).alias("same"))


@query(f"SELECT DISTINCT doc_id, topic FROM documents JOIN ({FAMILIES}) v(topic, word) ON contains(lower(text), word)")
def r24_topics(t):
    return route.keyword_hits(t("documents"), "doc_id", F.col("text"), literal(t, FAMILIES, "topic, word"), "topic", "word").select("doc_id", "topic").distinct()


@query(f"WITH a AS (SELECT DISTINCT doc_id, o FROM documents JOIN ({FAMILIES}) v(o, word) ON contains(lower(text), word) WHERE o <> 'B'), b AS (SELECT DISTINCT doc_id, o FROM documents JOIN ({FAMILIES}) v(o, word) ON contains(lower(text), word) WHERE o <> 'A') SELECT doc_id, coalesce(a.o, 'none') AS first, coalesce(b.o, 'none') AS second FROM a FULL JOIN b USING (doc_id)")
def r25_crosswalk(t):
    words = literal(t, FAMILIES, "owner, word")
    found = [route.keyword_hits(t("documents"), "doc_id", F.col("text"), words.where(f"owner <> '{x}'"), "owner", "word") for x in "BA"]
    return route.crosswalk(*found, "doc_id")


# A document's vector is the row of embeddings with its number, an item's likewise; source and lang stand for control and family.
DENSE = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
dn AS (
  SELECT item_id, doc_id, rank FROM (
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (
      SELECT q.vec_id AS item_id, x.vec_id AS doc_id, round(list_inner_product(q.e, x.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(x.e, x.e)) + 1e-9), 6) AS score
      FROM v q JOIN benchmark b ON b.item_id = q.vec_id JOIN v x ON x.vec_id <> q.vec_id JOIN documents d ON d.doc_id = x.vec_id) WHERE score > 0) WHERE rank <= 50
), fu AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf_score DESC, doc_id) AS rank FROM (
    SELECT item_id, doc_id, round(coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + dn.rank), 0), 9) AS rrf_score FROM (SELECT * FROM r WHERE rank <= 50) a FULL JOIN dn USING (item_id, doc_id))) WHERE rank <= 50
), pr AS (
  SELECT fu.item_id, fu.doc_id, fu.rank, rrf_score, coalesce(r.score, 0) AS bm25_score, b.text AS q, d.text AS t, d.source, d.lang, qe.e AS qe, de.e AS de,
    list_distinct(""" + WORDS.format("b.text") + """) AS qw, list_distinct(""" + WORDS.format("d.text") + """) AS tw
  FROM fu JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id) LEFT JOIN (SELECT * FROM r WHERE rank <= 50) r USING (item_id, doc_id) LEFT JOIN v qe ON qe.vec_id = fu.item_id LEFT JOIN v de ON de.vec_id = fu.doc_id
)"""
HELD = " + ".join(f"contains(lower(t), '{w}')::BIGINT" for w in route.REGULATORY)


def ranking(t: Read) -> DataFrame:
    """The first 50 of both arms' fusion, with the nine features."""
    items, docs = t("benchmark"), t("documents")
    vectors = t("embeddings").select("vec_id", "embedding")
    of_items = vectors.withColumnRenamed("vec_id", "item_id").join(items.select("item_id"), "item_id", "left_semi")
    of_docs = vectors.withColumnRenamed("vec_id", "doc_id").join(docs.select("doc_id"), "doc_id", "left_semi")
    lexical = materialize(top(t, 50), "lexical")
    dense = retrieve.cosine(of_docs, of_items, doc="doc_id", query="item_id", k=50)
    fused = retrieve.fuse(lexical, dense, ["item_id", "doc_id"], ["item_id"], "doc_id", 50).withColumnRenamed("score", "rrf")
    pairs = fused.join(lexical.select("item_id", "doc_id", F.col("score").alias("bm25")), ["item_id", "doc_id"], "left")
    pairs = pairs.join(items.select("item_id", F.col("text").alias("q")), "item_id").join(docs.select("doc_id", F.col("text").alias("d"), "source", "lang"), "doc_id")
    pairs = pairs.join(of_items.withColumnRenamed("embedding", "qe"), "item_id", "left").join(of_docs.withColumnRenamed("embedding", "de"), "doc_id", "left")
    told = route.ranking_features(spread(pairs), F.col("q"), F.col("d"), F.col("source"), F.col("lang"), F.col("bm25"), route.dense_similarity(F.col("qe"), F.col("de")), F.col("rrf"))
    return told.withColumn("label", F.contains("d", F.col("q")).cast("double")).select("item_id", "doc_id", "rank", *route.RANKING, "label")


@query(f"WITH {ALL}, {DENSE} SELECT item_id, doc_id, rank, bm25_score, coalesce(CASE WHEN len(qe) = len(de) AND list_inner_product(qe, qe) > 0 AND list_inner_product(de, de) > 0 THEN round(list_inner_product(qe, de) / (sqrt(list_inner_product(qe, qe)) * sqrt(list_inner_product(de, de))), 6) END, 0) AS dense_similarity, rrf_score, contains(lower(q), lower(source))::INT::DOUBLE AS control_id_in_query, contains(lower(q), lower(lang))::INT::DOUBLE AS family_match, length(t) / 1000 AS passage_length, round(len(list_intersect(qw, tw)) / greatest(len(qw), 1), 6) AS word_overlap, round(len(list_intersect(qw, tw)) / greatest(len(tw), 1), 6) AS word_overlap_ratio, {HELD} AS regulatory_keyword_count, contains(t, q)::INT::DOUBLE AS label FROM pr")
def r20_ranking_features(t):
    return ranking(t)


@query()
def r21_learned_rank(t):
    """The nine features of the fused pairs; the label is whether the document holds the whole item. Fitted on seven items in ten, ranked on the others."""
    split = curate.split_by_hash(materialize(ranking(t).drop("rank"), "features"), ["item_id"], 42, {"train": 700, "dev": 300})
    names = list(route.RANKING)
    return rank.learned_rank(rank.fit_ranker(split.where("split = 'train'"), names, "label"), split.where("split = 'dev'"), names, ["item_id"], "doc_id")


# Segmentation and extraction.


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+ [0-9]+')) AS match FROM documents")
def x10_inline_matches(t):
    return segment.inline_matches(t("documents"), "doc_id", F.col("text"), "[a-z]+ [0-9]+")


@query(r"SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n, n_nationkey::VARCHAR AS number, n_name AS name, '' AS statement, CASE WHEN n_nationkey % 2 = 0 THEN 'x' ELSE '' END AS p1 FROM nation")
def x9_grid_records(t):
    """A grid per region: a header, then a row per nation, the last cell missing for every second one."""
    cells = F.array(F.col("n_nationkey").cast("string"), F.concat(F.lit(" "), "n_name"), F.when(F.col("n_nationkey") % 2 == 0, "x"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", cells.alias("c")))), lambda x: x["c"])
    head = F.array(F.array(F.lit("Control Number"), F.lit("Control Name"), F.lit("P1")))
    grids = t("nation").groupBy("n_regionkey").agg(F.concat(head, body).alias("rows"))
    fields = {"number": ["control number", "number"], "name": ["control name", "name"], "statement": ["statement", "description"], "p1": ["p1"]}
    return extract.grid_records(grids, ["n_regionkey"], F.col("rows"), fields, ["control number", "control name"]).withColumn("n", F.col("n").cast("long"))


@query("SELECT p_partkey, 'The entity shall keep a register of ' || p_name || ' and review it.' AS description, p_brand || '|' || p_type || '|' || p_name AS criteria FROM part")
def x12_description_and_criteria(t):
    title = F.concat(F.lit("The entity shall keep a register of "), "p_name")
    body = F.concat(F.lit("and review it.\nThe policy shall:\n1. "), "p_brand", F.lit("\na. "), "p_type", F.lit("\n2. "), "p_name")
    x = extract.description_and_criteria(title, body)
    flat = F.array_join(F.flatten(F.transform(x["criteria"], lambda c: F.concat(F.array(c["text"]), c["sub"]))), "|")
    return t("part").select("p_partkey", x["description"].alias("description"), flat.alias("criteria"))


@query("SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS item, o_orderpriority || ' more' AS text, o_orderstatus AS sub FROM orders")
def x13_layout_items(t):
    """Every order as three blocks: a numbered one, what continues it, a lettered one; a heading before, a footer after each customer's."""
    block = lambda i, x, s: F.struct(F.lit(i).alias("i"), F.lit(x).alias("x"), s.alias("text"))
    three = F.array(block(1, 61.0, F.concat(F.lit("1. "), "o_orderpriority")), block(2, 79.0, F.lit("more")), block(3, 80.0, F.concat(F.lit("a. "), "o_orderstatus")))
    rows = t("orders").select("o_custkey", "o_orderkey", F.explode(three).alias("b")).select("o_custkey", (F.col("o_orderkey") * 10 + F.col("b.i")).alias("place"), "b.x", "b.text")
    ends = t("orders").select("o_custkey").distinct().select("o_custkey", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("place"), F.lit("Heading").alias("text")), F.struct(F.lit(2**40).alias("place"), F.lit("Footer").alias("text")))).alias("b")).select("o_custkey", "b.place", F.lit(20.0).alias("x"), "b.text")
    return extract.layout_items(rows.unionByName(ends), ["o_custkey"], "place", "x", "text").withColumn("sub", F.array_join("sub", "|"))


@query("SELECT * FROM (SELECT o_custkey AS control_id, 0 AS n, 'main' AS kind, o_orderpriority AS text FROM orders UNION ALL SELECT o_custkey, 1, 'sub', o_orderstatus FROM orders)")
def x14_control_passages(t):
    rows = t("orders").select(F.col("o_custkey").alias("control_id"), F.col("o_orderpriority").alias("description"), F.array("o_orderstatus", F.lit(" ")).alias("sub_controls"), F.lit(None).cast("string").alias("guidelines"))
    return segment.control_passages(rows)


@query("SELECT doc_id, unnest(generate_series(1, len(a))) AS n, trim(unnest(a)) AS section, '' AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)")
def x2_markdown_sections(t):
    return segment.markdown_sections(t("documents"), "doc_id", F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n# "))))


# Training sets, annotation and replies.


@query(f"WITH {LABELS} SELECT control_id, passage_id, coalesce(b.text, 'q') AS query, d.text AS passage, CASE status WHEN 'Fully Addressed' THEN 1.0::DOUBLE WHEN 'Partially Addressed' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM g LEFT JOIN benchmark b ON b.item_id = control_id JOIN documents d ON d.doc_id = passage_id")
def c6_training_pairs(t):
    rows = labels(t).withColumns({"query_snippet": F.lit("q"), "passage_snippet": F.lit(None).cast("string")})
    queries = t("benchmark").select(F.col("item_id").alias("control_id"), "text")
    return curate.training_pairs(rows, queries, t("documents").select(F.col("doc_id").alias("passage_id"), "text"), {k: v / 2 for k, v in STATUS.items()})


@query("SELECT conv_id, turn, 'system:s|human:' || role || '|gpt:' || text AS turns FROM conversations")
def c13_conversation(t):
    turns = curate.conversation(F.lit("s"), F.col("role"), F.col("text"))
    return t("conversations").select("conv_id", "turn", F.array_join(F.transform(turns, lambda x: F.concat_ws(":", x["from"], x["value"])), "|").alias("turns"))


@query(f"WITH {MENU} SELECT doc_id, string_agg('  ' || member, chr(10) ORDER BY hits DESC, family, place) AS menu FROM m GROUP BY 1")
def c14_menu_text(t):
    return synthesize.menu_text(menu(t), "doc_id")


PROPOSED = "VALUES ('a1'), ('a1'), ('b3'), ('z9')"


@query(f"SELECT DISTINCT doc_id, v.member, 'Not Addressed' AS status, true AS is_hard_negative FROM documents CROSS JOIN ({PROPOSED}) v(member) WHERE v.member <> 'z9' AND NOT (v.member = 'a1' AND doc_id % 2 = 0)")
def c14_valid_negatives(t):
    said = t("documents").select("doc_id").crossJoin(F.broadcast(literal(t, PROPOSED, "member")))
    return synthesize.valid_negatives(said, "doc_id", "member", literal(t, MEMBERS, "family, member"), positives(t)).select("doc_id", "member", "status", "is_hard_negative")


TEMPLATES = {"Fully Addressed": ["We always do this: {text}"], "Partially Addressed": ["We mostly do this: {text}"], "Not Addressed": ["We do something else."]}


@query("SELECT item_id, 'synthetic_' || item_id || '_' || replace(lower(status), ' ', '_') || '_' || c AS passage_id, status, replace(template, '{text}', text) AS passage FROM benchmark CROSS JOIN (VALUES ('Fully Addressed', 'We always do this: {text}'), ('Partially Addressed', 'We mostly do this: {text}'), ('Not Addressed', 'We do something else.')) v(status, template) CROSS JOIN (VALUES (1), (2)) c(c)")
def c15_synthetic_pairs(t):
    return synthesize.synthetic_pairs(t("benchmark"), "item_id", "text", TEMPLATES, 2)


@query(r"WITH x AS (SELECT doc_id, regexp_extract(text, 'that [^.]*\.') AS a, trim(regexp_split_to_array(text, '[.!?]\s+')[1]) AS s, text FROM documents), y AS (SELECT doc_id, CASE WHEN length(trim(a)) > 15 THEN trim(a) WHEN length(s) > 15 THEN s ELSE substr(text, 1, 200) END AS answer FROM x), z AS (SELECT 'q_' || doc_id AS question_id, answer, length(answer) AS score FROM y WHERE length(answer) >= 10) SELECT question_id, answer, score, true AS is_validated FROM z WHERE score >= 40")
def c16_questions(t):
    rows = synthesize.single_questions(t("documents"), "doc_id", F.lit("What does it say?"), T.answer(F.col("text"), [r"that [^.]*\."]))
    return synthesize.validated(rows.withColumn("score", F.char_length("answer").cast("long")), "score", 40).select("question_id", "answer", "score", "is_validated")


@query("""WITH d AS (SELECT doc_id, source, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS a, ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT AS h FROM documents WHERE text <> '' AND source IS NOT NULL),
b AS (SELECT source, ceil(count(*) / 10000)::BIGINT AS buckets FROM d GROUP BY 1), p AS (SELECT *, h % buckets AS b FROM d JOIN b USING (source)),
g AS (SELECT *, (row_number() OVER (PARTITION BY source, b ORDER BY h, doc_id) - 1) // 4 AS g FROM p)
SELECT 'q_' || source || '_' || b || '_' || g AS question_id, 'What is said about ' || source || '?' AS question, string_agg('From ' || doc_id || ': ' || a, ' ' ORDER BY doc_id) AS answer, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS passages, count(*) AS n FROM g GROUP BY source, b, g HAVING count(*) >= 2""")
def c16_topic_questions(t):
    return synthesize.topic_questions(t("documents").withColumn("reply", T.snippet(F.col("text"), 80)), "doc_id", "source", "reply", "What is said about {topic}?", 4).withColumn("passages", F.array_join(F.transform("passages", lambda p: p.cast("string")), ","))


@query("SELECT o_orderkey, o_orderstatus = 'O' AND o_totalprice > 100000 AS hard FROM orders")
def l3_hard_negative(t):
    status = F.when(F.col("o_orderstatus") == "O", "Not Addressed").otherwise("Fully Addressed")
    return t("orders").select("o_orderkey", annotate.hard_negative(status, F.lit("ok"), F.when(F.col("o_totalprice") > 100000, 5).otherwise(2)).alias("hard"))


@query("SELECT o_orderkey, 1 + (o_orderstatus = 'F')::INT + (o_totalprice > 100000)::INT AS yes FROM orders")
def l6_checklist(t):
    said = lambda c: F.when(c, "yes").otherwise("No")
    reply = F.concat(F.lit("Q1: YES\nq2: "), said(F.col("o_orderstatus") == "F"), F.lit("\nQ3: "), said(F.col("o_totalprice") > 100000))
    return t("orders").select("o_orderkey", annotate.checklist_reply(reply)["yes"].alias("yes"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Fully Addressed' WHEN 'P' THEN 'Partially Addressed' ELSE 'Not Addressed' END AS verdict, o_orderstatus <> 'O' AS kept FROM orders")
def l7_free_reply(t):
    reply = F.when(F.col("o_orderstatus") == "F", "I find it not fully met.").when(F.col("o_orderstatus") == "P", "verdict: Partial\nfully argued").otherwise("No idea")
    return annotate.keep_judged(t("orders").select("o_orderkey", annotate.free_reply(reply).alias("verdict")), "verdict", drop=False)


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'right' WHEN 'P' THEN 'part' ELSE 'wrong' END AS token FROM orders")
def l8_token_reply(t):
    reply = F.when(F.col("o_orderstatus") == "F", "It is FULL.").when(F.col("o_orderstatus") == "P", "partial").otherwise("fullness")
    return t("orders").select("o_orderkey", annotate.token_reply(reply, {"full": "right", "partial": "part"}, "wrong").alias("token"))


@query("SELECT o_orderkey, n::BIGINT AS n, CASE n WHEN 0 THEN 'C' || o_custkey ELSE 'D' || o_orderkey END AS control_id, CASE n WHEN 0 THEN 'one' ELSE 'two' END AS reason FROM orders CROSS JOIN (VALUES (0), (1)) v(n)")
def l10_negative_sets(t):
    reply = F.concat(F.lit("Here:\nCONTROL_ID: C"), F.col("o_custkey").cast("string"), F.lit("\nREASON: one\ncontrol_id: D"), F.col("o_orderkey").cast("string"), F.lit("\nReason: two\nCONTROL_ID: late"))
    return annotate.negative_sets(t("orders").withColumn("reply", reply), "o_orderkey", "reply", 2).withColumn("n", F.col("n").cast("long"))
