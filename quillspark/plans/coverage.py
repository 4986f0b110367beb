"""Queries of scans, sinks, column functions and filters, with DuckDB SQL. Scans and sinks write to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import obligations as O
from quillspark.functions import text as T
from quillspark.operators import annotate, curate, evaluate, score, segment, synthesize
from quillspark.plans import queries as registered
from quillspark.plans.mapping import Options
from quillspark.plans.queries import WORDS, Read
from quillspark.sources import readers, sinks


def query(sql: str | None = None):
    """Register like queries.query; whole numbers come out as long."""

    def register(f):
        def longs(t: Read) -> DataFrame:
            out = f(t)
            return out.withColumns({c: F.col(c).cast("long") for c, kind in out.dtypes if kind == "int"})

        longs.__name__ = f.__name__
        registered.query(sql)(longs)
        return f

    return register


def literal(t: Read, values: str, names: str) -> DataFrame:
    return t("region").sparkSession.sql(f"SELECT * FROM VALUES {values} AS v({names})")


def place(t: Read, name: str) -> str:
    return sinks.shared_folder(t("region").sparkSession, name)


# Scans and sinks.

NATION = "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation"


@query(NATION)
def s1_json_array(t):
    """One JSON array in a file, and back."""
    path = place(t, "s1")
    sinks.json_report(t("nation").select("n_nationkey", "n_name"), path)
    return readers.json_array(t("nation").sparkSession, path, "n_nationkey long, n_name string")


@query("SELECT s_suppkey::BIGINT AS s_suppkey, 'say \"' || s_name || '\", ' || chr(92) || chr(10) || 'ü' AS note, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS balance FROM supplier")
def k1_json_report(t):
    """K1: quotes, backslashes, line breaks and nulls come back from one JSON array as they were."""
    path = place(t, "k1")
    note = F.concat(F.lit('say "'), "s_name", F.lit('", \\\nü'))
    sinks.json_report(t("supplier").select("s_suppkey", note.alias("note"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("balance")), path)
    return readers.json_array(t("supplier").sparkSession, path, "s_suppkey long, note string, balance double")


@query("SELECT r_name AS id, row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS rank, n_name AS item FROM nation JOIN region ON n_regionkey = r_regionkey")
def s2_keyed_object(t):
    """An object of id to array."""
    lists = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    whole = lists.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", "names")))).alias("value"))
    path = place(t, "s2")
    whole.coalesce(1).write.text(path)
    return readers.keyed_object(t("nation").sparkSession, path, "array<string>")


@query("SELECT o_orderkey::BIGINT AS o_orderkey, o_orderstatus FROM orders")
def s3_json_lines(t):
    """S3: blank and malformed lines are passed over."""
    rows = t("orders").select(F.to_json(F.struct("o_orderkey", "o_orderstatus")).alias("value"))
    path = place(t, "s3")
    rows.unionByName(rows.limit(3).select(F.lit("{bad").alias("value"))).unionByName(rows.limit(2).select(F.lit("").alias("value"))).write.text(path)
    return readers.json_lines(rows.sparkSession, path, "o_orderkey long, o_orderstatus string").where("o_orderkey is not null")


@query("SELECT o_orderkey::BIGINT AS o_orderkey, o_orderstatus FROM orders")
def k4_json_lines(t):
    path = place(t, "k4")
    sinks.json_lines(t("orders").select("o_orderkey", "o_orderstatus"), path)
    return readers.json_lines(t("orders").sparkSession, path, "o_orderkey long, o_orderstatus string", strict=True)


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name || ', \"' || p_brand || '\"' AS p_name, 'none' AS notes FROM part")
def s4_csv(t):
    """Quotes and commas in fields, a column that the file lacks."""
    path = place(t, "s4")
    t("part").select("p_partkey", F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("p_name")).write.option("header", True).option("escape", '"').csv(path)
    return readers.csv_table(t("part").sparkSession, path, {"p_partkey": "", "p_name": "", "notes": "none"})


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, n_name, s_nationkey::VARCHAR AS s_nationkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def k2_csv_with_names(t):
    path = place(t, "k2")
    names = t("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    sinks.csv_with_names(t("supplier").select("s_suppkey", "s_nationkey"), names, "s_nationkey", ["s_suppkey", "n_name", "s_nationkey"], path)
    return readers.csv_table(names.sparkSession, path, {"s_suppkey": "", "n_name": "", "s_nationkey": ""})


@query("SELECT n_name, 'n_regionkey=' || n_regionkey AS folder FROM nation")
def s5_folder(t):
    """A file with a JSON array in each of several folders, read by a glob."""
    path = place(t, "s5")
    arrays = t("nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("n_name"))).alias("value"))
    arrays.write.partitionBy("n_regionkey").text(path)
    rows = readers.folder(t("nation").sparkSession, f"{path}/*", "n_name string", "*.txt")
    return rows.select("n_name", F.regexp_extract(F.input_file_name(), "(n_regionkey=[0-9]+)", 1).alias("folder"))


@query("SELECT n_regionkey::BIGINT AS n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def k3_index(t):
    return sinks.per_document(t("nation").select("n_regionkey", "n_name"), "n_regionkey", place(t, "k3"))


@query("WITH f AS (SELECT l_orderkey, l_partkey, 'f' || l_linenumber AS file FROM lineitem WHERE l_linenumber <> 7) SELECT l_orderkey, l_partkey, file FROM f QUALIFY file = max(file) OVER (PARTITION BY l_orderkey)")
def s6_last_file(t):
    rows = t("lineitem").select("l_orderkey", "l_partkey", F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("file"))
    return readers.last_file_wins(rows, "l_orderkey", "^f7$").select("l_orderkey", "l_partkey", "file")


@query(NATION)
def s7_first_existing(t):
    path, spark = place(t, "s7"), t("nation").sparkSession
    t("nation").select("n_nationkey", "n_name").write.parquet(f"{path}/second")
    return spark.read.parquet(readers.first_existing(spark, [f"{path}/first", f"{path}/second", f"{path}/third"])).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


@query("SELECT n_nationkey::VARCHAR AS control_id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'inner' ELSE 'flat' END AS description FROM nation")
def s8_nested_or_flat(t):
    key = F.col("n_nationkey").cast("string")
    inner = F.when(F.col("n_nationkey") % 2 == 0, F.struct(key.alias("id"), F.col("n_name").alias("name"), F.lit("inner").alias("description")))
    return readers.nested_or_flat(t("nation").select(inner.alias("control"), key.alias("control_id"), F.col("n_name").alias("control_name"), F.lit("flat").alias("description")))


@query("SELECT DISTINCT 'c' || c_nationkey AS id FROM customer")
def s9_id_list(t):
    """Distinct ids, a line each, between comments and blank lines."""
    path = place(t, "s9")
    ids = sinks.distinct_ids(t("customer").select(F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("a")), "a")
    noise = t("region").select(F.lit("# comment").alias("value")).union(t("region").select(F.lit("  ")))
    ids.select(F.concat(F.lit(" "), "id").alias("value")).union(noise).write.text(path)
    return readers.id_list(ids.sparkSession, path)


@query("SELECT s_nationkey::VARCHAR AS id FROM supplier UNION SELECT c_nationkey::VARCHAR FROM customer")
def k9_distinct_ids(t):
    both = t("supplier").select(F.col("s_nationkey").cast("string").alias("a"), F.lit(None).cast("string").alias("b")).union(t("customer").select(F.lit(None).cast("string"), F.col("c_nationkey").cast("string")))
    return sinks.distinct_ids(both, "a", "b")


@query("SELECT n_nationkey::BIGINT AS id, upper(n_name) AS text FROM nation")
def s10_decoded_files(t):
    """Binary files through a decoder (here: UTF-8 in upper case, in place of a PDF library)."""
    path = place(t, "s10")
    t("nation").select("n_nationkey", F.col("n_name").alias("value")).write.partitionBy("n_nationkey").text(path)

    def decode(frames):
        for frame in frames:
            key = frame["path"].str.extract(r"n_nationkey=(\d+)")[0].astype("int64")
            yield frame.assign(id=key, text=frame["content"].map(lambda b: b.decode().strip().upper()))[["id", "text"]]

    return readers.binary_files(t("nation").sparkSession, f"{path}/*", decode, "id long, text string", "*.txt")


@query("SELECT item_id, 'CORRECT' AS assignment, 'seen ' || length(text) AS reason FROM benchmark")
def s11_model_endpoint(t):
    """Prompts to an endpoint (here a stub that answers by the prompt's length) and what its replies say."""
    def client(prompts):
        return [f"EVIDENCE: YES\nREASON: seen {len(p)}" for p in prompts]

    return annotate.judge_run(t("benchmark").select("item_id", F.col("text").alias("prompt")), client).select("item_id", "judged.assignment", "judged.reason")


@query("SELECT item_id, round(least(length(text), 512) / 1000, 6) AS score FROM benchmark")
def s12_scorer(t):
    """A model behind the Scorer interface, over the first 512 characters."""
    pairs = t("benchmark").select("item_id", F.lit("q").alias("query"), "text")
    return score.rescore(pairs, "query", "text", lambda frame: (frame["text"].str.len() / 1000).round(6)).select("item_id", "score")


@query(f"WITH {registered.ALL} SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 7")
def s13_options(t):
    """The depth of a search from an environment's text; names that aren't options are passed over."""
    options = Options.read({"candidates": " 7", "full": "0.8", "block_before": "true", "unknown": "x"})
    return registered.top(t, options.candidates)


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name AS name, n_regionkey::VARCHAR AS id FROM nation")
def s14_embedded_json(t):
    written = F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("id")))
    return t("nation").select("n_nationkey", readers.embedded_json(written, "name string, id string").alias("c")).select("n_nationkey", "c.name", "c.id")


@query("SELECT l_suppkey::VARCHAR AS l_suppkey, (count(*) FILTER (l_returnflag = 'A'))::VARCHAR AS \"A\", (count(*) FILTER (l_returnflag = 'N'))::VARCHAR AS \"N\", count(*)::VARCHAR AS total FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def k5_matrix_csv(t):
    path = place(t, "k5")
    evaluate.matrix(t("lineitem").where("l_returnflag <> 'R'"), "l_suppkey", "l_returnflag", ["A", "N"]).drop("active").write.option("header", True).csv(path)
    return readers.csv_table(t("region").sparkSession, path, dict.fromkeys(("l_suppkey", "A", "N", "total"), ""))


@query("SELECT n_name, 2::BIGINT AS runs FROM nation")
def k6_run_log(t):
    path, rows = place(t, "k6"), t("nation").select("n_name")
    for _ in range(2):
        sinks.append_run(rows, path)
    return readers.json_lines(rows.sparkSession, path, "n_name string").groupBy("n_name").agg(F.count("*").alias("runs"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def k7_resume(t):
    return sinks.resume(t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N')")
def k7_resume_part_done(t):
    """K7: what a checkpoint lists, often more than once, isn't done again."""
    done = t("lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("o_orderkey"))
    return sinks.resume(t("orders").select("o_custkey", "o_orderkey"), done, ["o_orderkey"])


@query("SELECT conv_id, string_agg('=== ' || role || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def k8_banners(t):
    return sinks.banner_text(t("conversations"), "conv_id", "role", "text", "turn")


CHOICE = "'<Choice value=\"' || replace(replace(replace(n_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '\" />'"


@query(f"SELECT r_regionkey::BIGINT AS r_regionkey, '<View><Text name=\"passage\" value=\"$passage\" /><Choices name=\"family\" toName=\"passage\">' || string_agg({CHOICE}, '' ORDER BY n_name) || '</Choices><TextArea name=\"comment\" toName=\"passage\" /></View>' AS form FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def k10_label_form(t):
    """A form a region, its nations (with what XML escapes) the choices."""
    named = t("nation").groupBy(F.col("n_regionkey").cast("long").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("names"))

    def forms(frames):
        for frame in frames:
            yield frame.assign(form=[sinks.label_config({"family": ("Choices", list(n)), "comment": ("TextArea", [])}, ["passage"]) for n in frame["names"]])[["r_regionkey", "form"]]

    return named.mapInPandas(forms, "r_regionkey long, form string")


# Column functions.

CUTS = (200, 300, 400, 500, 512, 600, 700, 800, 1000, 1200, 2000, 4000, 8000)


@query("SELECT doc_id, " + ", ".join(f"sha256(substr(text, 1, {n})) AS head_{n}" for n in CUTS) + " FROM documents")
def p2_heads(t):
    """The starts of every length that the source cuts to; the cut is the feature."""
    return t("documents").select("doc_id", *(F.sha2(F.substring("text", 1, n), 256).alias(f"head_{n}") for n in CUTS))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'M1.' || c_custkey ELSE c_name END AS id FROM customer")
def p11_without_prefix(t):
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("CTRL_M1."), F.col("c_custkey").cast("string"))).otherwise(F.col("c_name"))
    return t("customer").select("c_custkey", T.without_prefix(raw, "CTRL_").alias("id"))


@query("SELECT p_partkey, 'information security ' || lower(p_brand) AS name FROM part")
def p13_canonical_name(t):
    file = F.concat(F.lit("Info_Sec-"), "p_brand", F.lit("_v2.1-final.docx"))
    return t("part").select("p_partkey", T.canonical_name(file, {"info": "information", "sec": "security"}).alias("name"))


@query("SELECT p_partkey, lower(p_type) || ' of ' || p_size AS name FROM part")
def p14_display_name(t):
    return t("part").select("p_partkey", T.canonical_name(F.concat("p_type", F.lit("_of_"), F.col("p_size").cast("string"), F.lit(".pdf")), {}).alias("name"))


@query("SELECT c_custkey, 'Does ' || c_name || ' meet ' || c_mktsegment || '? ' AS question FROM customer")
def p21_template(t):
    return t("customer").select("c_custkey", synthesize.filled(F.lit("Does {who} meet {what}? {none}"), {"who": F.col("c_name"), "what": F.col("c_mktsegment"), "none": F.lit(None).cast("string")}).alias("question"))


@query("SELECT p_partkey, p_brand || '|always' AS listed, CASE WHEN p_size % 3 = 0 THEN 'P' || p_size WHEN p_size % 3 = 1 THEN 'always' ELSE 'P1' END AS found FROM part")
def p23_applicability(t):
    size = F.col("p_size").cast("string")
    free = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("the priority  P"), size, F.lit(" holds"))).when(F.col("p_size") % 3 == 1, F.lit("is Always applicable")).otherwise(F.lit("nothing"))
    listed = F.concat("p_brand", F.lit(" ; , always"))
    return t("part").select("p_partkey", F.array_join(T.applicability_list(listed), "|").alias("listed"), F.array_join(T.applicability_found(free), "|").alias("found"))


@query("SELECT doc_id, sha256(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS safe FROM documents")
def p24_xml_escape(t):
    return t("documents").select("doc_id", F.sha2(T.xml_escape(F.col("text")), 256).alias("safe"))


@query("SELECT n_regionkey::BIGINT AS n_regionkey, '|key|name|' || chr(10) || string_agg('|' || n_nationkey || '|' || n_name || '|', chr(10) ORDER BY n_nationkey) || chr(10) AS tables FROM nation GROUP BY 1")
def p25_markdown_tables(t):
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit("|"), x["n_nationkey"].cast("string"), F.lit("|"), x["n_name"], F.lit("|"))), "\n")
    text = F.concat(F.lit("before\n|single|\n\n|key|name|\n"), rows, F.lit("\nafter"))
    return t("nation").groupBy("n_regionkey").agg(text.alias("t")).select("n_regionkey", F.array_join(T.markdown_tables(F.col("t")), "#").alias("tables"))


@query("SELECT c_custkey, CASE WHEN length(c_name) >= length(c_mktsegment) THEN c_name ELSE c_mktsegment END AS longest FROM customer")
def p29_longest(t):
    return t("customer").select("c_custkey", T.longest(F.col("c_name"), F.lit(None).cast("string"), F.col("c_mktsegment"), F.lit("")).alias("longest"))


@query("SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'F' WHEN bool_or(o_orderstatus = 'P') THEN 'P' ELSE min(o_orderstatus) END AS status FROM orders GROUP BY 1")
def p30_preferred(t):
    return t("orders").groupBy("o_custkey").agg(T.first_of_enum(F.array_sort(F.collect_set("o_orderstatus")), ["F", "P"]).alias("status"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'P' THEN 0.7::DOUBLE END AS score, CASE o_orderstatus WHEN 'F' THEN 'Fully Addressed' WHEN 'P' THEN 'Partially Addressed' ELSE 'Not Addressed' END AS status FROM orders")
def p31_status_codes(t):
    status = F.when(F.col("o_orderstatus") == "F", "Fully addressed").when(F.col("o_orderstatus") == "P", "Partially Addressed").otherwise("?")
    found = T.by_status(status, {"Fully Addressed": 1.0, "Partially Addressed": 0.7})
    return t("orders").select("o_orderkey", found.alias("score"), T.status_of_score(F.coalesce(found, F.lit(0.0))).alias("status"))


@query("SELECT c_custkey, (CASE WHEN c_nationkey % 6 = 0 THEN 2 ELSE c_nationkey % 6 - 1 END) / 4 AS confidence FROM customer")
def p33_unit_confidence(t):
    return t("customer").select("c_custkey", T.unit_confidence(F.col("c_nationkey") % 6).alias("confidence"))


@query("SELECT o_orderkey, round(o_totalprice / max(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders")
def p35_of_greatest(t):
    from pyspark.sql import Window

    return t("orders").select("o_orderkey", F.round(T.of_greatest(F.col("o_totalprice"), Window.partitionBy("o_custkey")), 6).alias("share"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 0 ELSE round(l_discount / l_tax, 6) END AS ratio, round(l_extendedprice, 2) AS two, round(l_discount, 4) AS four FROM lineitem")
def p36_guarded_ratio(t):
    """P36, P37."""
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(T.ratio(F.col("l_discount"), F.col("l_tax")), 6).alias("ratio"), F.round("l_extendedprice", 2).alias("two"), F.round("l_discount", 4).alias("four"))


@query("SELECT l_orderkey, l_linenumber, round(l_discount / 8, 2) AS two, round(l_discount / 8, 3) AS three, round(l_tax / 16, 4) AS four FROM lineitem")
def p37_rounding(t):
    """Two to four places; halves go away from zero."""
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_discount") / 8, 2).alias("two"), F.round(F.col("l_discount") / 8, 3).alias("three"), F.round(F.col("l_tax") / 16, 4).alias("four"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 5 END AS digit FROM orders")
def p39_choice_digit(t):
    choice = F.when(F.col("o_orderkey") % 3 == 0, "High").otherwise(F.concat((F.col("o_orderkey") % 5).cast("string"), F.lit(" - High")))
    return t("orders").select("o_orderkey", annotate.choice_digit(choice).alias("digit"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 0 THEN o_clerk ELSE '2024-01-01' END AS updated FROM (SELECT *, 'x' AS o_clerk FROM (SELECT o_orderkey, o_orderdate FROM orders))")
def p40_last_updated(t):
    key = F.col("o_orderkey")
    return t("orders").select("o_orderkey", T.last_updated(F.lit(" "), F.when(key % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")), F.when(key % 3 == 0, "x"), default="2024-01-01").alias("updated"))


@query("SELECT p_partkey, 'b' || ('0x' || substr(md5(p_name), 1, 8))::BIGINT % 10000 AS id FROM part")
def p41_bucket_id(t):
    return t("part").select("p_partkey", T.bucket_id(F.col("p_name"), "b").alias("id"))


@query("SELECT p_partkey, 'p_' || substr(sha256(p_name || chr(31) || p_partkey), 1, 8) AS id FROM part")
def p42_short_id(t):
    return t("part").select("p_partkey", T.short_id(F.col("p_name"), F.col("p_partkey"), prefix="p_").alias("id"))


@query(f"SELECT doc_id, array_to_string({WORDS.format('text')}[1:5], chr(10)) AS head FROM documents")
def p43_head_joined(t):
    return t("documents").select("doc_id", T.head_joined(T.tokens(F.col("text")), 5).alias("head"))


@query("SELECT p_partkey, p_brand || '|' || p_type || '|' || p_name AS subs FROM part")
def p46_sub_items(t):
    text = F.concat(F.lit("1. top\na) "), "p_brand", F.lit("\nb) "), "p_type", F.lit("\n2. next\na) "), "p_name")
    return t("part").select("p_partkey", F.array_join(T.sub_items(segment.nested_list(text)), "|").alias("subs"))


@query("SELECT p_partkey, p_brand || chr(10) || p_type AS text, p_brand || '|' || p_type AS items FROM part")
def p47_text_or_list(t):
    items = F.array("p_brand", F.lit(""), "p_type")
    return t("part").select("p_partkey", T.as_text(items).alias("text"), F.array_join(T.as_list(F.concat(F.lit(" "), T.as_text(items), F.lit("\n\n"))), "|").alias("items"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name || '|b' AS leaves FROM nation")
def p48_leaves(t):
    return t("nation").select("n_nationkey", F.array_join(annotate.leaves(F.array(F.array(F.lit("a"), "n_name"), F.array(F.lit("b")))), "|").alias("leaves"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name AS last, 'first' AS first FROM nation")
def p49_picked(t):
    answer = lambda name, value: F.struct(F.lit(name).alias("from_name"), F.struct(F.array(value).alias("choices")).alias("value"))
    result = F.array(answer("status_a", F.lit("first")), answer("other", F.lit("no")), answer("status_b", F.col("n_name")))
    return t("nation").select("n_nationkey", F.get(annotate.picked(result, "status", "choices"), F.lit(0)).alias("last"), F.get(annotate.picked(result, "status", "choices", last=False), F.lit(0)).alias("first"))


@query("SELECT c_custkey, c_name || ': ' || c_mktsegment || chr(10) || ': all' AS text, replace(c_name, '#', '') || '>' || c_mktsegment || ',>all of it' AS roles FROM customer")
def p50_roles(t):
    role = lambda r, s: F.struct(r.alias("role"), s.alias("responsibility"))
    text = T.roles_text(F.array(role(F.col("c_name"), F.col("c_mktsegment")), role(F.lit(None).cast("string"), F.lit("all"))))
    parsed = T.roles_of(F.concat(F.replace("c_name", F.lit("#"), F.lit("")), F.lit(" : "), "c_mktsegment", F.lit("\n\nall of it")))
    return t("customer").select("c_custkey", text.alias("text"), F.array_join(F.transform(parsed, lambda r: F.concat(r["role"], F.lit(">"), r["responsibility"])), ",").alias("roles"))


# Filters. The invented prose holds none of the source's words, so some of its syllables are replaced by them.

SHALL = "replace(replace(replace(text, 'that', ' shall '), 'with', ' is required to '), 'und', ' must not ')"


def shall(text: str = "text"):
    return F.expr(SHALL.replace("text", text))


EDGED = "(?:^|[^\\p{{L}}\\p{{N}}_])(?:{0})(?:[^\\p{{L}}\\p{{N}}_]|$)"


@query(f"SELECT doc_id, regexp_matches(lower({SHALL}), '{'|'.join(O.PIPELINE_WORDS)}') AS obliges FROM documents")
def f1_pipeline_words(t):
    return t("documents").select("doc_id", O.holds_any(shall()).alias("obliges"))


SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


@query(f"""WITH d AS (SELECT doc_id, regexp_replace({SHALL}, '^{SPACE}+|{SPACE}+$', '', 'g') AS t FROM documents)
SELECT doc_id, length(t) >= 20 AND NOT regexp_matches(lower(t), '^(?:{'|'.join(O.RULE_NOISE)})(?:[^\\p{{L}}\\p{{N}}_]|$)') AND (regexp_matches(lower(t), '{EDGED.format('|'.join(O.RULE_PHRASES))}') OR list_has_any(regexp_split_to_array(lower(t), '{SPACE}+'), {list(O.RULE_WORDS)})) AS obliges FROM d""")
def f2_rule(t):
    return t("documents").select("doc_id", O.by_rule(shall()).alias("obliges"))


@query(f"SELECT doc_id, regexp_matches(lower({SHALL}), '{'|'.join(O.PARSER_WORDS)}') AS obliges FROM documents")
def f3_parser_words(t):
    return t("documents").select("doc_id", O.holds_any(shall(), O.PARSER_WORDS).alias("obliges"))


# One branch a phrase: a pattern that is a column would be compiled anew for every sentence.
P19 = " UNION ALL ".join(f"SELECT doc_id, text, '{k}' AS type FROM c WHERE regexp_matches(lower(text), '{EDGED.format(p)}')" for p, k in O.TYPED)


@query(f"""WITH s AS (SELECT doc_id, unnest(string_split({SHALL}, '.')[:-2]) AS raw FROM documents),
r AS (SELECT doc_id, regexp_replace(raw, '^{SPACE}+', '') || '.' AS text FROM s),
c AS MATERIALIZED (SELECT doc_id, text FROM r WHERE length(text) >= 15)
{P19}""")
def p19_source_patterns(t):
    return t("documents").select("doc_id", F.explode(O.typed(shall())).alias("x")).select("doc_id", "x.*")


@query(f"SELECT regexp_matches(lower({SHALL}), 'shall') AS kept, count(*) AS n, sum(length(text))::BIGINT AS size FROM documents GROUP BY 1")
def f5_kept_and_removed(t):
    kept, removed = O.kept_and_removed(t("documents").withColumn("s", shall()), F.lower("s").rlike("shall"))
    counts = lambda x, name: x.agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("size")).select(F.lit(name).alias("kept"), "n", "size").where("n > 0")
    return counts(kept, True).unionByName(counts(removed, False))


@query("SELECT item_id, length(text) >= 100 AS obliges FROM benchmark")
def f6_model_or_rule(t):
    rows = t("benchmark").select("item_id", "text")
    return O.by_model(rows, "text", lambda frame: (frame["text"].str.len() >= 100) * 0.5, 0.5).select("item_id", "obliges")


@query("SELECT doc_id FROM documents WHERE length(text) BETWEEN 50 AND 5000")
def f7_length_bounds(t):
    return t("documents").where(F.char_length("text").between(50, 5000)).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def f8_positive_status(t):
    return registered.labels(t).where(F.col("status").isin(evaluate.POSITIVE)).select(F.col("ordinal").alias("o_orderkey"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount >= 0.04")
def f9_least_score(t):
    return t("lineitem").where(F.col("l_discount") >= 0.04).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey FROM part WHERE starts_with(p_type, 'PROMO')")
def f10_prefix(t):
    return t("part").where(F.startswith("p_type", F.lit("PROMO"))).select("p_partkey")


@query("SELECT p_partkey, (p_brand || '_' || p_size || '.json') GLOB 'Brand#[12]?_*5.json' AS fits FROM part")
def f11_glob(t):
    return t("part").select("p_partkey", T.like_glob(F.concat_ws("_", "p_brand", F.concat(F.col("p_size").cast("string"), F.lit(".json"))), "Brand#[12]?_*5.json").alias("fits"))


@query("SELECT c_custkey, c_custkey % 3 = 0 AS leaf FROM customer")
def f12_leaf_ids(t):
    dotted = F.concat(F.lit("M1.2"), F.when(F.col("c_custkey") % 3 == 0, ".1").when(F.col("c_custkey") % 3 == 1, "").otherwise(".1.a"))
    return t("customer").select("c_custkey", T.id_depth(dotted).alias("leaf"))


@query("SELECT doc_id, " + ", ".join(f"len({WORDS.format('text')}) >= {n} AS words_{n}" for n in (5, 10, 20)) + " FROM documents")
def f13_least_words(t):
    return t("documents").select("doc_id", *(T.has_words(F.col("text"), n).alias(f"words_{n}") for n in (5, 10, 20)))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount * 10 IN (0, 1)")
def f14_certain_scores(t):
    return t("lineitem").where((F.col("l_discount") * 10).isin(0.0, 1.0)).select("l_orderkey", "l_linenumber")


@query("SELECT DISTINCT o_custkey AS doc, o_orderkey % 50 AS member FROM orders WHERE o_orderkey % 50 IN (SELECT n_nationkey FROM nation) AND (o_custkey, o_orderkey % 50) NOT IN (SELECT c_custkey, c_nationkey FROM customer)")
def f15_valid_ids(t):
    said = t("orders").select(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 50).alias("member"))
    positives = t("customer").select(F.col("c_custkey").alias("doc"), F.col("c_nationkey").cast("long").alias("member"))
    return synthesize.valid_negatives(said, "doc", "member", t("nation").select(F.col("n_nationkey").cast("long").alias("member")), positives).select("doc", "member")


@query("SELECT p_partkey, p_partkey % 5 IN (0, 1, 2) AS heading FROM part")
def f16_headings(t):
    k = F.col("p_partkey") % 5
    line = F.when(k == 0, F.concat(F.lit("4.2 "), "p_name")).when(k == 1, F.upper("p_name")).when(k == 2, F.concat(F.lit("## "), "p_name")).when(k == 3, F.concat(F.lower("p_name"), F.lit(" and more"))).otherwise(F.concat(F.lit("1. "), "p_name", F.lit(".")))
    return t("part").select("p_partkey", T.is_heading(line).alias("heading"))
