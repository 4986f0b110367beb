"""One query per operator, over whole tables, and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.sources.readers import spread


def _read(spark, sf_dir: str, table: str):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark, sf_dir):
    from quillspark.llm.ngram_join import jaccard_classes

    return jaccard_classes(spread(_read(spark, sf_dir, "documents").select("doc_id", "text")), k=3, num=90)


OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN []::VARCHAR[] WHEN len(a) < 3 THEN [array_to_string(a, ' ')] ELSE list_transform(generate_series(1, len(a) - 2), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, coalesce(k.n_links, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a) k USING (doc_id)
"""


def op2_sentencepiece(spark, sf_dir):
    from quillspark.llm.sentencepiece_bpe import decode, encode

    coded = decode(encode(spread(_read(spark, sf_dir, "documents").select("doc_id", "text"))))
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("lossless"))


def op3_url_filter(spark, sf_dir):
    from quillspark.llm.url_filter import judge

    return judge(_read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP3 = r"""
WITH p AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), r(h, p, rule, verdict) AS (
  VALUES ('com', '/', 'com/', 'allow'), ('example.com', '/en/', 'example.com/en/', 'block'), ('www.example.com', '/en/', 'www.example.com/en/', 'allow'), ('net', '/es/', 'net/es/', 'block'), ('net', '/fr/', 'net/fr/', 'block')
), b(h) AS (
  VALUES ('ads-track.example.com'), ('adult-x.example.com'), ('casino-win.example.net'), ('cheap-pills.example.net'), ('free-bets.example.net'), ('spam-farm.example.org')
), m AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, m.rule,
  coalesce(m.verdict, CASE WHEN EXISTS (SELECT 1 FROM b WHERE p.host = b.h OR ends_with(p.host, '.' || b.h)) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m USING (page_id)
"""


def op4_nearest_neighbours(spark, sf_dir):
    from quillspark.llm.ann_forest import nearest

    return nearest(_read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op5_packing(spark, sf_dir):
    from quillspark.llm.packing import pack

    return pack(spread(_read(spark, sf_dir, "documents").select("doc_id", "text"))).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op6_html_extraction(spark, sf_dir):
    from quillspark.llm.html_text import extract

    return extract(spread(_read(spark, sf_dir, "pages"))).withColumn("n_chars", F.char_length("text").cast("long"))


def op7_chat_formatting(spark, sf_dir):
    from quillspark.llm.chat import format_messages

    return format_messages(_read(spark, sf_dir, "conversations"))


# The tables hold no tool calls: there the result is each message as canonical JSON.
OP7 = r"""
SELECT conv_id, turn, role, 0::BIGINT AS n_calls, 0::BIGINT AS n_faults,
  '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' AS message_json
FROM conversations
"""


def chat_linked_calls(spark, sf_dir):
    """The linking of op7 on messages that hold calls: every message becomes a call that refers to the one before it, and a result."""
    from quillspark.llm.chat import link_calls

    turn = F.col("turn").cast("string")
    call = F.concat(F.lit('so <tool_call>{"name":"search", "id":"t'), turn, F.lit('","arguments":{"query":"$t'), (F.col("turn") - 1).cast("string"), F.lit('","limit":'), turn, F.lit("}}</tool_call>"))
    result = F.concat(F.lit('<tool_result>{"content":'), F.char_length(F.coalesce("text", F.lit(""))).cast("string"), F.lit(',"id":"t'), turn, F.lit('"}</tool_result>'))
    rows = _read(spark, sf_dir, "conversations").where("turn is not null").dropDuplicates(["conv_id", "turn"])
    asked = rows.select("conv_id", (2 * F.col("turn")).cast("long").alias("turn"), F.lit("assistant").alias("role"), call.alias("text"))
    told = rows.select("conv_id", (2 * F.col("turn") + 1).cast("long"), F.lit("tool"), result)
    return link_calls(asked.union(told)).select("conv_id", "turn", F.col("depth").cast("long").alias("depth"), F.size("faults").cast("long").alias("n_faults"), "call_json")


LINKED = r"""
WITH c AS (SELECT conv_id, turn, any_value(length(coalesce(text, ''))) AS n FROM conversations WHERE turn IS NOT NULL GROUP BY 1, 2),
i AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM c)
SELECT conv_id, (2 * turn)::BIGINT AS turn, (turn - min(turn) OVER (PARTITION BY conv_id, island))::BIGINT AS depth, 0::BIGINT AS n_faults,
  '{"arguments":{"limit":' || turn || ',"query":"$t' || turn - 1 || '"},"id":"t' || turn || '","name":"search","result":' || n || '}' AS call_json
FROM i
"""


def op8_quality_rules(spark, sf_dir):
    from quillspark.llm.repetition import quality_rules

    return quality_rules(spread(_read(spark, sf_dir, "documents").select("doc_id", "text"))).drop("spans", "longest_repeat")


# A repeat of ten words or more is a repeated ten-word window; one of more than a hundred is a repeated 101-word window.
OP8 = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents
), k AS (
  SELECT doc_id, n, i, array_to_string(a[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, a, n, unnest(generate_series(1, len(a) - n + 1)) AS i FROM w CROSS JOIN (VALUES (5), (10), (101)) v(n))
), f AS (SELECT doc_id, n, i FROM k QUALIFY count(*) OVER (PARTITION BY doc_id, n, g) > 1),
c AS (
  SELECT doc_id, count(DISTINCT p) FILTER (n = 5) AS r5, count(DISTINCT p) FILTER (n = 10) AS r10
  FROM (SELECT doc_id, n, unnest(generate_series(i, i + n - 1)) AS p FROM f WHERE n < 101) GROUP BY doc_id
), l AS (SELECT DISTINCT doc_id FROM f WHERE n = 101),
d AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), x AS (
  SELECT doc_id, len(a)::BIGINT AS n_words, length(array_to_string(a, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
    coalesce(r5, 0)::BIGINT AS n_repeat_words, coalesce(r10, 0)::BIGINT AS covered_words, l.doc_id IS NOT NULL AS very_long
  FROM w LEFT JOIN c USING (doc_id) LEFT JOIN d USING (doc_id) LEFT JOIN l USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND covered_words <= 0.2 * n_words AND NOT very_long AS kept
FROM x
"""


def op9_secret_scan(spark, sf_dir):
    from quillspark.llm.secrets import KINDS, scan, written

    found = scan(spread(_read(spark, sf_dir, "documents").select("doc_id", "text")))
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    counts = {f"n_{name}": of(i) for i, name in enumerate(KINDS)}
    return found.select("doc_id", *(c.alias(n) for n, c in counts.items()), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"))


def op10_token_store(spark, sf_dir):
    from quillspark.llm.token_store import round_trip

    return round_trip(_read(spark, sf_dir, "documents")).select("doc_id", "start", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op11_merkle_manifest(spark, sf_dir):
    from quillspark.llm.manifest import prove

    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower).otherwise(F.col("text"))
    found = prove(_read(spark, sf_dir, "documents"), forged={"text": tampered})
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


# crc32 by the usual table of 256 values, from its rule; the trees level by level; a row's fold and proof from its leaf up.
OP11 = r"""
WITH RECURSIVE c(i, k, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM c WHERE k < 8
), t AS (SELECT list(v ORDER BY i) AS t FROM c WHERE k = 8),
s AS (
  SELECT doc_id, lang, text, xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(a >> 8, t.t[(xor(a, x) & 255) + 1])), 4294967295) % 3 = 0 AS bad,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM documents CROSS JOIN t
), l AS (
  SELECT doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || CASE WHEN bad THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS forged,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n
  FROM s
), a(g, lvl, p, d, n) AS (
  SELECT g::BIGINT, 0::BIGINT, p::BIGINT, leaf, n::BIGINT FROM l
  UNION ALL SELECT g, any_value(lvl) + 1, p // 8, sha256(string_agg(d, '' ORDER BY p)), any_value((n + 7) // 8) FROM a WHERE n > 1 GROUP BY g, p // 8
), b(lvl, p, d, n) AS (
  SELECT 0::BIGINT, g - 1, d, count(*) OVER () FROM a WHERE n = 1
  UNION ALL SELECT any_value(lvl) + 1, p // 8, sha256(string_agg(d, '' ORDER BY p)), any_value((n + 7) // 8) FROM b WHERE n > 1 GROUP BY p // 8
), ar AS (SELECT g, lvl, p // 8 AS r, list(d ORDER BY p) AS ds FROM a WHERE n > 1 GROUP BY ALL),
br AS (SELECT lvl, p // 8 AS r, list(d ORDER BY p) AS ds FROM b WHERE n > 1 GROUP BY ALL),
x(doc_id, leaf, g, lvl, p, proof, f) AS (
  SELECT doc_id, leaf, g::BIGINT, 0::BIGINT, p::BIGINT, '', forged FROM l
  UNION ALL SELECT doc_id, leaf, x.g, x.lvl + 1, p // 8, proof || array_to_string(ds[1 : p % 8], '') || array_to_string(ds[p % 8 + 2 :], ''),
    sha256(array_to_string(ds[1 : p % 8], '') || f || array_to_string(ds[p % 8 + 2 :], ''))
  FROM x JOIN ar ON ar.g = x.g AND ar.lvl = x.lvl AND ar.r = p // 8
), y(doc_id, leaf, g, lvl, p, proof, f) AS (
  SELECT doc_id, leaf, x.g, 0::BIGINT, x.g - 1, proof, f FROM x JOIN a ON a.g = x.g AND a.lvl = x.lvl AND a.n = 1
  UNION ALL SELECT doc_id, leaf, g, y.lvl + 1, p // 8, proof || array_to_string(ds[1 : p % 8], '') || array_to_string(ds[p % 8 + 2 :], ''),
    sha256(array_to_string(ds[1 : p % 8], '') || f || array_to_string(ds[p % 8 + 2 :], ''))
  FROM y JOIN br ON br.lvl = y.lvl AND br.r = p // 8
)
SELECT y.doc_id, y.leaf, a.d AS subroot, b.d AS root, sha256(y.proof) AS proof_sha256, y.f AS folded_root, y.f = b.d AS verified
FROM y JOIN b ON b.lvl = y.lvl AND b.n = 1 JOIN a ON a.g = y.g AND a.n = 1
"""


def op12_periodic_runs(spark, sf_dir):
    from quillspark.llm.periodic import find_runs
    from quillspark.llm.secrets import let

    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def planted(words):
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return let(F.struct(a.cast("int").alias("a"), p.cast("int").alias("p")), lambda v: F.array_join(F.transform(words, lambda w, i: F.when(i < v["a"], w).otherwise(F.get(words, v["a"] + (i - v["a"]) % v["p"]))), " "))

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, planted(w)))).otherwise(F.col("text"))
    found = find_runs(spread(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", text.alias("text")))
    longer = lambda m, r: r["length"] * m["period"] > m["length"] * r["period"]
    best = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda m, r: F.when(m.isNull() | longer(m, r), r).otherwise(m))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    told = found.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return told.select("doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_license_scan(spark, sf_dir):
    from quillspark.llm.licenses import scan

    found = scan(spread(_read(spark, sf_dir, "documents").select("doc_id", "text")))
    base, own = F.transform("places", lambda p: p["label"]), F.transform("matches", lambda m: m["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    at = F.transform("places", lambda p: p["word"])
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)))
    return found.select(F.col("id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"), score.alias("score"))


def op13_sql() -> str:
    """Every block is held against every template. The templates' words come from the operator's own list."""
    from quillspark.llm.licenses import LINE, PHRASES, SHARE, TEMPLATES, WINDOW, need, words_of

    rows = []
    for i, (label, text) in enumerate(TEMPLATES):
        own = [w.decode() for w in words_of(text)]
        rows.append(f"({i}, '{label}', {sorted(set(own))}, {len(set(own))}, {need(len(set(own)), SHARE)}, {len(own) > LINE // 2})")
    phrases = ", ".join(f"({phrase.split()}, {len(phrase.split())}, '{label}')" for phrase, label in PHRASES)
    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), a AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a FROM w),
v(id, label, words, size, need, long) AS (VALUES {", ".join(rows)}),
i AS (SELECT r, unnest(generate_series(0, len(a) - 1)) AS i, a FROM a),
p AS (SELECT r, i, f.label FROM i JOIN (VALUES {phrases}) f(words, n, label) ON a[i + 1 : i + n] = f.words),
n AS (SELECT r, unnest(list_transform(string_split(t, chr(10)), lambda x: regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))) AS a FROM a),
s AS (
  SELECT r, a, false AS long, {LINE} AS width FROM n WHERE len(a) > 0 UNION ALL SELECT r, a, true, {WINDOW} FROM a WHERE len(a) > 0
), b AS (
  SELECT r, long, row_number() OVER () AS b, list_distinct(a[k * (width // 2) + 1 : k * (width // 2) + width]) AS ws
  FROM (SELECT *, unnest(generate_series(0, greatest(1, ceil(len(a) / (width // 2))::BIGINT - 1) - 1)) AS k FROM s)
), m AS (
  SELECT b.r, b.b, v.id, v.label, v.size, v.words, len(list_intersect(ws, v.words)) / v.size::DOUBLE AS c
  FROM b JOIN v ON b.long = v.long AND len(list_intersect(ws, v.words)) >= v.need
), k AS (
  SELECT r, label, c FROM m WHERE NOT EXISTS (
    SELECT 1 FROM m o WHERE o.b = m.b AND o.id <> m.id AND 2 * len(list_intersect(o.words, m.words)) >= least(o.size, m.size) AND (o.c > m.c OR o.c = m.c AND (o.size > m.size OR o.size = m.size AND o.id < m.id)))
), pb AS (SELECT r, count(*) AS n, min(i) AS first, max(i) AS last, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM p GROUP BY r),
every AS (SELECT r, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM (SELECT r, label FROM p UNION ALL SELECT r, label FROM k) GROUP BY r),
best AS (SELECT r, max(c) AS c FROM k GROUP BY r)
SELECT doc_id, len(a)::BIGINT AS n_words, coalesce(pb.n, 0)::BIGINT AS n_base, pb.first::BIGINT AS first_word, pb.last::BIGINT AS last_word,
  coalesce(pb.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, CASE WHEN pb.n > 0 THEN 1.0 ELSE coalesce(best.c, 0) END::DOUBLE AS score
FROM a LEFT JOIN pb USING (r) LEFT JOIN every USING (r) LEFT JOIN best USING (r)
"""


def queries() -> dict:
    listed = (chat_linked_calls, op1_ngram_jaccard_join, op2_sentencepiece, op3_url_filter, op4_nearest_neighbours, op5_packing, op6_html_extraction, op7_chat_formatting, op8_quality_rules, op9_secret_scan, op10_token_store, op11_merkle_manifest, op12_periodic_runs, op13_license_scan)
    return {f.__name__: f for f in listed}


def oracle_sql() -> dict[str, str]:
    return {"chat_linked_calls": LINKED, "op1_ngram_jaccard_join": OP1, "op3_url_filter": OP3, "op7_chat_formatting": OP7, "op8_quality_rules": OP8, "op11_merkle_manifest": OP11, "op13_license_scan": op13_sql()}
