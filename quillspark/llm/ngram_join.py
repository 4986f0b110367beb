"""N-gram Jaccard join: exact set-similarity self-join of documents over word shingles.

Method: set-relation skipping (index level and answer level).

* Index level. A set's tokens are dealt over positions; the index has a list per (size class, position,
  content of the position). A set enters and reads only the block of its own content at each position and
  skips its smallest positions (`shingles.position_keys` says why no link is lost). A list therefore holds
  sets that agree on a whole position, about eight tokens at a similarity of 0.9, never all sets with one
  frequent token. Below 0.88 positions are small, so tokens of very many sets are left to a second index.
* Answer level. Lists give candidate clusters. In a cluster one set leads; every other set is kept as its
  small difference from the leader, sets are put in an order of similarity, and the answers of each set are
  derived from the computed answers of the one before it by the lists in which the two differ (`shingles._answer`).
  Clusters are cut into blocks of 1,024 sets; each pair of blocks is a unit of work.

Equal sets are one class from the start, so copies are never compared; the result carries their number.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._spark import broadcast_if_small, materialize, task
from quillspark.llm.components import connected_components

INDEX = "doc_id long, n_shingles long, fp1 long, fp2 long, keys array<long>"
TOKENS = "cluster long, fp1 long, fp2 long, min_id long, copies long, size long, blocks int, leads boolean, tokens array<long>"
ANSWERS = "fp1 long, fp2 long, low long, min_id long, links long"


def common_tokens(docs: DataFrame, k: int, least: int = 64, most: int = 1_000_000) -> np.ndarray:
    """Tokens in `least` or more sets, counted over all documents; `least` doubles until there are at most `most` (8 MB).

    The choice orders the index and costs time only: the join is exact whichever tokens are returned.
    """
    counts = docs.mapInArrow(task("shingles:repeated_tokens", k), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    counts = materialize(counts, "common")
    while counts.where(F.col("n") >= least).count() > most:
        least *= 2
    found = counts.where(F.col("n") >= least).select("token").toPandas()["token"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, spare: float = 0.25, block: int = 1024, hot: int = 500) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links.

    Two documents link when den * |intersection| >= num * |union| of their distinct k-word shingles (words
    ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; a text of fewer than k words is one shingle). component_id is the
    smallest id reachable by links, n_links the number of documents linked directly.

    Null or wordless texts have no shingle and no link. A row with a null id is returned alone, with a null
    component_id. Repeated rows are copies of each other. An empty table gives an empty one. Other columns of
    docs are ignored, whatever their names.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    common = common_tokens(source, k) if num < 0.88 * den else None
    index = materialize(source.mapInArrow(task("shingles:index_rows", k, num, den, spare, common), INDEX), "index")

    # Lists are combined in their tasks first: inside a task each set of a list meets the list's first one there, and only
    # those first ones are shuffled by the key, so that a list with very many sets isn't gathered in one task.
    held = index.where("keys is not null").select("keys", "doc_id")
    firsts = held.mapInArrow(task("shingles:first_of_key", False), "key long, first long, doc_id long").select("key", "doc_id")
    inside = held.mapInArrow(task("shingles:first_of_key", True), "key long, first long, doc_id long").select("first", "doc_id")
    least = F.min("doc_id").over(Window.partitionBy("key"))
    edges = firsts.withColumn("first", least).where("first < doc_id").select("first", "doc_id").unionByName(inside.distinct())
    edges = edges.select("first", "doc_id")
    clusters = connected_components(edges, "first", "doc_id")

    rep = F.min(F.when(F.col("keys").isNotNull(), F.col("doc_id")))
    classes = index.where("fp1 is not null").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("min_id"), rep.alias("rep"), F.count("*").alias("copies"))
    members = materialize(clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")).join(classes, "rep"), "members")
    sets = members.groupBy("cluster").agg(F.count("*").alias("sets"), F.min(F.struct("rep", "fp1", "fp2")).alias("lead")).where("sets > 1")
    sets = materialize(sets, "sets")  # so that the join with it can split a large cluster
    members = members.join(sets, "cluster").withColumn("leads", F.struct("rep", "fp1", "fp2") == F.col("lead")).withColumn("blocks", F.ceil(F.col("sets") / block).cast("int"))
    members = materialize(members.select(F.col("rep").alias("doc_id"), "cluster", "fp1", "fp2", "min_id", "copies", "blocks", "leads"), "members")

    texts = source.join(broadcast_if_small(members, members.count(), 200_000), "doc_id").select("text", "cluster", "fp1", "fp2", "min_id", "copies", "blocks", "leads")
    tokens = materialize(texts.mapInArrow(task("shingles:member_tokens", k), TOKENS), "tokens")

    # A leader goes to every block of its cluster, so that a large cluster's rows are spread.
    leaders = tokens.where("leads").groupBy("cluster", "blocks").agg(F.first("tokens").alias("leader"))
    leaders = leaders.select("cluster", "leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
    dealt = tokens.withColumn("own", F.pmod(F.xxhash64("fp2", "fp1"), F.col("blocks")).cast("int"))
    apart = (
        dealt.join(leaders, ["cluster", "own"])
        .withColumn("apart", F.concat(F.array_except("tokens", "leader"), F.array_except("leader", "tokens")))
        .select("cluster", "blocks", "own", "fp1", "fp2", "min_id", "copies", "size", "apart")
    )
    pairs = (
        apart.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cluster", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.col("own").alias("side"), "fp1", "fp2", "min_id", "copies", "size", "apart")
    )
    spread = pairs.repartition("cluster", "p", "q").sortWithinPartitions("cluster", "p", "q")
    answers = materialize(spread.mapInArrow(task("shingles:block_answers", num, den), ANSWERS), "answers")

    # Blocks of a cluster each saw a part of it: their classes meet again over the classes' smallest ids.
    met = connected_components(answers.where("low < min_id"), "low", "min_id").withColumnRenamed("node", "min_id").withColumnRenamed("component", "low")
    links = answers.groupBy("fp1", "fp2").agg(F.sum("links").alias("links"))
    solved = classes.join(links, ["fp1", "fp2"], "left").join(met, "min_id", "left")
    solved = materialize(solved.select("fp1", "fp2", "copies", F.coalesce("low", "min_id").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "solved")

    # Classes of very many copies (at most documents / hot of them) are looked up without dealing their documents out by class.
    large, own = solved.where(F.col("copies") >= hot).select("fp1", "fp2", F.struct("component_id", "n_links").alias("found")), index.select("doc_id", "n_shingles", "fp1", "fp2")
    looked = own.join(broadcast_if_small(large, large.count(), 100_000), ["fp1", "fp2"], "left")
    small = solved.where(F.col("copies") < hot).select("fp1", "fp2", F.struct("component_id", "n_links").alias("found"))
    rest = looked.where("found is null and fp1 is not null").drop("found").join(small, ["fp1", "fp2"])
    alone = looked.where("fp1 is null").withColumn("found", F.struct(F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))
    return looked.where("found is not null").unionByName(rest).unionByName(alone).select("doc_id", "n_shingles", "found.component_id", "found.n_links")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents whose component_id isn't their own doc_id: one document of each group stays.

    Of rows that repeat an id and a text, all but one go; rows with a null id stay.
    """
    found = jaccard_classes(docs, **options)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    repeated = kept.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    again = broadcast_if_small(repeated, repeated.count())
    return kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
