"""BM25 over an inverted index with block maxima: safe top-k without scoring every document that shares a word.

The corpus is tokenised once, into a written table of postings. Documents are dealt to shards; in a shard they are numbered by
group and key and cut into blocks of `BLOCK`. Of each term every block has its greatest weight, so the sum over a query's terms
bounds the score of any document in the block. Blocks are opened in rounds, those with the greatest bounds first; a block
whose bound can't beat the k-th score of its group so far is skipped. The result is the same as that of scoring everything.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import tokens
from quillspark.operators.meeting import batch, meet
from quillspark.sources.readers import spread
from quillspark.sources.sinks import materialize, small

# Workers get this module's class with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK, SHARD_ROWS, QUERY_BLOCK = 32, 32_768, 8_192

#: A shard's postings (its task takes a few hundred bytes for each), and how many found rows leave a task at once.
SHARD_POSTINGS, FOUND = 500_000, 100_000


def ranked(rows: DataFrame, by: list[str], score: str, tie: str, k: int | None = None, name: str = "rank") -> DataFrame:
    """1-based ranks by falling score, ties to the smaller key; the first k where k is given.

    Spark pushes rank <= k below the window (WindowGroupLimit), so no group is sorted whole on one task before the cut.
    """
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie)))
    return out.where(F.col(name) <= k) if k else out


def postings(corpus: DataFrame, doc: str, text: Column, group: list[str] | None = None) -> DataFrame:
    """The index, written down: (group, doc, dl, term, tf), and one row with a null term for every document (its length).

    Words are counted in each row, in Arrow batches: nothing is shuffled. Rows with a null key are left out; rows that repeat a key are
    added up when they are scored.
    """
    by = group or []
    texts = spread(corpus.where(F.col(doc).isNotNull()).select(*by, doc, text.alias("_text")))
    words = texts.select(*by, doc, tokens(F.coalesce("_text", F.lit(""))).alias("_w"))
    kinds = [f"`{c}` {words.schema[c].dataType.simpleString()}" for c in [*by, doc]]

    def count(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                lists = part.column(part.num_columns - 1)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                coded = lists.flatten().dictionary_encode()
                n = max(1, len(coded.dictionary))
                key, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                row = np.r_[np.arange(len(sizes)), key // n]
                terms = pa.concat_arrays([pa.nulls(len(sizes), coded.dictionary.type), coded.dictionary.take(pa.array(key % n))])
                own = [part.column(i).take(pa.array(row)) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes[row].astype(np.int32)), terms, pa.array(np.r_[np.zeros(len(sizes), np.int64), tf])], names=[*part.schema.names[:-1], "dl", "term", "tf"])

    return materialize(words.mapInArrow(count, ", ".join([*kinds, "dl int, term string, tf long"])), "postings")


def bm25_index(corpus: DataFrame, doc: str, text: Column, group: list[str] | None = None, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings (group, doc, dl, term, tf), term statistics (group, term, df) and group statistics (group, n, avgdl).

    The corpus is tokenised once; the postings are of the terms of `only` where that is given, the statistics of all.
    """
    by = group or []
    rows = postings(corpus, doc, text, group)
    found = rows.where("term is not null")
    terms = found.groupBy(*by, "term").agg(F.count("*").alias("df"))
    stats = rows.where("term is null").groupBy(*by).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return found if only is None else found.join(only.select("term").distinct(), "term", "left_semi"), terms, stats


def places(stats: DataFrame, idf: DataFrame, shard_rows: int) -> tuple[DataFrame, float]:
    """(_g, _before, _size) of each group on a line, written down, and the line's length: 1 is what a shard may hold.

    The numbers of the groups are counted up within the partitions that gave them, then the partitions' sums are.
    """
    held = idf.groupBy("_g").agg(F.sum("df").alias("_held"))
    size = F.col("n") / shard_rows + F.coalesce("_held", F.lit(0)) / SHARD_POSTINGS
    own = materialize(stats.join(held, "_g", "left").select("_g", F.shiftright("_g", 33).alias("_p"), size.alias("_size")), "sizes")
    earlier = lambda window: F.coalesce(F.sum("_size").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = own.groupBy("_p").agg(F.sum("_size").alias("_size")).select("_p", earlier(Window.orderBy("_p")).alias("_first"))
    line = own.withColumn("_in", earlier(Window.partitionBy("_p").orderBy("_g"))).join(F.broadcast(sums), "_p")
    return materialize(line.select("_g", (F.col("_first") + F.col("_in")).alias("_before"), "_size"), "places"), own.agg(F.sum("_size")).first()[0] or 0.0


def bm25(corpus: DataFrame, queries: DataFrame, *, doc: str, text: Column, query: str, query_text: Column, group: list[str] | None = None, k: int | None = 5, k1: float = 1.5, b: float = 0.75, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query, group, doc, score, rank) of positive scores, the first k per query and group (all, if k is None); scores have 6 places.

    idf = ln((N - df + 0.5) / (df + 0.5)), where negative replaced by a quarter of the group's mean idf. Query terms count as
    often as they occur. Groups lie end to end on a line, each as long as its counted documents and postings of the queries' terms;
    shards are equal stretches of it, so one holds at most about `shard_rows` documents and SHARD_POSTINGS postings, whatever the
    number of shards. Queries go to every shard, in blocks. Only what may be among the first k leaves a shard.
    """
    by = group or []
    found, terms, stats = bm25_index(corpus, doc, text, group)
    words = materialize(queries.select(query, tokens(F.coalesce(query_text, F.lit(""))).alias("_w")), "asked")
    asked = words.select(query, F.explode("_w").alias("term")).groupBy(query, "term").agg(F.count("*").alias("qf"))
    named = materialize(asked.select("term").distinct().withColumn("_t", F.monotonically_increasing_id()), "terms")
    stats = materialize(stats.withColumn("_g", F.monotonically_increasing_id()), "statistics")
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    # Statistics are one row, or one a group: a group's come by its key.
    told = materialize((terms.join(small(stats), by) if by else terms.crossJoin(F.broadcast(stats))).withColumn("_raw", raw), "frequencies")
    floor = told.groupBy("_g").agg((0.25 * F.avg("_raw")).alias("_floor"))
    idf = told.join(small(named), "term").join(floor, "_g").select(*by, "term", "_t", "_g", "n", "avgdl", "df", F.when(F.col("_raw") < 0, F.col("_floor")).otherwise(F.col("_raw")).alias("_idf"))
    idf = materialize(idf, "weights")
    weight = F.col("_idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))

    line, length = places(stats, idf, shard_rows)
    # A small corpus is dealt to all cores, too.
    totals = stats.agg(F.sum("n").alias("n")).first()["n"] or 0
    shards = max(1, math.ceil(length), min(corpus.sparkSession.sparkContext.defaultParallelism, totals // 512))
    parts = max(1, -(-words.count() // query_block))
    share = F.pmod(F.xxhash64(doc), F.lit(1 << 30)) / (1 << 30)
    shard = F.least(F.floor((F.col("_before") + share * F.col("_size")) * (shards / (length or 1))), F.lit(shards - 1)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = found.join(small(idf.join(small(line), "_g")), [*by, "term"]).select("_g", F.col(doc).alias("_doc"), "_t", weight.alias("_w"), shard.alias("_shard"))
    asks = asked.join(small(named), "term").select(F.col(query).alias("_query"), "_t", "qf", F.pmod(F.xxhash64(query), F.lit(parts)).cast("int").alias("_part"))
    kind = {c: t.schema[c].dataType.simpleString() for t, c in ((queries, query), (corpus, doc))}
    best = k or 1 << 40

    def search(rows: pa.Table, asks: pa.Table) -> Iterator[pa.RecordBatch]:
        numbers = {c: rows[c].to_numpy() for c in ("_g", "_t", "_w")}
        coded = rows["_doc"].combine_chunks().dictionary_encode()
        # Documents are numbered by their key, as ties go to the smaller one.
        ascending = pyarrow.compute.sort_indices(coded.dictionary)
        keys, order = coded.dictionary.take(ascending), np.empty(len(ascending), np.int64)
        order[ascending.to_numpy()] = np.arange(len(keys))
        index = Shard(numbers["_g"], order[coded.indices.to_numpy()], numbers["_t"], numbers["_w"])
        named = asks["_query"].combine_chunks().dictionary_encode(null_encoding="encode")
        code = named.indices.to_numpy()
        own = np.argsort(code, kind="stable")
        term, times, edges = asks["_t"].to_numpy()[own], asks["qf"].to_numpy()[own], np.searchsorted(code[own], np.arange(len(named.dictionary) + 1))
        found, n = [], 0
        for q in range(len(named.dictionary)):
            at, score = index.top(term[edges[q] : edges[q + 1]], times[edges[q] : edges[q + 1]], best)
            found.append((np.full(len(at), q), at, score))
            n += len(at)
            if n >= FOUND or q + 1 == len(named.dictionary):
                who, at, score = (np.concatenate(x) for x in zip(*found, strict=True))
                yield batch({"_query": named.dictionary.take(pa.array(who)), "_g": pa.array(index.group[at]), "_doc": keys.take(pa.array(index.doc[at])), "score": pa.array(score)})
                found, n = [], 0

    left = base.withColumn("_part", every(parts)) if parts > 1 else base.withColumn("_part", F.lit(0))
    right = asks.withColumn("_shard", every(shards)) if shards > 1 else asks.withColumn("_shard", F.lit(0))
    hits = meet(left, right, ["_shard", "_part"], search, f"_query {kind[query]}, _g long, _doc {kind[doc]}, score double")
    hits = hits.select(F.col("_query").alias(query), "_g", F.col("_doc").alias(doc), "score")
    if by:
        hits = hits.join(small(stats.select("_g", *by)), "_g")
    return ranked(hits.select(query, *by, doc, "score"), [query, *by], "score", doc, k)


class Shard:
    """The postings of a shard's documents: (group, doc, term, weight) rows, numbered, in blocks of one group each."""

    def __init__(self, groups: np.ndarray, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray, block: int = BLOCK):
        keys, doc = np.unique(docs, return_inverse=True)
        both, number = np.unique(np.unique(groups, return_inverse=True)[1] * len(keys) + doc, return_inverse=True)
        first = np.zeros(len(both), np.int64)
        first[number] = np.arange(len(docs))
        self.group, self.doc = groups[first], docs[first]
        new = np.r_[True, self.group[1:] != self.group[:-1]]
        begin = np.maximum.accumulate(np.where(new, np.arange(len(both)), 0))
        place = np.arange(len(both)) - begin
        self.block = np.cumsum(new | (place % block == 0)) - 1
        starts = np.flatnonzero(np.r_[True, self.block[1:] != self.block[:-1]])
        self.first = starts
        self.part = np.cumsum(new)[starts] - 1  # the group's number, of each block
        self.parts = int(new.sum())
        # Postings by term, then document; an entry is a term's postings in a block.
        order = np.lexsort((number, terms))
        self.number, self.weight = number[order], weights[order]
        term, at = terms[order], self.block[number[order]]
        edge = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (at[1:] != at[:-1])])
        self.start, self.stop = edge, np.r_[edge[1:], len(order)]
        self.entry_block = at[edge]
        # A document may lack the term: its weight there is none.
        self.most = np.maximum(np.maximum.reduceat(self.weight, edge), 0)
        own = term[edge]
        self.terms, low = np.unique(own, return_index=True)
        self.low, self.high = low, np.r_[low[1:], len(own)]
        self.scored = 0

    def entries(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of some terms, and which of the terms each is of."""
        at = np.searchsorted(self.terms, terms)
        at = np.minimum(at, len(self.terms) - 1)
        known = np.flatnonzero(self.terms[at] == terms)
        return spans(self.low[at[known]], self.high[at[known]], known)

    def top(self, terms: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(document numbers, scores): those with a positive score that are among the first k of their group, and perhaps some more."""
        entry, which = self.entries(terms)
        blocks = len(self.first)
        at = self.entry_block[entry]
        bound = rounded(np.bincount(at, weights=self.most[entry] * times[which], minlength=blocks) + 1e-9)
        # The place of each block among its group's, by falling bound: rounds open places 0, 1 to 3, 4 to 15 and so on.
        order = np.lexsort((np.arange(blocks), -bound, self.part))
        place = np.empty(blocks, np.int64)
        place[order] = np.arange(blocks) - np.maximum.accumulate(np.where(np.r_[True, np.diff(self.part[order]) != 0], np.arange(blocks), 0))
        open_ = bound > 0
        docs, scores = np.empty(0, np.int64), np.empty(0)
        low, high = 0, max(1, -(-k // BLOCK))
        while open_.any():
            now = open_ & (place >= low) & (place < high)
            if now.any():
                chosen = now[at]
                found, score = self.score(entry[chosen], times[which[chosen]])
                docs, scores = self.best(np.r_[docs, found], np.r_[scores, score], k)
                least, last = self.kth(docs, scores, k)
                # A block goes on only if its first document could come before its group's k-th.
                own = self.part
                open_ &= (bound > least[own]) | ((bound == least[own]) & (self.first < last[own]))
            open_ &= place >= high
            low, high = high, high * 4
        return docs, scores

    def score(self, entry: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, which = spans(self.start[entry], self.stop[entry], np.arange(len(entry)))
        docs, place = np.unique(self.number[at], return_inverse=True)
        self.scored += len(docs)
        score = rounded(np.bincount(place, weights=self.weight[at] * times[which], minlength=len(docs)))
        return docs[score > 0], score[score > 0]

    def best(self, docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first k of each group, by falling score, then number."""
        part = self.part[self.block[docs]]
        order = np.lexsort((docs, -scores, part))
        part = part[order]
        first = np.maximum.accumulate(np.where(np.r_[True, part[1:] != part[:-1]], np.arange(len(part)), 0)) if len(part) else part
        order = order[np.arange(len(part)) - first < k]
        return docs[order], scores[order]

    def kth(self, docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each group the k-th score and its document; nothing and the end where there are fewer."""
        least, last = np.zeros(self.parts), np.full(self.parts, -1)
        part = self.part[self.block[docs]]
        full = np.flatnonzero(np.bincount(part, minlength=self.parts) == k)
        end = np.searchsorted(part, full, "right") - 1  # best() leaves them by group, the k-th last
        least[full], last[full] = scores[end], docs[end]
        return least, last


def spans(start: np.ndarray, stop: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges [start, stop), one range after the other, and each one's label."""
    size = stop - start
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size), np.repeat(label, size)


def rounded(x: np.ndarray) -> np.ndarray:
    """Six places, halves up."""
    return np.floor(x * 1e6 + 0.5) / 1e6
