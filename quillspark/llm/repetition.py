"""Quality rules: word counts, and repetition found with a suffix array over each text's words.

Longest-common-prefix intervals give each position's longest repeated substring; the spans of those with
`min_repeat` words or more are united. A text is rejected where the base rule rejects it, where the united
spans cover more than `max_covered` of its words, or where one repeat is longer than `max_repeat` words.
Many texts share one suffix array per batch (their suffixes never compare equal); a batch holds at most
`WORDS` words or one text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._spark import task
from quillspark.llm.suffixes import covered, longest_repeats, suffix_array

WORDS = 300_000
RULES = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("covered_words", pa.int64()), ("longest_repeat", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))]
)
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long, spans array<struct<first: long, last: long>>"


def runs(mask: np.ndarray) -> list[dict]:
    edge = np.diff(np.r_[0, mask.astype(np.int8), 0])
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), strict=True)]


def _judge(texts: list[tuple], min_repeat: int, max_covered: float, max_repeat: int) -> list[tuple]:
    words = [w for _, _, _, ws in texts for w in ws]
    sizes = np.array([len(ws) for _, _, _, ws in texts], np.int64)
    stop = np.cumsum(sizes)
    ids = pd.factorize(np.array(words, dtype=object))[0] if words else np.empty(0, np.int64)
    length = longest_repeats(*suffix_array(ids, np.repeat(np.arange(len(texts)), sizes), np.repeat(stop, sizes)))
    windows, long = covered(length, 5), covered(length, min_repeat)
    out = []
    for (doc_id, text, raw, ws), a, b in zip(texts, stop - sizes, stop, strict=True):
        n = len(ws)
        blank = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
        symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        repeated = int(windows[a:b].sum())
        cover, longest = int(long[a:b].sum()), int(length[a:b].max(initial=0))
        failed = n < 10 or 100 * repeated > 20 * n
        kept = not failed and cover <= max_covered * n and longest <= max_repeat
        out.append((doc_id, n, len(text) - blank, symbols, len(lines) - len(set(lines)), repeated, failed, kept, cover, longest, runs(long[a:b])))
    return out


def rule_rows(batches, min_repeat: int, max_covered: float, max_repeat: int):
    """(doc_id, text) to RULES."""

    def made(texts):
        rows = _judge(texts, min_repeat, max_covered, max_repeat)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RULES, strict=True)], schema=RULES)

    texts, held = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").encode()
            words = raw.split()
            if texts and held + len(words) > WORDS:
                yield made(texts)
                texts, held = [], 0
            texts.append((doc_id, text or "", raw, words))
            held += len(words)
    if texts:
        yield made(texts)


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = 10, max_covered: float = 0.2, max_repeat: int = 100) -> DataFrame:
    """One row per document: the counts, base_failed, kept, and the spans (first and last word) of repeats.

    A null text has no word and is rejected, as is any of fewer than ten words. Null ids are returned as they
    are; repeated rows are judged each. An empty table gives no row. Other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(task("repetition:rule_rows", min_repeat, max_covered, max_repeat), SCHEMA)


def keep_rows(batches, at: int, min_repeat: int, max_covered: float, max_repeat: int):
    """Batches without the rows whose text, in column `at`, is rejected."""
    for batch in batches:
        texts, keep, held = [], [], 0
        for text in batch.column(at).to_pylist():
            raw = (text or "").encode()
            words = raw.split()
            if texts and held + len(words) > WORDS:
                keep += [r[7] for r in _judge(texts, min_repeat, max_covered, max_repeat)]
                texts, held = [], 0
            texts.append((None, text or "", raw, words))
            held += len(words)
        keep += [r[7] for r in _judge(texts, min_repeat, max_covered, max_repeat)]
        yield batch.filter(pa.array(keep, pa.bool_()))


def keep_good(docs: DataFrame, *, text_col: str = "text", min_repeat: int = 10, max_covered: float = 0.2, max_repeat: int = 100) -> DataFrame:
    """The documents that quality_rules keeps, with all their columns, in one pass without a join."""
    return docs.mapInArrow(task("repetition:keep_rows", docs.columns.index(text_col), min_repeat, max_covered, max_repeat), docs.schema)
