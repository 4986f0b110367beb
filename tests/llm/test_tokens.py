import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillspark.llm import packing, sentencepiece_bpe, token_store
from quillspark.llm.tokens import WordIds, default_tokenizer

ODD = ["", "a\nb", "a\n\nb", "a.\nB c\n", "\na b", "a\u2003 b\xa0\nc\nd", " ", "a", "a b", " a  b ", "a \n b c", "don't  stop\t now", "x\x1c y 　 z", "<|endoftext|> é 漢字 😀😀 a​ b", "a !b ?c 12 3'll 's", "\n\n a", "a" * 5000, "é ▁ ▁a", "  ▁", "tail ", "\x00 z"]


def documents():
    rng = random.Random(4)
    pieces = ODD + ["the", " of", "word,", "\n", "  ", "überall", "'s", "1234", "…"]
    return ODD + ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(300)]


def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_the_text_of_an_added_token_is_that_token():
    assert WordIds(default_tokenizer()).encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]


def test_word_ids_equal_the_library():
    t, words = library(), WordIds(default_tokenizer())
    for text in documents():
        assert words.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_sentencepiece_without_dropout_equals_the_library_and_all_decode():
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    plain = sentencepiece_bpe.Encoder(sentencepiece_bpe.default_model(), 1, 0.0, 4)
    dropped = sentencepiece_bpe.Encoder(sentencepiece_bpe.default_model(), 1, 0.3, 4)
    differ = 0
    for i, text in enumerate(documents()):
        ids = plain.encode(text, i).tolist()
        if "▁" not in text and "\x00" not in text:
            assert ids == model.encode(text), repr(text)
        other = dropped.encode(text, i).tolist()
        differ += other != ids
        assert plain.vocabulary.decode(ids) == plain.vocabulary.decode(other) == text
        assert other == sentencepiece_bpe.Encoder(sentencepiece_bpe.default_model(), 1, 0.3, 4).encode(text, i).tolist() if i % 60 == 0 else True
    assert differ > 100


def frame(spark, texts):
    rows = [(7 * i % 1000 - 300, t) for i, t in enumerate(texts)] + [(3, None), (None, "null id"), (3, "again"), (3, "again")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "'x' as start", "2 as shard").repartition(3), rows


def test_encode_decode_frame(spark):
    docs, rows = frame(spark, documents())
    got = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs)).collect()
    assert len(got) == len(rows) and all((r.text or "") == r.decoded for r in got)


def test_a_word_has_more_than_two_segmentations(spark):
    word = "internationalization"
    docs = spark.range(200).selectExpr("id as doc_id", f"'{word}' as text")
    assert len({tuple(r.ids) for r in sentencepiece_bpe.encode(docs, dropout=0.3).collect()}) > 2


@pytest.mark.parametrize("shards", [1, 4])
def test_token_store_round_trip(spark, shards):
    docs, rows = frame(spark, documents())
    t = library()
    got = [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in token_store.round_trip(docs, shards=shards).collect()]
    want, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = (t.encode(text, add_special_tokens=False).ids if text else []) + [0]
        want.append((doc_id, at, ids))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_table_lookup(tmp_path):
    path = tmp_path / "t.sst"
    with path.open("wb") as out:
        writer = token_store.Writer(out, 2)
        keys = sorted([*range(-5000, 5000, 3), 4, 4])
        for k in keys:
            writer.add(token_store.key_of(k), np.arange(k % 50, dtype="<u2").tobytes())
        with pytest.raises(ValueError):
            writer.add(token_store.key_of(-9999), b"")
        writer.close()
    files, name = token_store.opened(str(path))
    table = token_store.Table(files, name)
    assert len(table.where) > 1 and [k for k, _ in table] == keys
    assert table.get(5000) == [] and table.get(0) == [] and len(table.get(4)) == 3 and table.get(-5000)[0].tolist() == list(range(0))
    assert table.get(-4997)[0].tolist() == list(range(-4997 % 50))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_store.round_trip(empty).count() == packing.pack(empty).count() == sentencepiece_bpe.decode(sentencepiece_bpe.encode(empty)).count() == 0


def test_packing(spark):
    docs, rows = frame(spark, documents())
    t, window = library(), 256
    pieces = packing.pack(docs, window=window).collect()
    sequences, documents_ = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length > 0
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        documents_.setdefault(p.doc_id, []).append((p.start, p.doc_tokens, ids.tolist()))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0
    for doc_id, text in rows:
        if doc_id != 3:
            ids = (t.encode(text, add_special_tokens=False).ids if text else []) + [1]
            assert [x for _, _, part in sorted(documents_[doc_id]) for x in part] == ids
            assert {n for _, n, _ in documents_[doc_id]} == {len(ids)}


def test_sum_of_squares_places_at_the_best_level():
    rng = random.Random(1)
    packer = packing.SumOfSquares(32)
    for i in range(2000):
        size = rng.randint(1, 31)
        n = packer.count.copy()
        best = []
        for h in [0, *np.flatnonzero(n)]:
            if h + size <= 32:
                after = n.copy()
                after[h] -= h > 0
                after[h + size] += h + size < 32
                best.append((int((after**2).sum()), -int(h)))
        assert packer.level(size) == -min(best)[1]
        packer.add((i, 0, size, np.zeros(size, "<u4")))


def test_both_agendas_agree(monkeypatch):
    words = sentencepiece_bpe.vocabulary(sentencepiece_bpe.default_model())
    rng = random.Random(6)
    units = ["".join(rng.choice(" theandinger.,é漢😀▁\n") for _ in range(rng.randrange(2, 33))) for _ in range(300)]
    short = [words.segment(u, 3, 1, p) for u in units for p in (0.0, 0.2)]
    monkeypatch.setattr(words, "segment_short", None)
    long = []
    for u in units:
        for p in (0.0, 0.2):
            key = sentencepiece_bpe.xxhash.xxh64_intdigest(f"3:1:{u}") if p else 0
            long.append(words.segment_long(u, key, int(p * (1 << 32))))
    assert short == long
