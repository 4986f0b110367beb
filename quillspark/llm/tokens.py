"""Byte-level BPE ids of whole texts by the tokenizers library, with a cache of words. Runs on the workers."""

from __future__ import annotations

import re
from array import array

import numpy as np

from quillspark.llm._spark import RELEASE

# A space or line feed that is the only white space between two other characters. (Python's white space holds all of Unicode's.)
BETWEEN = re.compile(r"(?<=\S)(?: (?=\S)|(?=\n\S))")
OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: printable Latin-1 bytes as themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Recent(dict):
    """A cache of make(key). When it holds `most` keys it becomes the older half, which is asked before anything is made anew."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(key) < 200:
            self[key] = value
        return value


class WordIds:
    """Ids of texts, by way of their words.

    Where a single space or line feed stands between two characters that are no white space, the tokenizer's
    own pattern starts a new piece there, so the ids of the parts are the ids of the whole. Words are led by a
    space that their key leaves out, or by a line feed that it holds. A word that is not in the cache is cut by the
    published pattern of byte-level BPE, and each piece goes to the library's model.
    """

    def __init__(self, path: str, most: int = 700_000):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = dict(enumerate(byte_letters()))
        self.code = "H" if self.tokenizer.get_vocab_size() < 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        # Fixed value: the pattern of this pre-tokenizer. Any other tokenizer encodes words as a whole, by its own rules.
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        plain = isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) and self.tokenizer.normalizer is None
        self.model = self.tokenizer.model
        self.piece = Recent(self.piece_ids, most // 2)
        self.word = Recent(self.word_ids if plain else self.whole_ids, most)

    def piece_ids(self, piece: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def word_ids(self, word: str) -> bytes:
        pieces = self.pieces(word if word[0] == "\n" else " " + word)
        return self.piece[pieces[0]] if len(pieces) == 1 else b"".join(map(self.piece.__getitem__, pieces))

    def whole_ids(self, word: str) -> bytes:
        return self.ids(word if word[0] == "\n" else " " + word)

    def ids(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text, as the library gives them with add_special_tokens=False: an added token's own text is that token."""
        if not text:
            return np.empty(0, self.dtype)
        if any(t in text for t in self.added):
            return np.frombuffer(self.ids(text), self.dtype)
        if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or OTHER_SPACE.search(text):
            first, *words = BETWEEN.split(text)
        else:
            first, *words = text.replace("\n", " \n").split(" ")
        return np.frombuffer(self.ids(first) + b"".join(map(self.word.__getitem__, words)), self.dtype)


_LOADED: dict[str, WordIds] = {}
RELEASE.append(_LOADED.clear)


def word_ids(path: str) -> WordIds:
    if path not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def encoded(batch, words: WordIds):
    """Rows of an Arrow batch, with the ids of the text in its last column in the text's place."""
    for first in range(0, batch.num_rows, 500):
        *others, texts = (c.to_pylist() for c in batch.slice(first, 500).columns)
        yield from zip(*others, map(words.encode, texts), strict=True)
