"""Token ids of whole texts, from a public tokenizer file, with a cache of word ids in each Python worker.

The vocabulary lower-cases, drops white space and never merges across it. A text of Latin-1 characters splits into
the letters, single digits and signs that the vocabulary's own splitting makes, so its ids are those of these words in
turn; of other texts the space-separated chunks go to the tokenizer. Texts that spell a special token are given to
the tokenizer as they are.
"""

from __future__ import annotations

import re

import numpy as np

_LETTERS, _DIGITS, _SPACES = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", r" \t\n\x0b\x0c\r\x85\xa0"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACES}{_LETTERS}{_DIGITS}]+")
#: Entries kept in each of a worker's two caches, and the longest chunk that is kept.
CACHE, LONGEST = 400_000, 48
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.words: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> list[bytes]:
        """Ids of each word, from one call: the tokenizer numbers the words of what it splits."""
        e = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids, word = np.array(e.ids, "<u4").tobytes(), np.array(e.word_ids)
        cuts = (4 * (np.flatnonzero(np.diff(word)) + 1)).tolist()
        if len(cuts) + 1 != len(words):
            return self._each(words)
        return [ids[a:b] for a, b in zip([0, *cuts], [*cuts, len(ids)])]

    def _encoded(self, split: list[list[str]], cache: tuple, learn) -> tuple[list[bytes], tuple]:
        """Ids of each list of pieces, and the cache for the next call.

        The cache has a young and an old half. What is used moves to the young one; when that is full it becomes the old
        one, so frequent pieces stay. Neither half keeps long pieces.
        """
        young, old = cache
        new = set().union(*split).difference(young)
        again = [w for w in new if w in old]
        fresh = list(new.difference(again))
        young.update((w, old[w]) for w in again)
        if fresh:
            young.update(zip(fresh, learn(fresh)))
        get = young.__getitem__
        out = [b"".join(map(get, ws)) for ws in split]
        for w in [w for w in fresh if len(w) > LONGEST]:
            del young[w]
        return out, (young, old) if len(young) <= CACHE // 2 else ({}, young)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out = [b""] * len(texts)
        plain, other = [], []
        for k, t in enumerate(texts):
            if "<|" in t:
                out[k] = self._each([t])[0]
            else:
                (plain if _latin(t) else other).append(k)
        coded, self.words = self._encoded([_WORDS.findall(texts[k].lower()) for k in plain], self.words, self._joined)
        for k, ids in zip(plain, coded):
            out[k] = ids
        coded, self.chunks = self._encoded([texts[k].split(" ") for k in other], self.chunks, self._each)
        for k, ids in zip(other, coded):
            out[k] = ids
        return out


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
