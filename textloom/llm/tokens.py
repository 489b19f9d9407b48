"""Token ids of whole texts, for tokenizers that drop white space.

Such a tokenizer looks at one run without white space at a time, so a text's
ids are those of its runs, one after the other. A task therefore encodes each
run it has not met before, and the rest is array work: look up, gather.
"""

from __future__ import annotations

import os

import numpy as np
from tokenizers import Tokenizer

from textloom.llm import texts

MEMO_BYTES = 48 << 20  # of a worker
_WORD_BYTES = 32  # of a remembered word, besides its ids

_LOADED: dict[tuple, WordTokenizer] = {}


class WordTokenizer:
    """Encodes the words of a run of texts; remembers up to ``MEMO_BYTES`` of words by a 128-bit hash."""

    def __init__(self, path: str, specials: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials  # their strings in a text are then ordinary text
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    @classmethod
    def load(cls, path: str, specials: bool = True) -> WordTokenizer:
        """The tokenizer of this worker."""
        if (path, specials) not in _LOADED:
            _LOADED[path, specials] = cls(path, specials)
        return _LOADED[path, specials]

    def forget(self) -> None:
        self.key = np.zeros(0, np.uint64)
        self.second = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.used = 0

    def _encode(self, words: list[str]) -> list[list[int]]:
        """Ids per word. Words of letters only are one piece each, so one call takes them all."""
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        out: list[list[int]] = [[]] * len(words)
        whole = self.tokenizer.encode(" ".join(words[i] for i in plain), add_special_tokens=False) if plain else None
        owner = np.array(whole.word_ids if whole else [], np.int64)
        if len(owner) and owner[-1] + 1 == len(plain):
            ids = whole.ids
            cuts = np.searchsorted(owner, np.arange(len(plain) + 1)).tolist()
            for i, a, b in zip(plain, cuts, cuts[1:], strict=False):
                out[i] = ids[a:b]
        else:  # some letter's lower case is more than a letter
            plain = []
        rest = sorted({*range(len(words))} - {*plain})
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _find(self, key: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Where words are in the memo, -1 if they are not."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (self.second[at] == second), at, -1)

    def _learn(self, key: np.ndarray, second: np.ndarray, ids: list[list[int]]) -> None:
        length = np.array([len(i) for i in ids], np.int64)
        flat = np.array([x for i in ids for x in i], np.uint32)
        at = np.searchsorted(self.key, key)
        self.begin = np.insert(self.begin, at, self.used + np.cumsum(length) - length)
        self.length = np.insert(self.length, at, length)
        self.key, self.second = np.insert(self.key, at, key), np.insert(self.second, at, second)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used // 2 + len(flat), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def encode(self, words: texts.Words, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every text followed by ``end``, and where each text begins; one more: where the last ends."""
        if not any(s in words.data.tobytes() for s in self.specials):  # specials are found before lower-casing
            words = texts.Words(words.rows, texts.LOWER[words.data], words.bounds, words.starts, words.ends, words.first)
        key, second = texts.word_hashes(words), texts.word_hashes(words, 1)
        distinct, example, which = np.unique(key, return_index=True, return_inverse=True)
        if (second[example][which] != second).any():  # two words of one hash
            return self._encode_apart(words, end)
        new = np.flatnonzero(self._find(distinct, second[example]) < 0)
        if len(new):
            raw = words.data.tobytes()
            spans = zip(words.starts[example[new]].tolist(), words.ends[example[new]].tolist(), strict=True)
            fresh = self._encode([raw[a:b].decode() for a, b in spans])
            size = _WORD_BYTES * (len(self.key) + len(new)) + 4 * (self.used + sum(map(len, fresh)))
            if size > MEMO_BYTES:
                if not len(self.key):
                    return self._encode_apart(words, end)
                self.forget()  # start again with the words of these texts
                return self.encode(words, end)
            self._learn(distinct[new], second[example[new]], fresh)
        at = self._find(distinct, second[example])[which]
        return self._laid_out(self.begin[at], self.length[at], self.ids[: self.used], words.first, end)

    def _encode_apart(self, words: texts.Words, end: int) -> tuple[np.ndarray, np.ndarray]:
        raw = words.data.tobytes()
        ids = self._encode([raw[a:b].decode() for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True)])
        length = np.array([len(i) for i in ids], np.int64)
        return self._laid_out(np.cumsum(length) - length, length, np.array([x for i in ids for x in i], np.uint32), words.first, end)

    @staticmethod
    def _laid_out(begin: np.ndarray, length: np.ndarray, ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        ids = np.append(ids, np.uint32(end))
        last = len(ids) - 1
        begin, length = np.insert(begin, first[1:], last), np.insert(length, first[1:], 1)
        before = np.concatenate(([0], np.cumsum(length)))
        return ids[texts.ranges(begin, length)], before[first + np.arange(len(first))]
