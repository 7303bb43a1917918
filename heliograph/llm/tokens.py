"""Token ids of whole texts by a public tokenizer that drops white space, encoded once per distinct word."""

from __future__ import annotations

import json
import os
import re
import sys
import types

import numpy as np

from .common import WordHasher

#: Words that a Python worker remembers; beyond that it starts afresh, which costs time and changes no result.
REMEMBERED_WORDS = 500_000
#: Words that go to the library as one string.
JOINED = 256
#: Lower-case Latin letters: no normal form changes them, and every pre-tokenizer of words keeps them together.
LETTERS = re.compile("[a-zß-öø-ÿ]+")
#: The word pattern and end mark of tokenizers whose words of LETTERS are one pre-token each.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


def worker_memory(key: tuple, make):
    """What make() gave in this Python worker before; workers serve many tasks, one after another."""
    store = sys.modules.setdefault("_heliograph_worker_memory", types.ModuleType("_heliograph_worker_memory")).__dict__.setdefault("kept", {})
    if key not in store:
        store[key] = make()
    return store[key]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class IdPool:
    """Ids of words by 64-bit hash: what a worker has encoded before."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes, and each word's place in the pool of ids
        self.at = self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.filled = 0

    def learn(self, hashes: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        """Sorted new hashes, their ids in a row, and how many each has."""
        if self.filled + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.filled], np.zeros(self.filled + 2 * len(flat) + 1024, np.uint32)])
        self.ids[self.filled : self.filled + len(flat)] = flat
        at = self.filled + np.cumsum(size) - size
        self.filled += len(flat)
        into = np.searchsorted(self.known, hashes)
        self.known, self.at, self.size = np.insert(self.known, into, hashes), np.insert(self.at, into, at), np.insert(self.size, into, size)

    def gather(self, hashes: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words with these hashes, in their order, and the len(hashes) + 1 places where words begin.

        encode(first) gives the ids in a row, and how many each has, of words not met before: first[i] is the place of
        one of them.
        """
        total = np.zeros(len(hashes) + 1, np.int64)
        if not len(hashes):
            return np.zeros(0, np.uint32), total
        distinct, first, word = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > REMEMBERED_WORDS:
            self.forget()
        place = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        new = self.known[place] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            self.learn(distinct[new], *encode(first[new]))
            place = np.searchsorted(self.known, distinct)
        size = self.size[place][word]
        np.cumsum(size, out=total[1:])
        return self.ids[np.repeat(self.at[place][word] - total[:-1], size) + np.arange(total[-1])], total


class WordEncoder:
    """ids of texts, as the tokenizer at path encodes them without special tokens.

    For tokenizers whose pre-tokenizer splits at white space and drops it: a text's ids are then its words' ids in
    a row. A full stop or comma after a-z is a word of its own to the pre-tokenizer, so it is one here. Distinct
    words are told apart by 64-bit hashes, and each goes to the library once.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pool = IdPool()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        # Words that differ in case only are one word to the hasher where the normalizer makes them one.
        lowers = {"type": "Lowercase"} in ((spec.get("normalizer") or {}).get("normalizers") or [spec.get("normalizer")])
        self.hasher = WordHasher(fold=lowers)
        self.plain, self.ends = self.of_letters(spec) if lowers else (None, None)

    @staticmethod
    def of_letters(spec: dict):
        """The same model (of a tokenizer that lower-cases) behind a split at spaces only, and which ids end a word; None where that isn't the same.

        For a lower-cased word of LETTERS normalizer and word pattern change nothing, so words in a row can go
        through the model as one string, and come apart at the word ends.
        """
        from tokenizers import Tokenizer

        model, before = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        if model.get("type") != "BPE" or model.get("end_of_word_suffix") != WORD_END or before[0].get("pattern") != {"Regex": WORD_PATTERN}:
            return None, None
        spec = spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *before[1:]]}}
        ends = np.zeros(1 + max(model["vocab"].values()), bool)
        ends[[i for piece, i in model["vocab"].items() if piece.endswith(WORD_END)]] = True
        return Tokenizer.from_str(json.dumps(spec)), ends

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids in a row, and how many each word has."""
        lower = [w.lower() for w in words]
        plain = np.array([self.plain is not None and LETTERS.fullmatch(w) is not None for w in lower], bool)
        at = np.flatnonzero(plain).tolist()
        joined = [" ".join([lower[i] for i in at[k : k + JOINED]]) for k in range(0, len(at), JOINED)]
        row = np.array([i for e in self.plain.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids] if joined else [], np.uint32)
        others = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in np.flatnonzero(~plain).tolist()], add_special_tokens=False)]
        size = np.zeros(len(words), np.int64)
        size[~plain] = list(map(len, others))
        if len(row):
            size[plain] = np.diff(np.flatnonzero(self.ends[row]), prepend=-1)
        of_plain = np.repeat(plain, size)
        ids = np.zeros(len(of_plain), np.uint32)
        ids[of_plain] = row
        ids[~of_plain] = [i for x in others for i in x]
        return ids, size

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the n + 1 places where texts begin and end."""
        start, end, sums = self.hasher(data, offsets)
        letter = np.zeros(256, bool)
        letter[[*range(65, 91), *range(97, 123)]] = True
        last = data[end - 1]
        apart = ((last == 0x2E) | (last == 0x2C)) & (end - start > 1)
        apart[apart] = letter[data[end[apart] - 2]]
        times = 1 + apart
        which = np.repeat(np.arange(len(start)), times)
        second = np.zeros(len(which), bool)
        second[np.cumsum(times)[apart] - 1] = True
        start, end = start[which], end[which] - (apart[which] & ~second)
        start = np.where(second, end - 1, start)
        hashes = self.hasher.hashes(sums, start, end)
        raw = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C)) if len(data) > 1 else np.zeros(0, np.int64)
        for w in np.unique(np.searchsorted(start, raw, "right") - 1):  # may hold a special token, which has one spelling
            if w >= 0:
                hashes[w] = np.uint64(hash(data[start[w] : end[w]].tobytes()) & (2**64 - 1))

        def encode(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            whole = data.tobytes()
            return self.encode_words([whole[a:b].decode("utf-8", "replace") for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)])

        ids, at = self.pool.gather(hashes, encode)
        return ids, at[np.searchsorted(start, offsets)]
