"""Token ids of texts by public tokenizers, with bounded tables of the strings a worker has seen.

A table keeps 128-bit digests of strings and their ids. Whether the parts of a text may be encoded by themselves is asked of
the tokenizer on probes when its file is read; with one for which that does not hold, whole texts are encoded.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import HELD, LOWER, SAME, Words

#: Strings a worker keeps with their ids (some 40 bytes each).
MOST_WORDS = 600_000
#: Ids a table holds; words without end would else fill it.
MOST_IDS = 8_000_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A word's last character, if one of these follows a letter, is a token run of its own in tokenizers that cut there.
TAIL = ".,"
#: Texts by which a tokenizer shows whether words can be encoded by themselves.
PROBES = ("Hello world", "  lead and trail \n", "a\tb\x0bc\x0cd\r\ne", "it's 12 345, (x) é Ünï co-op.", "one\n\n  two   three", "\u3000wide \u00a0 space", "A . b , c ' d", "<|endoftext|> x </s> <s> y")
LETTERS = re.compile(r"[a-z]+")
LETTER_PROBES = ("a", "hello", "zqxjkv", "antionhareble", "internationalisation", "thththththth")
_tokenizers: dict[str, "WordTokenizer"] = {}
HELD.append(_tokenizers.clear)


def digests_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """The halves of each text's 128-bit digest."""
    digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, texts)), ">u8").astype(np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(digests[:, 0]), np.ascontiguousarray(digests[:, 1])


class Seen:
    """A table of strings and their ids: `encode` gives the ids of new ones."""

    def __init__(self, encode=None):
        if encode is not None:
            self.encode = encode
        self.forget()

    def forget(self) -> None:
        """An empty table: 128-bit digests of words in order, each with the number of its entry; entries' ids, flat, with offsets."""
        self.high, self.low, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.offsets = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The entry of each digest, -1 if there is none."""
        if not len(self.high):
            return np.full(len(high), -1)
        at = np.minimum(np.searchsorted(self.high, high), len(self.high) - 1)
        return np.where((self.high[at] == high) & (self.low[at] == low), self.entry[at], -1)

    def learn(self, words: list[str], high: np.ndarray, low: np.ndarray) -> None:
        ids = self.encode(words)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        new = np.arange(len(words)) + len(self.entry)
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
        high, low, entry = (np.concatenate(x) for x in ((self.high, high), (self.low, low), (self.entry, new)))
        order = np.argsort(high)
        self.high, self.low, self.entry = high[order], low[order], entry[order]

    def table(self, words: pa.Array, digests: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[pa.ListArray, np.ndarray]:
        """The ids of each word (words are distinct), and how many."""
        texts = words.to_numpy(zero_copy_only=False)
        high, low = digests or digests_of(texts)
        found = self.find(high, low)
        if (missing := np.flatnonzero(found < 0)).size:
            if len(self.entry) + len(missing) > MOST_WORDS or len(self.flat) > MOST_IDS:
                self.forget()
                missing = np.arange(len(texts))
            self.learn(texts[missing].tolist(), high[missing], low[missing])
            found = self.find(high, low)
        every = pa.ListArray.from_arrays(pa.array(self.offsets.astype(np.int32)), pa.array(self.flat))
        return every.take(pa.array(found)), np.diff(self.offsets)[found]


class WordTokenizer(Seen):
    """Ids of words by a tokenizer file, with a table of those seen. What it may assume is asked of the tokenizer itself."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.forget()
        letters = "abcdefghijklmnopqrstuvwxyz"
        normal = self.inner.normalizer
        self.lowers = normal is not None and normal.normalize_str(letters.upper()) == letters
        cut = self.inner.pre_tokenizer
        self.tail = "".join(t for t in TAIL if cut is not None and all([x for x, _ in cut.pre_tokenize_str(f"a{c}{t}")] == [f"a{c}", t] for c in letters))
        self.added = sorted({str(t.content)[:2] for t in self.inner.get_added_tokens_decoder().values()})
        ids = lambda x: self.inner.encode(x, add_special_tokens=False).ids
        self.by_word = all(ids(x) == [i for w in WORD.findall(x) for i in ids(w)] for x in PROBES)
        model, own = self.inner.model, [str(t.content) for t in self.inner.get_added_tokens_decoder().values()]
        self.plain_letters = not any(map(LETTERS.fullmatch, own)) and all([t.id for t in model.tokenize(w)] == ids(w) for w in LETTER_PROBES)

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each word; a run of small letters is one piece to the tokenizer's model, which is asked directly."""
        ids: list[list[int] | None] = [None] * len(words)
        rest, model = [], self.inner.model
        for k, w in enumerate(words):
            if self.plain_letters and LETTERS.fullmatch(w):
                ids[k] = [t.id for t in model.tokenize(w)]
            else:
                rest.append(k)
        run = getattr(self.inner, "encode_batch_fast", self.inner.encode_batch)
        for at in range(0, len(rest), 10_000):
            part = rest[at : at + 10_000]
            for k, e in zip(part, run([words[k] for k in part], add_special_tokens=False)):
                ids[k] = e.ids
        return ids

    def batch_ids(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, each text's end id included, and their offsets."""
        if not self.by_word:
            ids = [[*e.ids, end_id] for e in self.inner.encode_batch(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum())), np.concatenate([[0], np.cumsum(sizes)])
        plain = self.lowers and not any(pc.any(pc.match_substring(texts, t)).as_py() for t in self.added)
        words = Words(texts, LOWER if plain else SAME)
        if plain and self.tail and len(words.dictionary):
            ends = pc.match_substring_regex(words.dictionary, f"[a-z][{re.escape(self.tail)}]$")
            stems = pc.if_else(ends, pc.utf8_slice_codeunits(words.dictionary, 0, -1), words.dictionary).dictionary_encode()
            table, sizes = self.table(stems.dictionary)
            stem = stems.indices.to_numpy()
            last = pc.index_in(pc.if_else(ends, pc.utf8_slice_codeunits(words.dictionary, -1), ""), value_set=pa.array(list(self.tail)))
            last = pc.fill_null(last, -1).to_numpy(zero_copy_only=False)
            tails = [np.array(x.as_py(), np.uint32) for x in self.table(pa.array(list(self.tail)))[0]]
            flat = table.take(stems.indices).flatten().to_numpy()
            sizes = sizes[stem]
            stops = np.cumsum(sizes)
            at, more = [], []
            for k, ids in enumerate(tails):
                where = np.flatnonzero(last == k)
                at.append(np.repeat(stops[where], len(ids)))
                more.append(np.tile(ids, len(where)))
                sizes[where] += len(ids)
            flat = np.insert(flat, np.concatenate(at), np.concatenate(more))
            table = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
        else:
            table, sizes = self.table(words.dictionary)
        flat = table.take(pa.array(words.ids)).flatten().to_numpy()
        before = np.concatenate([[0], np.cumsum(sizes[words.ids])]).astype(np.int64)
        stops = before[words.offsets[1:]]
        return np.insert(flat, stops, np.uint32(end_id)), np.concatenate([[0], stops + np.arange(1, len(stops) + 1)])


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]
