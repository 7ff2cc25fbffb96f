"""BPE encoding and decoding with the vocabulary file of a public tokenizer (operator 1).

Words are merged with a segment tree over the ranks of adjacent pairs: its root names the leftmost
pair of lowest rank, and a merge updates three leaves in logarithmic time.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, solid

#: White space as the tokenizer's normaliser sees it.
UNICODE_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
CACHED_CHUNKS = 400_000
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Words of more bytes are merged one by one.
FOREST_WIDTH = 32
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(256 + rest.index(b)) for b in range(256)]


class PairTree:
    """Minimum over leaves of rank * leaves + place, so that equal ranks give the leftmost place."""

    def __init__(self, ranks: list[int | None]) -> None:
        self.width = 1
        while self.width < len(ranks):
            self.width *= 2
        self.none = 1 << 62
        leaves = [self.none if r is None else r * self.width + i for i, r in enumerate(ranks)]
        self.node = [self.none] * self.width + leaves + [self.none] * (self.width - len(leaves))
        for i in range(self.width - 1, 0, -1):
            self.node[i] = min(self.node[2 * i], self.node[2 * i + 1])

    def set(self, place: int, rank: int | None) -> None:
        node, i = self.node, place + self.width
        node[i] = self.none if rank is None else rank * self.width + place
        i >>= 1
        while i:
            least = node[2 * i] if node[2 * i] < node[2 * i + 1] else node[2 * i + 1]
            if node[i] == least:
                break
            node[i] = least
            i >>= 1

    def lowest(self) -> int | None:
        return None if self.node[1] == self.none else self.node[1] % self.width


class PairForest:
    """PairTrees of many words of the same width, merged side by side: one row a word."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, ranks: np.ndarray) -> None:
        n, self.width = ids.shape
        self.ids, self.sizes, place = ids, sizes, np.arange(self.width)
        self.after = np.tile(place + 1, (n, 1))
        self.before = np.tile(place - 1, (n, 1))
        self.alive = place[None, :] < sizes[:, None]
        self.none = np.int64(1) << 40
        self.node = np.full((n, 2 * self.width), self.none, dtype=np.int64)
        self.node[:, self.width : 2 * self.width - 1] = self._leaf(ranks, place[:-1])
        half = self.width // 2
        while half:
            self.node[:, half : 2 * half] = np.minimum(self.node[:, 2 * half : 4 * half : 2], self.node[:, 2 * half + 1 : 4 * half : 2])
            half //= 2

    def _leaf(self, ranks: np.ndarray, places: np.ndarray) -> np.ndarray:
        return np.where(ranks < 0, self.none, ranks.astype(np.int64) * self.width + places)

    def _raise(self, rows: np.ndarray, places: np.ndarray) -> None:
        node = (places + self.width) >> 1
        while node[0]:  # all leaves are equally deep
            self.node[rows, node] = np.minimum(self.node[rows, 2 * node], self.node[rows, 2 * node + 1])
            node = node >> 1

    def run(self, rank_of, merged: np.ndarray) -> None:
        rows = np.arange(len(self.ids))
        while True:
            root = self.node[rows, 1]
            rows, root = rows[root < self.none], root[root < self.none]
            if not len(rows):
                return
            i = root % self.width
            j = self.after[rows, i]
            k, h = self.after[rows, j], self.before[rows, i]
            self.ids[rows, i] = merged[root // self.width]
            self.alive[rows, j] = False
            self.after[rows, i] = k
            self.node[rows, j + self.width] = self.none
            self.node[rows, i + self.width] = self.none
            more = k < self.sizes[rows]
            if more.any():
                r, at, to = rows[more], i[more], k[more]
                self.before[r, to] = at
                self.node[r, at + self.width] = self._leaf(rank_of(self.ids[r, at], self.ids[r, to]), at)
            left = h >= 0
            if left.any():
                r, at, to = rows[left], h[left], i[left]
                self.node[r, at + self.width] = self._leaf(rank_of(self.ids[r, at], self.ids[r, to]), at)
                self._raise(r, at)
            self._raise(rows, j)
            self._raise(rows, i)
            if left.any():
                self._raise(rows[left], h[left])


class WordBpe:
    """A byte-level BPE vocabulary with word ends, read from a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        pairs = np.array(list(self.merges), dtype=np.int64).reshape(-1, 2)
        order = np.argsort(pairs[:, 0] << 32 | pairs[:, 1])
        self.pairs, self.pair_ranks = (pairs[:, 0] << 32 | pairs[:, 1])[order], np.array([r for r, _ in self.merges.values()], dtype=np.int64)[order]
        self.merged = np.zeros(len(model["merges"]), dtype=np.int64)
        for rank, made in self.merges.values():
            self.merged[rank] = made
        end = model["end_of_word_suffix"] or ""
        symbols = _byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + end] for s in symbols]
        self.inner_ids, self.last_ids = np.array(self.inner, dtype=np.int64), np.array(self.last, dtype=np.int64)
        self.pieces = regex.compile(pre[0]["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in self.added) + ")")
        self.cache: dict[str, tuple[int, str, str]] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of one word: merge the lowest-ranked pair, leftmost first, until none is left."""
        raw = word.encode()
        ids = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        n = len(ids)
        if n == 1:
            return ids
        merges, after, before = self.merges, list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i, j: (m := merges.get((ids[i], ids[j]))) and m[0]
        found = [merges.get(p) for p in zip(ids, ids[1:], strict=False)]
        tree = PairTree([m if m is None else m[0] for m in found])
        while (i := tree.lowest()) is not None:
            j = after[i]
            ids[i] = merges[ids[i], ids[j]][1]
            after[i] = k = after[j]
            if j < n - 1:
                tree.set(j, None)
            if k < n:
                before[k] = i
                tree.set(i, rank(i, k))
            else:
                tree.set(i, None)
            if (h := before[i]) >= 0:
                tree.set(h, rank(h, i))
            ids[j] = -1
        return [x for x in ids if x >= 0]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as the library does for a file without a decoder; unknown ids are skipped."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for pairs that never merge."""
        wanted = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.pair_ranks[at], -1)

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """merge() of many words: short ones in forests of equal width, long ones by a tree each."""
        out: list[list[int]] = [[]] * len(words)
        raws = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raws])
        width = 2
        while width <= FOREST_WIDTH:
            low = 0 if width == 2 else width // 2
            for at in np.array_split(own := np.flatnonzero((sizes > low) & (sizes <= width)), max(1, len(own) // 20_000)):
                if len(at):
                    data = np.frombuffer(b"".join(raws[i].ljust(width, b"\0") for i in at), dtype=np.uint8).reshape(len(at), width)
                    ids = self.inner_ids[data]
                    rows, ends = np.arange(len(at)), sizes[at] - 1
                    ids[rows, ends] = self.last_ids[data[rows, ends]]
                    ranks = self.rank_of(ids[:, :-1], ids[:, 1:])
                    ranks[np.arange(width - 1)[None, :] >= ends[:, None]] = -1
                    forest = PairForest(ids, sizes[at], ranks)
                    forest.run(self.rank_of, self.merged)
                    flat, cuts = forest.ids[forest.alive].tolist(), np.cumsum(forest.alive.sum(1)).tolist()
                    for i, start, end in zip(at.tolist(), [0, *cuts[:-1]], cuts, strict=True):
                        out[i] = flat[start:end]
            width *= 2
        for i in np.flatnonzero(sizes > FOREST_WIDTH):
            out[i] = self.merge(words[i])
        return out

    def learn(self, chunks: set[str]) -> None:
        """Put the number of ids, their text and the decoded text of new chunks into the cache."""
        new = [c for c in chunks if c not in self.cache]
        if len(self.cache) + len(new) > CACHED_CHUNKS:
            self.cache.clear()
            new = list(chunks)
        words = [[c] if c in self.added else self.pieces.findall(c) for c in new]
        plain = list({w for own in words for w in own if w not in self.added})
        made = {w: (len(ids), " ".join([str(i) for i in ids]), self.decode(ids)) for w, ids in zip(plain, self.merge_all(plain), strict=True)}
        made |= {t: (1, str(i), t) for t, i in self.added.items()}
        for chunk, own in zip(new, words, strict=True):
            parts = [made[w] for w in own]
            self.cache[chunk] = parts[0] if len(parts) == 1 else (sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts]))

    def split(self, text: str) -> list[str]:
        """Special tokens and the normalised text between them, cut at white space, which no word contains."""
        chunks: list[str] = []
        for part in self.specials.split(text) if "<|" in text else (text,):
            if part in self.added:
                chunks.append(part)
            elif part:
                part = part if part.isascii() else unicodedata.normalize("NFC", part)
                # lower case by character, without the final form of sigma
                part = "".join(map(str.lower, part)) if "\u03a3" in part else part.lower()
                # str.split knows four more separators than the tokenizer
                chunks += UNICODE_SPACE.split(part) if SEPARATORS.search(part) else part.split()
        return chunks

    def encode(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """For each text the number of ids, the ids and the decoded text, both joined by spaces."""
        split = [self.split(t or "") for t in texts]
        self.learn(set().union(*split) if split else set())
        out = []
        for chunks in split:
            parts = [p for p in map(self.cache.__getitem__, chunks) if p[0]]
            out.append((sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])))
        return out


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def _row(n: int, ids: str, decoded: str, outputs: list[str]) -> list:
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    make = {"n_tokens": lambda: n, "ids": lambda: np.array(ids.split(), dtype=np.int32), "decoded": lambda: decoded, "ids_sha256": lambda: sha(ids), "decoded_sha256": lambda: sha(decoded)}
    return [make[name]() for name in outputs]


def bpe_encode(docs: DataFrame, path: str, outputs: list[str] | None = None) -> DataFrame:
    """doc_id and the wanted OUTPUTS of every text; whole texts, one narrow stage, no shuffle.

    A null or empty text has no tokens (ids_sha256 is that of the empty string). Rows are independent, so
    repeated rows, null doc_ids and other columns change nothing; an empty table gives no rows. Very long
    words cost n log n. The vocabulary file is read once by each worker.
    """
    names = outputs or ["n_tokens", "ids"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(path)
        for part in in_slices(frames, "text", 2_000_000):
            texts = [t if isinstance(t, str) else None for t in part["text"]]
            rows = [_row(*made, names) for made in model.encode(texts)]
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()} | {n: [r[i] for r in rows] for i, n in enumerate(names)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(solid(run), f"doc_id {kind}, " + ", ".join(f"{n} {OUTPUTS[n]}" for n in names))


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of an ids array column. Null ids give a null text, unknown ids are skipped."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(path)
        for part in frames:
            texts = [None if ids is None else model.decode([int(i) for i in ids]) for ids in part["ids"]]
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "text": texts})

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInPandas(solid(run), f"doc_id {kind}, text string")
