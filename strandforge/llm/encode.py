"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 8), by speculation and verification.

A text is split into words by the vocabulary's pattern; the merges never cross a word's end. Each different word is encoded
once: a greedy longest match over a trie proposes tokens for all new words of a batch together, then every pair of
neighbouring tokens is tested, again for all words together. A pair (a, b) is compatible when merging the bytes of
a and b alone yields just a and b. If all tokens yield themselves and all neighbours are compatible, no merge ever crosses a
token's border and the proposal is the exact encoding. Only words with a failing pair are merged step by step.

An empty or null text has an empty list. Strings that look like special tokens are ordinary text. Texts of any length are
encoded whole. The vocabulary file is a parameter and is read on each worker.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pattern that splits text into words for this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept between batches, and characters encoded at once.
CACHE = 400_000
CHUNK = 4_000_000
_NEVER = np.int64(1 << 40)


def _byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary file writes each byte: itself if printable, else 256 and up in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges and a trie of a byte-level BPE file.

    Tokens are numbered internally by the time of their merge: the 256 bytes first, then the result of each merge in order;
    ``ids`` maps these numbers to the file's ids.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        self.bytes = [bytes([b]) for b in range(256)]
        number = {c: b for c, b in letters.items()}
        left, right, ids = [-1] * 256, [-1] * 256, [0] * 256
        for c, b in letters.items():
            ids[b] = model["vocab"][c]
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            number.setdefault(a + b, len(left))
            ids.append(model["vocab"][a + b])
            left.append(number[a])
            right.append(number[b])
            self.bytes.append(self.bytes[left[-1]] + self.bytes[right[-1]])
        self.left, self.right, self.ids = (np.array(x, np.int64) for x in (left, right, ids))
        n = len(left)
        keys = self.left[256:] * n + self.right[256:]
        order = np.argsort(keys)
        self._keys, self._made = keys[order], order.astype(np.int64) + 256
        self.merged = dict(zip(zip(left[256:], right[256:]), range(256, n)))
        self._sound = self._yield_themselves()
        self._grow_trie()
        self._known_pairs, self._known_ok = np.zeros(0, np.int64), np.zeros(0, bool)

    def _merge_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that (a, b) merges to, or _NEVER."""
        want = a * len(self.left) + b
        at = np.minimum(np.searchsorted(self._keys, want), len(self._keys) - 1)
        return np.where(self._keys[at] == want, self._made[at], _NEVER)

    def _apart(self, a: np.ndarray, b: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Whether no merge of number below ``before`` joins a's end to b's start while both are being built.

        Goes back in time: of the two parts at the border the one merged later is taken apart, and until that merge the
        smaller parts stood side by side. Equal merges happen from the left, so a right part's merge comes after
        an equal one across the border.
        """
        a, b, before = a.copy(), b.copy(), before.copy()
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            joins = self._merge_of(x, y) < before[live]
            ok[live[joins]] = False
            whole = ~joins & ((x >= 256) | (y >= 256))
            live, x, y = live[whole], x[whole], y[whole]
            take_left = x > y
            before[live] = np.where(take_left, x, y + 1)
            a[live] = np.where(take_left, self.right[x], x)
            b[live] = np.where(take_left, y, self.left[y])
        return ok

    def _yield_themselves(self) -> np.ndarray:
        """Tokens whose bytes are encoded as that one token."""
        n = len(self.left)
        t = np.arange(256, n)
        sound = np.ones(n, bool)
        sound[256:] = self._apart(self.left[256:], self.right[256:], t)
        while True:
            again = sound.copy()
            again[256:] &= sound[self.left[256:]] & sound[self.right[256:]]
            if (again == sound).all():
                return sound
            sound = again

    def _grow_trie(self) -> None:
        """Nodes 0.. by sorted edges (node * 256 + byte); ``_token`` has each node's token or -1."""
        nodes: list[dict[int, int]] = [{}]
        token = [-1]
        for t, raw in enumerate(self.bytes):
            if not self._sound[t]:
                continue
            at = 0
            for c in raw:
                to = nodes[at].get(c)
                if to is None:
                    to = len(nodes)
                    nodes[at][c] = to
                    nodes.append({})
                    token.append(-1)
                at = to
            token[at] = t
        count = sum(map(len, nodes))
        edges = np.fromiter((i * 256 + c for i, d in enumerate(nodes) for c in d), np.int64, count)
        ends = np.fromiter((to for d in nodes for to in d.values()), np.int64, count)
        order = np.argsort(edges)
        self._edges, self._ends, self._token, self._nodes = edges[order], ends[order], np.array(token, np.int64), nodes

    def _longest(self, buf: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest token and its length at each position ``at``, not beyond ``end``."""
        node = np.zeros(len(at), np.int64)
        best, length = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live, depth = np.arange(len(at)), 0
        while len(live):
            want = node[live] * 256 + buf[at[live] + depth]
            i = np.minimum(np.searchsorted(self._edges, want), len(self._edges) - 1)
            there = self._edges[i] == want
            live, to = live[there], self._ends[i[there]]
            depth += 1
            node[live] = to
            token = self._token[to]
            hit = token >= 0
            best[live[hit]], length[live[hit]] = token[hit], depth
            live = live[at[live] + depth < end[live]]
        return best, length

    def _propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy tokens of all words, one after the other, and the number of each word's tokens."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        buf = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        end = np.cumsum(sizes)
        at = end - sizes
        live = np.flatnonzero(sizes > 0)
        who, what = [], []
        while len(live) > 64:
            token, length = self._longest(buf, at[live], end[live])
            who.append(live)
            what.append(token)
            at[live] += length
            live = live[at[live] < end[live]]
        for w in live:  # a few long words are walked one by one
            raw, p, stop = words[w], int(at[w] - end[w] + sizes[w]), len(words[w])
            tokens = []
            while p < stop:
                node, best, step, d = 0, 0, 0, 0
                while p + d < stop and (to := self._nodes[node].get(raw[p + d])) is not None:
                    node, d = to, d + 1
                    if self._token[node] >= 0:
                        best, step = int(self._token[node]), d
                tokens.append(best)
                p += step
            who.append(np.full(len(tokens), w))
            what.append(np.array(tokens, np.int64))
        if not who:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        owner, tokens = np.concatenate(who), np.concatenate(what)
        order = np.argsort(owner, kind="stable")
        return tokens[order], np.bincount(owner, minlength=len(words))

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair may stand side by side; answers are kept."""
        want = a * len(self.left) + b
        pairs, back = np.unique(want, return_inverse=True)
        at = np.searchsorted(self._known_pairs, pairs)
        known = np.zeros(len(pairs), bool)
        inside = at < len(self._known_pairs)
        known[inside] = self._known_pairs[at[inside]] == pairs[inside]
        ok = np.zeros(len(pairs), bool)
        ok[known] = self._known_ok[at[known]]
        new = pairs[~known]
        if len(new):
            ok[~known] = got = self._apart(new // len(self.left), new % len(self.left), np.full(len(new), _NEVER))
            kept = (self._known_pairs, self._known_ok) if len(self._known_pairs) < 4_000_000 else (new[:0], got[:0])
            every, answers = np.concatenate([kept[0], new]), np.concatenate([kept[1], got])
            order = np.argsort(every, kind="stable")
            self._known_pairs, self._known_ok = every[order], answers[order]
        return ok[back]

    def merge_exactly(self, raw: bytes) -> list[int]:
        """Tokens of one word by its merges in order, each time the earliest and leftmost."""
        tokens: list[int] = list(raw)
        n = len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i) for i in range(n - 1) if (m := self.merged.get((tokens[i], tokens[i + 1]))) is not None]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or self.merged.get((tokens[i], tokens[j])) != m:
                continue
            tokens[i], gone[j] = m, True
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (k := self.merged.get((m, tokens[after[i]]))) is not None:
                    heapq.heappush(heap, (k, i))
            if before[i] >= 0 and (k := self.merged.get((tokens[before[i]], m))) is not None:
                heapq.heappush(heap, (k, before[i]))
        return [t for t, g in zip(tokens, gone) if not g]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """File ids of all words one after the other, the number of each word's ids, and how many words were merged exactly."""
        tokens, counts = self._propose(words)
        owner = np.repeat(np.arange(len(words)), counts)
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
        failing = inner[~self._compatible(tokens[inner], tokens[inner + 1])] if len(inner) else inner
        wrong = np.unique(owner[failing])
        if len(wrong):
            exact = [self.merge_exactly(words[w]) for w in wrong]
            keep = np.ones(len(words), bool)
            keep[wrong] = False
            counts_exact = np.fromiter(map(len, exact), np.int64, len(exact))
            owner = np.concatenate([owner[keep[owner]], np.repeat(wrong, counts_exact)])
            tokens = np.concatenate([tokens[keep[np.repeat(np.arange(len(words)), counts)]], np.fromiter(chain.from_iterable(exact), np.int64, int(counts_exact.sum()))])
            order = np.argsort(owner, kind="stable")
            tokens, counts = tokens[order], np.bincount(owner, minlength=len(words))
        return self.ids[tokens].astype(np.int32), counts, len(wrong)


class _Numbers(dict):
    """Word -> number; words without one get the next and are noted in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Encoder:
    """Encodes batches of texts; keeps the ids of words it has met, at most about CACHE of them."""

    def __init__(self, path: str = VOCABULARY):
        import regex

        self.vocabulary = Vocabulary(path)
        self._split = regex.compile(PATTERN).findall
        self._clear()

    def _clear(self) -> None:
        self._numbers = _Numbers()
        self._flat, self._start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self) -> None:
        new = self._numbers.new
        if new:
            ids, counts, _ = self.vocabulary.encode_words([w.encode("utf-8", "surrogatepass") for w in new])
            self._flat = np.concatenate([self._flat, ids])
            self._start = np.concatenate([self._start, self._start[-1] + np.cumsum(counts)])
            self._numbers.new = []

    def _words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words, and how many words each text has."""
        if len(self._numbers) > CACHE:
            self._clear()
        words = [self._split(t) if t else [] for t in texts]
        per = np.fromiter(map(len, words), np.int64, len(words))
        numbers = np.fromiter(map(self._numbers.__getitem__, chain.from_iterable(words)), np.int64, int(per.sum()))
        self._learn()
        return numbers, per

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and len(texts) + 1 offsets."""
        numbers, per = self._words(texts)
        counts = self._start[numbers + 1] - self._start[numbers]
        total = np.concatenate([[0], np.cumsum(counts)])
        place = np.repeat(self._start[numbers] - total[:-1], counts) + np.arange(total[-1])
        return self._flat[place], total[np.concatenate([[0], np.cumsum(per)])]

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        numbers, per = self._words(texts)
        total = np.concatenate([[0], np.cumsum(self._start[numbers + 1] - self._start[numbers])])
        return np.diff(total[np.concatenate([[0], np.cumsum(per)])])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    return Encoder(path)


def text_chunks(batch: pa.RecordBatch, column: str, chars: int = CHUNK) -> Iterator[tuple[int, int, list[str | None]]]:
    """The batch in pieces of rows with about so many bytes of text; one longer text is a piece alone."""
    texts = batch.column(column)
    size = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.float64)))
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + chars, side="right")))
        yield a, b, texts.slice(a, b - a).to_pylist()
        a = b


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, ids): the ids of each row's text, without special tokens. Rows stand as they are, repeated or with null keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for a, b, texts in text_chunks(batch, "text"):
                ids, offsets = own.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(a, b - a), lists], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.selectExpr(f"`{key}` as key", f"`{text}` as text").mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_column(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, name: str = "size") -> DataFrame:
    """(key, size): the number of ids of each row's text; 0 for empty and null texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for a, b, texts in text_chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(a, b - a), pa.array(own.count(texts), pa.int64())], names=[key, name])

    kind = df.schema[key].dataType.simpleString()
    return df.selectExpr(f"`{key}` as key", f"`{text}` as text").mapInArrow(run, f"`{key}` {kind}, `{name}` bigint")
