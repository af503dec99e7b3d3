"""Byte-level BPE by speculation and verification, for a public vocabulary file.

Greedy longest match proposes the tokens of a word. A proposal is the true encoding exactly
when every two neighbouring tokens would also come out of encoding just their own bytes;
that is tested for all pairs at once by walking both merge trees down from the seam. Only
words with a failing pair go through exact merging.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionloom.runtime import spread

DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the published word pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MAX_FILE = 64 << 20
_KNOWN_WORDS = 300_000
_HUGE = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files write bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class BytePairs:
    """A vocabulary whose ids beyond the single bytes stand in order of merging."""

    def __init__(self, raw: bytes) -> None:
        model = json.loads(raw)["model"]
        letters = byte_letters()
        vocab = model["vocab"]
        self.ids = {bytes(letters[c] for c in t): i for t, i in vocab.items() if all(c in letters for c in t)}
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int64)
        n = max(self.ids.values()) + 1
        self.left = np.arange(n, dtype=np.int64)
        self.right = np.arange(n, dtype=np.int64)
        pairs = {}
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            whole = vocab[a + b]
            self.left[whole], self.right[whole] = vocab[a], vocab[b]
            pairs[(vocab[a], vocab[b])] = whole
        self.pairs = pairs
        keys = np.array([a * n + b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.whole = np.array(list(pairs.values()), dtype=np.int64)[order]
        self.n = n
        self.longest = max(map(len, self.ids))
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        out, at, n = [], 0, len(word)
        while at < n:
            end = min(n, at + self.longest)
            while (token := self.ids.get(word[at:end])) is None:
                end -= 1
            out.append(token)
            at = end
        return out

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether each pair of neighbouring tokens stays as it is when its own bytes are encoded."""
        good = np.ones(len(first), dtype=bool)
        live = np.arange(len(first))
        a, b = first.astype(np.int64), second.astype(np.int64)
        limit = np.full(len(first), _HUGE)
        while len(live):
            key = a * self.n + b
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            merged = np.where(self.keys[at] == key, self.whole[at], _HUGE)
            clash = merged < limit
            good[live[clash]] = False
            # Undo the later of the two merges next to the seam; at a single byte undo the other one.
            la, rb = self.right[a], self.left[b]
            take_a = a > b
            end_a, end_b = la == a, rb == b
            down_a = np.where(take_a, ~end_a, end_b & ~end_a)
            down_b = np.where(take_a, end_a & ~end_b, ~end_b)
            limit = np.where(down_a, a, np.where(down_b, b + 1, limit))
            a, b = np.where(down_a, la, a), np.where(down_b, rb, b)
            go = ~clash & (down_a | down_b)
            live, a, b, limit = live[go], a[go], b[go], limit[go]
        return good

    def merge(self, word: bytes) -> list[int]:
        """Exact merging in order of rank, by a heap over a linked list."""
        ids = [int(self.single[x]) for x in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or self.pairs.get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := self.pairs.get((rank, ids[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := self.pairs.get((ids[h], rank))) is not None:
                heapq.heappush(heap, (r, h))
        return [x for x in ids if x >= 0]

    def learn(self, words: list[str]) -> None:
        """Encode words not met before."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        proposals = [self.propose(b) for b in raw]
        sizes = np.array([len(p) for p in proposals])
        flat = np.fromiter((t for p in proposals for t in p), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        code, back = np.unique(flat[inside] * self.n + flat[inside + 1], return_inverse=True)
        bad = ~self.compatible(code // self.n, code % self.n)[back]
        for k in np.unique(owner[inside[bad]]).tolist():
            proposals[k] = self.merge(raw[k])
        self.known.update(zip(words, proposals))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts; null and empty texts have none."""
        split = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.known) > _KNOWN_WORDS:
            self.known.clear()
        fresh = list({w: None for words in split for w in words if w not in self.known})
        if fresh:
            self.learn(fresh)
        out: list[int] = []
        ends = [0]
        known = self.known
        for words in split:
            for w in words:
                out += known[w]
            ends.append(len(out))
        return np.array(ends, dtype=np.int32), np.array(out, dtype=np.int32)


_LOADED: dict[int, BytePairs] = {}


def token_ids(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = DEFAULT_PATH) -> DataFrame:
    """doc_id and ids (array<int>) of every row, without special tokens.

    Null and empty texts give an empty list, blank texts the ids of their white space; what
    looks like a special token is ordinary text. Rows with the same doc_id each give a row.
    The vocabulary file is read by the driver and broadcast; a file over 64 MB is refused.
    Further columns of ``df`` play no part; an empty table gives an empty result.
    """
    with open(path, "rb") as f:
        raw = f.read(_MAX_FILE + 1)
    if len(raw) > _MAX_FILE:
        raise ValueError(f"{path} is larger than a vocabulary may be")
    shared = df.sparkSession.sparkContext.broadcast(raw)
    kind = df.select(F.col(doc_id)).schema[0].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = BytePairs(shared.value)
        bpe = _LOADED[key]
        for batch in batches:
            texts = batch.column(1)
            step = 512
            for k in range(0, batch.num_rows, step):
                ends, ids = bpe.encode(texts.slice(k, step).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, step), lists], names=["doc_id", "ids"])

    return spread(df.select(F.col(doc_id), F.col(text))).mapInArrow(encode, f"doc_id {kind}, ids array<int>")
