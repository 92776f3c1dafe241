"""P7: encoding of a corpus with a public byte-level BPE tokenizer.

Two tiers.  Every distinct pre-token of a batch is first looked up, vectorised, in a minimal perfect hash over the
vocabulary (hash and displace: one displacement per bucket, one slot per token, the token's bytes verified).
What is not in the vocabulary is merged with a heap of candidate pairs over a linked list of its bytes, O(n log n)
for a pre-token of n bytes, so a text that is one unbroken run of a million letters is no special case.

The vocabulary has a fixed size (50,256 tokens, checked against ``MAX_VOCABULARY``), so the broadcast is bounded.
Defined cases: null and empty texts give an empty list; text that spells a special token is ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import map_columns, tokenizer_path

#: Tokens a vocabulary may have to be broadcast (a few MB).
MAX_VOCABULARY = 1_000_000
_KEYS_PER_BUCKET = 4
_DIRECT = np.int64(-(1 << 40))


def _mixed(h: np.ndarray, displacement: np.ndarray | int) -> np.ndarray:
    """A 64-bit finaliser of the hash with the displacement."""
    with np.errstate(over="ignore"):
        x = h ^ (np.asarray(displacement, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash from byte strings to integers: n keys in exactly n slots."""

    def __init__(self, ids: dict[bytes, int]):
        if len(ids) > MAX_VOCABULARY:
            raise ValueError(f"vocabulary of {len(ids)} tokens is beyond {MAX_VOCABULARY}")
        keys = list(ids)
        n = max(1, len(keys))
        self.buckets = n // _KEYS_PER_BUCKET + 1
        self.displacement = np.zeros(self.buckets, dtype=np.int64)
        self.values = np.full(n, -1, dtype=np.int64)
        self.tokens: list[bytes | None] = [None] * n
        h = self.hashes(keys)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        free = np.ones(n, dtype=bool)
        sizes = np.diff(edges)
        tries = np.arange(1, 257, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable"):
            members = order[edges[b] : edges[b + 1]]
            if len(members) < 2:
                break
            first = np.uint64(0)
            while True:
                slots = (_mixed(h[members][None, :], (tries + first)[:, None]) % np.uint64(n)).astype(np.int64)
                ordered = np.sort(slots, axis=1)
                good = free[slots].all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if good.any():
                    at = int(np.argmax(good))
                    self.displacement[b] = int(tries[at] + first)
                    free[slots[at]] = False
                    for k, s in zip(members, slots[at]):
                        self.tokens[s], self.values[s] = keys[k], ids[keys[k]]
                    break
                first += np.uint64(len(tries))
        left = iter(np.nonzero(free)[0])
        for b in np.nonzero(sizes == 1)[0]:  # a bucket of one key takes any slot left over
            k, s = order[edges[b]], next(left)
            self.displacement[b] = _DIRECT + s
            self.tokens[s], self.values[s] = keys[k], ids[keys[k]]

    @staticmethod
    def hashes(keys: Iterable[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64)

    def lookup(self, keys: list[bytes]) -> list[int]:
        """The integer of each key, -1 for a key that is not in the table."""
        if not keys:
            return []
        h = self.hashes(keys)
        d = self.displacement[(h % np.uint64(self.buckets)).astype(np.int64)]
        n = len(self.values)
        slots = np.where(d < 0, d - _DIRECT, (_mixed(h, np.abs(d)) % np.uint64(n)).astype(np.int64))
        tokens = self.tokens
        return [v if tokens[s] == k else -1 for k, s, v in zip(keys, slots.tolist(), self.values[slots].tolist())]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merges of one pre-token: a heap of ranked pairs over a linked list of parts."""
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            heap.append((rank, i, 2))
    heapq.heapify(heap)
    while heap:
        rank, i, length = heapq.heappop(heap)
        left = parts[i]
        if left is None or (j := following[i]) >= n or len(left) + len(parts[j]) != length or ranks.get(left + parts[j]) != rank:
            continue  # one of the two parts has changed since
        parts[i], parts[j] = left + parts[j], None
        following[i] = k = following[j]
        if k < n:
            before[k] = i
        for a, b in ((before[i], i), (i, k)):
            if a >= 0 and b < n:
                joined = parts[a] + parts[b]
                rank = ranks.get(joined)
                if rank is not None:
                    heapq.heappush(heap, (rank, a, len(joined)))
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    """A byte-level BPE vocabulary of ranks with its pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        # a token that its own merges do not give back stays out of the first tier
        self.whole = PerfectHash({t: i for t, i in ranks.items() if len(t) == 1 or merge(t, ranks) == [i]})
        self._split = None

    def __getstate__(self):
        return self.__dict__ | {"_split": None}

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        self._split = self._split or regex.compile(self.pattern)
        split = [self._split.findall(t) if t else [] for t in texts]
        distinct = list({p for pieces in split for p in pieces})
        raw = [p.encode("utf-8") for p in distinct]
        known = {}
        for piece, data, token in zip(distinct, raw, self.whole.lookup(raw)):
            known[piece] = (token,) if token >= 0 else tuple(merge(data, self.ranks))
        return [[i for p in pieces for i in known[p]] for pieces in split]


@lru_cache(maxsize=4)
def load_encoder(path: str, pattern: str) -> Encoder:
    """Read a rank file (one base64 token and its rank per line)."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines)
        ranks = {base64.b64decode(p[0]): int(p[1]) for p in pairs if len(p) == 2}
    return Encoder(ranks, pattern)


def encode(documents: DataFrame, path: str | None = None, pattern: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the token ids of ``text`` as ``ids``, one row per row, without a shuffle."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    shared = documents.sparkSession.sparkContext.broadcast(load_encoder(path or tokenizer_path("byte_bpe_50k.tiktoken"), pattern))
    kind = dict(documents.dtypes)[key]
    return map_columns(
        documents.select(key, text),
        lambda c: {key: c[key], "ids": shared.value.encode_batch(c[text])},
        f"`{key}` {kind}, ids array<int>",
    )
