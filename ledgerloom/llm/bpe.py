"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves pre-tokens that are
tokens themselves. Tier two: the other pre-tokens are merged by rank, with a heap of
adjacent pairs over a linked list of bytes, in n log n steps for n bytes. Both tiers
look ranks up in the same hash. The vocabulary is a file of fixed size and the only
thing that is broadcast.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice, repeat

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import small_batches

#: Pre-tokens whose ids a task remembers, the longest one remembered, and pre-tokens of a text that are encoded at once.
REMEMBERED, LONGEST, AT_ONCE = 1 << 19, 64, 1 << 16
#: Bytes from which the links of a pre-token are kept in arrays.
SHORT = 4096


class PerfectHash:
    """A minimal perfect hash from byte strings to their ranks: n keys fill n slots, hash and displace.

    Keys fall into buckets; from the fullest on, each bucket gets the displacement
    that sends its keys to free slots. Buckets of one key name their slot outright.
    The slot's own key is compared, so strings outside the vocabulary give None.
    """

    def __init__(self, ranks: dict[bytes, int]):
        n = self.n = max(1, len(ranks))
        self.buckets = max(1, n // 2)
        self.keys: list[bytes | None] = [None] * n
        self.ranks = [0] * n
        self.moves = [0] * self.buckets
        members: list[list[tuple[int, bytes]]] = [[] for _ in range(self.buckets)]
        for key in ranks:
            h = xxhash.xxh64_intdigest(key)
            members[h % self.buckets].append((h, key))
        free, cursor = bytearray(b"\1" * n), 0
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            if len(members[b]) > 1:
                move = 0
                while True:
                    slots = {self._slot(h, move) for h, _ in members[b]}
                    if len(slots) == len(members[b]) and all(free[s] for s in slots):
                        break
                    move += 1
            elif members[b]:
                cursor = free.index(1, cursor)
                move = -cursor - 1
            else:
                continue
            self.moves[b] = move
            for h, key in members[b]:
                s = self._slot(h, move)
                self.keys[s], self.ranks[s], free[s] = key, ranks[key], 0

    def _slot(self, h: int, move: int) -> int:
        return -move - 1 if move < 0 else (((h ^ move * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> 24) % self.n

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh64_intdigest(key)
        s = self._slot(h, self.moves[h % self.buckets])
        return self.ranks[s] if self.keys[s] == key else None


def read_ranks(path: str) -> dict[bytes, int]:
    """token -> rank of a file with a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Looked(dict):
    """Byte string -> its rank or None, out of the perfect hash; frequent parts of pre-tokens are remembered."""

    def __init__(self, ranks: PerfectHash):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> int | None:
        rank = self.ranks.get(piece)
        if len(self) < REMEMBERED and len(piece) <= LONGEST:
            self[piece] = rank
        return rank


def merge_ids(piece: bytes, ranks: Looked) -> list[int]:
    """Ids of a pre-token that is no token: always merge the adjacent pair of the lowest rank, the leftmost of equals.

    Links are arrays of 32-bit numbers (lists for short ones) and the heap holds rank and place in one
    integer, about 70 bytes a byte of the pre-token altogether. An entry is stale if
    the pair that starts there has another rank by now; pairs of one rank at one
    place are the same bytes, so no end needs to be kept.
    """
    n, rank_of = len(piece), ranks.__getitem__
    packed = list if n < SHORT else lambda numbers: array("i", numbers)
    after, before, paired = packed(range(1, n + 1)), packed(range(-1, n - 1)), packed(repeat(-1, n))
    heap = []
    for i in range(n - 1):
        if (r := rank_of(piece[i : i + 2])) is not None:
            paired[i] = r
            heap.append(r << 32 | i)
    heapify(heap)
    while heap:
        entry = heappop(heap)
        i = entry & 0xFFFFFFFF
        if paired[i] != entry >> 32:
            continue
        j = after[i]
        end = after[i] = after[j]
        paired[j] = paired[i] = -1
        if end < n:
            before[end] = i
            if (r := rank_of(piece[i : after[end]])) is not None:
                paired[i] = r
                heappush(heap, r << 32 | i)
        if (h := before[i]) >= 0:
            if (r := rank_of(piece[h:end])) is not None:
                paired[h] = r
                heappush(heap, r << 32 | h)
            else:
                paired[h] = -1
    ids, i = [], 0
    while i < n:
        ids.append(rank_of(piece[i : after[i]]))
        i = after[i]
    if None in ids:
        raise ValueError("the vocabulary lacks single bytes")
    return ids


class Encoder(dict):
    """Pre-token -> its ids as little-endian 32-bit integers, found on first use and remembered."""

    def __init__(self, ranks: PerfectHash, pattern: str):
        super().__init__()
        self.ranks, self.looked, self.pattern = ranks, Looked(ranks), regex.compile(pattern)

    def __missing__(self, token: str) -> bytes:
        piece = token.encode()
        rank = self.ranks.get(piece)
        ids = np.array([rank] if rank is not None else merge_ids(piece, self.looked), dtype="<u4").tobytes()
        if len(self) < REMEMBERED and len(token) <= LONGEST:
            self[token] = ids
        return ids

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of the text, in pieces."""
        if len(text) < AT_ONCE:
            yield b"".join(map(self.__getitem__, self.pattern.findall(text)))
            return
        matches = self.pattern.finditer(text)
        while part := [m[0] for m in islice(matches, AT_ONCE)]:
            yield b"".join(map(self.__getitem__, part))


OUT = "id string, ids array<int>, n_tokens long, ids_sha256 string, decoded binary, decoded_sha256 string"


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256 and what `keep` names: `ids` (array<int>), `decoded` (binary).

    vocabulary: a file of base64 tokens and ranks that the driver reads. Each match of
    `pattern` is encoded separately, in whole texts, without special tokens; null and
    empty texts have no tokens. Bytes that aren't UTF-8 are read as U+FFFD. The ids
    are decoded again by joining their tokens. Repeated rows give repeated rows.
    """
    small_batches(docs.sparkSession)
    read = read_ranks(vocabulary)
    tokens: list[bytes] = [b""] * (max(read.values(), default=-1) + 1)
    for token, rank in read.items():
        tokens[rank] = token
    known = docs.sparkSession.sparkContext.broadcast((PerfectHash(read), tokens))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks, tokens = known.value
        encoder = Encoder(ranks, pattern)
        names = [x.split()[0] for x in OUT.split(", ")]
        before, answer = None, None
        for pdf in batches:
            rows, held = [], 0
            for key, text in zip(pdf["id"], pdf["text"], strict=True):
                if answer is not None and text == before:  # a copy right behind its original
                    rows.append((key, *answer))
                    held += answer[1] if keep else 0
                    continue
                n, told, back, parts, whole = 0, hashlib.sha256(), hashlib.sha256(), [], []
                for ids in encoder.encode(text.decode(errors="replace")) if text is not None else ():
                    n += len(ids) // 4
                    told.update(ids)
                    decoded = b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
                    back.update(decoded)
                    if "ids" in keep:
                        parts.append(ids)
                    if "decoded" in keep:
                        whole.append(decoded)
                before, answer = text, (np.frombuffer(b"".join(parts), "<i4"), n, told.hexdigest(), b"".join(whole), back.hexdigest())
                rows.append((key, *answer))
                held += n if keep else 0
                if held > AT_ONCE * 16:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    told = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInPandas(run, OUT)
    return told.select(F.col("id").cast("long").alias(id_col), "n_tokens", "ids_sha256", "decoded_sha256", *keep)
