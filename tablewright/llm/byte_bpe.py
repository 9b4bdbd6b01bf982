"""Byte-level BPE with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary answers for a pre-token that is
itself in the vocabulary, with one probe and one comparison. Tier two: any other
pre-token is merged by rank with a heap over linked bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces of text whose ids a task remembers, as bytes (some 150 bytes each in all); beyond it the memory starts anew.
MEMO_PIECES = 1_000_000
#: Pre-tokens outside the vocabulary that it remembers likewise.
MEMO_TOKENS = 300_000
_WIDE_GAP = re.compile(r" (?:\s|$)")
SCHEMA = "doc_id long, ids binary, decoded_sha256 string, n_tokens long, ids_sha256 string"


def read_ranks(data: bytes) -> list[bytes]:
    """Tokens by rank from the text of a rank file: base64 token and rank in each line."""
    found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, data.splitlines()) if token}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks have gaps")
    return [found[i] for i in range(len(found))]


class PerfectHash:
    """Minimal perfect hash of distinct byte strings by displacement.

    Keys fall into buckets by one 64-bit hash. Buckets are placed from the largest
    to the smallest: a bucket gets the first displacement that sends its keys to
    free places; a bucket of one key names a place left over instead, as a negative
    number. There are as many places as keys. ``shift`` of an earlier table of the
    same keys saves the search.
    """

    def __init__(self, keys: list[bytes], shift: np.ndarray | None = None, load: int = 2):
        n = self.n = len(keys)
        self.buckets = max(1, -(-n // load))
        self.value: list[int] = [-1] * n
        self.keys: list[bytes | None] = [None] * n
        hashes = [xxhash.xxh3_128_intdigest(k) for k in keys]
        self.shift = (self._search(hashes) if shift is None else shift).tolist()
        for i, h in enumerate(hashes):
            p = self._place(h, self.shift[h % self.buckets])
            self.keys[p], self.value[p] = keys[i], i

    def _search(self, hashes: list[int]) -> np.ndarray:
        shift, taken = np.zeros(self.buckets, np.int64), bytearray(self.n)
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for h in hashes:
            members[h % self.buckets].append(h)
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        for b in order:
            if len(members[b]) < 2:
                break
            d = 0
            while True:
                at = {self._place(h, d) for h in members[b]}
                if len(at) == len(members[b]) and not any(taken[p] for p in at):
                    break
                d += 1
            shift[b] = d
            for p in at:
                taken[p] = 1
        free = iter([p for p in range(self.n) if not taken[p]])
        for b in order:
            if len(members[b]) == 1:
                shift[b] = -1 - next(free)
        return shift

    def _place(self, h: int, d: int) -> int:
        if d < 0:
            return -1 - d
        mixed = ((h >> 32) + d * 0x9E3779B97F4A7C15) * ((h >> 64) | 1) & 0xFFFFFFFFFFFFFFFF
        return (mixed >> 31) % self.n

    def get(self, key: bytes) -> int:
        """The key's number, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_128_intdigest(key)
        p = self._place(h, self.shift[h % self.buckets])
        return self.value[p] if self.keys[p] == key else -1


class Codec:
    """Encodes and decodes by ranks; one per task."""

    def __init__(self, tokens: list[bytes], pattern: str, shift: np.ndarray | None = None):
        self.tokens, self.table, self.split = tokens, PerfectHash(tokens, shift), regex.compile(pattern)
        self.rank = {t: i for i, t in enumerate(tokens)}
        # Bytes, unlike lists, are nothing that Python's collector has to walk.
        self.memo: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token outside the vocabulary: always the pair of least rank, then leftmost."""
        n, rank_of = len(piece), self.rank.get
        # A heap entry is one number: rank, place of the left part, end of the right part.
        width = n.bit_length()
        mask, low = (1 << width) - 1, 2 * width
        pairs = map(rank_of, [piece[i : i + 2] for i in range(n - 1)])
        heap = [rank << low | i << width | i + 2 for i, rank in enumerate(pairs) if rank is not None]
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            code = pop(heap)
            stop, i = code & mask, code >> width & mask
            j = after[i]
            if j >= n or end[j] != stop or end[i] < 0:
                continue  # one of its two parts has changed since
            end[i], end[j] = stop, -1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                rank = rank_of(piece[i : end[j]])
                if rank is not None:
                    push(heap, rank << low | i << width | end[j])
            h = before[i]
            if h >= 0:
                rank = rank_of(piece[h:stop])
                if rank is not None:
                    push(heap, rank << low | h << width | stop)
        out, i = [], 0
        while i < n:
            out.append(rank_of(piece[i : end[i]]))
            i = after[i]
        return out

    def piece_ids(self, piece: str) -> bytes:
        out = []
        for token in self.split.findall(piece):
            ids = self.known.get(token)
            if ids is None:
                raw = token.encode()
                rank = self.table.get(raw)
                ids = rank.to_bytes(4, "little") if rank >= 0 else _packed(self.merge(raw))
                if len(raw) <= 64:
                    if len(self.known) >= MEMO_TOKENS:
                        self.known.clear()
                    self.known[token] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers.

        A space before a character that is no space always starts a match of the
        pattern, so the text is cut there and equal pieces are looked up once.
        """
        memo, pieces = self.memo, text.replace(" ", "\0 ").split("\0") if "\0" not in text else _cut(text)
        if _WIDE_GAP.search(text):
            # A piece that starts with white space after its space belongs to the one before.
            joined = pieces[:1]
            for piece in pieces[1:]:
                if piece == " " or piece[1].isspace():
                    joined[-1] += piece
                else:
                    joined.append(piece)
            pieces = joined
        if len(memo) > MEMO_PIECES:
            memo.clear()
        new = set(pieces).difference(memo)
        for piece in new:
            memo[piece] = self.piece_ids(piece)
        out = b"".join(map(memo.__getitem__, pieces))
        for piece in new:
            if len(piece) > 256:
                del memo[piece]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _cut(text: str) -> list[str]:
    """The text cut before each space."""
    parts = text.split(" ")
    return [parts[0], *[" " + p for p in parts[1:]]]


def encode_documents(
    docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """Ids of every whole text, and what they decode to.

    ``ranks`` is the content of a rank file, ``pattern`` the pattern of its
    pre-tokens. Returns doc_id, ids (little-endian unsigned 32-bit; null without
    ``with_ids``), n_tokens, ids_sha256, decoded_sha256. Null and empty texts have
    no ids; repeated rows come out as often as they come in; further columns are
    not read. Rows are independent: nothing is shuffled.
    """

    shift = np.array(PerfectHash(read_ranks(ranks)).shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(read_ranks(ranks), pattern, shift)
        for batch in batches:
            packed, counts, shas, decoded = [], [], [], []
            for text in batch.column(1):
                raw = codec.encode(text.as_py() or "")
                packed.append(raw if with_ids else None)
                counts.append(len(raw) // 4)
                shas.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(raw)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(packed, pa.binary()),
                    pa.array(decoded, pa.string()),
                    pa.array(counts, pa.int64()),
                    pa.array(shas, pa.string()),
                ],
                ["doc_id", "ids", "decoded_sha256", "n_tokens", "ids_sha256"],
            )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCHEMA)
