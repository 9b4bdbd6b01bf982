"""Harmonic packing of token pieces into fixed-capacity sequences.

Lengths belong to classes by the reciprocal of their share of the capacity: class k
holds the pieces of which k fit, and each of its bins takes exactly k of them. Bins
of different classes never mix, so every worker (task) packs its own pieces with one
counter per class and no exchange.

Documents may be cut, so a document's length is written as whole sequences, then
pieces of half, a quarter, ... of the capacity down to ``least``, and one shorter
tail. Classes of the former fill their bins without padding; a tail of length t
belongs to class capacity // t. What a worker has left in bins that did not fill up is
joined in the same order and cut again by powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, LEAST = 4096, 64
#: White-space pieces whose ids a task remembers, as bytes (some 150 bytes each in all); beyond it the memory starts anew.
MEMO_PIECES = 1_000_000
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


#: Letters that stay letters when lower-cased, and ASCII signs but the apostrophe and <, with which added tokens start.
_LETTERS, _SIGNS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f", r"\x21-\x26\x28-\x3b\x3d-\x40\x5b-\x60\x7b-\x7e"
_PIECE = re.compile(rf"[{_LETTERS}]++(?![^\x00-\x7f])|[{_SIGNS}]++(?!['<]|[^\x00-\x7f])|[^ \t\n\r\f\v]+")


class WordIds:
    """Ids of texts by a ``tokenizers`` file, one lookup per piece.

    Valid for tokenizers that drop white space, part runs of letters from runs of
    signs and lower-case, as the word-level files do. A text is cut at ASCII white space, and
    between letters and signs where no apostrophe, added token or other character
    could join with them; the ids of a text are then those of its pieces in order.
    """

    def __init__(self, spec: str):
        # The tasks of an executor share its cores; a pool of threads in each would only fight over them.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_str(spec), {}
        added = self.tokenizer.get_added_tokens_decoder().values()
        if not all(t.content.startswith("<") and not set(t.content) & set(" \t\n\r\f\v") for t in added):
            raise ValueError("added tokens must start with < and have no white space")

    def ids(self, text: str) -> bytes:
        """Ids as unsigned 32-bit numbers in the machine's order."""
        memo = self.memo
        if len(memo) > MEMO_PIECES:
            memo.clear()
        pieces = _PIECE.findall(text)
        new = set(pieces).difference(memo)
        # A-Z and a-z only need lower-casing before the merges; all else takes the whole way.
        other = [p for p in new if not (p.isascii() and p.isalpha())]
        merges = self.tokenizer.model.tokenize
        for p in new.difference(other):
            memo[p] = array("I", [t.id for t in merges(p.lower())]).tobytes()
        for p, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            memo[p] = array("I", e.ids).tobytes()
        out = b"".join(map(memo.__getitem__, pieces))
        for p in new:
            if len(p) > 256:
                del memo[p]
        return out


class Packer:
    """Fills the bins of one worker; emits placed pieces as rows."""

    def __init__(self, worker: int, capacity: int, least: int, with_ids: bool = True):
        self.capacity, self.least, self.with_ids = capacity, least, with_ids
        self.next_sequence = worker << 32
        self.open: dict[int, list[tuple[int, int, np.ndarray, int]]] = {}
        self.rows: list[tuple] = []

    def put(self, sequence: int, offset: int, piece: tuple[int, int, np.ndarray, int]) -> None:
        doc_id, start, ids, total = piece
        raw = ids.tobytes() if self.with_ids else None
        self.rows.append((doc_id, start, len(ids), zlib.crc32(ids), total, sequence, offset, raw))

    def sequence(self) -> int:
        self.next_sequence += 1
        return self.next_sequence - 1

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while start < total:
            left = total - start
            size = self.capacity
            while size > left and size > self.least:
                size //= 2
            size = min(size, left)
            piece = (doc_id, start, ids[start : start + size], total)
            start += size
            bin_ = self.open.setdefault(size, [])
            bin_.append(piece)
            if len(bin_) == self.capacity // size:
                number = self.sequence()
                for i, p in enumerate(bin_):
                    self.put(number, i * size, p)
                bin_.clear()

    def finish(self) -> None:
        """Join the pieces of bins that did not fill up, then cut at the capacity and by powers of two."""
        rest = [p for size in sorted(self.open, reverse=True) for p in self.open[size]]
        left = sum(len(p[2]) for p in rest)
        room, number = 0, 0
        for doc_id, start, ids, total in rest:
            while len(ids):
                if room == 0:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                    number, offset = self.sequence(), 0
                take = ids[:room]
                self.put(number, offset, (doc_id, start, take, total))
                start, ids = start + len(take), ids[len(take) :]
                offset, room, left = offset + len(take), room - len(take), left - len(take)
        self.open.clear()


def pack_documents(
    docs: DataFrame,
    spec: str,
    end_id: int,
    capacity: int = CAPACITY,
    least: int = LEAST,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most ``capacity`` tokens.

    ``spec`` is the content of a ``tokenizers`` file; ``end_id`` ends each document.
    ``capacity`` and ``least`` are powers of two. Returns a row per piece: doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id (worker times 2^32 plus a
    number), offset, ids (little-endian unsigned 32-bit; null without ``with_ids``).
    Each id is in one piece; a sequence has no gap and is as long as the capacity, a
    power of two, or, for bins of tails, shorter than the capacity by less than
    ``least``. Null and empty texts are the end id alone; repeated rows are
    documents of their own; an empty table gives no rows. A task holds its open
    bins: fewer than 2 * least bins of one sequence each.
    """
    if capacity & (capacity - 1) or least & (least - 1) or not 0 < least <= capacity:
        raise ValueError("capacity and least must be powers of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(spec)
        packer, end = Packer(TaskContext.get().partitionId(), capacity, least, with_ids), array("I", [end_id]).tobytes()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [()] * 8
            packer.rows = []
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            ids = pa.array(columns[7], pa.binary())
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            return pa.RecordBatch.from_arrays([*arrays, ids], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.frombuffer(words.ids(text.as_py() or "") + end, np.uint32)
                packer.add(doc_id.as_py(), ids.astype("<u4", copy=False))
                if len(packer.rows) >= 20_000:
                    yield flush()
        packer.finish()
        yield flush()

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCHEMA)
