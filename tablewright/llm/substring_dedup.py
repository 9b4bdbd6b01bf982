"""Repeated passages by fixed-block anchors.

Each text is cut into words. Its non-overlapping blocks of ``block`` words, from the
first word on, are the index; every rolling window of ``block`` words is a probe. Any
passage of 2 * block - 1 words holds a whole block of its text, so of two equal passages
of that length each has a block that a rolling window of the other one hits. Hits are then
extended: the passages of ``window`` words over a hit are counted by a wide hash, and those
that occur twice join to maximal repeats.

Texts are kept in bundles of a few MB, compressed, in one checkpoint. What moves between
bundles and the index are sorted hashes, each bundle's once, as differences in byte planes;
the index answers with the hashes that are hit. So a passage in a third of all texts is
one entry for each bundle, and no pair of places is ever listed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import durable

#: Bytes of text in a bundle, and hashes that meet in one part of the index.
BUNDLE_BYTES, PART_HASHES = 8 << 20, 2 << 20
#: Bits of a probe beyond those of the number of words: one probe in 18,000 hits a block by chance.
SPARE_BITS = 10

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LONG_WORD = 256


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed scramble of 64-bit numbers, one to one; the argument is overwritten."""
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def word_places(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that lie end to end, text i in data[cuts[i]:cuts[i + 1]]."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~_SPACE[data]
    first, last = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    first[inner] = solid[inner + 1]
    last[inner - 1] = solid[inner]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time."""
    size = ends - starts
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", held, strides=(1,))
    out = _mix(size.astype(np.uint64) + _U(seed))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    some = np.flatnonzero(size <= _LONG_WORD)
    at = 0
    while len(some):
        left = np.minimum(size[some] - at, 8)
        out[some] = _mix(out[some] * _U(0x9E3779B97F4A7C15) + (eights[starts[some] + at] & masks[left]))
        at += 8
        some = some[size[some] > at]
    for i in np.flatnonzero(size > _LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return out


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive words, put together from windows of doubled width."""
    out, upto, power, size = None, 0, words, 1
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    while True:
        if width & size:
            part = power[upto : upto + n]
            out = part.copy() if out is None else _mix(out * _U(0xC2B2AE3D27D4EB4F) + part)
            upto += size
        if 2 * size > width:
            return out
        power = _mix(power[:-size] * _U(0x9E3779B97F4A7C15) + power[size:])
        size *= 2


def whole_windows(of_text: np.ndarray, width: int) -> np.ndarray:
    """Which windows of ``width`` words lie in one text; ``of_text`` is each word's text."""
    n = len(of_text) - width + 1
    return of_text[:n] == of_text[width - 1 :] if n > 0 else np.zeros(0, bool)


def pack(ascending: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, in compressed byte planes."""
    steps = np.diff(ascending, prepend=_U(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


class Texts:
    """The texts of a bundle, end to end; text i is data[cuts[i]:cuts[i + 1]]."""

    def __init__(self, payload: bytes):
        table = pa.ipc.open_stream(payload).read_all().combine_chunks()
        self.rows = table.drop_columns(["text"])
        texts = table["text"].combine_chunks()
        offsets, data = texts.buffers()[1:]
        self.cuts = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8).copy()
        lo, hi = self.cuts[0], self.cuts[-1]
        self.data = np.frombuffer(data, np.uint8, hi - lo, lo) if hi > lo else np.zeros(0, np.uint8)
        self.cuts -= lo


class Bundle(Texts):
    """The texts of a bundle with their word places."""

    def __init__(self, payload: bytes):
        super().__init__(payload)
        self.starts, self.ends = word_places(self.data, self.cuts)
        self.first = np.searchsorted(self.starts, self.cuts)
        self.of_text = np.repeat(np.arange(len(self.cuts) - 1), np.diff(self.first))

    def hashes(self, seed: int) -> np.ndarray:
        return word_hashes(self.data, self.starts, self.ends, seed)


def bundles_of(rows: DataFrame, bundle_bytes: int) -> DataFrame:
    """bundle, n_words and payload (Arrow stream of the columns) from rows with text (binary); a text is never cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, 0

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
            with pa.ipc.new_stream(sink, table.schema, options=options) as out:
                out.write_table(table.combine_chunks())
            payload = sink.getvalue().to_pybytes()
            words = len(Bundle(payload).starts)
            first = pa.array([(part << 33) + n], pa.int64())
            return pa.RecordBatch.from_arrays(
                [first, pa.array([words], pa.int64()), pa.array([payload], pa.binary())], ["bundle", "n_words", "payload"]
            )

        for b in batches:
            if not len(b):
                continue
            part, text = b.column("part")[0].as_py(), b.column("text").cast(pa.large_binary())
            b = b.drop_columns(["part"])
            b = b.set_column(b.schema.get_field_index("text"), "text", text)
            lengths = np.diff(np.frombuffer(text.buffers()[1], np.int64, len(b) + 1, text.offset * 8))
            start = 0
            for i, k in enumerate(lengths.tolist()):
                if size and size + k > bundle_bytes:
                    held.append(b.slice(start, i - start))
                    yield close()
                    held, size, n, start = [], 0, n + 1, i
                size += k + 1
            held.append(b.slice(start))
        if held:
            yield close()

    rows = rows.withColumn("part", F.spark_partition_id().cast("long"))
    return rows.mapInArrow(run, "bundle long, n_words long, payload binary")


def cut_by_range(ascending: np.ndarray, bits: int, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of sorted numbers of ``bits`` bits, by equal ranges of their values."""
    edges = [-(-(p << bits) // parts) for p in range(1, parts)]
    cuts = [0, *np.searchsorted(ascending, np.array(edges, np.uint64)).tolist(), len(ascending)]
    for p in range(parts):
        if cuts[p] < cuts[p + 1]:
            yield p, cuts[p], cuts[p + 1]


def _probes(payload: bytes, block: int, bits: int) -> np.ndarray:
    """Each distinct probe of a bundle times four, plus two if it occurs again in it, plus one if a block."""
    b = Bundle(payload)
    found = rolling(b.hashes(1), block) >> _U(64 - bits)
    place = np.arange(len(found)) - b.first[b.of_text[: len(found)]]
    keys = (found << _U(1)) + (place % block == 0).astype(np.uint64)
    keys = np.sort(keys[whole_windows(b.of_text, block)])
    values = keys >> _U(1)
    # A block sorts behind the other probes of its value.
    last = np.flatnonzero(np.append(values[1:] != values[:-1], True)) if len(values) else np.zeros(0, np.int64)
    again = np.diff(last, prepend=-1) > 1
    return (values[last] << _U(2)) + (again.astype(np.uint64) << _U(1)) + (keys[last] & _U(1))


def _hits(probes: list[np.ndarray]) -> list[np.ndarray]:
    """Of each bundle's probes those that some block has and that occur twice in all."""
    every = np.concatenate([np.zeros(0, np.uint64), *probes])
    values = every >> _U(2)
    order = np.argsort(values, kind="stable")
    ranked, flags = values[order], every[order] & _U(3)
    new = np.append(True, ranked[1:] != ranked[:-1]) if len(ranked) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in probes]
    found = np.bitwise_or.reduceat(flags, starts)
    twice = (np.diff(np.append(starts, len(ranked))) > 1) | (found & _U(2) > 0)
    hit = np.empty(len(every), bool)
    hit[order] = (twice & (found & _U(1) > 0))[run]
    ends = np.cumsum([0, *map(len, probes)])
    return [values[s:e][hit[s:e]] for s, e in zip(ends[:-1], ends[1:], strict=True)]


def member(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def _candidates(payload: bytes, hits: np.ndarray, block: int, window: int, bits: int) -> tuple[np.ndarray, ...]:
    """Both hashes of each distinct passage over a hit, ascending, and whether it occurs again in the bundle."""
    b = Bundle(payload)
    one, two = b.hashes(1), b.hashes(2)
    hit = member(rolling(one, block) >> _U(64 - bits), hits)
    seen = np.concatenate([[0], np.cumsum(hit & whole_windows(b.of_text, block))])
    whole = whole_windows(b.of_text, window)
    n = len(whole)
    at = np.flatnonzero(whole & (seen[window - block + 1 :][:n] > seen[:n])) if n else np.zeros(0, np.int64)
    one, two = rolling(one, window)[at], rolling(two, window)[at]
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])) if len(one) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return one[first], two[first], np.diff(np.append(first, len(one))) > 1


def _repeated(sent: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Of each bundle's passages which occur twice in all."""
    one, two, again = (np.concatenate([x[k] for x in sent]) for k in range(3))
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    if not len(starts):
        return [np.zeros(0, bool) for _ in sent]
    twice = (np.diff(np.append(starts, len(a))) > 1) | np.bitwise_or.reduceat(again[order], starts)
    flag = np.empty(len(a), bool)
    flag[order] = twice[np.cumsum(new) - 1]
    ends = np.cumsum([0, *[len(x[0]) for x in sent]])
    return [flag[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]


def _low_bytes(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _from_low_bytes(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def covered_words(repeated: np.ndarray, width: int, n_words: int) -> np.ndarray:
    """Which words the windows that start at the marked places cover."""
    edge = np.zeros(n_words + 1, np.int64)
    at = np.flatnonzero(repeated)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeated_passages(
    docs: DataFrame,
    window: int = 35,
    with_kept: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
    bundle_bytes: int = BUNDLE_BYTES,
    part_hashes: int = PART_HASHES,
) -> DataFrame:
    """Remove every word of a passage of ``window`` words that starts anywhere else too, in any text.

    Words are runs of characters other than space, tab, line feed, vertical tab, form
    feed and carriage return. Returns a row per row of ``docs``: doc_id, n_words,
    n_removed, spans (maximal removed runs as first word and word behind the last),
    kept (the other words joined by one space; only ``with_kept``) and kept_sha256.

    Null and empty texts have no words. Texts shorter than the window keep all. Repeated
    rows lose what they share with each other, as do rows without doc_id. An empty table
    gives an empty result; further columns are not read. Passages are judged on the input.
    Two passages count as equal when two hashes of 64 bits and of enough bits agree that
    one accidental agreement is expected in 2^33 runs. A text is held whole by one task,
    with arrays of about twenty times its size.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    block = (window + 1) // 2
    text = F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text")
    bundles = durable(bundles_of(docs.select(docs[id_col].cast("long").alias("doc_id"), text), bundle_bytes))
    total = bundles.agg(F.sum("n_words")).first()[0] or 0
    parts = max(1, math.ceil(total / part_hashes))
    bits = min(62, total.bit_length() + SPARE_BITS)
    more = min(8, max(1, math.ceil((2 * total.bit_length() + 32 - 64) / 8)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bundle, payload in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = _probes(payload.as_py(), block, bits)
                cut = list(cut_by_range(found, bits + 2, parts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p for p, _, _ in cut], pa.int32()),
                        pa.array([bundle] * len(cut), pa.int64()),
                        pa.array([pack(found[s:e]) for _, s, e in cut], pa.binary()),
                    ],
                    ["part", "bundle", "found"],
                )

    def index(table: pa.Table) -> pa.Table:
        hits = _hits([unpack(x.as_py()) for x in table["found"]])
        some = [i for i, h in enumerate(hits) if len(h)]
        return pa.table(
            {
                "bundle": table["bundle"].take(pa.array(some, pa.int64())),
                "hits": pa.array([pack(hits[i]) for i in some], pa.binary()),
            }
        )

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for bundle, payload in zip(left["bundle"].to_pylist(), left["payload"], strict=True):
            if not right.num_rows:
                continue
            hits = np.sort(np.concatenate([unpack(x.as_py()) for x in right["hits"]]))
            one, two, again = _candidates(payload.as_py(), hits, block, window, bits)
            for p, s, e in cut_by_range(one, 64, parts):
                out.append((p, bundle, pack(one[s:e]), _low_bytes(two[s:e], more), np.packbits(again[s:e]).tobytes()))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        names = ("part", "bundle", "one", "two", "again")
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    def count(table: pa.Table) -> pa.Table:
        sent = []
        for one, two, again in zip(table["one"], table["two"], table["again"], strict=True):
            a = unpack(one.as_py())
            flags = np.unpackbits(np.frombuffer(again.as_py(), np.uint8), count=len(a)).astype(bool)
            sent.append((a, _from_low_bytes(two.as_py(), more), flags))
        twice = _repeated(sent)
        some = [i for i, t in enumerate(twice) if t.any()]
        return pa.table(
            {
                "bundle": table["bundle"].take(pa.array(some, pa.int64())),
                "one": pa.array([pack(sent[i][0][twice[i]]) for i in some], pa.binary()),
                # Two bytes of the other hash are enough among the passages of a bundle.
                "two": pa.array([_low_bytes(sent[i][1][twice[i]], min(2, more)) for i in some], pa.binary()),
            }
        )

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        width = min(2, more)
        mask = _U((1 << 8 * width) - 1)
        ids, out = [], []
        for payload in left["payload"]:
            b = Bundle(payload.as_py())
            gone = np.zeros(len(b.starts), bool)
            if right.num_rows:
                one = np.concatenate([unpack(x.as_py()) for x in right["one"]])
                two = np.concatenate([_from_low_bytes(x.as_py(), width) for x in right["two"]])
                a, c = rolling(b.hashes(1), window), rolling(b.hashes(2), window) & mask
                found = member(a, np.sort(one)) & whole_windows(b.of_text, window)
                pairs = set(zip(one.tolist(), two.tolist(), strict=True)) if len(np.unique(one)) < len(one) else None
                if pairs is None and len(one):
                    order = np.argsort(one)
                    near = np.minimum(np.searchsorted(one[order], a), len(one) - 1)
                    found &= two[order][near] == c
                elif pairs:
                    found &= np.array([p in pairs for p in zip(a.tolist(), c.tolist(), strict=True)], bool)
                gone = covered_words(found, window, len(b.starts))
            ids += b.rows["doc_id"].to_pylist()
            out += _results(b, gone, with_kept)
        columns = list(zip(*out, strict=True)) or [()] * 5
        result = {"doc_id": pa.array(ids, pa.int64())}
        names, kinds = ("n_words", "n_removed", "spans", "kept", "kept_sha256"), (pa.int64(), pa.int64(), _SPANS, pa.string(), pa.string())
        result |= {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)}
        return pa.table(result if with_kept else {k: v for k, v in result.items() if k != "kept"})

    found = bundles.select("bundle", "payload").mapInArrow(probe, "part int, bundle long, found binary")
    hits = found.groupBy("part").applyInArrow(index, "bundle long, hits binary")
    texts = bundles.select("bundle", "payload")
    sent = texts.groupBy("bundle").cogroup(hits.groupBy("bundle")).applyInArrow(
        extend, "part int, bundle long, one binary, two binary, again binary"
    )
    twice = sent.groupBy("part").applyInArrow(count, "bundle long, one binary, two binary")
    kept = "kept string, " if with_kept else ""
    schema = f"doc_id long, n_words long, n_removed long, spans array<struct<first:long,behind:long>>, {kept}kept_sha256 string"
    return texts.groupBy("bundle").cogroup(twice.groupBy("bundle")).applyInArrow(cut, schema)


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("behind", pa.int64())]))


def _results(b: Bundle, gone: np.ndarray, with_kept: bool) -> list[tuple]:
    """(n_words, n_removed, spans, kept, kept_sha256) of each text of a bundle."""
    whole, out = b.data.tobytes(), []
    for i, (s, e) in enumerate(zip(b.first[:-1].tolist(), b.first[1:].tolist(), strict=True)):
        words, cut = whole[b.cuts[i] : b.cuts[i + 1]].split(), gone[s:e]
        spans = []
        if cut.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[0], cut.astype(np.int8), [0]]))).tolist()
            spans = [{"first": f, "behind": t} for f, t in zip(edges[::2], edges[1::2], strict=True)]
            ends = [0, *edges, len(words)]
            words = [w for f, t in zip(ends[::2], ends[1::2], strict=True) for w in words[f:t]]
        kept = b" ".join(words)
        out.append((e - s, int(cut.sum()), spans, kept.decode() if with_kept else None, hashlib.sha256(kept).hexdigest()))
    return out
