"""Removal of long byte strings that a document with a smaller id has as well.

Column-wise multi-document construction: the strings of a collection get their symbols
from the right, one symbol per string and round. A round sorts the suffixes of the
collection by the symbols that the Burrows-Wheeler transform holds for the round before
(one stable pass), which gives the next transform, and updates the common prefixes of
neighbours: one more than the least common prefix between the places they came from.
After the last round, suffixes whose neighbours share ``length`` symbols start with
the same string.

A corpus is no single collection: a round for each of a document's symbols would have no
end. Strings that can be equal are brought together first. Of the ``k``-byte strings in
every window of ``length`` bytes the one with the least hash is its anchor. Equal windows
have equal anchors at equal places, so only anchors that two documents share count,
and each contributes its context: the bytes of the windows that it is the anchor of, at
most 2 * length - k. Every window is in one context.

Texts are kept in bundles, compressed, in one checkpoint. A bundle sends the sorted hashes of
its anchors and learns which are shared, then the hashes of the different contexts of those with
the least id of each. All but the smallest id lose a context that is the same in both (64 bits,
beside those of the anchor). Only contexts that differ from another one of their anchor move as
bytes, one for each string and bundle: those of an anchor that have a side in common with another one, and those of neighbouring
anchors up to ``SORTED`` strings, are one collection. The windows of an anchor with more than
``collection`` contexts are dealt by their bytes. So a passage in a third of all documents is one row for each bundle.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from tablewright.llm.common import durable, release
from tablewright.llm.substring_dedup import Texts, bundles_of, cut_by_range, pack, unpack

LENGTH, ANCHOR = 50, 24
#: Bytes of text in a bundle, contexts of an anchor at most in a collection, strings from which on a
#: collection takes no other anchor (its arrays stay in a core's cache), anchors that meet in one part, and parts at least.
BUNDLE_BYTES, COLLECTION, SORTED, PART_ANCHORS, LEAST_PARTS = 16 << 20, 2048, 256, 2_000_000, 48
#: Bits of an anchor's hash beyond those of their number: one anchor in 1,000 seems shared by chance.
SPARE_BITS = 10
_SLICE = 1 << 16
_LAST_ID = (1 << 63) - 1


class AnchorFinder:
    """Anchors of byte strings: least hash of k bytes in every window, the leftmost on ties."""

    def __init__(self, k: int, length: int):
        self.k, self.length, self.width = k, length, length - k + 1
        base = 0x9E3779B97F4A7C15
        steps = np.ones(_SLICE + length + 2, np.uint64)
        steps[1:] = base
        self.up = np.cumprod(steps, dtype=np.uint64)
        steps[1:] = pow(base, -1, 1 << 64)
        self.down = np.cumprod(steps, dtype=np.uint64)

    def find(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the anchors of a text."""
        return self.find_all(data, np.array([0, len(data)]))[:2]

    def find_all(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Anchors of texts that lie end to end, text i in data[cuts[i]:cuts[i + 1]].

        Places, hashes, texts, and the first and the last start of the windows that an
        anchor is the anchor of. Each window of a text has one anchor.
        """
        n = len(data) - self.length + 1
        # Windows that reach into the next text don't count.
        edge = np.zeros(len(data) + 1, np.int8)
        np.add.at(edge, np.maximum(cuts[:-1], cuts[1:] - self.length + 1), 1)
        np.add.at(edge, cuts[1:], -1)
        inside = np.cumsum(edge[:-1], dtype=np.int8) == 0
        low = np.uint64(_SLICE - 1)
        numbers = np.arange(_SLICE, dtype=np.uint64)
        places, hashes, firsts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        step = _SLICE - self.width
        for s in range(0, max(n, 0), step):
            part = data[s : s + min(step, n - s) + self.length - 1].astype(np.uint64)
            part += np.uint64(1)
            part *= self.up[: len(part)]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part, out=sums[1:])
            h = sums[self.k :] - sums[: -self.k]
            h *= self.down[: len(h)]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            least = h & ~low
            least |= numbers[: len(h)]
            span, count = 1, len(h) - self.width + 1
            while span < self.width:
                move = min(span, self.width - span)
                least = np.minimum(least[: len(least) - move], least[move:])
                span += move
            first = np.flatnonzero(inside[s : s + count])
            at = (least[first] & low).astype(np.int64)
            new = np.ones(len(at), bool)
            new[1:] = at[1:] != at[:-1]
            places.append(at[new] + s)
            hashes.append(h[at[new]])
            firsts.append(first[new] + s)
        place, h, first = map(np.concatenate, (places, hashes, firsts))
        new = np.ones(len(place), bool)
        new[1:] = place[1:] != place[:-1]
        place, h, first = place[new], h[new], first[new]
        doc = np.searchsorted(cuts, first, side="right") - 1
        last = np.append(first[1:], n) - 1
        return place, h, doc, first, np.minimum(last, cuts[doc + 1] - self.length)


def common_classes(strings: list[bytes], length: int) -> np.ndarray:
    """For every string, one after the other, and every place in it: the class of the ``length`` bytes there.

    Equal classes mean equal bytes; places with fewer bytes left have class -1.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum(sizes)
    # The suffixes in order: where each starts, and what it shares with the one before. A suffix of
    # no symbols starts at its string's end, told from the next string's start by its place in the order.
    empty = np.arange(len(strings)) + ends
    start = np.concatenate(([0], empty[:-1] + 1)).astype(np.int64)
    symbols = np.zeros(int(empty[-1]) + 1 if len(strings) else 0, np.uint8)
    inner = np.ones(len(symbols), bool)
    inner[empty] = False
    symbols[inner] = flat
    more = np.ones(len(symbols), bool)
    more[start] = False
    at, shared, none = empty, np.zeros(len(strings), np.uint8), np.zeros(len(strings), np.uint8)
    for _ in range(int(sizes.max(initial=0))):
        from_ = np.flatnonzero(more.take(at))
        before = at.take(from_) - 1
        symbol = symbols.take(before)
        order = np.argsort(symbol, kind="stable")
        from_, symbol = from_.take(order), symbol.take(order)
        same = np.flatnonzero(symbol[1:] == symbol[:-1])
        common = np.zeros(len(from_), np.uint8)
        common[same + 1] = np.minimum(_least(shared, from_.take(same) + 1, from_.take(same + 1) + 1), length - 1) + 1
        at = np.concatenate((empty, before.take(order)))
        shared = np.concatenate((none, common))
    size = np.repeat(empty, sizes + 1)[at] - at
    number = np.cumsum((shared < length) | (size < length))
    out = np.full(len(symbols), -1, np.int64)
    whole = size >= length
    out[at[whole]] = number[whole]
    return out[inner]


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least value in each range, high exclusive; no range is empty."""
    # Most neighbours were neighbours before: their range is one place.
    out = values.take(low)
    size = high - low
    wide = np.flatnonzero(size > 1)
    if not len(wide):
        return out
    low, size = low.take(wide), size.take(wide)
    levels = int(size.max()).bit_length()
    table = np.empty((levels, len(values)), np.uint8)
    table[0] = values
    for k in range(1, levels):
        half = 1 << (k - 1)
        np.minimum(table[k - 1, :-half], table[k - 1, half:], out=table[k, :-half])
        table[k, -half:] = table[k - 1, -half:]
    level = np.frexp(size.astype(np.float32))[1] - 1
    flat, first = table.ravel(), level * len(values) + low
    out[wide] = np.minimum(flat.take(first), flat.take(first + size - (1 << level)))
    return out


def _squeeze(values: np.ndarray) -> bytes:
    """Numbers of one width, in compressed byte planes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1) if len(values) else np.zeros((0, 1), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.T.tobytes())


def _loose(blob: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _begins(*sorted_values: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before."""
    new = np.ones(len(sorted_values[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_values])
    return new


class Anchored(Texts):
    """The texts of a bundle with their anchors, in the order of ``bits`` bits of the anchors' hashes."""

    def __init__(self, payload: bytes, finder: AnchorFinder, bits: int):
        super().__init__(payload)
        place, h, doc, first, last = finder.find_all(self.data, self.cuts)
        # The least of many hashes is a small number, so it is scrambled anew before it is cut into ranges.
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h >>= np.uint64(64 - bits)
        order = np.argsort(h, kind="stable")
        self.anchor, self.doc, self.start, self.end = h[order], doc[order], first[order], last[order] + finder.length
        self.inside = (place - first)[order]
        self.lead = np.flatnonzero(_begins(self.anchor))
        self.copies = np.diff(np.append(self.lead, len(h)))

    def distinct(self) -> np.ndarray:
        """Each different anchor times two, plus one if two texts of the bundle have it."""
        several = self.doc[self.lead] != self.doc[self.lead + self.copies - 1]
        return (self.anchor[self.lead] << np.uint64(1)) | several.astype(np.uint64)


class Contexts:
    """The different contexts of a bundle's shared anchors with their least ids, and all places of each."""

    def __init__(self, b: Anchored, shared: np.ndarray):
        at = np.flatnonzero(np.repeat(shared, b.copies))
        self.blob = b.data.tobytes()
        start, end = b.start[at], b.end[at]
        spans = zip(start.tolist(), end.tolist(), strict=True)
        digest = xxhash.xxh3_64_intdigest
        text = np.fromiter((digest(self.blob[s:e]) for s, e in spans), np.uint64, len(at))
        anchor, ids = b.anchor[at], b.rows["id"].to_numpy()[b.doc[at]]
        order = np.lexsort((ids, text, anchor))
        anchor, text, ids, self.start, self.end = anchor[order], text[order], ids[order], start[order], end[order]
        #: Where a context has its anchor.
        self.inside = b.inside[at][order]
        new = _begins(anchor, text)
        self.lead = np.flatnonzero(new)
        self.anchor, self.text, self.least = anchor[self.lead], text[self.lead], ids[self.lead]
        #: Of each place its context, and whether its document has the least id of those in the bundle.
        self.of = np.cumsum(new) - 1
        self.first = ids == self.least[self.of]


def _told(bundle: int, cuts: list[tuple[int, int, int]], **columns) -> pa.Table:
    """A row for each part of a bundle's sorted values."""
    kinds = {k: pa.binary() for k in columns}
    return pa.table(
        {"part": pa.array([p for p, _, _ in cuts], pa.int64()), "bundle": pa.array([bundle] * len(cuts), pa.int64())}
        | {k: pa.array([f(s, e) for _, s, e in cuts], kinds[k]) for k, f in columns.items()}
    )


def _answered(table: pa.Table, column: str) -> np.ndarray:
    """What all parts say of a bundle's values, in the order of the values."""
    said = sorted(zip(table["part"].to_pylist(), table[column].to_pylist(), strict=True))
    return np.concatenate([np.zeros(0, np.uint8), *(_loose(x, np.uint8) for _, x in said)])


def _answers(table: pa.Table, sizes: list[int], column: str, values: np.ndarray) -> pa.Table:
    ends = np.cumsum([0, *sizes]).tolist()
    said = [_squeeze(values[s:e].astype(np.uint8)) for s, e in zip(ends[:-1], ends[1:], strict=True)]
    return pa.table({"part": table["part"], "bundle": table["bundle"], column: pa.array(said, pa.binary())})


def _shared(table: pa.Table) -> pa.Table:
    """Which anchors of a part two texts have."""
    told = [unpack(x) for x in table["anchors"].to_pylist()]
    every = np.concatenate(told)
    order = np.argsort(every, kind="stable")
    values = every[order] >> np.uint64(1)
    new = _begins(values)
    lead = np.flatnonzero(new)
    behind = np.append(lead[1:], len(values))
    # Of equal anchors one that two texts of its bundle have is the last.
    several = (behind - lead > 1) | ((every[order] & np.uint64(1)) > 0)[behind - 1]
    out = np.empty(len(every), bool)
    out[order] = several[np.cumsum(new) - 1]
    return _answers(table, [len(x) for x in told], "shared", out)


#: What is to be done with a context: nothing, remove it, compare it, compare each of its windows.
_KEEP, _REMOVE, _COMPARE, _WINDOWS = 0, 1, 2, 3
_NO_SIDE = 255


def _judged(table: pa.Table, collection: int) -> pa.Table:
    """Of each context of a part: remove it if a smaller id has it too, compare it if its anchor has others."""
    told = [unpack(x) for x in table["anchors"].to_pylist()]
    anchor = np.concatenate(told)
    text = np.concatenate([_loose(x, np.uint64) for x in table["texts"].to_pylist()])
    ids = np.concatenate([_loose(x, np.int64) for x in table["ids"].to_pylist()])
    order = np.lexsort((ids, text, anchor))
    anchor, text, ids = anchor[order], text[order], ids[order]
    new = _begins(anchor, text)
    least, of = ids[new], np.cumsum(new) - 1
    begins = _begins(anchor[new])
    lead = np.flatnonzero(begins)
    sizes = np.diff(np.append(lead, len(least)))
    # Contexts that all have the same least id remove nothing from each other.
    differ = np.minimum.reduceat(least, lead) != np.maximum.reduceat(least, lead)
    what = np.where(differ, np.where(sizes > collection, _WINDOWS, _COMPARE), _KEEP)
    out = np.empty(len(ids), np.uint8)
    out[order] = np.where(ids > least[of], _REMOVE, what[np.cumsum(begins) - 1][of])
    return _answers(table, [len(x) for x in told], "what", out)


_SENT = ["part", "bundle", "anchors", "insides", "ids", "sizes", "texts", "counts", "starts"]
_SENT_SCHEMA = "part long, bundle long, " + ", ".join(f"{x} binary" for x in _SENT[2:])


def _strings(
    bundle: int,
    anchor: np.ndarray,
    inside: np.ndarray,
    ids: np.ndarray,
    texts: list[bytes],
    starts: list[np.ndarray],
    cuts: list[tuple[int, int, int]],
) -> pa.Table:
    """Strings to compare, sorted by anchor, with the anchor's place in them, their ids and the places where they start."""
    sizes, counts = np.array([len(x) for x in texts], np.uint8), np.array([len(x) for x in starts], np.uint32)
    pressed = zstandard.ZstdCompressor(level=1)
    return _told(
        bundle,
        cuts,
        anchors=lambda s, e: pack(anchor[s:e]),
        insides=lambda s, e: _squeeze(inside[s:e].astype(np.uint8)),
        ids=lambda s, e: _squeeze(ids[s:e]),
        sizes=lambda s, e: _squeeze(sizes[s:e]),
        texts=lambda s, e: pressed.compress(b"".join(texts[s:e])),
        counts=lambda s, e: _squeeze(counts[s:e]),
        starts=lambda s, e: _squeeze(np.concatenate(starts[s:e]).astype(np.uint32)),
    )


def _ranges(found: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """Ranges as runs, start and end; ranges that only touch may lie in two texts and stay apart."""
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *(np.stack(x, axis=1) for x in found)])
    return _squeeze((merged(pairs - [0, 1]) + [0, 1]).astype(np.uint32).ravel())


def _to_compare(bundle: int, c: Contexts, what: np.ndarray, length: int, bits: int, parts: int) -> Iterator[pa.Table]:
    """What a bundle itself can tell of its ranges to remove, and the strings that are to be compared."""
    lost = ~c.first | (what == _REMOVE)[c.of]
    gone = [(c.start[lost], c.end[lost])]
    runs = np.append(c.lead, len(c.of))

    def places(j: int) -> np.ndarray:
        """The starts of a context in the documents with the least id."""
        s, e = runs[j], runs[j + 1]
        return c.start[s:e][c.first[s:e]]

    some = np.flatnonzero(what == _COMPARE)
    spans = zip(c.start[c.lead[some]].tolist(), c.end[c.lead[some]].tolist(), strict=True)
    texts, starts = [c.blob[s:e] for s, e in spans], [places(j) for j in some.tolist()]
    cuts = list(cut_by_range(c.anchor[some], bits, parts))
    yield _strings(bundle, c.anchor[some], c.inside[c.lead[some]], c.least[some], texts, starts, cuts)
    # The windows of an anchor with very many contexts are dealt by their bytes, each different one once.
    windows: dict[bytes, tuple[int, list]] = {}
    for j in np.flatnonzero(what == _WINDOWS).tolist():
        i, starts = int(c.least[j]), places(j)
        s, e = int(c.start[c.lead[j]]), int(c.end[c.lead[j]])
        for k in range(e - s - length + 1):
            window = c.blob[s + k : s + k + length]
            least, held = windows.setdefault(window, (i, []))
            if i > least:
                gone.append((starts + k, starts + k + length))
                continue
            if i < least:
                gone += [(x, x + length) for x in held]
                windows[window] = (i, held := [])
            held.append(starts + k)
    keys = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in windows), np.uint64, len(windows)) >> np.uint64(64 - bits)
    order = np.argsort(keys, kind="stable")
    listed = list(windows.items())
    listed = [listed[k] for k in order.tolist()]
    ids = np.array([i for _, (i, _) in listed], np.int64)
    texts, starts = [w for w, _ in listed], [np.concatenate(h) for _, (_, h) in listed]
    # Equal windows are equal as a whole, so they have no side to look at.
    inside = np.full(len(keys), _NO_SIDE)
    yield _strings(bundle, keys[order], inside, ids, texts, starts, list(cut_by_range(keys[order], bits, parts)))
    columns = [[parts + bundle], [bundle], *[[b""]] * 6, [_ranges(gone)]]
    yield pa.table([pa.array(x, pa.binary() if n > 1 else pa.int64()) for n, x in enumerate(columns)], _SENT)


def _decide(rows: list[tuple], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bundle, start, end) that rows (id, bundle, starts, string, ...) of one collection lose."""
    strings = list(dict.fromkeys(r[3] for r in rows))
    classes = common_classes(strings, length)
    at = dict(zip(strings, np.cumsum([0, *map(len, strings[:-1])]).tolist(), strict=True))
    sizes = np.array([len(r[3]) - length + 1 for r in rows])
    behind = np.cumsum(sizes)
    of = np.repeat(np.arange(len(rows)), sizes)
    place = np.arange(len(of)) - np.repeat(behind - sizes, sizes)
    mine = classes[np.repeat(np.array([at[r[3]] for r in rows]), sizes) + place]
    ids = np.array([r[0] for r in rows], np.int64)
    least = np.full(int(classes.max(initial=-1)) + 1, _LAST_ID, np.int64)
    np.minimum.at(least, mine, ids[of])
    gone = np.flatnonzero(least[mine] < ids[of])
    begins = np.flatnonzero(_begins(of[gone], gone - np.arange(len(gone))))
    ends = gone[np.append(begins[1:], len(gone)) - 1] if len(gone) else gone
    for s, e in zip(gone[begins].tolist(), ends.tolist(), strict=True):
        _, bundle, starts, *_ = rows[of[s]]
        yield bundle, starts + place[s], starts + place[e] + length


def _with_equal_side(group: list[tuple], k: int, length: int) -> list[tuple]:
    """Of the strings of an anchor what can hold a window of another one.

    Of the bytes of a window beside its anchor half at least are on one side, so it is in
    no other string unless that half is. Where only one side is, only windows that
    reach as far there are left.
    """
    half = (length - k + 1) // 2
    sides: tuple[dict, dict] = {}, {}
    cut = []
    for inside, string in {(r[4], r[3]) for r in group}:
        both = string[max(0, inside - half) : inside + k], string[inside : inside + k + half]
        for side, seen in zip(both, sides, strict=True):
            seen[side] = len(side) == k + half and side in seen
        cut.append((inside, string, both))
    left = {}
    for inside, string, both in cut:
        found = [seen[side] for side, seen in zip(both, sides, strict=True)]
        if any(found):
            s = 0 if found[0] else max(0, inside - (length - k - half))
            left[inside, string] = s, string[s:] if found[1] else string[s : inside - half + length]
    return [(i, b, at + x[0], x[1], inside) for i, b, at, text, inside in group if (x := left.get((inside, text)))]


def _compared(table: pa.Table, k: int, length: int, collection: int, parts: int) -> pa.Table:
    """bundle and ranges to remove, of a part; what a bundle could tell by itself is passed on."""
    if table["part"][0].as_py() >= parts:
        return pa.table({"bundle": table["bundle"], "ranges": table["starts"]})
    anchors, rows = [], []
    columns = [c.to_pylist() for c in table.columns[1:]]
    for bundle, anchor, insides, ids, sizes, texts, counts, starts in zip(*columns, strict=True):
        anchors.append(unpack(anchor))
        cuts = np.cumsum([0, *_loose(sizes, np.uint8)]).tolist()
        blob = zstandard.ZstdDecompressor().decompress(texts)
        places = np.split(_loose(starts, np.uint32).astype(np.int64), np.cumsum(_loose(counts, np.uint32))[:-1])
        pieces = [blob[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        ids, insides = _loose(ids, np.int64).tolist(), _loose(insides, np.uint8).tolist()
        rows += zip(ids, [bundle] * len(places), places, pieces, insides, strict=True)
    anchor = np.concatenate(anchors)
    order = np.argsort(anchor, kind="stable")
    lead = np.append(np.flatnonzero(_begins(anchor[order])), len(order)).tolist()
    found: dict[int, list] = {b: [] for b in table["bundle"].to_pylist()}
    held: list[tuple] = []

    def close() -> None:
        for bundle, s, e in _decide(held, length) if held else ():
            found[bundle].append((s, e))
        held.clear()

    for s, e in zip(lead[:-1], lead[1:], strict=True):
        group = [rows[k] for k in order[s:e].tolist()]
        if all(r[3] == group[0][3] for r in group):
            # One string: nothing to sort, all but the smallest id lose it.
            least = min(r[0] for r in group)
            for i, bundle, starts, string, _ in group:
                if i > least:
                    found[bundle].append((starts, starts + len(string)))
            continue
        held += _with_equal_side(group, k, length) if group[0][4] != _NO_SIDE else group
        if len(held) >= min(collection, SORTED):
            close()
    close()
    some = [b for b, x in found.items() if x]
    return pa.table({"bundle": pa.array(some, pa.int64()), "ranges": pa.array([_ranges(found[b]) for b in some], pa.binary())})


def _cut(payload: bytes, ranges: list[bytes], with_kept: bool) -> pa.Table:
    """A row per text of a bundle without its ranges."""
    b = Texts(payload)
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *(_loose(x, np.uint32).reshape(-1, 2) for x in ranges)]).astype(np.int64)
    doc = np.searchsorted(b.cuts, pairs[:, 0], side="right") - 1
    # A run ends with its text: texts are kept one byte apart while runs are joined.
    spans = merged(pairs + doc[:, None])
    edges = b.cuts + np.arange(len(b.cuts))
    at = np.searchsorted(spans[:, 0], edges).tolist()
    blob, out = b.data.tobytes(), []
    for n, (i, s, e) in enumerate(zip(b.rows["id"].to_pylist(), b.cuts[:-1].tolist(), b.cuts[1:].tolist(), strict=True)):
        text, mine = blob[s:e], spans[at[n] : at[n + 1]] - edges[n]
        ends = [0, *mine.ravel().tolist(), len(text)]
        kept = b"".join(text[x:y] for x, y in zip(ends[::2], ends[1::2], strict=True)) if len(mine) else text
        sha = hashlib.sha256(kept).hexdigest()
        doc_id = None if i == _LAST_ID else i
        removed, runs = len(text) - len(kept), mine.astype("<i8").tobytes()
        out.append((doc_id, len(text), removed, len(mine), sha, runs, kept if with_kept else None))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
    columns = list(zip(*out, strict=True)) or [()] * 7
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    anchor: int = ANCHOR,
    collection: int = COLLECTION,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_kept: bool = True,
) -> DataFrame:
    """Remove every byte covered by ``length`` bytes that also start in a document with a smaller id.

    Texts are UTF-8 bytes and matches never cross documents; strings are judged on
    the input. Returns a row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans
    (maximal removed runs), kept_sha256, spans (removed runs: start and end as
    little-endian 64-bit pairs), kept (the remaining bytes; null without
    ``with_kept``).

    Null text counts as empty; texts shorter than ``length`` lose nothing. Rows with
    the same doc_id do not remove from each other; rows without doc_id come after
    all others, and do not remove from each other. An empty table gives an empty
    result; further columns are not read.
    """
    if not 8 <= anchor <= length <= 120:
        raise ValueError("8 <= anchor <= length <= 120")
    rows = docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(_LAST_ID)).alias("id"),
        F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"),
    )
    texts = durable(bundles_of(rows, BUNDLE_BYTES)).select("bundle", "payload")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    anchors = 2 * total // (length - anchor + 2)
    parts = max(LEAST_PARTS, math.ceil(anchors / PART_ANCHORS))
    bits = min(62, anchors.bit_length() + SPARE_BITS)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = AnchorFinder(anchor, length)
        for b in batches:
            for bundle, payload in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = Anchored(payload.as_py(), finder, bits).distinct()
                cuts = list(cut_by_range(found, bits + 1, parts))
                yield from _told(bundle, cuts, anchors=lambda s, e, found=found: pack(found[s:e])).to_batches()

    def opened(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, Contexts]]:
        """The bundle of a group, if a part of it is shared."""
        finder = AnchorFinder(anchor, length) if left.num_rows and right.num_rows else None
        for bundle, payload in zip(left["bundle"].to_pylist(), left["payload"], strict=True):
            if finder:
                yield bundle, Contexts(Anchored(payload.as_py(), finder, bits), _answered(right, "shared") > 0)

    def contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [_told(0, [], anchors=None, texts=None, ids=None)]
        for bundle, c in opened(left, right):
            out.append(
                _told(
                    bundle,
                    list(cut_by_range(c.anchor, bits, parts)),
                    anchors=lambda s, e, c=c: pack(c.anchor[s:e]),
                    texts=lambda s, e, c=c: _squeeze(c.text[s:e]),
                    ids=lambda s, e, c=c: _squeeze(c.least[s:e]),
                )
            )
        return pa.concat_tables(out)

    def strings(left: pa.Table, right: pa.Table) -> pa.Table:
        judged = right.filter(pc.is_valid(right["what"]))
        out = [_told(0, [], **dict.fromkeys(_SENT[2:]))]
        for bundle, c in opened(left, right.filter(pc.is_valid(right["shared"]))):
            out += _to_compare(bundle, c, _answered(judged, "what"), length, bits, parts)
        return pa.concat_tables(out)

    def judged(table: pa.Table) -> pa.Table:
        return _judged(table, collection)

    def compared(table: pa.Table) -> pa.Table:
        return _compared(table, anchor, length, collection, parts)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        ranges = right["ranges"].to_pylist()
        return pa.concat_tables([_cut(x.as_py(), ranges, with_kept) for x in left["payload"]])

    def beside(other: DataFrame) -> PandasCogroupedOps:
        return texts.groupBy("bundle").cogroup(other.groupBy("bundle"))

    found = texts.mapInArrow(seen, "part long, bundle long, anchors binary")
    shared = durable(found.groupBy("part").applyInArrow(_shared, "part long, bundle long, shared binary"))
    sent = beside(shared).applyInArrow(contexts, "part long, bundle long, anchors binary, texts binary, ids binary")
    what = durable(sent.groupBy("part").applyInArrow(judged, "part long, bundle long, what binary"))
    release(docs.sparkSession)
    both = shared.withColumn("what", F.lit(None).cast("binary")).unionByName(what, allowMissingColumns=True)
    parted = beside(both).applyInArrow(strings, _SENT_SCHEMA).groupBy("part")
    ranges = durable(parted.applyInArrow(compared, "bundle long, ranges binary"))
    release(docs.sparkSession)
    return beside(ranges).applyInArrow(
        cut,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary, kept binary",
    )


def merged(ranges: np.ndarray) -> np.ndarray:
    """Maximal runs covered by ranges (start, end)."""
    if not len(ranges):
        return ranges
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    first = np.flatnonzero(np.concatenate(([True], ranges[1:, 0] > reach[:-1])))
    last = np.append(first[1:], len(ranges)) - 1
    return np.stack([ranges[first, 0], reach[last]], axis=1)
