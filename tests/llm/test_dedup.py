import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tablewright.llm import suffix_dedup
from tablewright.llm.components import components
from tablewright.llm.embedding_dedup import joined_groups, near_vectors, tile_links
from tablewright.llm.exact_dedup import exact_duplicates
from tablewright.llm.shingle_sets import similar_duplicates
from tablewright.llm.simhash import BKTree, fingerprint, near_duplicates
from tablewright.llm.suffix_dedup import AnchorFinder, common_classes, merged, remove_repeats

DOCS = "doc_id long, text string, keep_id string, kept string, row_no string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOCS)


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_exact(spark):
    rows = [(3, "Ab"), (1, "aB"), (2, "ÄB"), (4, "äb"), (5, None), (6, ""), (None, "ab"), (7, "q"), (7, "q"), (None, "n")]
    rows += [(100 + i, "Hot") for i in range(300)]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for keep, pick in (("largest", max), ("smallest", min)):
        got = exact_duplicates(docs_of(spark, rows).repartition(5), keep=keep, fan=2).collect()
        groups = {}
        for i, t in rows:
            groups.setdefault((t or "").translate(lower), []).append(i)
        assert len(got) == len(rows)
        by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
        for r in got:
            ids = by_sha[r.text_sha256]
            known = [i for i in ids if i is not None]
            assert r.group_size == len(ids) and r.keep_id == (pick(known) if known else None)
        assert sum(r.kept for r in got) == len(groups)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_duplicates(docs_of(spark, [])).count() == 0
    with pytest.raises(ValueError):
        exact_duplicates(docs_of(spark, []), keep="any")


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(500, i) for i in range(501, 700)]
    links += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)] + [(5, 5), (None, 1)]
    want = roots({x for p in links if None not in p and p[0] != p[1] for x in p}, [p for p in links if None not in p])
    frame = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.root for r in components(frame).collect()} == want
    assert components(frame.limit(0)).count() == 0


def simple_fingerprint(text, n):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows = [(1, None), (2, " \t\n"), (3, "One"), (4, "one two"), (5, "one two THREE"), (6, "É\xa0a b c"), (7, "x " * 70000)]
    for k in range(60):
        words = rng.choices(vocabulary, k=400)
        rows.append((10 + 4 * k, " ".join(words)))
        for c in range(1, 4):
            copy = list(words)
            for _ in range(c - 1):
                copy[rng.randrange(400)] = "new"
            rows.append((10 + 4 * k + c, " ".join(copy)))
    rows += [(None, "one two"), (4, "one two"), (None, "alone here and there")]
    fp = {i: simple_fingerprint(t, 3) for i, t in rows if i is not None}
    assert all(fingerprint((t or "").encode(), 3) == simple_fingerprint(t, 3) for _, t in rows)
    for radius, shard_rows in ((2, 20_000), (4, 3)):
        want = roots(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= radius])
        got = near_duplicates(docs_of(spark, rows).repartition(3), 3, radius, shard_rows).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is not None:
                assert (r.component_id, int(r.fingerprint, 16)) == (want[r.doc_id], fp[r.doc_id])
        assert sorted(r.component_id for r in got if r.kept and r.doc_id is not None) == sorted(set(want.values()))
    assert near_duplicates(docs_of(spark, [])).count() == 0


def test_similar_texts(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(500)]
    rows, want = [(0, None), (1, ""), (5000, "a b"), (5001, "a b"), (None, "lonely words are here")], {0: 0, 1: 0, 5000: 5000, 5001: 5000}
    for k in range(80):
        words = rng.choices(vocabulary, k=300)
        for c in range(5):
            copy = list(words)
            for x in rng.sample(range(300), c):
                copy[x] = "other"
            rows.append((10 + 10 * k + c, " ".join(copy)))
            want[10 + 10 * k + c] = 10 + 10 * k
    got = similar_duplicates(docs_of(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    # Links never join different texts; copies are found with the stated recall, here far nearer than 0.8.
    assert all(found[i] == i or want[found[i]] == want[i] for i in want)
    assert np.mean([found[i] == want[i] for i in want]) > 0.95
    assert sum(r.kept for r in got) == len({r.component_id for r in got})
    assert similar_duplicates(docs_of(spark, [])).count() == 0


def test_similar_texts_lose_no_pair(spark):
    """Isolated pairs just above and below 0.8, of short and long texts, against the shingle sets."""
    rng = random.Random(12)
    rows = []
    for k in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((12, 40, 90, 300)))]
        copy = list(words)
        for x in rng.sample(range(len(words)), max(1, round(len(words) * rng.choice((0.01, 0.021, 0.023, 0.03))))):
            copy[x] = "other"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    passage = [f"p{x}" for x in range(60)]
    for k in range(60):
        words = passage[:]
        words[k : k + 1 + k % 3] = [f"q{k}"]
        rows.append((1000 + k, " ".join(words)))
        rows.append((2000 + k, " ".join(passage + [f"r{rng.randrange(10**6)}" for _ in range(60)])))

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {i: shingles(t) for i, t in rows}
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    links = [(a, b) for a in sets for b in sets if a < b and jaccard(a, b) >= 0.8]
    want = roots(list(sets), links)
    assert 30 < sum(want[2 * k + 1] == 2 * k for k in range(150)) < 149
    for frame in (docs_of(spark, rows).repartition(3), docs_of(spark, rows[::-1])):
        got = {r.doc_id: r.component_id for r in similar_duplicates(frame).collect()}
        assert got == want


def test_bk_tree_finds_all_within_radius():
    rng = random.Random(1)
    values = [rng.getrandbits(16) for _ in range(500)]
    tree = BKTree(3)
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.near(q)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 3]


def test_vectors(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(300):
        base = rng.normal(size=12)
        rows.append((k, base.tolist(), k % 3))
        if k % 4 == 0:
            rows += [(1000 + 3 * k + c, (base * (c + 1) + rng.normal(size=12) * 0.06 * c).tolist(), k % 3) for c in range(3)]
    rows += [(5000 + k, [1.0] * 12, 1) for k in range(50)]
    rows += [(6000, None, 1), (6001, [0.0] * 12, 1), (6002, [math.nan] * 12, 1), (6003, [1.0] * 12, None)]
    rows += [(6004, [None] + [1.0] * 11, 1), (6005, [math.inf] * 12, 1), (6006, [1.0] * 5, 1), (6007, [], 1), (6008, [2.0] * 12, 2)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, g string")
    usable = [r for r in rows if r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]

    def cosine(a, b):
        a, b = np.array(a), np.array(b)
        return a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)

    links = [
        (a[0], b[0])
        for i, a in enumerate(usable)
        for b in usable[i + 1 :]
        if a[2] == b[2] and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= 0.98
    ]
    want = roots([r[0] for r in rows], links)
    for block_rows in (1024, 20):
        got = {r.vec_id: r for r in near_vectors(frame.repartition(3), 0.98, block_rows=block_rows).collect()}
        assert len(got) == len(rows)
        for i, r in got.items():
            assert r.n_links == sum(i in p for p in links), i
            assert r.component_id == want[i] and r.kept == (want[i] == i)
    assert near_vectors(frame.limit(0)).count() == 0


def test_vectors_with_late_hubs(spark):
    """Members that do not link each other are joined by a hub of a larger id, or by a chain."""
    turn = lambda degrees: [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]
    rows = [(1, turn(0)), (2, turn(20)), (3, turn(10))]
    # A chain whose ids alternate, and a hub of 30 members that lie along axes of their own.
    rows += [(100 + (k * 7) % 12, turn(90 + 10 * k)) for k in range(12)]
    rows = [(i, [*v, *[0.0] * 30], 0) for i, v in rows]
    hub = np.full(32, 1.0)
    hub[:2] = 0
    for k in range(30):
        member = hub.copy()
        member[2 + k] += 1.06
        rows.append((200 + k, member.tolist(), 1))
    rows.append((900, hub.tolist(), 1))
    vectors = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    label = {i: g for i, _, g in rows}
    links = [(a, b) for a in label for b in label if a < b and label[a] == label[b] and vectors[a] @ vectors[b] >= 0.98]
    want = roots(list(label), links)
    assert want[2] == 1 and want[229] == 200 and not any(200 <= a < b < 900 for a, b in links)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").orderBy("vec_id").coalesce(1)
    for block_rows in (1024, 5):
        for r in near_vectors(frame, 0.98, block_rows=block_rows).collect():
            assert r.n_links == sum(r.vec_id in p for p in links), r.vec_id
            assert r.component_id == want[r.vec_id] and r.kept == (want[r.vec_id] == r.vec_id), r.vec_id


def test_joined_groups():
    rng = random.Random(8)
    for n in (1, 5, 60, 400):
        links = [(a, b) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(n)) if a != b] or [(2, 1)]
        a, b = (np.array(x, np.int64) for x in zip(*links, strict=True))
        groups, least = joined_groups(a, b)
        assert dict(zip(groups.tolist(), least.tolist(), strict=True)) == roots({x for p in links for x in p}, links)


def test_tile_bound_loses_nothing():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(200, 30)) * np.linspace(3, 0.1, 30)
    a /= np.linalg.norm(a, axis=1)[:, None]
    i, j = tile_links(a, a, 0.8, step=4)
    assert set(zip(*np.nonzero(a @ a.T >= 0.8), strict=True)) <= set(zip(i, j, strict=True))


def brute_repeats(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, 1 << 63), i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(2, 9)))
    passages = [" ".join(word() for _ in range(20)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 30)))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            cut = rng.randrange(0, 40)
            parts += [p[cut:], " ".join(word() for _ in range(5))]
        rows.append((1000 - i, " ".join(parts)))
    rows += [(i, rows[i % 7][1]) for i in range(10, 20)]
    rows += [(1, None), (2, ""), (3, "a" * 49), (4, "a" * 50), (5, "a" * 3000), (6, "ab" * 200), (7, "ab" * 60 + "é")]
    want = brute_repeats(rows, 50)
    frame = docs_of(spark, rows).repartition(4)
    for collection in (2048, 4):
        got = remove_repeats(frame, 50, 24, collection).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
            assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    twice = docs_of(spark, [(5, "x" * 80), (5, "x" * 80), (None, "x" * 80), (None, "y" * 60), (None, "y" * 60)])
    assert sorted(r.n_removed for r in remove_repeats(twice).collect()) == [0, 0, 0, 0, 80]
    assert remove_repeats(frame.limit(0)).count() == 0


def test_repeats_over_many_bundles_and_parts(spark, monkeypatch):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    line, page = text(170), text(900)
    rows = [(500 - i, text(rng.randrange(0, 200)) + line + text(rng.randrange(0, 90))) for i in range(60)]
    rows += [(600 + i, page[: rng.randrange(40, 900)] + text(5) + page[rng.randrange(0, 860) :]) for i in range(40)]
    rows += [(800 + i, rows[i][1]) for i in range(0, 100, 7)]
    monkeypatch.setattr(suffix_dedup, "BUNDLE_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "PART_ANCHORS", 300)
    want = brute_repeats(rows, 50)
    for collection in (2048, 8):
        got = remove_repeats(docs_of(spark, rows).repartition(3), 50, 24, collection, with_kept=False).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_copies_move_as_hashes():
    rng = np.random.default_rng(3)
    text = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
    page, bits = text(4000), 30
    bundles = []
    for k in range(5):
        rows = [(100 * k + i, page if i % 2 else text(2000) + page[500:900] + text(100)) for i in range(20)]
        table = pa.table({"id": [i for i, _ in rows], "text": pa.array([t for _, t in rows], pa.large_binary())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        bundles.append(suffix_dedup.Anchored(sink.getvalue().to_pybytes(), AnchorFinder(24, 50), bits))

    def told(columns):
        names = ["part", "bundle", *columns[0]]
        return pa.table({n: [0] * 5 if n == "part" else list(range(5)) if n == "bundle" else [c[n] for c in columns] for n in names})

    anchors = [b.distinct() for b in bundles]
    seen = told([{"anchors": suffix_dedup.pack(x)} for x in anchors])
    # Twelve bytes an anchor moved before, hash, document and place, of every anchor of every document.
    assert sum(map(len, seen["anchors"].to_pylist())) < 5 * sum(map(len, anchors))
    shared = suffix_dedup._shared(seen)
    found = [
        suffix_dedup.Contexts(b, suffix_dedup._answered(shared.slice(k, 1), "shared") > 0) for k, b in enumerate(bundles)
    ]
    columns = [
        {"anchors": suffix_dedup.pack(c.anchor)} | {n: suffix_dedup._squeeze(x) for n, x in (("texts", c.text), ("ids", c.least))}
        for c in found
    ]
    judged = suffix_dedup._judged(told(columns), 2048)
    compared = [suffix_dedup._answered(judged.slice(k, 1), "what") == suffix_dedup._COMPARE for k in range(5)]
    # Of 50 copies of a page only contexts at the ends of the quoted part are compared, a few for each quoting text.
    assert sum(len(c.of) for c in found) > 10_000
    assert 0 < sum(x.sum() for x in compared) < 50 * 8


def test_anchors_are_few_and_follow_the_text():
    rng = np.random.default_rng(1)
    passage = rng.integers(97, 123, 400).astype(np.uint8)
    a = np.concatenate((rng.integers(97, 123, 333).astype(np.uint8), passage))
    b = np.concatenate((rng.integers(97, 123, 71).astype(np.uint8), passage))
    finder = AnchorFinder(24, 50)
    found = []
    for text, start in ((a, 333), (b, 71)):
        at, h = finder.find(text)
        assert len(at) < len(text) / 8 and np.diff(at).max() <= 27
        found.append({(p - start, x) for p, x in zip(at.tolist(), h.tolist(), strict=True) if p >= start + 26})
    inner = [{x for x in f if x[0] < 340} for f in found]
    assert inner[0] == inner[1] and len(inner[0]) > 15
    assert len(finder.find(a[:49])[0]) == 0


def test_classes_and_runs():
    strings = [b"banana", b"bananas", b"nana", b"an", b""]
    classes = common_classes(strings, 3)
    at, seen = 0, {}
    for s in strings:
        for k in range(len(s)):
            c = int(classes[at + k])
            assert (c == -1) == (len(s) - k < 3)
            if c >= 0:
                assert seen.setdefault(c, s[k : k + 3]) == s[k : k + 3]
        at += len(s)
    assert len(seen) == len({s[k : k + 3] for s in strings for k in range(len(s) - 2)})
    assert merged(np.array([[5, 9], [0, 3], [3, 4], [6, 12]])).tolist() == [[0, 4], [5, 12]]
