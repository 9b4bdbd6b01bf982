import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tablewright.llm.queries import op13_substring_dedup
from tablewright.llm.substring_dedup import pack, remove_repeated_passages, unpack


def brute(texts, width):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), kept.decode(), hashlib.sha256(kept).hexdigest()))
    return out


def passages():
    rng = random.Random(1)
    vocab = ["a", "bb", "ccc", "dddddddd", "eeeeeeeee", "é" * 9, "z" * 300]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(60))) for _ in range(50)]
    long = [" ".join(str(rng.randrange(10**6)) for _ in range(300)) for _ in range(20)]
    texts += [None, "", " \t\n", texts[0], texts[0], "x" * 100_000, "a b " * 40, "q r\x0bs\x0ct\x1c u " * 30]
    return texts + [long[0] + " " + long[1], long[2] + "\t" + long[1][50:900] + " " + long[3], long[4] + long[0][30:400]]


@pytest.mark.parametrize("width", [2, 5, 6, 35])
@pytest.mark.parametrize("sizes", [{}, {"bundle_bytes": 2000, "part_hashes": 300}])
def test_against_brute_force(spark, width, sizes):
    texts = passages()
    rows = [(i, t, "s", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_words int").repartition(5)
    found = remove_repeated_passages(docs, window=width, **sizes).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept, r.kept_sha256) for r in found} == dict(enumerate(brute(texts, width)))
    for r in found:
        assert sum(s.behind - s.first for s in r.spans) == r.n_removed
        assert all(a.behind < b.first for a, b in zip(r.spans[:-1], r.spans[1:], strict=True))


def test_one_text_in_a_third_of_the_rows(spark):
    rng = random.Random(2)
    hot = " ".join(str(rng.randrange(100)) for _ in range(80))
    texts = [" ".join(str(rng.randrange(10**5)) for _ in range(50)) + (" " + hot if i % 3 == 0 else "") for i in range(900)]
    docs = spark.createDataFrame([(None if i == 5 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = remove_repeated_passages(docs, with_kept=False, bundle_bytes=5000, part_hashes=5000).collect()
    want = brute(texts, 35)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == {
        None if i == 5 else i: (w[0], w[1], w[3]) for i, w in enumerate(want)
    }


def test_empty_table_and_rules(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated_passages(empty).collect() == []
    with pytest.raises(ValueError, match="window"):
        remove_repeated_passages(empty, window=1)


def test_query_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op13_substring_dedup(spark, sf).collect()}
    want = brute(list(texts.values()), 35)
    assert found == {i: (w[0], w[1], w[3]) for i, w in zip(texts, want, strict=True)}


def test_packed_numbers_come_back():
    rng = np.random.default_rng(3)
    for values in ([], [0], [2**64 - 1], rng.integers(0, 2**63, 1000)):
        ascending = np.sort(np.array(values, np.uint64))
        assert (unpack(pack(ascending)) == ascending).all()
