import hashlib
import zlib

import numpy as np
import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from tablewright.llm.byte_bpe import Codec, PerfectHash, encode_documents, read_ranks  # noqa: E402
from tablewright.llm.packing import pack_documents  # noqa: E402

TEXTS = [
    None,
    "",
    " ",
    "  \n a  b\t\tc \n\n d",
    "it's we'll 'tis x'y",
    "Größe élan 日本語 テスト 　x \x85y \x1cz \xa0 w",
    "a" * 3000,
    "aB3$" * 500 + " end  ",
    "zero​width <|endoftext|> 12345 ½ \U0001f600\U0001f600",
    "word " * 4000,
    "the%%% it's %'s 'tis don't=x =\u0338 e\u0301% \u201cq\u201d% \u0130% f\u00fcr%% a1b2 \u216b% \x7f\x01a",
    "same",
    "same",
]


def frame(spark, texts):
    rows = [(i, t, "x", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, length string")


@pytest.fixture(scope="module")
def codec():
    return Codec(read_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read()), P.PATTERN)


def test_perfect_hash_is_minimal_and_exact():
    keys = [f"k{i}".encode() for i in range(5000)]
    table = PerfectHash(keys)
    assert sorted(table.value) == list(range(5000)) and None not in table.keys
    assert all(table.get(k) == i for i, k in enumerate(keys)) and table.get(b"other") == -1
    assert PerfectHash([]).get(b"a") == -1


def test_encode_equals_library(spark, codec):
    own = tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(codec.tokens)}, special_tokens={}
    )
    ranks = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
    got = {r.doc_id: r for r in encode_documents(frame(spark, TEXTS), ranks, P.PATTERN).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = own.encode_ordinary(t or "")
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids, t
        assert got[i].n_tokens == len(ids)
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert encode_documents(frame(spark, []), ranks, P.PATTERN).count() == 0


def test_packing_covers_every_id_once(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = pack_documents(frame(spark, TEXTS).repartition(3), open(path).read(), 2, capacity=256, least=16).collect()
    docs: dict[int, list] = {}
    sequences: dict[int, list] = {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(TEXTS):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        pieces = sorted(docs[i], key=lambda r: r.start)
        assert [x for p in pieces for x in np.frombuffer(p.ids, "<u4").tolist()] == ids
        assert all(p.ids_crc32 == zlib.crc32(p.ids) and p.doc_tokens == len(ids) for p in pieces)
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
    for members in sequences.values():
        members.sort(key=lambda r: r.offset)
        end = 0
        for r in members:
            assert r.offset == end
            end += r.length
        assert end <= 256 and (end & (end - 1) == 0 or 256 - end < 16)
    assert pack_documents(frame(spark, []), open(path).read(), 2).count() == 0
