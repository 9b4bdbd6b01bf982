import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tablewright.llm.prefix_trie import borrow_heads, conversation_trie, prefix_trie, turns_of

SCHEMA = "conv_id long, turn long, role string, text string, pos string, n int"


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            framed = f"{len(role.encode())}:{role}{text}".encode()
            convs[c].append(((turn is not None, turn or 0, hashlib.sha256(framed).digest()[:16]), (role, text)))
    return {c: [t for _, t in sorted(v)] for c, v in convs.items()}


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, out = defaultdict(list), []
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    for node, some in members.items():
        ends = ",".join(str(c) for c in sorted(some) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        row = (min(some), len(node), parent, len(some), len(kids[node]), leaves[node], saved[node])
        out.append((*row, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    return out


def talk(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 7)):
            rows.append((c * 7 % 1000, t, rng.choice(["user", "bot", None]), rng.choice(["é", "hi", "", None, "yes"]), "x", 1))
    first = [(5000, t, "user", f"line {t}", "x", 1) for t in range(9)]
    # Copies of one conversation, a very long one, a hot first turn, turns without number or of one number, rows without id.
    rows += [(c, *r[1:]) for c in range(5000, 5200) for r in first]
    rows += [(6000, t, "bot", "same", "x", 1) for t in range(700)] + [(6001, t, "bot", "same", "x", 1) for t in range(650)]
    rows += [(c, 0, "user", "hello", "x", 1) for c in range(7000, 7300)] + [(c, 1, "bot", f"{c}", "x", 1) for c in range(7000, 7150)]
    rows += [(8000, None, "user", "b", "x", 1), (8000, None, "user", "a", "x", 1), (8000, 0, "user", "a", "x", 1)]
    rows += [(8001, 1, "user", "b", "x", 1), (8001, 1, "user", "b", "x", 1), (None, 1, "user", "b", "x", 1)]
    return rows


def found(df):
    names = "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256".split(", ")
    return sorted((tuple(r) for r in df.select(names).collect()), key=repr)


def modulo(c):
    return c - c % 100


def crc(c):
    return F.crc32(c.cast("string").cast("binary")) % 6


@pytest.mark.parametrize("cells", [1 << 20, 256, 1])
def test_against_brute_force(spark, cells):
    rows = talk(120)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(conversation_trie(df, cells)) == brute(ordered(rows))


def test_borrowed_heads(spark):
    rows = talk(300, 2) + [(-105, t, "user", str(t), "x", 1) for t in range(4)] + [(9999, 0, "user", "only", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = rebuilt({c: t for c, t in ordered(rows).items() if c >= 0})
    got = prefix_trie(*borrow_heads(turns_of(df.where("conv_id >= 0")), modulo, crc, 5))
    assert found(got) == brute(want)
    assert any(not t for t in want.values())
    # An id below zero borrows from the id that the truncating remainder names.
    last = {r.conv_id: r.n for r in borrow_heads(turns_of(df), modulo, crc, 5)[1].collect()}
    h = zlib.crc32(b"-105") % 6
    assert last[-105] == max(4 - h, 0)


def test_one_conversation_in_a_third_of_the_rows(spark):
    rows = [(1, t % 50, "user", f"{t % 7}", "x", 1) for t in range(1000)]
    rows += [(2 + t % 400, t, "user", f"{t % 3}", "x", 1) for t in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert found(conversation_trie(df)) == brute(ordered(rows))


def test_empty_table_and_rules(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversation_trie(empty).collect() == []
    only_null = spark.createDataFrame([(None, 1, "user", "b", "x", 1)], SCHEMA)
    assert conversation_trie(only_null).collect() == []
    one = spark.createDataFrame([(3, 1, None, None, "x", 1)], SCHEMA)
    assert found(conversation_trie(one)) == brute(ordered([(3, 1, None, None)]))
    with pytest.raises(ValueError, match="power of two"):
        conversation_trie(empty, cells=100)


def test_prefixes_are_made_once(spark):
    """The result reads kept prefixes: Python runs for the ends of conversations only, once per branch of the nodes."""
    rows = [(c, t, "user", f"turn {t} of {c % 3}", "", 0) for c in range(12) for t in range(c % 4)]
    found = conversation_trie(spark.createDataFrame(rows, SCHEMA))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") <= 3
