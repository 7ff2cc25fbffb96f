"""The trie of prefixes against dictionaries of prefixes."""

import collections
import hashlib
import random
import zlib

import pytest

from folio.llm import trie


def brute(rows):
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), (role or "", text or "")))
    turns = {c: [t[-1] for t in sorted(some)] for c, some in own.items()}
    built = {}
    for c, some in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = tuple(turns.get(base, [])[:h] + some[h:])
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, some in sorted(built.items()):
        for d in range(len(some) + 1):
            members[some[:d]].append(c)
        ends[some].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, own_ in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(own_) - 1) * len(k[-1][1].encode()) if k else 0
    return [(m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, m in members.items()]


def made(seed=1):
    draw = random.Random(seed)
    rows = []
    for c in [*range(-12, 60), 10**12, 10**12 + 3]:
        for t in range(draw.choice([0, 1, 3, 9, 12])):
            rows.append((c, draw.choice([t, t, t, None]), draw.choice(["user", "user", None]), draw.choice(["hi", "é 日本", "", None, "hi"])))
    rows += [(60, t, "user", "x") for t in range(150)] + [(61, t, "user", "x" if t < 140 else "y") for t in range(150)] + [(62, t, "user", "long " * 9_000) for t in range(3)]
    return rows + rows[:9] + [(None, 1, "user", "hi"), (63, None, None, None)]


@pytest.mark.parametrize("band,chunk", [(8, 1_024), (2, 16)])
def test_trie_equals_dictionaries(spark, monkeypatch, band, chunk):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    monkeypatch.setattr(trie.subtree_totals, "__defaults__", (band,))
    rows = made()
    table = spark.createDataFrame([(*r, "k", 3) for r in rows], "conv_id long, turn long, role string, text string, key string, depth int").repartition(3)
    assert sorted(map(tuple, trie.conversation_trie(table).collect()), key=str) == sorted(brute(rows), key=str)


def test_no_conversations_give_no_nodes(spark):
    empty = spark.createDataFrame([(None, 1, "user", "hi")], "conv_id long, turn long, role string, text string")
    assert trie.conversation_trie(empty).count() == 0 and trie.conversation_trie(empty.limit(0)).count() == 0


def test_rounds_and_copies_are_bounded(spark):
    """A chain of 300 turns takes three rounds of bands of 8, and no node is copied to more than 8 ancestors in one."""
    rows = spark.createDataFrame([(1, t, "user", "x") for t in range(300)], "conv_id long, turn long, role string, text string")
    top = [r for r in trie.conversation_trie(rows).collect() if r.depth == 0]
    assert len(top) == 1 and (top[0].n_leaves, top[0].n_children) == (1, 1)


def test_ends_of_many_are_hashed_in_order(spark):
    rows = spark.range(25_000).selectExpr("id * 7 % 25013 - 5 as conv_id", "cast(cast(id % 2 as string) as binary) as key", "true as last").repartition(5)
    wanted = collections.defaultdict(list)
    for r in rows.collect():
        wanted[bytes(r.key)].append(r.conv_id)
    got = {bytes(r.key): r.ends_sha256 for r in trie.ends(rows).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in wanted.items()}
