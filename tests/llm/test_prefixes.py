"""The prefix trie against a plain one, with long conversations, hot nodes, ties, nulls and repeated rows."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tracewell.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    """The turns (role, text) of every conversation."""
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    return {c: [(role, text) for _, role, _, text in sorted(t)] for c, t in convs.items()}


def brute(convs):
    """Nodes of conversations (id -> turns), each prefix by its turns."""
    members, bytes_of, ends = defaultdict(list), {}, defaultdict(list)
    for c in sorted(convs):
        path = ()
        members[path].append(c)
        for turn in convs[c]:
            path += (turn,)
            members[path].append(c)
            bytes_of[path] = len(turn[1].encode())
        ends[path].append(c)
    kids = defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, m in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(m) - 1) * bytes_of.get(path, 0)
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], digest(ends[p])) for p, m in members.items()), key=str)


def nodes(df):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def random_rows(rng, n, turns, texts):
    return [(c, None if k == 0 and c % 4 == 0 else k, rng.choice(("user", "assistant", None)), rng.choice(texts)) for c in range(-n // 3, n) for k in range(rng.randrange(turns))]


def test_random_conversations_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "BLOCK", 2)
    rows = random_rows(random.Random(1), 40, 9, ["", None, "a", "é", "b c"])
    rng = random.Random(2)
    rows += [(None, 1, "user", "nobody's"), (3, 2, "user", "x"), (3, 2, "user", "x"), (3, 2, "tool", "x"), (5, None, None, None)]
    rng.shuffle(rows)
    assert nodes(prefixes.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(ordered(rows))


def test_rebuilt_conversations(spark):
    rows = random_rows(random.Random(3), 60, 7, ["a", "b"])
    convs, c = ordered(rows), F.col("conv_id")
    made = {i: (convs.get(i // 10 * 10, [])[: i % 4] + t[i % 4 :] if i // 10 * 10 != i else t) for i, t in convs.items()}
    got = prefixes.rebuilt_trie(spark.createDataFrame(rows, SCHEMA), F.pmod(c, F.lit(4)), F.floor(c / 10) * 10)
    assert nodes(got) == brute(made)


def test_turnless_conversations_end_at_the_root(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "user", "b")]
    got = nodes(prefixes.rebuilt_trie(spark.createDataFrame(rows, SCHEMA), F.lit(9), F.lit(77)))
    assert got == brute({1: [], 2: []}) and got[0][:4] == (1, 0, None, 2)


def test_one_conversation_and_one_turn_hold_most_rows(spark, monkeypatch):
    """A conversation of 400 equal turns beside many that start with the same turn, with small blocks, parts and few hot keys."""
    for name, value in (("BLOCK", 64), ("PART", 7), ("HOT", 5)):
        monkeypatch.setattr(prefixes, name, value)
    rows = [(0, None, "user", "same")] * 400 + [(c, k, "user", "same" if k < 2 else f"t{c % 50}-{k}") for c in range(1, 200) for k in range(3)] + [(c, k, "user", "same") for c in (500, 501) for k in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert nodes(prefixes.prefix_trie(df)) == brute(ordered(rows))
    ranks = prefixes.ranked(df)[0].where("conv_id = 0").select("i").collect()
    assert sorted(r.i for r in ranks) == list(range(400))


def test_lookup_broadcasts_hot_keys_only(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "HOT", 4)
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 1), (3, 1), (9, 1), (None, 1)], "k long, v long")
    found = spark.createDataFrame([(1, "hot", 50), (2, "cold", 1), (3, "cold", 1), (4, "none", 0)], "k long, name string, n long")
    got = sorted((r.k or 0, r.name or "") for r in prefixes.looked_up(rows, found, ["k"], "n").collect())
    assert got == sorted([(1, "hot")] * 50 + [(2, "cold"), (3, "cold"), (9, ""), (0, "")])


def test_empty_tables_and_other_columns(spark):
    df = spark.createDataFrame([(4, 0, "user", "x", 1, "i", "n1")], SCHEMA + ", i long, digest string, length string")
    assert nodes(prefixes.prefix_trie(df)) == brute({4: [("user", "x")]})
    assert nodes(prefixes.rebuilt_trie(df.limit(0), F.lit(1), F.col("conv_id"))) == []
