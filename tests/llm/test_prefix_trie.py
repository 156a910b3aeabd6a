"""The prefix trie against a plain one made of dictionaries."""

import hashlib
import random
import zlib

import check_oracle
import pytest
from pyspark.sql import functions as F

from claimscope.llm import prefix_trie as P
from claimscope.llm.prefix_trie import ORACLE_SQL, op13_prefix_trie, prefix_trie, turn_sequences, turn_texts, with_shared_heads

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(conversations):
    """``conversations``: number to its list of (role, text)."""
    members = {}
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = {n for n in below if len(n) == len(node) + 1}
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(str(c) for c in sorted(convs) if len(conversations[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def plain_heads(conversations):
    """Conversations with the head of their hundred's first one; ``%`` has the sign of its left side."""
    out = {}
    for c, turns in conversations.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = conversations.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])
        out[c] = base[:h] + turns[h:]
    return out


def as_table(spark, conversations):
    rows = [(c, i, role, text, 0) for c, turns in conversations.items() for i, (role, text) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int")


def found(trie):
    return sorted((tuple(r[c] for c in COLUMNS) for r in trie.select(*COLUMNS).collect()), key=repr)


def bushy(seed, n):
    """Conversations of few distinct turns, so that many share prefixes, are equal or are prefixes of others."""
    pick = random.Random(seed)
    texts = ["a", "bb", "é", "", "x" * 50]
    out = {}
    for c in range(n):
        out[c * 3 - 40] = [(pick.choice(["user", "assistant"]), pick.choice(texts)) for _ in range(pick.randrange(1, 9) if pick.random() < 0.9 else 1)]
    for c in range(150):
        out[10_000 + c] = [("user", "same"), ("assistant", "always")] * 20
    out[20_000] = [("user", f"{i}") for i in range(300)]
    out[20_001] = out[20_000][:150] + [("user", "other")]
    return out


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_any_split_into_partitions_gives_the_plain_trie(spark, partitions):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        for conversations in (bushy(partitions, 250), {5: [("user", "only")]}, {1: [("a", "x")] * 3, 2: [("a", "x")] * 3, 3: [("a", "x")] * 2}):
            sequences = turn_sequences(as_table(spark, conversations))
            assert found(prefix_trie(sequences)) == plain(conversations)
            if len(conversations) > 5:
                sequences = P.stage(sequences, "test")
                assert found(prefix_trie(with_shared_heads(sequences))) == plain(plain_heads(conversations))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("chunk", [1 << 16, 2])
def test_contracted_forests_of_all_cuts_equal_one_forest(monkeypatch, chunk):
    """Without a session: every cut of sorted sequences into partitions, with ends in parts."""
    monkeypatch.setattr(P, "_CHUNK", chunk)
    pick = random.Random(chunk)
    for _ in range(60):
        convs = {c: "".join(pick.choice("ab") for _ in range(pick.randrange(6))) for c in range(pick.randrange(1, 14))}
        ordered = sorted(convs, key=lambda c: (convs[c], c))
        cuts = sorted({0, len(ordered), *(pick.randrange(len(ordered) + 1) for _ in range(pick.randrange(6)))})
        rows, forests = [], []
        for place, (a, b) in enumerate(zip(cuts, cuts[1:])):
            items = P.Items()
            for c in ordered[a:b]:
                key = b"".join(t.encode() * P.DIGEST for t in convs[c])
                if items.key:
                    items.edges.append(P.common_turns(items.key[-1], key))
                items.add(key, P.np.arange(len(convs[c]) + 1) * 2, len(convs[c]), c)
            for row in P.partition_rows(items, place):
                (forests.append(P.Items(**P.pickle.loads(row["forest"]))) if row["kind"] == "forest" else rows.append(row))
        opened = list(P.open_rows(forests))
        number = {r["open_node"]: r["conv_id"] for r in opened if "open_node" in r}
        ends = {}
        for r in sorted((r for r in rows if r["kind"] == "ends"), key=lambda r: (r["place"], r["part"])):
            ends.setdefault(r["parent"], []).append(r["ids"])
        for r in opened:
            if r.get("open_node") in ends:
                r["ends_sha256"] = hashlib.sha256(",".join(ends[r["open_node"]]).encode()).hexdigest()
        done = [r | {"parent_conv_id": number[r["parent"]] if "parent" in r else r["parent_conv_id"]} for r in rows if r["kind"] == "node"]
        got = sorted((tuple(r[c] for c in COLUMNS) for r in done + opened), key=repr)
        assert got == plain({c: [(t, "xx") for t in text] for c, text in convs.items()}), (convs, cuts)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, scale):
    folder = f"/root/testdata/{scale}"
    assert check_oracle.differences(op13_prefix_trie(spark, folder), check_oracle.connect(folder), ORACLE_SQL) == []


def test_nulls_repeats_ties_and_empty_tables(spark):
    rows = [(1, None, None, "b"), (1, 0, "user", None), (None, 0, "user", "a"), (2, 0, "", "b"), (2, 1, "user", ""), (2, 1, "user", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    first = [("", "b"), ("user", "")]
    trie = prefix_trie(turn_sequences(table))
    assert found(trie) == plain({1: first, 2: [*first, ("user", "")]})
    assert prefix_trie(turn_sequences(table.limit(0))).collect() == []
    # A conversation left without turns by its short head is a member of the root.
    empty = P.stage(turn_sequences(table).withColumn("turns", F.slice("turns", 1, F.col("conv_id").cast("int") - 1)), "test")
    assert found(prefix_trie(empty)) == plain({1: [], 2: [("", "b")]})
    # Turns with the same number keep one order, whatever the order of the rows.
    ties = spark.createDataFrame([(c, 0, "user", t) for c, ts in ((1, "abc"), (2, "cab")) for t in ts], table.schema)
    assert {r.n_convs for r in prefix_trie(turn_sequences(ties)).collect()} == {2}
    long = spark.createDataFrame([(c, 0, "user", "x" * 3_000_000 + t) for c, t in ((1, "a"), (2, "b"), (3, "b"))], table.schema)
    assert sorted(r.saved_tokens for r in prefix_trie(turn_sequences(long)).collect()) == [0, 3_000_001, 3_000_001]


def test_nodes_lead_to_their_last_turn(spark):
    conversations = bushy(9, 40)
    table = as_table(spark, conversations)
    texts = {r.turn: (r.role, r.text) for r in turn_texts(table).collect()}
    for r in prefix_trie(turn_sequences(table)).collect():
        assert (r.turn is None) == (r.depth == 0)
        if r.depth:
            assert texts[r.turn] == conversations[r.conv_id][r.depth - 1]
