"""The trie of conversation prefixes.

A conversation is the sequence of its turns, each a digest of role and text. Sequences are sorted over the cluster by range, so that those with a common prefix
stand together. Per partition, edges between sorted neighbours carry the length of their longest common prefix (LCP). A union-find takes the edges in
descending depth: joining two components makes their branching node at that depth, or adds to a node that is there already. What is between two branching
nodes is a chain of nodes with the same members, written out at the end.

Nodes that hold neither the first nor the last sequence of their partition are done. The others, the forest's two spines, are contracted: such a node becomes one
item with what hangs below it summed up. The items of all partitions, with edges between neighbours as before and those across the boundaries, go through the same
union-find. Their number depends on partitions and depths, not on the number of conversations, and a done child asks for its open parent's number by a join.

Members that end at a node are hashed in ascending order, in one go where all are in a partition; parts of a longer run are strings that one task
reads one after the other.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.llm.common import load, stage
from claimscope.operators.lookup import skew_safe_join

#: Characters of a turn's digest: half of a SHA-256 in hexadecimal.
DIGEST = 32
_CHUNK = 1 << 16
_OUT_ROWS = 8192
#: The head of a conversation that others start with has at most so many turns.
MOST_HEAD = 5
NODE = {
    "conv_id": pa.int64(),
    "depth": pa.int64(),
    "parent_conv_id": pa.int64(),
    "n_convs": pa.int64(),
    "n_children": pa.int64(),
    "n_leaves": pa.int64(),
    "saved_tokens": pa.int64(),
    "ends_sha256": pa.string(),
    "turn": pa.string(),
}
# What a partition gives: done nodes, of which some wait for the number of their open ``parent``; parts of the ids that end at an open node; its
# contracted forest.
_PART = {"kind": pa.string(), **NODE, "parent": pa.binary(), "place": pa.int64(), "part": pa.int64(), "ids": pa.string(), "forest": pa.binary()}
_OPEN = {**NODE, "open_node": pa.binary()}
_SPARK = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _schema(columns: dict) -> str:
    return ", ".join(f"{n} {_SPARK[t]}" for n, t in columns.items())


def _batches(rows: Iterable[dict], columns: dict) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while part := list(islice(rows, _OUT_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in part], t) for n, t in columns.items()], names=list(columns))


def common_turns(a: bytes, b: bytes) -> int:
    """How many digests two sequences have in common at their start."""
    least, most = 0, min(len(a), len(b)) // DIGEST
    if a[: most * DIGEST] == b[: most * DIGEST]:
        return most
    while most - least > 1:
        middle = (least + most) // 2
        least, most = (middle, most) if a[: middle * DIGEST] == b[: middle * DIGEST] else (least, middle)
    return least


@dataclass
class Items:
    """Nodes in sorted order, as leaves of a union-find: sequences, or contracted parts of open nodes.

    ``key`` is the sequence of digests along an item's path, as far as its depth or further, and ``reach`` the code points of its turns up to each depth; items
    may share them. ``edges[i]`` is the common depth of items ``i`` and ``i + 1``.
    """

    depth: list[int] = field(default_factory=list)
    conv: list[int] = field(default_factory=list)
    members: list[int] = field(default_factory=list)
    children: list[int] = field(default_factory=list)
    leaves: list[int] = field(default_factory=list)
    saved: list[int] = field(default_factory=list)
    key: list[bytes] = field(default_factory=list)
    reach: list[np.ndarray] = field(default_factory=list)
    edges: list[int] = field(default_factory=list)

    def add(self, key: bytes, reach: np.ndarray, depth: int, conv: int, members: int = 1, children: int = 0, leaves: int = 0, saved: int = 0) -> None:
        self.key.append(key)
        self.reach.append(reach)
        self.depth.append(depth)
        self.conv.append(conv)
        self.members.append(members)
        self.children.append(children)
        self.leaves.append(leaves)
        self.saved.append(saved)


class Forest:
    """Branching nodes over items, made by merging neighbours along edges of descending depth.

    ``saved[v]`` is what the nodes strictly below ``v`` save; ``leaves[v]`` counts childless nodes under ``v``, itself if it has no child.
    """

    def __init__(self, items: Items):
        n = len(items.depth)
        self.items = items
        # Nodes 0 to n - 1 are the items; merges append.
        self.depth, self.conv, self.members = list(items.depth), list(items.conv), list(items.members)
        self.children, self.leaves, self.saved = list(items.children), list(items.leaves), list(items.saved)
        self.reach = list(items.reach)
        self.first, self.last = list(range(n)), list(range(n))
        self.parent = [-1] * n
        self.same = list(range(n))
        self._root = list(range(n))
        self._top = list(range(n))
        for edge in sorted(range(n - 1), key=lambda i: -items.edges[i]):
            self._merge(edge, edge + 1, items.edges[edge])

    def _find(self, i: int) -> int:
        root = i
        while self._root[root] != root:
            root = self._root[root]
        while self._root[i] != root:
            self._root[i], i = root, self._root[i]
        return root

    def _node(self, depth: int, reach: np.ndarray) -> int:
        for values, value in (
            (self.depth, depth), (self.conv, None), (self.members, 0), (self.children, 0), (self.leaves, 0), (self.saved, 0),
            (self.reach, reach), (self.first, None), (self.last, None), (self.parent, -1), (self.same, len(self.same)),
        ):
            values.append(value)
        return len(self.depth) - 1

    def _merge(self, left: int, right: int, depth: int) -> None:
        left, right = self._find(left), self._find(right)
        tops = [self._top[left], self._top[right]]
        into = next((t for t in tops if self.depth[t] == depth), None)
        if into is None:
            into = self._node(depth, self.reach[tops[0]])
        for top in tops:
            if top != into:
                self._take(into, top)
        self._root[right] = left
        self._top[left] = into

    def _take(self, into: int, node: int) -> None:
        """``node`` becomes a child of ``into``, or is the same node."""
        if self.depth[node] == self.depth[into]:
            self.same[node] = into
            self.children[into] += self.children[node]
            self.leaves[into] += self.leaves[node]
            self.saved[into] += self.saved[node]
        else:
            self.parent[node] = into
            self.children[into] += 1
            self.leaves[into] += self.leaves[node] or 1
            chain = int(self.reach[node][self.depth[node]] - self.reach[node][self.depth[into]])
            self.saved[into] += self.saved[node] + (self.members[node] - 1) * chain
        self.members[into] += self.members[node]
        self.conv[into] = self.conv[node] if self.conv[into] is None else min(self.conv[into], self.conv[node])
        self.first[into] = self.first[node] if self.first[into] is None else min(self.first[into], self.first[node])
        self.last[into] = self.last[node] if self.last[into] is None else max(self.last[into], self.last[node])

    def node_of(self, i: int) -> int:
        """The node that ``i`` was joined with at its own depth."""
        node = i
        while self.same[node] != node:
            node = self.same[node]
        while self.same[i] != node:
            self.same[i], i = node, self.same[i]
        return node

    def nodes(self) -> Iterator[int]:
        return (i for i in range(len(self.depth)) if self.same[i] == i)

    def parent_of(self, i: int) -> int:
        return self.node_of(self.parent[i]) if self.parent[i] >= 0 else -1

    def way_up(self, i: int) -> list[int]:
        """The node of item ``i`` and those above it."""
        way = [self.node_of(i)]
        while (above := self.parent_of(way[-1])) >= 0:
            way.append(above)
        return way

    def grow_root(self) -> None:
        """A node at depth 0 above everything, unless there is one."""
        top = self.way_up(0)[-1]
        if self.depth[top]:
            self._take(self._node(0, self.reach[top]), top)

    def key(self, i: int) -> bytes:
        return self.items.key[self.first[i]][: self.depth[i] * DIGEST]

    def chain(self, node: int, **more) -> Iterator[dict]:
        """The trie's nodes from below the parent of ``node`` down to it; the topmost gets ``more`` too."""
        above = self.parent_of(node)
        top = self.depth[above] + 1 if above >= 0 else self.depth[node]
        depth, n, reach, conv = self.depth[node], self.members[node], self.reach[node], self.conv[node]
        key = self.key(node).decode()
        for d in range(top, depth + 1):
            row = {
                "conv_id": conv, "depth": d, "n_convs": n, "n_leaves": self.leaves[node] or 1, "ends_sha256": _NO_ENDS,
                "n_children": self.children[node] if d == depth else 1,
                "saved_tokens": int(self.saved[node] + (n - 1) * (reach[depth] - reach[max(d - 1, 0)])),
                "parent_conv_id": conv if d > top else self.conv[above] if above >= 0 else None,
                "turn": key[(d - 1) * DIGEST : d * DIGEST] if d else None,
            }
            yield row | more if d == top else row


def open_name(key: bytes) -> bytes:
    """What an open node goes by in all partitions: the digest of its sequence."""
    return hashlib.blake2b(key, digest_size=16).digest()


def _ends(forest: Forest) -> dict[int, list[int]]:
    """Which sequences end at which node, in ascending order."""
    ends = defaultdict(list)
    for i, conv in enumerate(forest.items.conv):
        ends[forest.node_of(i)].append(conv)
    return ends


def partition_rows(items: Items, place: int) -> Iterator[dict]:
    """The done nodes of a partition, parts of the ids that end at its open ones, and its contracted forest."""
    forest = Forest(items)
    last = len(items.depth) - 1
    left, right = forest.way_up(0), forest.way_up(last)
    is_open = set(left) | set(right)
    ends = _ends(forest)
    rest = {u: {"conv": min(ends[u], default=None), "members": len(ends[u]), "children": 0, "leaves": 0, "saved": 0} for u in is_open}
    for node in forest.nodes():
        if node in is_open:
            continue
        above = forest.parent_of(node)
        more = {}
        if above in rest:
            more = {"parent_conv_id": None, "parent": open_name(forest.key(above))}
            sums = rest[above]
            chain = int(forest.reach[node][forest.depth[node]] - forest.reach[node][forest.depth[above]])
            sums["conv"] = forest.conv[node] if sums["conv"] is None else min(sums["conv"], forest.conv[node])
            sums["members"] += forest.members[node]
            sums["children"] += 1
            sums["leaves"] += forest.leaves[node] or 1
            sums["saved"] += forest.saved[node] + (forest.members[node] - 1) * chain
        rows = list(forest.chain(node, **more))
        if node in ends:
            rows[-1]["ends_sha256"] = hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
        for row in rows:
            yield {"kind": "node", **row}
    for node in is_open & ends.keys():
        name = open_name(forest.key(node))
        for part, at in enumerate(range(0, len(ends[node]), _CHUNK)):
            yield {"kind": "ends", "parent": name, "place": place, "part": part, "ids": ",".join(map(str, ends[node][at : at + _CHUNK]))}

    kept = Items()
    edge = None
    # Up from the first sequence to the node of all, down to the last sequence; between two of them the depth of the upper one.
    spine = [(u, 0) for u in left] + [(u, last) for u in right[-2::-1]]
    for i, (node, end) in enumerate(spine):
        if i:
            step = min(forest.depth[node], forest.depth[spine[i - 1][0]])
            edge = step if edge is None else min(edge, step)
        if rest[node]["members"]:
            if kept.depth:
                kept.edges.append(edge)
            edge = None
            kept.add(items.key[end], items.reach[end], forest.depth[node], **rest[node])
    yield {"kind": "forest", "place": place, "forest": pickle.dumps(vars(kept))}


def open_rows(forests: Iterable[Items]) -> Iterator[dict]:
    """The open nodes of all partitions, given their contracted forests in order."""
    joined = Items()
    for items in forests:
        if joined.key:
            joined.edges.append(common_turns(joined.key[-1], items.key[0]))
        for name, values in vars(items).items():
            getattr(joined, name).extend(values)
    if not joined.key:
        return
    forest = Forest(joined)
    forest.grow_root()
    for node in forest.nodes():
        name = open_name(forest.key(node))
        rows = list(forest.chain(node))
        for row in rows[:-1]:
            yield row
        yield rows[-1] | {"open_node": name}


def _partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    items, place = Items(), None
    for batch in batches:
        for conv, key, points, here in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "key", "points", "place")), strict=True):
            key, place = key.encode(), here
            if items.key:
                items.edges.append(common_turns(items.key[-1], key))
                # Equal sequences share one key.
                key = items.key[-1] if key == items.key[-1] else key
            items.add(key, np.concatenate([[0], np.cumsum(points, dtype=np.int64)]).astype(np.int64), len(points), conv)
    if items.key:
        yield from _batches(partition_rows(items, place), _PART)


def _merge_forests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = sorted((place, blob) for batch in batches for place, blob in zip(*(batch.column(c).to_pylist() for c in ("place", "forest")), strict=True))
    yield from _batches(open_rows(Items(**pickle.loads(blob)) for _, blob in found), _OPEN)


def _hash_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``parent, ends``: the hash of each open node's ids, its parts read in order."""
    kinds = {"parent": pa.binary(), "ends": pa.string()}

    def hashed() -> Iterator[dict]:
        name, state = None, None
        for batch in batches:
            for here, ids in zip(*(batch.column(c).to_pylist() for c in ("parent", "ids")), strict=True):
                if here != name:
                    if name is not None:
                        yield {"parent": name, "ends": state.hexdigest()}
                    name, state = here, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
        if name is not None:
            yield {"parent": name, "ends": state.hexdigest()}

    yield from _batches(hashed(), kinds)


def turn_digest() -> Column:
    """Digest of role and text; null is empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, DIGEST)


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns of each conversation by turn number, null first, as ``turns array<struct<digest, points>>``.

    Turns with the same number go by their digest. Rows without a ``conv_id`` belong to no conversation. Digests of all turns of a conversation
    are held by one task, its texts are not.
    """
    text = F.coalesce("text", F.lit(""))
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", turn_digest().alias("digest"), F.length(text).alias("points"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def with_shared_heads(sequences: DataFrame) -> DataFrame:
    """Conversations in which the first turns are those of the hundred's first conversation.

    ``sequences`` is a written table of ``conv_id, turns``. The first ``h`` turns of conversation ``c`` are replaced by the first ``h`` of ``c - c % 100``; ``h``
    is the CRC-32 of the number in decimal, modulo 6.
    """
    heads = sequences.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_HEAD).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (MOST_HEAD + 1)).cast("int")
    rows = sequences.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), h.alias("h")).join(heads, "base", "left")
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return rows.select("conv_id", F.concat(head, own).alias("turns"))


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row per node of the trie of ``conv_id, turns array<struct<digest, points, ...>>``, with unique ids.

    ``conv_id``: smallest member; ``depth``; ``parent_conv_id``: smallest member of the parent; ``n_convs``: members; ``n_children``; ``n_leaves``: childless nodes of the
    subtree; ``saved_tokens``: for each node of the subtree the code points of its last turn times its members but one; ``ends_sha256``: of the ids that end at the
    node; ``turn``: digest of the last turn, as ``turn_texts`` has it, null at the root. A conversation without turns is a member of the root alone. No conversations have no root.
    """
    key = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    rows = sequences.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["points"]).alias("points"))
    ordered = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("place", F.spark_partition_id().cast("long"))
    parts = stage(ordered.mapInArrow(_partition, _schema(_PART)), "trie-parts")

    forests = parts.where("kind = 'forest'").select("place", "forest").repartition(1)
    opened = stage(forests.mapInArrow(_merge_forests, _schema(_OPEN)), "trie-open")
    runs = parts.where("kind = 'ends'").select("parent", "place", "part", "ids")
    partitions = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = runs.repartition(partitions, "parent").sortWithinPartitions("parent", "place", "part").drop("place", "part")
    ends = ends.mapInArrow(_hash_ends, "parent binary, ends string").withColumnRenamed("parent", "open_node")
    spines = opened.join(ends, "open_node", "left").withColumn("ends_sha256", F.coalesce("ends", "ends_sha256")).select(*NODE)

    numbers = opened.where("open_node IS NOT NULL").select(F.col("open_node").alias("parent"), F.col("conv_id").alias("number"))
    done = skew_safe_join(parts.where("kind = 'node'").select(*NODE, "parent"), stage(numbers, "trie-numbers"), "parent")
    done = done.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "number")).select(*NODE)
    return done.unionByName(spines)


def turn_texts(conversations: DataFrame) -> DataFrame:
    """``turn, role, text`` of each distinct turn, to read a trie's ``turn`` by."""
    turn = turn_digest().alias("turn")
    return conversations.select(turn, F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["turn"])


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations with shared heads."""
    sequences = stage(turn_sequences(load(spark, sf_dir, "conversations")), "turn-sequences")
    return prefix_trie(with_shared_heads(sequences)).drop("turn")


# CRC-32 bit by bit: each byte comes as itself and seven zeros, each step shifts once.
_CRC = """CAST(xor(4294967295, list_reduce(
    list_prepend(4294967295, flatten(list_transform(range(1, len({0}) + 1), lambda i: [CAST(ascii(substr({0}, CAST(i AS INTEGER), 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END)) AS BIGINT)"""

ORACLE_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({{'digest': digest, 'points': length(text)}} ORDER BY turn NULLS FIRST, digest) AS turns FROM turns GROUP BY conv_id),
counted AS (SELECT *, {_CRC.format("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM own),
rebuilt AS (
  SELECT c.conv_id, coalesce(list_slice(b.turns, 1, c.h), []) || coalesce(list_slice(c.turns, c.h + 1, len(c.turns)), []) AS turns
  FROM counted c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
places AS (
  SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt),
paths AS (
  SELECT conv_id, depth, len(turns) = depth AS ends, CASE WHEN depth > 0 THEN turns[depth].points END AS points,
    list_aggregate(list_transform(turns[1:depth], lambda t: t.digest), 'string_agg', ',') AS key,
    list_aggregate(list_transform(turns[1:depth - 1], lambda t: t.digest), 'string_agg', ',') AS above
  FROM places),
nodes AS (
  SELECT depth, key, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(points) AS points,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids
  FROM paths GROUP BY depth, key),
children AS (SELECT depth - 1 AS depth, above AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.key IS NOT DISTINCT FROM n.key),
-- A node's smallest member passes all nodes above it.
below AS (
  SELECT p.depth, p.key, count(*) FILTER (WHERE n.n_children = 0) AS n_leaves,
    CAST(sum(CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * n.points ELSE 0 END) AS BIGINT) AS saved_tokens
  FROM full_nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.depth, p.key)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens, sha256(n.ids) AS ends_sha256
FROM full_nodes n JOIN below b ON b.depth = n.depth AND b.key IS NOT DISTINCT FROM n.key
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key IS NOT DISTINCT FROM n.above
"""
