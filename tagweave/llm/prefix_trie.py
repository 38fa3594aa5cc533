"""Prefix trie of conversations, by adaptive radix trees over turn ids.

A turn becomes an id of `WIDTH` bytes, big-endian, equal for equal (role, text); a conversation is the string of its
turns' ids. Equal conversations are put together first, then the distinct strings are range partitioned in byte order,
so that the tree of a partition is whole but for the prefixes it shares with its neighbours. Each partition builds an
adaptive radix tree: nodes of 4, 16, 48 or 256 places that grow as needed, with compressed paths. Byte depths that are
whole turns emit trie nodes; the others are inner structure only. The shared prefixes, at most one chain for each border
between partitions, are added up over the partitions, and their sums over subtrees follow from running sums
along the chains.

Defined cases: turns are ordered by turn number, null first, then by role and id; null role or text is empty; equal rows are
turns of their own; rows without a conversation id are left out; an empty table has no nodes; other columns
are not read, whatever their names. One conversation is one string in a row (24 bytes a turn), a list of equal
conversations is not: its ids are gathered in ranges and hashed as they come.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.llm.common import table, text_of
from tagweave.operators.joins import attach
from tagweave.session import settle

WIDTH = 16
#: Conversation ids that one row lists at most, as a range of ids.
ID_RANGE = 256
#: Distinct conversations, and bytes of their strings, of one tree.
TREE_KEYS, TREE_BYTES = 50_000, 16 << 20


class Node:
    """A place in the tree: the bytes that lead to it from its parent, and its children by their first byte.

    Up to 16 children are two short parallel arrays; up to 48 an index of 256 bytes into places; beyond that
    256 places. `value` is the number of the string that ends here, else -1.
    """

    __slots__ = ("path", "value", "size", "labels", "places")

    def __init__(self, path: bytes, value: int = -1):
        self.path, self.value, self.size = path, value, 0
        self.labels: bytearray | None = bytearray(4)
        self.places: list[Node | None] = [None] * 4

    def find(self, label: int) -> Node | None:
        kind = len(self.places)
        if kind <= 16:
            at = self.labels.find(label, 0, self.size)
            return self.places[at] if at >= 0 else None
        if kind == 48:
            at = self.labels[label]
            return self.places[at - 1] if at else None
        return self.places[label]

    def put(self, label: int, child: Node) -> None:
        """Set the child under a label, in a larger layout if this one is full."""
        kind = len(self.places)
        if kind <= 16:
            at = self.labels.find(label, 0, self.size)
        elif kind == 48:
            at = self.labels[label] - 1
        else:
            at = label if self.places[label] is not None else -1
        if at >= 0:
            self.places[at] = child
            return
        if self.size == kind:
            self.grow()
            kind = len(self.places)
        if kind <= 16:
            self.labels[self.size], self.places[self.size] = label, child
        elif kind == 48:
            self.places[self.size], self.labels[label] = child, self.size + 1
        else:
            self.places[label] = child
        self.size += 1

    def grow(self) -> None:
        kind = len(self.places)
        children = list(self.children())
        if kind == 4:
            self.labels, self.places = bytearray(16), [None] * 16
        elif kind == 16:
            self.labels, self.places = bytearray(256), [None] * 48
        else:
            self.labels, self.places = None, [None] * 256
        self.size = 0
        for label, child in children:
            self.put(label, child)

    def children(self) -> Iterator[tuple[int, Node]]:
        kind = len(self.places)
        if kind <= 16:
            yield from zip(self.labels[:self.size], self.places)
        elif kind == 48:
            for label, at in enumerate(self.labels):
                if at:
                    yield label, self.places[at - 1]
        else:
            for label, child in enumerate(self.places):
                if child is not None:
                    yield label, child


def insert(root: Node, key: bytes, value: int) -> None:
    """Add a string; a path that it leaves half-way is split where they part."""
    node, depth, above = root, 0, None
    while True:
        rest = key[depth:depth + len(node.path)]
        if rest != node.path:
            shared = next((i for i, (a, b) in enumerate(zip(rest, node.path)) if a != b), len(rest))
            fork = Node(node.path[:shared])
            node.path = node.path[shared:]
            fork.put(node.path[0], node)
            above.put(fork.path[0], fork)
            node = fork
        depth += len(node.path)
        if depth == len(key):
            node.value = value
            return
        below = node.find(key[depth])
        if below is None:
            node.put(key[depth], Node(key[depth:], value))
            return
        node, above = below, node


def _after(root: Node) -> list[tuple[Node, int, int]]:
    """Every node after all nodes below it: (node, depth of its parent, its own depth), in bytes."""
    order, stack = [], [(root, 0)]
    while stack:
        node, start = stack.pop()
        order.append((node, start, start + len(node.path)))
        stack.extend((child, start + len(node.path)) for _, child in node.children())
    return order[::-1]


class _Sums:
    """What is known of the strings below a place."""

    __slots__ = ("convs", "least", "kids", "leaves", "saved", "sample", "open")

    def __init__(self):
        self.convs = self.kids = self.leaves = self.saved = 0
        self.least, self.sample, self.open = None, -1, []

    def add(self, convs: int, least: int, sample: int) -> None:
        self.convs += convs
        if self.least is None or least < self.least:
            self.least = least
        self.sample = sample


def _chain(key: bytes | None, depth: int) -> list[bytes]:
    """Digests of the prefixes of 0 to `depth` turns."""
    running, out = hashlib.sha256(), []
    out.append(running.digest()[:WIDTH])
    for d in range(depth):
        running.update(key[d * WIDTH:(d + 1) * WIDTH])
        out.append(running.digest()[:WIDTH])
    return out


def _shared(a: bytes | None, b: bytes | None) -> int:
    """Whole turns with which both strings begin; 0 without a neighbour (the root)."""
    if a is None or b is None:
        return 0
    turns = min(len(a), len(b)) // WIDTH
    if not turns:
        return 0
    x, y = (np.frombuffer(k, np.uint8, turns * WIDTH).reshape(turns, WIDTH) for k in (a, b))
    apart = np.flatnonzero((x != y).any(1))
    return int(apart[0]) if len(apart) else turns


def grown(keys: list[bytes]) -> Node:
    root = Node(b"")
    for n, key in enumerate(keys):
        insert(root, key, n)
    return root


def emitted(keys: list[bytes], sizes: list, convs: list[int], least: list[int], ends: list[str],
            before: bytes | None, after: bytes | None) -> Iterator[dict]:
    """Trie nodes of sorted distinct strings, between the last string before them and the first one after.

    A node that a neighbour may hold too is marked by the digest of its prefix; its numbers count what this partition
    has, without marked nodes below. Other nodes are complete; right below a marked one they name its digest
    instead of their parent.
    """
    first, last = _shared(before, keys[0]), _shared(keys[-1], after)
    left, right = _chain(keys[0], first), _chain(keys[-1], last)

    def on(chain: int, key: bytes, sample: int, lowest: int) -> int:
        """Turns up to which a string runs along a chain to a neighbour; -1 if not from the depth asked for."""
        return min(chain, _shared(key, keys[sample])) if lowest <= chain else -1

    below: dict[int, _Sums] = {}
    for node, start, end in _after(grown(keys)):
        # `here` gathers what lies beyond the node's own depth; `open` are the trie nodes next below, parent unnamed
        here = _Sums()
        for _, child in node.children():
            sums = below.pop(id(child))
            here.add(sums.convs, sums.least, sums.sample)
            here.kids += sums.kids
            here.leaves += sums.leaves
            here.saved += sums.saved
            here.open += sums.open
        if node.value >= 0:
            here.add(convs[node.value], least[node.value], node.value)
        lowest = 0 if end == 0 and start == 0 else start // WIDTH + 1
        to_left = on(first, keys[0], here.sample, lowest)
        to_right = on(last, keys[-1], here.sample, lowest)
        for depth in range(end // WIDTH, lowest - 1, -1):
            digest = left[depth] if depth <= to_left else right[depth] if depth <= to_right else None
            ended = node.value if node.value >= 0 and depth * WIDTH == end else -1
            size = int(sizes[here.sample][depth - 1]) if depth else 0
            row = {"conv_id": here.least, "depth": depth, "n_convs": here.convs, "n_children": here.kids,
                   "ends_sha256": ends[ended] if ended >= 0 else None, "bytes": size, "digest": digest,
                   "parent_conv_id": None, "parent_digest": None, "lo": None, "hi": None}
            for child in here.open:
                child["parent_digest" if digest else "parent_conv_id"] = digest or here.least
                yield child
            if digest:
                row |= {"n_leaves": here.leaves, "saved_tokens": here.saved,
                        "lo": int(depth > to_left), "hi": int(depth <= to_right)}
                here.kids = 0  # marked children are counted when they are added up
            else:
                here.leaves += not here.kids
                here.saved += (here.convs - 1) * size
                row |= {"n_leaves": here.leaves, "saved_tokens": here.saved}
                here.kids = 1
            here.open = [row]
        below[id(node)] = here
    yield from here.open


_ROW = ("conv_id long, depth long, n_convs long, n_children long, ends_sha256 string, bytes long, digest binary, "
        "parent_conv_id long, parent_digest binary, lo long, hi long, n_leaves long, saved_tokens long, part long")
_OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_id(role: Column, text: Column) -> Column:
    """The first bytes of a digest of both, as a fixed-width number, high byte first."""
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, WIDTH)


def in_order(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`conv_id` and `turns`, its turns in order: role, id and bytes of the text."""
    rows = df.filter(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"),
        F.struct(F.col(f"`{turn}`").alias("turn"), text_of(role).alias("role"), turn_id(text_of(role), text_of(text)).alias("id"),
                 F.octet_length(text_of(text)).cast("long").alias("n")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(
        t["id"].alias("id"), t["n"].alias("n"))).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Each conversation with its first turns taken from the one whose id is the next lower multiple of five."""
    donors = convs.filter("conv_id % 5 = 0").select(F.col("conv_id").alias("donor"), F.slice("turns", 1, 8).alias("given"))
    own = convs.select("*", F.expr("conv_id - conv_id % 5").alias("donor"), F.expr("cast(crc32(cast(cast(conv_id as string) as binary)) % 9 as int)").alias("h"))
    both = own.join(donors, "donor", "left")
    none = F.array().cast("array<struct<id:binary,n:bigint>>")
    given = F.when(F.col("h") > 0, F.slice(F.coalesce("given", none), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(none)
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return both.select("conv_id", F.concat(given, rest).alias("turns"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each string, from its ranges of ids in order: the ids are hashed as they come."""
    held, digest, out = None, None, []

    def closed():
        return (held["key"], held["sizes"], held["convs"], held["least"], digest.hexdigest())

    def batch():
        names = ["key", "sizes", "convs", "least", "ends"]
        kinds = [pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            for row in whole.slice(at, 256).to_pylist():
                if held is None or row["key_hash"] != held["key_hash"]:
                    if held is not None:
                        out.append(closed())
                    held, digest = row, hashlib.sha256(row["ids"].encode())
                else:
                    held["convs"] += row["convs"]
                    held["least"] = min(held["least"], row["least"])
                    digest.update(b"," + row["ids"].encode())
            if out:
                yield batch()
                out = []
    if held is not None:
        out.append(closed())
        yield batch()


def distinct_strings(convs: DataFrame) -> DataFrame:
    """`key`, the string of turn ids of equal conversations, their number, least id and the hash of their ids."""
    hexes = F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "")
    rows = convs.select("conv_id", F.unhex(hexes).alias("key"), F.transform("turns", lambda t: t["n"]).alias("sizes"))
    ranges = (rows.withColumn("key_hash", F.unhex(F.sha2("key", 256)))
              .withColumn("range", F.expr(f"conv_id div {ID_RANGE}"))
              .groupBy("key_hash", "range").agg(F.first("key").alias("key"), F.first("sizes").alias("sizes"),
                                                F.count(F.lit(1)).alias("convs"), F.min("conv_id").alias("least"),
                                                F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")))
    return (ranges.repartition("key_hash").sortWithinPartitions("key_hash", "range")
            .mapInArrow(_hashed, "key binary, sizes array<long>, convs long, least long, ends string"))


def _planted(part: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The trie nodes of one partition; its neighbours' nearest strings come as rows of their own."""
    side = rows["side"].to_numpy()
    near = {s: bytes(rows["key"].iloc[i]) for s in (-1, 1) for i in np.flatnonzero(side == s)}
    own = rows[side == 0].sort_values("key")
    found = list(emitted([bytes(k) for k in own["key"]], list(own["sizes"]), own["convs"].tolist(), own["least"].tolist(),
                         own["ends"].tolist(), near.get(-1), near.get(1)))
    n = int(part[0])
    names = [c.split()[0] for c in _ROW.split(", ")]
    columns = {c: [r.get(c) for r in found] for c in names}
    columns["part"] = [n] * len(found)
    for name in ("lo", "hi"):
        columns[name] = [None if v is None else n + v for v in columns[name]]
    kinds = {"ends_sha256": object, "digest": object, "parent_digest": object}
    return pd.DataFrame({c: pd.Series(columns[c], dtype=kinds.get(c, "Int64")) for c in names})


def _forest(strings: DataFrame) -> DataFrame:
    """Nodes of all partitions, marked where neighbours may hold them too."""
    rows, size = strings.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("key") + 64), F.lit(0))).first()
    parts = max(1, -(-rows // TREE_KEYS), -(-size // TREE_BYTES))
    dealt = settle(strings.repartitionByRange(parts, "key").withColumn("place", F.spark_partition_id()))
    in_turn = Window.orderBy("place")  # one row for each partition
    ends = settle(dealt.groupBy("place").agg(F.min("key").alias("low"), F.max("key").alias("high")).select(
        "place", (F.row_number().over(in_turn) - 1).cast("long").alias("part"), F.lag("high").over(in_turn).alias("before"),
        F.lead("low").over(in_turn).alias("after")))
    own = dealt.join(F.broadcast(ends.select("place", "part")), "place").drop("place").withColumn("side", F.lit(0))
    near = ends.select("part", F.explode(F.array(F.struct(F.lit(-1).alias("side"), F.col("before").alias("key")),
                                                 F.struct(F.lit(1).alias("side"), F.col("after").alias("key")))).alias("e"))
    near = near.select("part", "e.side", "e.key", F.lit(0).cast("long").alias("convs"), F.lit(0).cast("long").alias("least"))
    near = near.filter("key is not null")
    return own.unionByName(near, allowMissingColumns=True).groupBy("part").applyInPandas(_planted, _ROW)


def _merged(shared: DataFrame) -> DataFrame:
    """Nodes that several partitions hold, added up; `lo` and `hi` are the first and last border they span."""
    nodes = settle(shared.groupBy("digest").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.max("ends_sha256").alias("ends_sha256"), F.first("bytes").alias("bytes"),
        F.first("parent_digest").alias("parent_digest"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
    marked = nodes.filter("parent_digest is not null").groupBy(F.col("parent_digest").alias("digest")).agg(F.count(F.lit(1)).alias("more"))
    nodes = settle(nodes.join(marked, "digest", "left").withColumn("n_children", F.expr("n_children + coalesce(more, 0)"))
                   .withColumn("leaf", F.expr("cast(n_children = 0 as long)")).withColumn("own", F.expr("(n_convs - 1) * bytes")))
    # each node stands on the chain of its first border; below a node lie the rest of that chain and the later chains up to `hi`
    deeper = Window.partitionBy("lo").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    chains = nodes.select(F.explode(F.array("lo", "hi")).alias("at"), F.lit(0).alias("leaf"), F.lit(0).alias("own")).union(
        nodes.select("lo", "leaf", "own")).groupBy("at").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    so_far = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # one row for each border
    totals = settle(chains.select("at", F.sum("leaf").over(so_far).alias("leaves"), F.sum("own").over(so_far).alias("saves")))
    low, high = (totals.select(F.col("at").alias(c), F.struct("leaves", "saves").alias(f"at_{c}")) for c in ("lo", "hi"))
    summed = (nodes.withColumn("tail_leaves", F.sum("leaf").over(deeper)).withColumn("tail_saves", F.sum("own").over(deeper))
              .join(low, "lo").join(high, "hi"))
    summed = summed.withColumn("n_leaves", F.expr("n_leaves + tail_leaves + at_hi.leaves - at_lo.leaves")).withColumn(
        "saved_tokens", F.expr("saved_tokens + tail_saves + at_hi.saves - at_lo.saves"))
    return settle(summed.select(*[c for c in _OUT if c != "parent_conv_id"], "digest", "parent_digest"))


def trie(convs: DataFrame) -> DataFrame:
    """One row for each node of the prefix trie of conversations (`conv_id`, `turns` of id and bytes)."""
    nodes = settle(_forest(settle(distinct_strings(convs))))
    merged = _merged(nodes.filter("digest is not null"))
    names = merged.select(F.col("digest").alias("parent_digest"), F.col("conv_id").alias("named"))
    whole = nodes.filter("digest is null").select(*_OUT, "parent_digest").unionByName(
        merged.drop("digest"), allowMissingColumns=True)
    under = attach(whole, names, ["parent_digest"], salt_by=["conv_id", "depth"])
    return under.select("conv_id", "depth", F.coalesce("parent_conv_id", "named").alias("parent_conv_id"), "n_convs", "n_children",
                        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations."""
    convs = settle(in_order(table(spark, folder, "conversations")))
    return trie(rebuilt(convs))
