"""Prefix trie of conversations in sharded double arrays.

A node is a distinct sequence of a conversation's first d turns (role, text); its members are the conversations that
start with it; the root (d = 0) has all of them.

1. Turns are numbered by a range-partitioned sort over all conversations (:func:`running`), so a conversation may
   span any number of tasks.  The same pass over (conversation, depth) gives every prefix a 124-bit key, the running
   sum of hashes of (depth, role, text); node counts are one partially aggregated grouping by that key.
2. A conversation's turns below the last node it shares with another one form its tail.  Only a tail's first node enters a
   trie; the others are rows of their own (one member, one leaf, nothing saved).
3. Nodes with more than ``shard_nodes`` rows below them are upper nodes.  The subtrees right below the upper nodes
   are dealt to shards by their prefix.  A shard numbers its turns densely, packs its nodes into BASE and CHECK
   arrays (child = BASE[node] + turn, valid where CHECK[child] = node) and traverses them from the shard's root to
   number of children, leaves and saved tokens.  A shard holds distinct nodes only, so a group of copies counts once.
4. Upper nodes are merged over all shards.  Every node belongs to its smallest member c, and c's nodes form
   one stretch of c's path.  With T(c) the sum over c's own upper nodes and over the shard subtree that c leads, the sum over
   a node's subtree is the sum of T over its members without what c owns above the node: two partially aggregated
   groupings and a running sum, no iteration over depths.
5. Member ids of a node's end are joined in ascending order in stretches of a range-partitioned sort; a node's
   stretches are hashed one after the other, so no task holds all ids.

Defined results: rows with null conv_id belong to no conversation; turns are ordered by number (null first), then
role, then text; null role or text is empty; repeated rows are turns of their own; an empty table has no nodes;
other columns are ignored.  In queries the edited conversations use Spark's ``%`` (sign of the dividend).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctrltok.llm.common import stored
from ctrltok.udfs import by_value

by_value(__name__)

MASK = (1 << 62) - 1
NODE = ["depth", "s1", "s2"]
PARENT = ["depth", "p1", "p2"]
IDS_IN_A_STRETCH = 1 << 16


# numbering and running sums over groups of any size


def running(df: DataFrame, key: str, order: list[str], sums: list[str], keep: list[str], name: str) -> DataFrame:
    """``key``, ``keep``, ``pos`` (place in the key's rows by ``order``, from 0) and for each of ``sums`` its running sum
    ``run_<column>`` modulo 2**62 (values from 0 to 2**62 - 1).

    Rows are range-partitioned by (key, order).  A task numbers its rows and tells the totals of its first and last key;
    totals of earlier partitions are added afterwards, so no key is bound to a task."""
    columns = [key, *dict.fromkeys([*keep, *sums])]
    ranged = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).select(*columns)
    kinds = {f.name: f.dataType.simpleString() for f in ranged.schema.fields}
    out = [key, *keep, "pos", *(f"run_{c}" for c in sums), "part", "edge"]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in [key, *keep]), *(f"{c} long" for c in out[1 + len(keep):-1]), "edge boolean"])

    def run(batches):
        part = TaskContext.get().partitionId()
        last, count, totals, first = None, 0, [0] * len(sums), None

        def edge(of, n, total, types):
            values = [pa.array([of], types[0]), *[pa.nulls(1, t) for t in types[1:]], pa.array([n], pa.int64()),
                      *[pa.array([t], pa.int64()) for t in total], pa.array([part], pa.int64()), pa.array([True])]
            return pa.RecordBatch.from_arrays(values, names=out)

        for b in batches:
            if not b.num_rows:
                continue
            types = [b.schema.field(c).type for c in [key, *keep]]
            keys = b.column(0).to_numpy()
            new = np.r_[keys[0] != last, keys[1:] != keys[:-1]]
            if last is not None and new[0] and first is None:
                first = (last, count, totals)
                yield edge(*first, types)
            at = np.arange(len(keys))
            begin = np.maximum.accumulate(np.where(new, at, -1))
            carried = begin < 0
            pos = np.where(carried, at + count, at - begin)
            results = []
            for k, c in enumerate(sums):
                total = np.cumsum(b.column(columns.index(c)).to_numpy().astype(np.uint64), dtype=np.uint64)
                before = np.where(begin > 0, total[np.maximum(begin - 1, 0)], np.uint64(0))
                results.append(((total - before + np.where(carried, np.uint64(totals[k]), np.uint64(0))) & np.uint64(MASK)).astype(np.int64))
            if first is None and new[1:].any():
                end = int(np.flatnonzero(new[1:])[0])
                first = (int(keys[0]), int(pos[end]) + 1, [int(r[end]) for r in results])
                yield edge(*first, types)
            last, count, totals = int(keys[-1]), int(pos[-1]) + 1, [int(r[-1]) for r in results]
            yield pa.RecordBatch.from_arrays(
                [b.column(columns.index(c)) for c in [key, *keep]] + [pa.array(x) for x in (pos, *results)] +
                [pa.array(np.full(len(keys), part, np.int64)), pa.array(np.zeros(len(keys), bool))], names=out)
        if last is not None:
            yield edge(last, count, totals, types)

    rows = stored(ranged.mapInArrow(run, schema), name)
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    wide = "decimal(38,0)"
    measures = ["pos", *(f"run_{c}" for c in sums)]
    # at most two rows a partition, so broadcast whatever the threshold
    carry = (rows.filter("edge").select(key, "part", *[(F.sum(F.col(m).cast(wide)).over(before) % (MASK + 1)).cast("long").alias(f"c_{m}")
                                                       for m in measures]).filter("c_pos > 0"))
    joined = rows.filter("not edge").join(F.broadcast(carry), [key, "part"], "left")
    added = [F.col(m) + F.coalesce(f"c_{m}", F.lit(0)) for m in measures]
    return joined.select(key, *keep, added[0].alias("pos"),
                         *[a.bitwiseAND(F.lit(MASK)).alias(m) for a, m in zip(added[1:], measures[1:], strict=True)])


# conversations


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, t1, t2, bytes``: every turn with its place in the conversation, a 128-bit hash and its text's bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                 role.alias("role"), text.alias("text")).filter("conv_id is not null")
    turns = turns.select("*", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1), "text", F.lit(2), "role").alias("t2"),
                         F.octet_length("text").cast("long").alias("bytes"))
    return running(turns, "conv_id", ["turn", "role", "text"], [], ["t1", "t2", "bytes"], "trie-turns")


def plain(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, len)`` of every conversation and ``(conv_id, depth, len, t1, t2, bytes)`` of its turns."""
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("len"))
    return convs, turns.join(convs, "conv_id").select("conv_id", (F.col("pos") + 1).alias("depth"), "len", "t1", "t2", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As :func:`plain`, with every conversation c edited: the first h = crc32(c) % 9 turns are those of conversation
    c - c % 5 (all it has if fewer), then come c's own after its first h."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    own = own.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % 5).alias("head"),
                     (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h"))
    had = own.select(F.col("conv_id").alias("head"), F.col("n").alias("head_n"))
    convs = own.join(had, "head", "left").select("conv_id", "head", "h", F.least("h", F.coalesce("head_n", F.lit(0))).alias("k"), "n")
    convs = stored(convs.select("*", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "trie-conversations")
    heads = turns.filter("pos < 8").withColumnRenamed("conv_id", "head")
    first = convs.join(heads, "head").filter("pos < h").select("conv_id", (F.col("pos") + 1).alias("depth"), "len", "t1", "t2", "bytes")
    rest = turns.join(convs, "conv_id").filter("pos >= h").select(
        "conv_id", (F.col("k") + F.col("pos") - F.col("h") + 1).alias("depth"), "len", "t1", "t2", "bytes")
    return convs.select("conv_id", "len"), first.union(rest)


def prefixes(rows: DataFrame) -> DataFrame:
    """Rows with the key of their prefix (``s1, s2``) and of its parent (``p1, p2``)."""
    mask = F.lit(MASK)
    salted = rows.select("*", F.xxhash64("depth", "t1", "t2").bitwiseAND(mask).alias("a"),
                         F.xxhash64("t2", F.lit(3), "t1", "depth").bitwiseAND(mask).alias("b"))
    found = running(salted, "conv_id", ["depth"], ["a", "b"], ["len", "t1", "t2", "bytes", "a", "b"], "trie-prefixes")
    return found.select("conv_id", (F.col("pos") + 1).alias("depth"), "len", "t1", "t2", "bytes", F.col("run_a").alias("s1"),
                        F.col("run_b").alias("s2"), (F.col("run_a") - F.col("a")).bitwiseAND(mask).alias("p1"),
                        (F.col("run_b") - F.col("b")).bitwiseAND(mask).alias("p2"))


def node_rows(rows: DataFrame, *more: Column) -> DataFrame:
    """One row per node: smallest member, members, members that end here, bytes of the last text, parent's key."""
    return rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
                                   F.count(F.when(F.col("depth") == F.col("len"), 1)).alias("ends"), F.max("bytes").alias("bytes"),
                                   F.max("t1").alias("t1"), F.max("t2").alias("t2"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), *more)


# double arrays


class DoubleArray:
    """A trie of dense codes (from 1): the child of node s over code c is t = base[s] + c where check[t] = s; node 1 is
    the root, slot 0 is never used."""

    def __init__(self):
        self.base, self.check = [0, 0], [-1, 0]
        self.free = 2

    def room(self, size: int) -> None:
        grow = size - len(self.check)
        if grow > 0:
            self.base += [0] * grow
            self.check += [-1] * grow

    def add(self, node: int, codes: list[int], tries: int = 32) -> list[int]:
        """Give ``node`` children over ascending ``codes``; returns their slots.  First fit over the next free slots,
        behind the end after ``tries`` misses."""
        low, check = codes[0], self.check
        while self.free < len(check) and check[self.free] >= 0:
            self.free += 1
        at, base = self.free, None
        for _ in range(tries):
            if at >= len(check):
                break
            if check[at] < 0:
                shift = at - low
                if all(shift + c >= len(check) or check[shift + c] < 0 for c in codes):
                    base = shift
                    break
            at += 1
        if base is None:
            base = len(check) - low
        self.room(base + codes[-1] + 1)
        self.base[node] = base
        slots = [base + c for c in codes]
        for s in slots:
            self.check[s] = node
        return slots

    def child(self, node: int, code: int) -> int:
        """The child's slot, -1 if there is none."""
        t = self.base[node] + code
        return t if 1 < t < len(self.check) and self.check[t] == node else -1


def pack(parent: list[int], label: list) -> tuple[DoubleArray, list[int]]:
    """The double array of nodes given by their parent's number (-1: the root; parents come first) and their label, and
    every node's slot.  Labels are numbered densely in order of appearance, so siblings often lie side by side."""
    codes: dict = {}
    children: dict[int, list[tuple[int, int]]] = {}
    for i, (p, x) in enumerate(zip(parent, label, strict=True)):
        children.setdefault(p, []).append((codes.setdefault(x, len(codes) + 1), i))
    trie, slots = DoubleArray(), [0] * len(parent)
    for p in [-1, *range(len(parent))]:
        if p in children:
            below = sorted(children[p])
            for (_, i), s in zip(below, trie.add(1 if p < 0 else slots[p], [c for c, _ in below]), strict=True):
                slots[i] = s
    return trie, slots


def traverse(trie: DoubleArray, value: dict[int, int]) -> dict[int, tuple[int, int, int]]:
    """``slot -> (children, leaves, sum of value over the subtree)`` of all nodes, from CHECK's links."""
    below: dict[int, list[int]] = {}
    for t, s in enumerate(trie.check):
        if s > 0:
            below.setdefault(s, []).append(t)
    order = [1]
    for s in order:
        order += below.get(s, ())
    done: dict[int, tuple[int, int, int]] = {}
    for s in reversed(order):
        kids = below.get(s, ())
        done[s] = (len(kids), sum(done[t][1] for t in kids) or 1, value.get(s, 0) + sum(done[t][2] for t in kids))
    return done


SHARD = ("conv_id long, depth long, s1 long, s2 long, p1 long, p2 long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, top boolean")


def shard_nodes_of(table: pa.Table) -> pa.Table:
    """Results of one shard's nodes: rows of the nodes right below upper ones (``top``) and of all nodes under them."""
    cols = {c: table.column(c).to_pylist() for c in ("depth", "s1", "s2", "p1", "p2", "conv_id", "n_convs", "ends", "bytes", "t1", "t2", "rd")}
    order = sorted(range(table.num_rows), key=lambda i: (cols["depth"][i], cols["conv_id"][i]))
    c = {k: [v[i] for i in order] for k, v in cols.items()}
    number = {(d, a, b): i for i, (d, a, b) in enumerate(zip(c["depth"], c["s1"], c["s2"], strict=True))}
    top = [d == r for d, r in zip(c["depth"], c["rd"], strict=True)]
    parent = [-1 if t else number[d - 1, a, b] for t, d, a, b in zip(top, c["depth"], c["p1"], c["p2"], strict=True)]
    label = [(d, a, b) if t else (u, v) for t, d, a, b, u, v in zip(top, c["depth"], c["s1"], c["s2"], c["t1"], c["t2"], strict=True)]
    trie, slots = pack(parent, label)
    done = traverse(trie, {s: (n - 1) * b for s, n, b in zip(slots, c["n_convs"], c["bytes"], strict=True)})
    at = {s: i for i, s in enumerate(slots)}
    found = [done[s] for s in slots]
    above = [None if t else c["conv_id"][at[trie.check[s]]] for t, s in zip(top, slots, strict=True)]
    children = [1 - e if n == 1 else f[0] for n, e, f in zip(c["n_convs"], c["ends"], found, strict=True)]
    values = [c["conv_id"], c["depth"], c["s1"], c["s2"], c["p1"], c["p2"], above, c["n_convs"], children, [f[1] for f in found], [f[2] for f in found]]
    names = [f.split()[0] for f in SHARD.split(", ")]
    return pa.table([*[pa.array(v, pa.int64()) for v in values], pa.array(top)], names=names)


# member ids


def end_hashes(ends: DataFrame) -> DataFrame:
    """``depth, s1, s2, ends_sha256`` of nodes where conversations end, from ``(depth, s1, s2, conv_id)`` rows."""
    def stretches(batches):
        key, ids = None, []

        def put():
            return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int64()) for k in key], pa.array([ids[0]], pa.int64()),
                                               pa.array([",".join(map(str, ids))])], names=[*NODE, "first", "ids"])

        for b in batches:
            for *k, c in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if key != k or len(ids) >= IDS_IN_A_STRETCH:
                    if ids:
                        yield put()
                    key, ids = k, []
                ids.append(c)
        if ids:
            yield put()

    def digest(batches):
        key, hashed = None, None
        names = [*NODE, "ends_sha256"]
        for b in batches:
            out = []
            for *k, ids in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if key == k:
                    hashed.update(b"," + ids.encode())
                else:
                    if key:
                        out.append([*key, hashed.hexdigest()])
                    key, hashed = k, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=names)
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in [*key, hashed.hexdigest()]], names=names)

    parts = (ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").select(*NODE, "conv_id")
             .mapInArrow(stretches, "depth long, s1 long, s2 long, first long, ids string"))
    return (parts.repartition(*NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "ids")
            .mapInArrow(digest, "depth long, s1 long, s2 long, ends_sha256 string"))


# the trie


def trie(conversations: DataFrame, edited: bool = False, shard_nodes: int = 2048) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (bytes that sharing the subtree's turns saves) and ``ends_sha256`` (ids of the members that end here)."""
    turns = numbered(conversations)
    convs, rows = (rebuilt if edited else plain)(turns)
    rows = stored(prefixes(rows), "trie-rows")
    nodes = stored(node_rows(rows), "trie-nodes")
    tails = stored(nodes.filter("n_convs = 1").groupBy("conv_id").agg(F.min("depth").alias("tail")), "trie-tails")
    shared = rows.join(tails, "conv_id", "left").filter("tail is null or depth <= tail")
    below = F.sum(F.coalesce("tail", "len") - F.col("depth") + 1).alias("below")
    inner = stored(node_rows(shared, below), "trie-inner")
    shared = shared.select("conv_id", *NODE)

    upper = stored(inner.filter(F.col("below") > shard_nodes), "trie-upper")
    upper_keys = upper.select(*NODE)
    crossed = shared.join(upper_keys, NODE).groupBy("conv_id").agg((F.max("depth") + 1).alias("rd"))
    tops = (shared.join(crossed, "conv_id", "left").withColumn("rd", F.coalesce("rd", F.lit(1))).filter("depth = rd")
            .select("conv_id", "rd", F.col("s1").alias("r1"), F.col("s2").alias("r2")))
    lower = inner.filter(F.col("below") <= shard_nodes)
    shards = lower.agg(F.greatest(F.ceil(F.count("*") / shard_nodes), F.lit(1)).alias("shards"))   # one row
    dealt = (lower.join(tops, "conv_id").crossJoin(F.broadcast(shards))
             .withColumn("shard", F.pmod(F.xxhash64("rd", "r1", "r2"), F.col("shards"))))
    packed = stored(dealt.groupBy("shard").applyInArrow(shard_nodes_of, SHARD), "trie-shards")

    merged = merge_upper(upper, inner, shared, packed)
    names = ["conv_id", *NODE, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    at_top = packed.filter("top").drop("parent_conv_id").union(merged.select(packed.drop("parent_conv_id").columns))
    parents = upper.select(F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), F.col("s1").alias("p1"), F.col("s2").alias("p2"))
    least = convs.agg(F.min("conv_id").alias("least"))                                             # one row
    at_top = (at_top.join(parents, PARENT, "left").crossJoin(F.broadcast(least))
              .withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("least")).otherwise(F.col("parent_conv_id"))))
    one = F.lit(1).cast("long")
    tail = (nodes.filter("n_convs = 1").join(tails, "conv_id").filter("depth > tail")
            .select("conv_id", *NODE, F.col("conv_id").alias("parent_conv_id"), "n_convs", (one - F.col("ends")).alias("n_children"),
                    one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens")))
    known = stored(packed.filter("not top").select(*names).union(at_top.select(*names)).union(tail.select(*names)), "trie-known")

    zero = F.lit(0).cast("long")
    ends = rows.filter("depth = len").select(*NODE, "conv_id").union(
        convs.filter("len = 0").select(zero.alias("depth"), zero.alias("s1"), zero.alias("s2"), "conv_id"))
    first = known.filter("depth = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    root = (convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").crossJoin(first)
            .select("conv_id", zero.alias("depth"), zero.alias("s1"), zero.alias("s2"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
                    "n_children", F.coalesce("n_leaves", one).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens")))
    nobody = hashlib.sha256(b"").hexdigest()
    return (known.union(root.select(*names)).join(end_hashes(ends), NODE, "left")
            .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nobody))).drop("s1", "s2"))


def merge_upper(upper: DataFrame, inner: DataFrame, shared: DataFrame, packed: DataFrame) -> DataFrame:
    """Results of the upper nodes over all shards (``SHARD`` without parent_conv_id)."""
    value = (F.col("n_convs") - 1) * F.col("bytes")
    kids = (inner.select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("s1"), F.col("p2").alias("s2")).join(upper.select(*NODE), NODE)
            .groupBy(*NODE).agg(F.count("*").alias("n_children")))
    counted = stored(upper.join(kids, NODE, "left").withColumn("n_children", F.when(F.col("n_convs") == 1, 1 - F.col("ends"))
                                                               .otherwise(F.coalesce("n_children", F.lit(0)))), "trie-counted")
    own = running(counted.withColumn("value", value), "conv_id", ["depth"], ["value"], [*NODE[1:], "depth", "value"], "trie-own")
    above = own.select(*NODE, (F.col("run_value") - F.col("value")).alias("above"))
    leaf = F.when((F.col("n_children") == 0) | (F.col("n_convs") == 1), 1).otherwise(0)
    parts = (counted.select("conv_id", value.alias("t"), leaf.alias("l"))
             .union(packed.filter("top").select("conv_id", F.col("saved_tokens").alias("t"), F.col("n_leaves").alias("l")))
             .groupBy("conv_id").agg(F.sum("t").alias("t"), F.sum("l").alias("l")))
    sums = (shared.join(upper.select(*NODE), NODE).join(parts, "conv_id").groupBy(*NODE)
            .agg(F.sum("t").alias("t"), F.sum("l").alias("n_leaves")))
    return (counted.join(sums, NODE).join(above, NODE)
            .select("conv_id", *NODE, "p1", "p2", "n_convs", "n_children", "n_leaves", (F.col("t") - F.col("above")).alias("saved_tokens"),
                    F.lit(True).alias("top")))
