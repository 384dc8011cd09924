"""The prefix trie of conversations, from adaptive radix trees over fixed-width turn ids.

A turn is 16 big-endian bytes, the md5 of its role and text. Conversations are cut into stretches of
``STRETCH`` turns, so that no row grows with a conversation; a stretch's key is the id of the prefix
it starts from and its turns' ids. Stretches are dealt to tasks by ranges of their keys, so those that
share prefixes meet; equal ones are told apart by their conversation, so a group of copies is spread.
Each task adds its keys to radix trees of bounded size. Only byte depths that end a turn are nodes, and
Spark adds up what several tasks or trees say of one node.

The id of a prefix is the XOR of 128-bit hashes of (place, turn): a sum over rows, in any order. Sums
over subtrees need no walk from level to level: a node is owned by its smallest member; the nodes that
a conversation owns are the lower end of its path. So the sum below a node is the sum over its members
of all they own, less what its owner owns above it: a second round of the same trees with other weights.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.llm.radix import RadixTree
from panelworks.operators.position import running_within_segments
from panelworks.session import materialize

WIDTH = 16
STRETCH = 256
TREE_BYTES = 32 << 20  # keys of one tree; a task starts the next one beyond
FAMILY, HEADS = 20, 4
LEADING_TURNS = 4  # of a key, for its range
CHAIN_SEGMENT = 4096
WORD = r"[^\x20\x09-\x0D]+"
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each conversation of a sorted partition."""
    now, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy()
        new = np.concatenate([[conv[0] != now], conv[1:] != conv[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(conv)), 0))
        nth = np.arange(len(conv)) - start + 1
        if not new[0]:
            nth[: int(np.argmax(new)) if new.any() else len(nth)] += seen
        now, seen = conv[-1], int(nth[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth)], [*batch.schema.names, "nth"])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, tid, words): turns in order, from 1; tid is the md5 of role and text.

    Turns are ordered by turn (null first), then role, then text; null role or text counts as empty.
    Rows without conv_id belong to no conversation. Rows are dealt by ranges, so a conversation of any
    length is spread; ties beyond the first 64 letters of a text stay together.
    """
    n = _partitions(conversations)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint"), F.col("turn"), role.alias("role"), text.alias("text"))
    order = ["conv_id", "turn", "role"]
    dealt = rows.repartitionByRange(n, *order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    dealt = dealt.select("conv_id", F.spark_partition_id().alias("part"), F.unhex(F.md5(said)).alias("tid"),
                         F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words"))
    placed = materialize(dealt.mapInArrow(_numbers, "conv_id bigint, part int, tid binary, words bigint, nth bigint"), "turns")
    parts = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("_n"))
    several = parts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select("conv_id")
    split = parts.join(several, "conv_id", "left_semi").withColumnsRenamed({"part": "_seg"})
    before = running_within_segments(split.withColumn("_own", F.lit(0)), "_own", ["conv_id"], ["_n"])
    before = before.select("conv_id", F.col("_seg").alias("part"), F.col("_n_before").alias("_before"))
    place = F.col("nth") + F.coalesce("_before", F.lit(0))
    return placed.join(before, ["conv_id", "part"], "left").select("conv_id", place.alias("place"), "tid", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, tid, words) of rebuilt conversations, and (conv_id) of all of them, turnless ones too.

    Conversation c starts with the first h = crc32(c) % 4 turns of c - c % 20 (all if it has fewer,
    none if it does not exist); its own turns follow, without its first h. c % 20 has the sign of c.
    """
    turns = materialize(turns, "numbered")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("_size"))
    convs = materialize(convs.withColumns({"_h": taken, "_base": F.col("conv_id") - F.col("conv_id") % FAMILY}), "conversations")
    bases = convs.filter("conv_id = _base").select("_base", F.least("_size", F.lit(HEADS)).alias("_there"))
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("place") < HEADS)).withColumnRenamed("conv_id", "_base")
    led = convs.filter("_h > 0").join(heads, "_base").filter(F.col("place") <= F.col("_h")).select("conv_id", *turns.columns[1:])
    known = convs.join(bases, "_base", "left").select(
        "conv_id", "_h", F.least("_h", F.coalesce("_there", F.lit(0))).alias("_led"))
    own = turns.join(known, "conv_id").filter(F.col("place") > F.col("_h")).select(
        "conv_id", (F.col("place") - F.col("_h") + F.col("_led")).alias("place"), "tid", "words")
    return led.unionByName(own), convs.select("conv_id")


def stretches(turns: DataFrame) -> DataFrame:
    """One row per conversation and ``STRETCH`` turns: seq, turns in order, its hashes' XOR, the prefix before it."""
    hashed = turns.withColumns({
        "seq": F.floor((F.col("place") - 1) / STRETCH), "a": F.xxhash64("place", "tid"), "b": F.xxhash64("tid", "place", F.lit(1))})
    packed = materialize(hashed.groupBy("conv_id", "seq").agg(
        F.sort_array(F.collect_list(F.struct("place", "tid", "a", "b", "words"))).alias("turns"),
        F.bit_xor("a").alias("sa"), F.bit_xor("b").alias("sb")), "stretches")
    long = packed.filter("seq = 1").select("conv_id")
    digests = packed.select("conv_id", "seq", "sa", "sb").join(long, "conv_id", "left_semi")
    upto = "partition by conv_id order by seq rows between unbounded preceding and 1 preceding"
    before = digests.select("conv_id", "seq", F.expr(f"bit_xor(sa) over ({upto})").alias("pa"), F.expr(f"bit_xor(sb) over ({upto})").alias("pb"))
    return materialize(packed.join(before, ["conv_id", "seq"], "left").fillna(0, ["pa", "pb"]), "stretches")


_NODES = "ia bigint, ib bigint, fa bigint, fb bigint, depth bigint, words bigint, least bigint, sums array<bigint>"


def _accumulated(hashes: np.ndarray, before: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Per row the XOR up to each turn, beginning with the one before the row: one more entry than turns."""
    size = np.diff(start) + 1
    at = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()), np.int64)
    inner = np.ones(len(flat), bool)
    inner[at] = False
    flat[inner] = hashes
    run = np.bitwise_xor.accumulate(flat) if len(flat) else flat
    return run ^ np.repeat(run[at] ^ before, size)


def _tree_nodes(batches: Iterator[pa.RecordBatch], weights: int, tree_bytes: int) -> Iterator[pa.RecordBatch]:
    """Sums of the weights of all members below, for each node of the trees of a partition."""
    tree, held, starts, used = RadixTree(weights), [], [], 0

    def emitted() -> Iterator[pa.RecordBatch]:
        ids = [np.concatenate([h[k] for h in held]) for k in range(4)]  # prefix ids a, b; words; depth
        first = np.concatenate(starts)
        found = list(tree.aligned(WIDTH, 1))
        for i in range(0, len(found), 1 << 16):
            part = found[i : i + (1 << 16)]
            at = first[[n.row for _, n in part]] + np.array([d - 1 for d, _ in part])
            sums = pa.array([n.sums for _, n in part], pa.list_(pa.int64()))
            cols = [ids[0][at], ids[1][at], ids[0][at - 1], ids[1][at - 1], ids[3][at], ids[2][at], [n.least for _, n in part]]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols], sums], [c.split()[0] for c in _NODES.split(", ")])

    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        turns = batch.column("turns")
        start = turns.offsets.to_numpy()
        flat = turns.flatten()
        start = start - start[0]
        raw = b"".join(flat.field("tid").to_pylist())
        before = [batch.column(c).to_numpy() for c in ("pa", "pb")]
        lead = np.stack([b.astype(">i8") for b in before], axis=1).tobytes()
        a, b = (_accumulated(flat.field(c).to_numpy(), p, start) for c, p in zip("ab", before))
        size = np.diff(start) + 1
        at = np.cumsum(size) - size
        inner = np.ones(len(a), bool)
        inner[at] = False
        extra = np.zeros((2, len(a)), np.int64)
        extra[0, inner], extra[1, inner] = flat.field("words").to_numpy(), flat.field("place").to_numpy()
        starts.append(at + sum(len(h[0]) for h in held))
        held.append((a, b, extra[0], extra[1]))
        conv, weight = batch.column("conv_id").to_pylist(), batch.column("weights").to_pylist()
        cuts = start.tolist()
        for k in range(len(conv)):
            key = lead[k * WIDTH : (k + 1) * WIDTH] + raw[cuts[k] * WIDTH : cuts[k + 1] * WIDTH]
            tree.insert(key, weight[k], conv[k], rows + k)
        rows += len(conv)
        used += len(raw)
        if used > tree_bytes:
            yield from emitted()
            tree, held, starts, used, rows = RadixTree(weights), [], [], 0, 0
    if held:
        yield from emitted()


def tree_sums(parts: DataFrame, weights: int, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """Per node of the trie of ``parts`` (stretches with an array of ``weights`` numbers): partial rows.

    (ia, ib) names the node, (fa, fb) its parent; depth, words of its last turn, its smallest member
    and its sums: to be added up by (ia, ib).
    """
    lead = F.transform(F.slice("turns", 1, LEADING_TURNS), lambda t: t["tid"])
    order = ["pa", "pb", "_lead", "conv_id"]
    dealt = parts.select("conv_id", "pa", "pb", "turns", "weights", lead.alias("_lead")).repartitionByRange(_partitions(parts), *order)
    return dealt.drop("_lead").mapInArrow(partial(_tree_nodes, weights=weights, tree_bytes=tree_bytes), _NODES)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the members' numbers of each node, along sorted rows."""
    now, state, out = None, None, []

    def made() -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["ia", "ib", "ends"])

    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, conv = (batch.column(c).to_numpy() for c in ("ia", "ib", "conv_id"))
        cuts = np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1, [len(a)]]).tolist()
        for i, j in zip(cuts[:-1], cuts[1:]):
            here = (int(a[i]), int(b[i]))
            text = ",".join(map(str, conv[i:j].tolist())).encode()
            if here == now:
                state.update(b"," + text)
            else:
                if state is not None:
                    out.append((*now, state.hexdigest()))
                now, state = here, hashlib.sha256(text)
        yield made()
        out = []
    if state is not None:
        out.append((*now, state.hexdigest()))
        yield made()


def end_digests(ends: DataFrame) -> DataFrame:
    """(ia, ib, ends): hash of the numbers of the conversations (conv_id, ia, ib) that end at a node.

    The hash runs along sorted rows in constant memory. It is sequential by nature, so the members of
    one node pass through one task.
    """
    dealt = ends.repartition(_partitions(ends), "ia", "ib").sortWithinPartitions("ia", "ib", "conv_id")
    return dealt.mapInArrow(_digests, "ia bigint, ib bigint, ends string")


def _gathered(rows: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows, to be put together by an aggregate: what only some of them have is null in the others."""
    for other in others:
        rows = rows.unionByName(other, allowMissingColumns=True)
    return rows


def _first(*names: str) -> list[Column]:
    return [F.max(n).alias(n) for n in names]


def prefix_trie(conversations: DataFrame, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (conv_id, turn, role, text).

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. Conversations without turns belong to the root alone, which
    is then a leaf if no other node exists. Rows that repeat a turn are turns of their own, in order of
    role and text; rows without conv_id are left out; an empty table has no nodes, not even a root.
    Other columns are not read.
    """
    turns, convs = rebuilt(numbered_turns(conversations))
    parts = stretches(turns)
    convs = materialize(convs.join(
        parts.groupBy("conv_id").agg(F.bit_xor("sa").alias("ia"), F.bit_xor("sb").alias("ib")), "conv_id", "left"
    ).fillna(0, ["ia", "ib"]), "members")

    once = tree_sums(parts.withColumn("weights", F.array(F.lit(1).cast("bigint"))), 1, tree_bytes)
    found = materialize(once.groupBy("ia", "ib").agg(
        *_first("fa", "fb", "depth", "words"), F.min("least").alias("owner"), F.sum(F.col("sums")[0]).alias("n")), "found")
    family = found.groupBy(F.col("fa").alias("ia"), F.col("fb").alias("ib")).agg(F.count(F.lit(1)).alias("kids"))
    own = ["fa", "fb", "depth", "words", "owner", "n"]
    nodes = _gathered(found, family).groupBy("ia", "ib").agg(*_first(*own, "kids")).filter("depth is not null")
    nodes = materialize(nodes.withColumns({
        "kids": F.coalesce("kids", F.lit(0)), "saved": (F.col("n") - 1) * F.col("words"),
        "leaf": F.when(F.col("kids").isNull(), 1).otherwise(0).cast("bigint")}), "nodes")

    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("saved").alias("_saved"), F.sum("leaf").alias("_leaf"))
    weights = F.array(*[F.coalesce(c, F.lit(0)) for c in ("_saved", "_leaf")])
    below = tree_sums(parts.join(owned, "conv_id", "left").withColumn("weights", weights), 2, tree_bytes)
    below = below.groupBy("ia", "ib").agg(F.sum(F.col("sums")[0]).alias("all_saved"), F.sum(F.col("sums")[1]).alias("all_leaves"))
    columns = [*own, "kids", "saved", "all_saved", "all_leaves", "ends"]
    whole = _gathered(nodes.drop("leaf"), below, end_digests(convs)).groupBy("ia", "ib").agg(*_first(*columns))
    whole = materialize(whole, "whole")

    inner = whole.filter("depth is not null").withColumn("_seg", F.floor(F.col("depth") / CHAIN_SEGMENT))
    inner = running_within_segments(inner, "depth", ["owner"], ["saved"])
    top = convs.agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 0")
    sums = nodes.agg(
        F.count_if((F.col("fa") == 0) & (F.col("fb") == 0)).alias("kids"), F.coalesce(F.sum("saved"), F.lit(0)).alias("total_saved"),
        F.greatest(F.coalesce(F.sum("leaf"), F.lit(0)), F.lit(1)).alias("leaves"))
    ended = whole.filter("depth is null").agg(F.max("ends").alias("ends"))
    facts = ["owner", "n", "kids", "total_saved", "leaves", "ends"]
    root = _gathered(top, sums, ended).agg(*_first(*facts)).filter("n is not null").select(
        F.col("owner").alias("conv_id"), F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("total_saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_MEMBERS)).alias("ends_sha256"))
    parents = nodes.select(F.col("ia").alias("fa"), F.col("ib").alias("fb"), F.col("owner").alias("parent_conv_id"))
    parents = parents.unionByName(top.select(
        F.lit(0).cast("bigint").alias("fa"), F.lit(0).cast("bigint").alias("fb"), F.col("owner").alias("parent_conv_id")))
    rows = inner.join(parents, ["fa", "fb"]).select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("all_leaves").alias("n_leaves"), (F.col("all_saved") - F.col("saved_before")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_MEMBERS)).alias("ends_sha256"))
    return root.unionByName(rows)
