"""Prefix trie of conversations; subtree sums come from an Euler tour that is ranked over all tasks.

A node is a distinct sequence of first turns. Its name is its smallest member
and its depth, which is unique, so no node needs a hash once the trie is built.

1. Every turn has a digest. The key of a prefix is the running sum, modulo
   2**40 in three lanes, of hashes of (place, digest); sums run inside blocks
   of places, and only block totals cross a border.
2. Keys are grouped to nodes, and the parent's key is the own key less the
   last turn's hash.
3. Each node has an enter and an exit arc; siblings follow each other by
   smallest member. The next sibling comes from one range-sorted pass, in
   which one row for each partition crosses a border.
4. The tour, a list of twice as many arcs as nodes, is ranked by contraction:
   tasks hold arcs that lie close together, rank the runs among them and hand
   on one arc for each run. Where neighbours lie far apart, arcs jump along
   predecessors up to arcs that were drawn by hash, every sixteenth or so.
   A list of at most ``ONE_TASK`` arcs is ranked in one task.
5. Leaves and savings are summed over the places of the tour in blocks; a
   subtree is what lies between enter and exit.

Defined cases: null role or text counts as empty. Turns are ordered by turn,
null first, ties by role and then by a digest of the text; repeated rows are
turns of their own. Rows without conv_id belong to no conversation and are
passed over. Long texts are read whole. An empty table has no nodes. Further
columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import dense_number
from ..session import materialize

WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows of one conversation, and arcs of the tour, that a window takes at a time.
BLOCK = 65536
#: Members whose numbers are joined to one string; as many at most have the same quotient.
MEMBERS = 4096
#: Arcs that a task ranks at a time, and the length of a list that one task ranks.
SLICE = 1 << 19
ONE_TASK = 1 << 19
#: One arc in so many ends a jump.
SPACING = 16
#: A pass over close arcs must leave at most this share of them.
USEFUL = 0.6
LANES = 3
MASK = (1 << 40) - 1
EMPTY = hashlib.sha256(b"").hexdigest()

_KEYS = [f"k{i}" for i in range(LANES)]
_UP = [f"u{i}" for i in range(LANES)]


def _placed(conversations: DataFrame) -> DataFrame:
    """conv_id, p (place from 0), digest, words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"),
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60)))
    return dense_number(rows, ["conv_id"], ["turn", "role", "digest"], "p", block=block).select("conv_id", "p", "digest", "words")


def rebuilt(placed: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and their turns (conv_id, q, digest, words, ends) after the shared openings are put in."""
    sizes = placed.groupBy("conv_id").agg((F.max("p") + 1).alias("own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    leaders = sizes.select(F.col("conv_id").alias("leader"), F.least("own", F.lit(most - 1)).alias("lead"))
    convs = sizes.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("leader"))
    convs = convs.join(leaders, "leader", "left").withColumn("head", F.least("h", F.coalesce("lead", F.lit(0))))
    convs = materialize(convs.withColumn("length", F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).drop("lead"))
    own = placed.join(convs.select("conv_id", "h", "head", "length"), "conv_id").where("p >= h").select(
        "conv_id", (F.col("p") - F.col("h") + F.col("head")).alias("q"), "digest", "words", "length"
    )
    opening = placed.where(F.col("p") < most - 1).select(F.col("conv_id").alias("leader"), "p", "digest", "words")
    led = convs.where("h > 0").join(opening, "leader").where("p < h").select("conv_id", F.col("p").alias("q"), "digest", "words", "length")
    turns = own.unionByName(led).withColumn("ends", F.col("q") + 1 == F.col("length")).drop("length")
    return convs.select("conv_id", "length"), turns


def _with_keys(turns: DataFrame) -> DataFrame:
    """Keys of every prefix and of the prefix one turn shorter."""
    turns = turns.withColumn("b", F.floor(F.col("q") / BLOCK))
    own = [F.xxhash64(F.lit(i), F.col("q"), F.col("digest")).bitwiseAND(MASK).alias(f"h{i}") for i in range(LANES)]
    turns = turns.select("conv_id", "q", "b", "words", "ends", *own)
    inside = Window.partitionBy("conv_id", "b").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    totals = turns.groupBy("conv_id", "b").agg(*[F.sum(f"h{i}").bitwiseAND(MASK).alias(f"t{i}") for i in range(LANES)])
    carried = totals.select("conv_id", "b", *[F.sum(f"t{i}").over(before).bitwiseAND(MASK).alias(f"o{i}") for i in range(LANES)])
    summed = turns.select("*", *[F.sum(f"h{i}").over(inside).alias(f"s{i}") for i in range(LANES)])
    summed = summed.join(carried.where("b > 0"), ["conv_id", "b"], "left")
    keys = [(F.col(f"s{i}") + F.coalesce(f"o{i}", F.lit(0))).bitwiseAND(MASK).alias(f"k{i}") for i in range(LANES)]
    up = [(F.col(f"s{i}") + F.coalesce(f"o{i}", F.lit(0)) - F.col(f"h{i}")).bitwiseAND(MASK).alias(f"u{i}") for i in range(LANES)]
    return summed.select("conv_id", (F.col("q") + 1).alias("depth"), "words", "ends", *keys, *up)


def _grouped(convs: DataFrame, marked: DataFrame) -> DataFrame:
    """Nodes with members, words of the last text, ended conversations, keys and parents' names."""
    nodes = marked.groupBy("depth", *_KEYS).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        F.count_if("ends").alias("n_ends"), F.min(F.when(F.col("ends"), F.col("conv_id"))).alias("first_end"), *[F.min(u).alias(u) for u in _UP],
    )
    turnless = F.col("length") == 0
    root = convs.agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if(turnless).alias("n_ends"),
        F.min(F.when(turnless, F.col("conv_id"))).alias("first_end"),
    ).where("n_convs > 0")
    zero = F.lit(0).cast("bigint")
    root = root.select("*", zero.alias("depth"), zero.alias("words"), *[zero.alias(k) for k in _KEYS], *[F.lit(None).cast("bigint").alias(u) for u in _UP])
    nodes = materialize(nodes.unionByName(root))
    above = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(k).alias(u) for k, u in zip(_KEYS, _UP)], F.col("conv_id").alias("parent_conv_id"))
    return materialize(nodes.join(above, ["depth", *_UP], "left").drop(*_UP))


_NEXT = "parent bigint, up bigint, conv_id bigint, after bigint, opens int, closes int"


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The next row's conv_id where it has the same parent; the first and the last row carry the task's number."""
    task, held, first = TaskContext.get().partitionId(), None, True
    names = ["parent", "up", "conv_id", "after", "opens", "closes"]

    def rows(columns, last):
        nonlocal first
        parent, up, conv = columns
        n = len(conv) if last else len(conv) - 1
        same = np.zeros(n, bool)
        after = np.zeros(n, np.int64)
        m = len(conv) - 1
        same[:m] = (parent[1:] == parent[:-1]) & (up[1:] == up[:-1])
        after[:m] = conv[1:]
        opens, closes = np.full(n, task, np.int32), np.full(n, task, np.int32)
        no_open, no_close = np.ones(n, bool), np.ones(n, bool)
        if first and n:
            no_open[0], first = False, False
        if last:
            no_close[-1] = False
        return pa.RecordBatch.from_arrays(
            [pa.array(x[:n]) for x in columns] + [pa.array(after, mask=~same), pa.array(opens, mask=no_open), pa.array(closes, mask=no_close)], names
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
        held = [c[-1:] for c in columns]
        if len(columns[2]) > 1:
            yield rows(columns, False)
    if held is not None:
        yield rows(held, True)


def next_siblings(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, after: the sibling with the next larger name, for nodes that have one."""
    pairs = nodes.where("depth > 0").select(F.col("parent_conv_id").alias("parent"), (F.col("depth") - 1).alias("up"), "conv_id")
    order = ["parent", "up", "conv_id"]
    rows = materialize(pairs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_followed, _NEXT))
    # One row for each partition, so their number bounds both the window and the broadcast.
    by_task = Window.orderBy("opens")
    border = rows.where("opens is not null").select(
        F.col("opens").alias("closes"), F.lead("parent").over(by_task).alias("p2"), F.lead("up").over(by_task).alias("u2"),
        F.lead("conv_id").over(by_task).alias("c2"),
    )
    joined = rows.join(F.broadcast(border), "closes", "left")
    over = F.when((F.col("parent") == F.col("p2")) & (F.col("up") == F.col("u2")), F.col("c2"))
    return joined.select("conv_id", (F.col("up") + 1).alias("depth"), F.coalesce("after", over).alias("after")).where("after is not null")


def _arcs(nodes: DataFrame) -> DataFrame:
    """Enter (even code) and exit (odd code) of every node with the arc that follows, and what counts at it."""
    here, down = 2 * F.col("depth"), 2 * F.col("depth") + 2
    leaf = F.col("n_children") == 0
    enter = F.struct(
        here.alias("code"), F.when(leaf, F.col("conv_id")).otherwise(F.col("first_child")).alias("to_conv"),
        F.when(leaf, here + 1).otherwise(down).alias("to_code"), leaf.cast("bigint").alias("leaf"), F.col("own").alias("saved"),
    )
    there = F.col("after").isNotNull()
    leave = F.struct(
        (here + 1).alias("code"), F.coalesce("after", "parent_conv_id").alias("to_conv"),
        F.when(there, here).when(F.col("depth") > 0, here - 1).alias("to_code"), F.lit(0).cast("bigint").alias("leaf"), F.lit(0).cast("bigint").alias("saved"),
    )
    return nodes.select("conv_id", F.explode(F.array(enter, leave)).alias("a")).select("conv_id", "a.*", F.lit(1).cast("bigint").alias("weight"))


def chained(conv: np.ndarray, code: np.ndarray, to_conv: np.ndarray, to_code: np.ndarray, ends: np.ndarray, weight: np.ndarray):
    """Runs among arcs sorted by (conv, code): each arc's head and distance, and the arcs that end a run."""
    n = len(conv)
    names = np.unique(conv)
    width = int(max(code.max(), to_code.max())) + 1
    keys = np.searchsorted(names, conv) * width + code
    at = np.minimum(np.searchsorted(names, to_conv), len(names) - 1)
    goal = at * width + to_code
    to = np.minimum(np.searchsorted(keys, goal), n - 1)
    local = ~ends & (names[at] == to_conv) & (keys[to] == goal)
    head, far = np.arange(n), np.zeros(n, np.int64)
    head[to[local]] = np.flatnonzero(local)
    far[to[local]] = weight[local]
    while True:
        further = head[head]
        if np.array_equal(further, head):
            return head, far, np.flatnonzero(~local)
        far, head = far + far[head], further


_RUN = "conv_id bigint, code bigint, leaf bigint, saved bigint, head_conv bigint, head_code bigint, far bigint, size bigint, to_conv bigint, to_code bigint"


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Every arc with the head of its run; heads also carry the run's length and the arc behind it."""
    held: list[pa.RecordBatch] = []

    def work():
        table = pa.Table.from_batches(held)
        held.clear()
        get = lambda k: table[k].combine_chunks()
        conv, code, weight = (get(k).to_numpy(zero_copy_only=False) for k in ("conv_id", "code", "weight"))
        ends = get("to_conv").is_null().to_numpy(zero_copy_only=False)
        to_conv, to_code = (get(k).fill_null(0).to_numpy(zero_copy_only=False) for k in ("to_conv", "to_code"))
        head, far, tails = chained(conv, code, to_conv, to_code, ends, weight)
        n = len(conv)
        total, out = np.zeros(n, np.int64), np.zeros(n, np.int64)
        total[head[tails]] = far[tails] + weight[tails]
        out[head[tails]] = tails
        inner = head != np.arange(n)
        no_out = inner | ends[out]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(conv), pa.array(code), get("leaf"), get("saved"), pa.array(conv[head]), pa.array(code[head]), pa.array(far),
                pa.array(total, mask=inner), pa.array(to_conv[out], mask=no_out), pa.array(to_code[out], mask=no_out),
            ],
            ["conv_id", "code", "leaf", "saved", "head_conv", "head_code", "far", "size", "to_conv", "to_code"],
        )

    for batch in batches:
        for low in range(0, batch.num_rows, size):
            part = batch.slice(low, size)
            if held and sum(b.num_rows for b in held) + part.num_rows > size:
                yield work()
            held.append(part)
    if sum(b.num_rows for b in held):
        yield work()


def _close_runs(arcs: DataFrame, alone: bool) -> DataFrame:
    arcs = arcs.select("conv_id", "code", "to_conv", "to_code", "weight", "leaf", "saved")
    dealt = arcs.repartition(1) if alone else arcs.repartitionByRange("conv_id", "code")
    size = ONE_TASK if alone else SLICE
    return materialize(dealt.sortWithinPartitions("conv_id", "code").mapInArrow(lambda batches: _runs(batches, size), _RUN))


def _drawn_runs(arcs: DataFrame, level: int) -> DataFrame:
    """The same by jumping along predecessors up to drawn arcs; needs no neighbours in one task."""
    before = arcs.where("to_conv is not null").select(
        F.col("to_conv").alias("conv_id"), F.col("to_code").alias("code"), F.col("conv_id").alias("p_conv"), F.col("code").alias("p_code"),
        F.col("weight").alias("p_weight"),
    )
    linked = materialize(arcs.join(before, ["conv_id", "code"], "left"))
    heads = F.col("p_conv").isNull() | (F.pmod(F.xxhash64(F.lit(level), F.col("conv_id"), F.col("code")), F.lit(SPACING)) == 0)
    name = lambda a, b: F.when(heads, F.col(a)).otherwise(F.col(b))
    state = materialize(linked.select(
        "conv_id", "code", name("conv_id", "p_conv").alias("head_conv"), name("code", "p_code").alias("head_code"),
        F.when(heads, F.lit(0)).otherwise(F.col("p_weight")).alias("far"), heads.alias("is_head"), heads.alias("done"),
    ))
    while state.where("not done").limit(1).count():
        # The arc pointed to is a head, has reached one, or lies as far along as it could come.
        aim = state.select(
            F.col("conv_id").alias("head_conv"), F.col("code").alias("head_code"), F.col("head_conv").alias("n_conv"), F.col("head_code").alias("n_code"),
            F.col("far").alias("n_far"), F.col("done").alias("n_done"),
        )
        moved = state.where("not done").join(aim, ["head_conv", "head_code"]).select(
            "conv_id", "code", F.col("n_conv").alias("head_conv"), F.col("n_code").alias("head_code"), (F.col("far") + F.col("n_far")).alias("far"),
            "is_head", F.col("n_done").alias("done"),
        )
        state = materialize(state.where("done").unionByName(moved))
    # The arc before a head ends the run of its own head.
    tails = state.select(F.col("conv_id").alias("p_conv"), F.col("code").alias("p_code"), F.col("head_conv").alias("r_conv"), F.col("head_code").alias("r_code"), F.col("far").alias("t_far"))
    following = linked.where(heads & F.col("p_conv").isNotNull()).join(tails, ["p_conv", "p_code"]).select(
        F.col("r_conv").alias("conv_id"), F.col("r_code").alias("code"), F.col("conv_id").alias("to_conv"), F.col("code").alias("to_code"),
        (F.col("t_far") + F.col("p_weight")).alias("size"),
    )
    full = state.join(arcs.select("conv_id", "code", "leaf", "saved"), ["conv_id", "code"]).join(following, ["conv_id", "code"], "left")
    # The last run has no follower, and its length is never asked for.
    size = F.when(F.col("is_head"), F.coalesce("size", F.lit(1)))
    return materialize(full.select("conv_id", "code", "leaf", "saved", "head_conv", "head_code", "far", size.alias("size"), "to_conv", "to_code"))


def ranked(arcs: DataFrame, level: int = 0) -> DataFrame:
    """conv_id, code, leaf, saved and the place of every arc in the list, from 0."""
    n = arcs.count()
    if n <= ONE_TASK:
        return _close_runs(arcs, True).select("conv_id", "code", "leaf", "saved", F.col("far").alias("place"))
    runs = _close_runs(arcs, False)
    left = runs.where("size is not null")
    if left.count() > USEFUL * n:
        runs = _drawn_runs(arcs, level)
        left = runs.where("size is not null")
    inner = ranked(left.select("conv_id", "code", "to_conv", "to_code", F.col("size").alias("weight"), "leaf", "saved"), level + 1)
    inner = inner.select(F.col("conv_id").alias("head_conv"), F.col("code").alias("head_code"), F.col("place").alias("start"))
    return runs.join(inner, ["head_conv", "head_code"]).select("conv_id", "code", "leaf", "saved", (F.col("start") + F.col("far")).alias("place"))


def _subtree_sums(places: DataFrame) -> DataFrame:
    """conv_id, depth, n_leaves, saved_tokens from prefix sums at the places of the arcs."""
    places = places.withColumn("b", F.floor(F.col("place") / BLOCK))
    totals = places.groupBy("b").agg(F.sum("leaf").alias("tl"), F.sum("saved").alias("ts"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("b", F.coalesce(F.sum("tl").over(before), F.lit(0)).alias("ol"), F.coalesce(F.sum("ts").over(before), F.lit(0)).alias("os"))
    inside = Window.partitionBy("b").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sums = places.select("*", F.sum("leaf").over(inside).alias("sl"), F.sum("saved").over(inside).alias("ss")).join(totals, "b")
    sums = sums.select("conv_id", F.floor(F.col("code") / 2).alias("depth"), "leaf", "saved", (F.col("sl") + F.col("ol")).alias("sl"), (F.col("ss") + F.col("os")).alias("ss"))
    return sums.groupBy("conv_id", "depth").agg(
        (F.max("sl") - F.min("sl") + F.sum("leaf")).alias("n_leaves"), (F.max("ss") - F.min("ss") + F.sum("saved")).alias("saved_tokens")
    )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the strings of every node, read in order; no node is held as a whole."""
    now, sha = None, None

    def done(node):
        return pa.RecordBatch.from_pydict({"conv_id": pa.array([node[0]], pa.int64()), "depth": pa.array([node[1]], pa.int64()), "hash": pa.array([sha.hexdigest()])})

    for batch in batches:
        for conv, depth, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (conv, depth) != now:
                if now is not None:
                    yield done(now)
                now, sha = (conv, depth), hashlib.sha256(text.encode())
            else:
                sha.update(b"," + text.encode())
    if now is not None:
        yield done(now)


def _ends(convs: DataFrame, marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """conv_id, depth, hash for nodes at which several conversations end."""
    zero = F.lit(0).cast("bigint")
    ends = marked.where("ends").select("depth", *_KEYS, F.col("conv_id").alias("member"))
    ends = ends.unionByName(convs.where("length = 0").select(zero.alias("depth"), *[zero.alias(k) for k in _KEYS], F.col("conv_id").alias("member")))
    several = nodes.where("n_ends > 1").select("depth", *_KEYS, "conv_id")
    parts = ends.join(several, ["depth", *_KEYS]).groupBy("conv_id", "depth", F.floor(F.col("member") / MEMBERS).alias("part")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda x: x.cast("string")), ",").alias("text")
    )
    return parts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part").mapInArrow(_hashed, "conv_id bigint, depth bigint, hash string")


def prefix_trie(conversations: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``group`` conversations with neighbouring numbers share the first turns of
    the one whose number divides evenly; how many, below ``most``, is a hash of
    the number. ``group=1`` leaves conversations as they are.
    """
    convs, turns = rebuilt(materialize(_placed(conversations)), group, most)
    marked = materialize(_with_keys(turns))
    nodes = _grouped(convs, marked)
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"), F.min("conv_id").alias("first_child")
    )
    full = nodes.join(children, ["conv_id", "depth"], "left").join(next_siblings(nodes), ["conv_id", "depth"], "left")
    full = materialize(full.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))).withColumn("own", (F.col("n_convs") - 1) * F.col("words")))
    sums = _subtree_sums(ranked(materialize(_arcs(full))))
    out = full.join(sums, ["conv_id", "depth"]).join(_ends(convs, marked, nodes), ["conv_id", "depth"], "left")
    one: Column = F.when(F.col("n_ends") == 0, F.lit(EMPTY)).when(F.col("n_ends") == 1, F.sha2(F.col("first_end").cast("string"), 256)).otherwise(F.col("hash"))
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", one.alias("ends_sha256")
    )
