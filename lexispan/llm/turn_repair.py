"""Least-cost repair of turn structure: a Viterbi search whose chunks run in parallel.

A conversation's rows are kept, given another role or deleted, and empty turns
are put in, so that the roles read: perhaps a system turn, then user and
assistant in turn, or nothing at all. Four states (nothing yet, after system,
after user, after assistant) and the costs below make it a shortest path.

Conversations are cut into chunks of ``CHUNK`` rows, each kept as a string of
one code a row, so that all passes move a byte for each row.

1. Every chunk computes backward costs, the cheapest way from each state at its
   left border to the end. The last chunk of a conversation knows the true costs
   at its right border, the others start from speculative ones.
2. Fix-up passes hand each chunk the costs of the chunk behind it. Where these
   differ from those it started from by more than a constant, it runs again,
   beside the old run, and only until both differ by a constant; what lies
   further to the left then differs by the same constant. Passes end when no
   chunk has anything to mend.
3. Constants are added up: the costs are stitched. From them, each chunk traces
   the least edits for each of the four states it may be entered in; a chain over
   the chunks picks the state, the pieces make the audit.

Faults, the first that holds counts: blank (no character that is not white),
duplicate (role and text stand earlier in the conversation), truncated (the last
such character is none of ``.!?``). Costs: keep 0, other role 3, delete 4 (blank
and duplicate rows must go), insert 3; a truncated row that stays costs 3 more.
Of equally cheap edits the audit that sorts first is taken.

Defined cases: nulls are one space each. Rows go by turn, null first, ties by
role and a digest of the text; repeated rows are rows of their own and, but for
the first, duplicates. Rows without conv_id are one conversation without id.
Long texts are read whole, a conversation of any length is streamed. An empty
table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import dense_number
from ..session import materialize

#: Rows of a chunk.
CHUNK = 256
BLOCK = 65536
#: Stands for a missing conv_id inside.
NO_ID = -(1 << 63)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
EMPTY = hashlib.sha256(b"").hexdigest()
LEGAL = ["su", "ua", "au"]

#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. What a user or assistant turn leads to.
_ON = np.array([2, 2, 3, 2])
_FAR = 1 << 40
#: Costs of reaching state y from x by inserted turns.
_FILL = np.array([[0, _FAR, 1, 2], [_FAR, 0, 1, 2], [_FAR, _FAR, 0, 1], [_FAR, _FAR, 1, 0]]) * INSERT
_FILL = np.minimum(_FILL, _FAR)
#: Costs from a state after the last row: nothing and after assistant may end.
_LAST = np.minimum(_FILL[:, 0], _FILL[:, 3])


def _steps() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a row's code: cost matrix of one row without insertions, keep's and rerole's cost by state."""
    one, keep, other = np.full((12, 4, 4), _FAR), np.full((12, 4), _FAR), np.full((12, 4), _FAR)
    for code in range(12):
        kind, fault = divmod(code, 3)
        extra = TRUNCATED if fault == 1 else 0
        for x in range(4):
            one[code, x, x] = DELETE
            if fault == 2:
                continue
            other[code, x] = REROLE + extra
            one[code, x, _ON[x]] = min(one[code, x, _ON[x]], REROLE + extra)
            to = {0: 1 if x == 0 else -1, 1: 2 if _ON[x] == 2 else -1, 2: 3 if x == 2 else -1, 3: -1}[kind]
            if to >= 0:
                keep[code, x] = KEEP + extra
                one[code, x, to] = min(one[code, x, to], KEEP + extra)
    return one, keep, other


_ONE, _KEEP, _OTHER = _steps()
#: Where keep leads, by kind (system, user, assistant, other).
_KEPT = np.array([1, 2, 3, 0])
#: One row with insertions before it.
_ROW = np.minimum((_FILL[None, :, :, None] + _ONE[:, None, :, :]).min(axis=2), _FAR)


def _back(codes: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Costs one row further to the left, for many chunks at once."""
    return (_ROW[codes] + right[:, None, :]).min(axis=2)


def _padded(kinds: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of many chunks, right-aligned, and the lengths."""
    lengths = np.array([len(k) for k in kinds], np.int64)
    codes = np.zeros((len(kinds), int(lengths.max(initial=0))), np.int64)
    for i, k in enumerate(kinds):
        if k:
            codes[i, codes.shape[1] - len(k) :] = np.frombuffer(k.encode(), np.uint8) - 97
    return codes, lengths


def swept(codes: np.ndarray, lengths: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Costs at the left border of every chunk."""
    costs = right.copy()
    for j in range(1, codes.shape[1] + 1):
        live = np.flatnonzero(lengths >= j)
        costs[live] = _back(codes[live, -j], costs[live])
    return costs


def mended(codes: np.ndarray, lengths: np.ndarray, old_right: np.ndarray, old_left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The same from other costs at the right border, run beside the old ones only until both differ by constants."""
    old, new = old_right.copy(), right.copy()
    left = np.zeros_like(right)
    live = np.arange(len(lengths))
    for j in range(1, codes.shape[1] + 2):
        gap = new[live] - old[live]
        settled = (gap == gap[:, :1]).all(axis=1)
        done = settled | (lengths[live] < j)
        ready = live[done]
        left[ready] = np.where(settled[done][:, None], old_left[ready] + gap[done][:, :1], new[ready])
        live = live[~done]
        if not len(live):
            return left
        old[live], new[live] = _back(codes[live, -j], old[live]), _back(codes[live, -j], new[live])
    return left


def traced(codes: np.ndarray, lengths: np.ndarray, right: np.ndarray, last: np.ndarray) -> tuple[list[list[str]], np.ndarray]:
    """Edits of every chunk for each state it may be entered in, and the state it is left in."""
    n, width = codes.shape
    after = np.zeros((n, width + 1, 4), np.int64)
    after[:, width] = right
    for j in range(1, width + 1):
        live = np.flatnonzero(lengths >= j)
        after[live, width - j] = _back(codes[live, -j], after[live, width - j + 1])
    pieces = [[[] for _ in range(4)] for _ in range(n)]
    out = np.tile(np.arange(4), (n, 1))
    chunk, entry = np.repeat(np.arange(n), 4), np.tile(np.arange(4), n)
    state = entry.copy()
    for j in range(width):
        active = np.flatnonzero(lengths[chunk] >= width - j)
        while len(active):
            i, x = chunk[active], state[active]
            code, here = codes[i, j], after[i, j, :][np.arange(len(active)), x]
            nxt = after[i, j + 1]
            at = np.arange(len(active))
            kept = _KEPT[code // 3]
            # In the order of the alphabet: delete, insert, keep, rerole.
            delete = DELETE + nxt[at, x] == here
            insert = ~delete & (INSERT + after[i, j, :][at, _ON[x]] == here)
            keep = ~delete & ~insert & (_KEEP[code, x] + nxt[at, kept] == here)
            for a, d, ins, k in zip(active.tolist(), delete.tolist(), insert.tolist(), keep.tolist()):
                pieces[chunk[a]][entry[a]].append("D" if d else "I" if ins else "K" if k else "R")
            state[active] = np.where(delete, x, np.where(keep, kept, _ON[x]))
            active = active[insert]
    ends = np.flatnonzero(last[chunk])
    while len(ends):
        # Inserted turns behind the last row, as long as they make it cheaper.
        more = ends[_LAST[state[ends]] > 0]
        for a in more.tolist():
            pieces[chunk[a]][entry[a]].append("I")
        state[more] = _ON[state[more]]
        ends = more
    out[chunk, entry] = state
    return [["".join(p) for p in four] for four in pieces], out


# Rows

_WHITE = "\\x20\\x09-\\x0D"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that a hash of conv_id and turn gives each row."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)
    ).cast("binary")) % 20
    text = F.coalesce("text", space)
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("bigint"), F.lit(NO_ID)).alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), kind.alias("kind"),
    )
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("kind <> 0").withColumn("copy", F.explode(times)).drop("kind")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))


def _coded(rows: DataFrame) -> DataFrame:
    """conv_id, p (place), turn, digest, initial, fault (0 none, 1 truncated, 2 blank, 3 duplicate); texts are left behind."""
    blank = ~F.col("text").rlike(f"[^{_WHITE}]")
    cut = ~F.col("text").rlike(f"[.!?][{_WHITE}]*\\z")
    slim = rows.select(
        "conv_id", "turn", "role", "digest", "copy", F.substring("role", 1, 1).alias("initial"), F.when(blank, 2).when(cut, 1).otherwise(0).alias("own")
    )
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60)))
    placed = materialize(dense_number(slim, ["conv_id"], ["turn", "role", "digest", "copy"], "p", block=block))
    repeated = placed.groupBy("conv_id", "digest").agg(F.min("p").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = placed.join(repeated, ["conv_id", "digest"], "left")
    fault = F.when((F.col("own") != 2) & (F.col("p") > F.col("first")), F.lit(3)).otherwise(F.col("own"))
    return joined.select("conv_id", "p", "turn", "role", "digest", "initial", fault.alias("fault"))


def _counts(coded: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated."""
    turns = coded.groupBy("conv_id", "turn").agg(
        *[F.count_if(F.col("fault") == k).alias(name) for k, name in ((2, "blank"), (3, "duplicate"), (1, "truncated"))]
    )
    return turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        *[F.sum(name).alias(name) for name in ("blank", "duplicate", "truncated")],
    )


def _chunks(coded: DataFrame, size: int) -> DataFrame:
    """conv_id, chunk, kinds (a letter for each row), last, illegal (pairs in the chunk and at its right border)."""
    kind = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    code = F.char(97 + 3 * kind + F.least("fault", F.lit(2)))
    rows = coded.withColumn("chunk", F.floor(F.col("p") / size)).withColumn("letter", code)
    packed = rows.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("p", "letter", "initial"))).alias("rows"))
    packed = packed.select(
        "conv_id", "chunk", F.array_join(F.transform("rows", lambda x: x["letter"]), "").alias("kinds"), F.transform("rows", lambda x: x["initial"]).alias("initials")
    )
    order = Window.partitionBy("conv_id").orderBy("chunk")
    packed = packed.withColumn("next", F.lead(F.col("initials")[0]).over(order))
    line = F.array_compact(F.concat("initials", F.array("next")))
    pairs = F.transform(F.sequence(F.lit(1), F.size(line) - 1), lambda i: F.concat(F.element_at(line, i.cast("int")), F.element_at(line, (i + 1).cast("int"))))
    bad = F.when(F.size(line) > 1, F.size(F.filter(pairs, lambda x: ~x.isin(LEGAL)))).otherwise(0)
    return packed.select("conv_id", "chunk", "kinds", F.col("next").isNull().alias("last"), bad.cast("bigint").alias("illegal"))


# Passes over chunks


def _vectors(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.int64).reshape(-1, 4)


def _list(values: np.ndarray) -> pa.Array:
    return pa.array(values.tolist(), pa.list_(pa.int64()))


_SWEPT = "conv_id bigint, chunk bigint, kinds string, last boolean, illegal bigint, right array<bigint>, left array<bigint>"


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            codes, lengths = _padded(batch.column(2).to_pylist())
            right = np.tile(_LAST, (batch.num_rows, 1))
            left = swept(codes, lengths, right)
            yield pa.RecordBatch.from_arrays([*batch.columns, _list(right), _list(left)], [*batch.schema.names, "right", "left"])


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with the costs of the chunk behind them in ``given``."""
    for batch in batches:
        if batch.num_rows:
            codes, lengths = _padded(batch.column(2).to_pylist())
            right, left, given = (_vectors(batch.column(i)) for i in (5, 6, 7))
            left = mended(codes, lengths, right, left, given)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], _list(given), _list(left)], batch.schema.names[:7])


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            kinds, last = batch.column(2).to_pylist(), batch.column(3).to_numpy(zero_copy_only=False)
            pieces, out = traced(*_padded(kinds), _vectors(batch.column(4)), last)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.list_(pa.string())), _list(out)], ["conv_id", "chunk", "pieces", "out"])


def _settled(chunks: DataFrame) -> DataFrame:
    """Chunks with costs at both borders that fit their neighbours' up to constants."""
    names = ["conv_id", "chunk", "kinds", "last", "illegal"]
    state = materialize(chunks.select(*names).mapInArrow(_first, _SWEPT))
    order = Window.partitionBy("conv_id").orderBy("chunk")
    shape = lambda v: F.transform(v, lambda x: x - F.element_at(v, 1))
    while True:
        seen = state.withColumn("given", F.lead("left").over(order))
        wrong = F.col("given").isNotNull() & (shape(F.col("given")) != shape(F.col("right")))
        seen = materialize(seen.withColumn("wrong", wrong))
        if not seen.where("wrong").limit(1).count():
            return state
        again = seen.where("wrong").drop("wrong").mapInArrow(_again, _SWEPT)
        state = materialize(seen.where("not wrong").drop("given", "wrong").unionByName(again))


_CHAIN = "conv_id bigint, chunk bigint, entry bigint"


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which every chunk is entered; chunks come in order, only the state is carried."""
    now, state = None, 0
    for batch in batches:
        entries = []
        for conv, out in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if conv != now:
                now, state = conv, 0
            entries.append(state)
            state = out[state]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entries, pa.int64())], ["conv_id", "chunk", "entry"])


def _traced(state: DataFrame) -> DataFrame:
    """conv_id, chunk, last, illegal, cost (part of it), piece, entry."""
    order = Window.partitionBy("conv_id").orderBy("chunk")
    # A chunk adds what its left border costs more, in the first state, than the border behind it, for equal shapes.
    stitched = state.withColumn("add", F.element_at("left", 1) - F.when(F.col("last"), F.lit(0)).otherwise(F.element_at("right", 1)))
    ways = materialize(stitched.select("conv_id", "chunk", "kinds", "last", "right").mapInArrow(_tails, "conv_id bigint, chunk bigint, pieces array<string>, out array<bigint>"))
    several = ways.join(state.where("not last").select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "chunk", "out")
    entries = several.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_entered, _CHAIN)
    entered = ways.join(entries, ["conv_id", "chunk"], "left").withColumn("entry", F.coalesce("entry", F.lit(0).cast("bigint")))
    chosen = entered.select("conv_id", "chunk", "entry", F.element_at("pieces", (F.col("entry") + 1).cast("int")).alias("piece"))
    return stitched.select("conv_id", "chunk", "illegal", "add").join(chosen, ["conv_id", "chunk"])


# Result

_EDITS = "conv_id bigint, p bigint, roles array<string>, keep boolean"
_ROLES = {2: "user", 3: "assistant"}


def _edits(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows that stay: the roles of turns put in before them and, at the end, their new role; ``p`` past the end for turns put in last."""
    for batch in batches:
        found: list[tuple[int, int, list[str], bool]] = []
        for conv, chunk, kinds, entry, piece in zip(*(batch.column(i).to_pylist() for i in range(5))):
            state, at, put = entry, 0, []
            for edit in piece:
                if edit == "D":
                    at += 1
                    continue
                if edit == "K":
                    state = int(_KEPT[(ord(kinds[at]) - 97) // 3])
                else:
                    state = int(_ON[state])
                    put.append(_ROLES[state])
                if edit != "I":
                    found.append((conv, chunk * size + at, put, edit == "K"))
                    put, at = [], at + 1
            if put:
                found.append((conv, -1, put, False))
        kinds = [("conv_id", pa.int64()), ("p", pa.int64()), ("roles", pa.list_(pa.string())), ("keep", pa.bool_())]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the repaired lines of every conversation; an edit comes just before the row it is about."""
    now, out = None, []

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([h for _, h in out], pa.string())], ["conv_id", "repaired_sha256"])
        out.clear()
        return batch

    def write(line: str):
        nonlocal begun
        sha.update(("\n" + line if begun else line).encode())
        begun = True

    for batch in batches:
        names = batch.schema.names
        columns = (batch.column(names.index(k)).to_pylist() for k in ("conv_id", "digest", "side", "roles", "keep", "role", "text"))
        for conv, digest, side, roles, keep, role, text in zip(*columns):
            if conv != now:
                if now is not None:
                    out.append((now, sha.hexdigest()))
                now, sha, begun, wanted = conv, hashlib.sha256(), False, None
            if side == 0:
                wanted = (digest, roles, keep)
            elif side == 2:
                for r in roles:
                    write(f"{r}:")
            elif wanted and wanted[0] == digest:
                _, roles, keep = wanted
                for r in roles if keep else roles[:-1]:
                    write(f"{r}:")
                write(f"{role if keep else roles[-1]}:{text}")
                wanted = None
        if len(out) >= 4096:
            yield flush()
    if now is not None:
        out.append((now, sha.hexdigest()))
    yield flush()


def _repaired(rows: DataFrame, coded: DataFrame, chunks: DataFrame, done: DataFrame, size: int) -> DataFrame:
    """conv_id, repaired_sha256. Rows and edits meet by order, so texts are moved once."""
    pieces = done.join(chunks.select("conv_id", "chunk", "kinds"), ["conv_id", "chunk"]).select("conv_id", "chunk", "kinds", "entry", "piece")
    edits = materialize(pieces.mapInArrow(lambda batches: _edits(batches, size), _EDITS))
    stay = edits.where("p >= 0").join(coded.select("conv_id", "p", "turn", "role", "digest"), ["conv_id", "p"])
    none = lambda kind: F.lit(None).cast(kind)
    parts = ["conv_id", F.lit(0).alias("at_end"), "turn", "role", "digest", F.lit(0).alias("side"), "roles", "keep", none("string").alias("text")]
    edited = stay.select(*parts)
    lines = rows.where("copy = 0").select(
        "conv_id", F.lit(0).alias("at_end"), "turn", "role", "digest", F.lit(1).alias("side"), none("array<string>").alias("roles"), none("boolean").alias("keep"), "text"
    )
    ends = edits.where("p < 0").select(
        "conv_id", F.lit(1).alias("at_end"), none("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.lit(2).alias("side"), "roles", "keep", none("string").alias("text")
    )
    everything = edited.unionByName(lines).unionByName(ends).repartition("conv_id").sortWithinPartitions("conv_id", "at_end", "turn", "role", "digest", "side")
    return everything.mapInArrow(_hashed, "conv_id bigint, repaired_sha256 string")


def repaired_conversations(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row for each conversation: faults, cost, audit and a hash of the repaired turns."""
    rows = _keyed(damaged(conversations))
    coded = materialize(_coded(rows))
    chunks = materialize(_chunks(coded, chunk))
    done = materialize(_traced(_settled(chunks)))
    audits = done.groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"), F.sum("add").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "piece"))), lambda x: x["piece"]), "").alias("audit"),
    )
    every = conversations.select(F.coalesce(F.col("conv_id").cast("bigint"), F.lit(NO_ID)).alias("conv_id")).distinct()
    out = every.join(_counts(coded), "conv_id", "left").join(audits, "conv_id", "left").join(_repaired(rows, coded, chunks, done, chunk), "conv_id", "left")
    number: list[Column] = [F.coalesce(k, F.lit(0).cast("bigint")).alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        F.when(F.col("conv_id") != NO_ID, F.col("conv_id")).alias("conv_id"), *number, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"),
    )
