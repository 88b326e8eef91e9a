"""Token ids in binary files: ids ranked by frequency, bytes of variable length, control bytes apart.

A block holds whole documents in ascending order of their ids. Its fields are
the document ids (int64), the number of ids of each document (uint32), the
control bytes and the data bytes. An id is written as its rank by frequency,
least significant byte first, in one to four bytes; two bits of the control
byte give the length of one id, so a control byte serves four. A document
begins a new control byte. Decoding looks up lengths by control byte, takes the
bytes by offsets, and looks up ids by rank; there is no loop over ids.

Blocks are rows of a Parquet table, written by Spark, so that any store that
Spark can write serves; the ranks are a second small table beside it.

Null and empty texts hold the end id alone. Rows that repeat a document id
follow each other, ordered by their ids' number and bytes. A row without a
document id comes first.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import textbatch as T

#: Bytes that one id takes, by two bits of a control byte.
LENGTHS = np.array([[(c >> shift & 3) + 1 for shift in (0, 2, 4, 6)] for c in range(256)], np.uint8)
#: Ids of a block; a longer document is a block of its own.
BLOCK_IDS = 1 << 17
#: Distinct chunks of text whose ids a Python worker remembers before it forgets those met once.
MEMO = 500_000

ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
# An apostrophe may begin a contraction, so no chunk ends beside it.
PUNCT = ~ALNUM & ~T.WHITE
PUNCT[[0x27, *range(128, 256)]] = False


class Memo:
    """Ids of chunks that were encoded before, found by hash; sorted arrays take a few bytes for each chunk.

    A full memo keeps the chunks that were met again since it was last full.
    """

    def __init__(self, encode):
        self.encode = encode
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.again = np.zeros(0, bool)

    def trim(self) -> None:
        kept = self.again[self.at]
        if kept.sum() > MEMO // 2:
            return self.__init__(self.encode)
        starts, sizes = self.ends[self.at[kept]], np.diff(self.ends)[self.at[kept]]
        self.keys, self.at = self.keys[kept], np.arange(len(sizes))
        self.ids, self.ends = T.gather(self.ids, starts, sizes), np.concatenate([[0], np.cumsum(sizes)])
        self.again = np.zeros(len(sizes), bool)

    def add(self, keys: np.ndarray, chunks: list[str]) -> None:
        parts, sizes = [self.ids], []
        for low in range(0, len(chunks), 4096):
            for got in self.encode(chunks[low : low + 4096]):
                parts.append(np.asarray(got, np.uint32))
                sizes.append(len(got))
        self.ids = np.concatenate(parts)
        keys = np.concatenate([self.keys, keys])
        at = np.concatenate([self.at, np.arange(len(self.ends) - 1, len(self.ends) - 1 + len(chunks))])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.array(sizes, np.int64))])
        self.again = np.concatenate([self.again, np.zeros(len(chunks), bool)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], at[order]

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of byte ranges one after another, and how many each has."""
        if len(self.keys) > MEMO:
            self.trim()
        unique, first, back = np.unique(T.hashes(data, starts, ends), return_index=True, return_inverse=True)
        near = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        new = self.keys[near] != unique if len(self.keys) else np.ones(len(unique), bool)
        self.again[self.at[near[~new]]] = True
        if new.any():
            self.add(unique[new], T.strings(data, starts[first[new]], ends[first[new]]))
        place = self.at[np.searchsorted(self.keys, unique)][back]
        sizes = self.ends[place + 1] - self.ends[place]
        return T.gather(self.ids, self.ends[place], sizes), sizes


_memos: dict[str, Memo] = {}


def tokenizer_memo(path: str) -> tuple[Memo, object]:
    """One memo and tokenizer of a Python worker."""
    if path not in _memos:
        from tokenizers import Tokenizer

        one = Tokenizer.from_file(path)
        _memos[path] = (Memo(lambda xs: [e.ids for e in one.encode_batch_fast(xs, add_special_tokens=False)]), one)
    return _memos[path]


def encode_slice(memo: Memo, tokenizer, specials: list[str], data: np.ndarray, offsets: np.ndarray):
    """Ids of all rows, and how many each row has.

    The tokenizer drops white space, lowers letters and cuts between letters or
    digits and punctuation before it merges; text is cut there first, so that
    equal chunks are encoded once. Rows that spell a special token go to the
    tokenizer whole.
    """
    n = len(offsets) - 1
    low = T.LOWER[data]
    cut = np.flatnonzero((ALNUM[low[:-1]] & PUNCT[low[1:]]) | (PUNCT[low[:-1]] & ALNUM[low[1:]])) + 1
    starts, ends, _ = T.runs(~T.WHITE[low], np.unique(np.concatenate([offsets, cut])))
    rows = np.searchsorted(offsets, starts, "right") - 1
    ids, sizes = memo.look_up(low, starts, ends)
    counts = np.bincount(rows, weights=sizes, minlength=n).astype(np.int64)
    raw = data.tobytes()
    if any(s.encode() in raw for s in specials):
        whole = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i, text in enumerate(whole):
            if any(s in text for s in specials):
                parts[i] = np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
    return ids, counts


def end_ids(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append the end id to every row."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


def token_ids(documents: DataFrame, tokenizer_path: str, end_id: int, id_column="doc_id", text_column="text", kind=np.uint32) -> DataFrame:
    """doc_id, number of ids and ids (little-endian) of every text."""
    fields = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}

    def encode(found):
        memo, tokenizer = tokenizer_memo(tokenizer_path)
        specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        for batch in found:
            for low, high, data, offsets in T.slices(batch.column(1)):
                ids, counts = end_ids(*encode_slice(memo, tokenizer, specials, data, offsets), end_id)
                columns = batch.column(0).slice(low, high - low), counts, T.binary(ids.astype(kind), counts)
                yield T.batches(fields, {k: [c] for k, c in zip(fields, columns)})

    return documents.select(id_column, text_column).mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def flat(column: pa.Array, kind) -> np.ndarray:
    """The bytes of a binary column as one array."""
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    ends = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind) if data is not None else np.zeros(0, kind)


def row_slices(counts: np.ndarray, most: int = 1 << 19):
    """Ranges of rows of at most ``most`` values each, or one longer row."""
    ends = np.cumsum(counts)
    low = 0
    while low < len(counts):
        before = ends[low] - counts[low]
        high = max(low + 1, int(np.searchsorted(ends, before + most, "right")))
        yield low, high
        low = high


def id_counts(coded: DataFrame, kind=np.uint32) -> DataFrame:
    """How often every id occurs; a task sends one row for each id that it has seen."""

    def count(found):
        total = np.zeros(0, np.int64)
        for batch in found:
            ids = flat(batch.column(0), kind)
            for low in range(0, len(ids), 1 << 20):
                got = np.bincount(ids[low : low + (1 << 20)])
                if len(got) < len(total):
                    got, total = total, got
                got[: len(total)] += total
                total = got
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids])], ["id", "n"])

    return coded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def pack(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of ragged rows, and how many of each a row has."""
    size = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        some = size > k
        data[at[some] + k] = (ranks[some] >> np.uint32(8 * k)).astype(np.uint8)
    rows, place = T.spread(counts)
    n_control = (counts + 3) // 4
    control_at = np.cumsum(n_control) - n_control
    slot = 4 * control_at[rows] + place
    quads = np.zeros(4 * int(n_control.sum()), np.uint8)
    quads[slot] = size - 1
    control = quads[0::4] | quads[1::4] << 2 | quads[2::4] << 4 | quads[3::4] << 6
    n_data = np.bincount(rows, weights=size, minlength=len(counts)).astype(np.int64)
    return control, n_control, data, n_data


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ranks of ragged rows; the inverse of ``pack``."""
    rows, place = T.spread(counts)
    n_control = (counts + 3) // 4
    first = np.cumsum(n_control) - n_control
    size = LENGTHS[control].reshape(-1)[4 * first[rows] + place].astype(np.int64)
    at = np.cumsum(size) - size
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    ranks = padded[at].astype(np.uint32)
    for k in range(1, 4):
        some = np.flatnonzero(size > k)
        ranks[some] |= padded[at[some] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def rank_table(counts: DataFrame, size: int) -> np.ndarray:
    """Ids by rank: the commonest first, ties by id. Read by the driver; it has one entry for each id of the vocabulary at most."""
    rows = counts.where(F.col("id") < size).collect()
    return np.array([r["id"] for r in sorted(rows, key=lambda r: (-r["n"], r["id"]))], np.uint32)


def write_token_files(coded: DataFrame, folder: str, vocabulary: int, kind=np.uint32) -> None:
    """Write ``folder``/ranks and ``folder``/blocks from ids of documents."""
    spark = coded.sparkSession
    by_rank = rank_table(id_counts(coded, kind), vocabulary)
    ranks = np.zeros(vocabulary, np.uint32)
    ranks[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    spark.createDataFrame(pa.table({"id": pa.array(by_rank, pa.int64())}).to_pandas(), "id long").withColumn(
        "rank", F.monotonically_increasing_id()
    ).coalesce(1).write.parquet(f"{folder}/ranks")

    fields = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "control": pa.binary(), "data": pa.binary()}

    def code(found):
        for batch in found:
            sizes = np.asarray(batch.column(1))
            for low, high in row_slices(sizes):
                counts = sizes[low:high]
                control, n_control, data, n_data = pack(ranks[flat(batch.column(2).slice(low, high - low), kind)], counts)
                columns = batch.column(0).slice(low, high - low), counts, T.binary(control, n_control), T.binary(data, n_data)
                yield T.batches(fields, {k: [c] for k, c in zip(fields, columns)})

    def blocks(found):
        number = start = 0
        for batch in found:
            counts = np.asarray(batch.column(1))
            cuts = np.flatnonzero(np.diff(np.cumsum(counts) // BLOCK_IDS)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(counts)]):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                n = counts[low:high]
                ids = part.column(0)
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": [number], "block_start": [start], "first_doc": [ids[0].as_py()], "n_docs": [len(n)],
                        "n_ids": [int(n.sum())], "no_id": [int(ids.null_count)],
                        "docs": [np.asarray(ids.fill_null(0)).tobytes()], "counts": [n.astype(np.uint32).tobytes()],
                        "control": [flat(part.column(2), np.uint8).tobytes()], "data": [flat(part.column(3), np.uint8).tobytes()],
                    },
                    schema=pa.schema(
                        [(k, pa.int64()) for k in ("block", "block_start", "first_doc", "n_docs", "n_ids", "no_id")]
                        + [(k, pa.binary()) for k in ("docs", "counts", "control", "data")]
                    ),
                )
                number, start = number + 1, start + int(n.sum())

    packed = coded.mapInArrow(code, "doc_id long, n_tokens long, control binary, data binary")
    ordered = packed.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n_tokens", "data")
    cut = ordered.mapInArrow(
        blocks,
        "block long, block_start long, first_doc long, n_docs long, n_ids long, no_id long, docs binary, counts binary, control binary, data binary",
    )
    cut.withColumn("shard", F.spark_partition_id()).write.option("compression", "zstd").parquet(f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (uint32, little-endian) of every document, read from the files alone."""
    by_rank = np.array([r["id"] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()], np.uint32)
    blocks = spark.read.parquet(f"{folder}/blocks")
    # One row for each shard; a shard is one range of document ids.
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", F.coalesce(F.sum("shard_ids").over(before), F.lit(0)).alias("shard_start"))
    fields = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}

    def decode(found):
        for batch in found:
            for i in range(batch.num_rows):
                block = {k: batch.column(j)[i].as_py() for j, k in enumerate(batch.schema.names)}
                counts = np.frombuffer(block["counts"], np.uint32).astype(np.int64)
                ids = by_rank[unpack(np.frombuffer(block["control"], np.uint8), np.frombuffer(block["data"], np.uint8), counts)]
                docs = np.frombuffer(block["docs"], np.int64)
                start = block["shard_start"] + block["block_start"] + np.cumsum(counts) - counts
                yield T.batches(
                    fields,
                    {
                        "doc_id": [pa.array(docs, mask=np.arange(len(docs)) < block["no_id"])], "start": [start],
                        "n_tokens": [counts], "ids": [T.binary(ids, counts)],
                    },
                )

    return (
        blocks.join(F.broadcast(starts), "shard")
        .select("shard_start", "block_start", "no_id", "docs", "counts", "control", "data")
        .mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
    )


def checksums(decoded: DataFrame) -> DataFrame:
    """Replace the ids by their unsigned crc32."""

    def sums(found):
        for batch in found:
            crc = [zlib.crc32(x.as_buffer()) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return decoded.mapInArrow(sums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize_to_files(documents: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, id_column="doc_id", text_column="text") -> None:
    """Encode every text and write the files."""
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_file(tokenizer_path).get_vocab().values()) + 1
    vocabulary = max(vocabulary, end_id + 1)
    kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
    coded = materialize(token_ids(documents, tokenizer_path, end_id, id_column, text_column, kind), compression="zstd")
    write_token_files(coded, folder, vocabulary, kind)
