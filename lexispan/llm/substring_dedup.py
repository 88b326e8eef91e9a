"""Removal of repeated passages by sharded automata of recurring phrases.

A window is ``window`` words in a row. A word goes if a window that covers it
also starts earlier, in a document with a smaller id or before it in the same
document.

1. Every window has an anchor: the run of ``SEED`` words in it with the smallest
   hash. Equal windows have equal anchors, so a window whose anchor occurs once
   in the corpus occurs once. About one word in seven begins an anchor.
2. Windows with a recurring anchor are counted by hash. Those that occur twice
   or more are confirmed; the first place of each is kept.
3. Confirmed windows whose first places follow each other form a phrase, held by
   one document. Phrases are dealt to shards by that document. A document goes
   to the shards that hold a phrase of one of its windows, and to no other; a
   shard with many documents is split, and each part gets the shard's phrases.
4. A shard compiles its phrases into an Aho-Corasick automaton, ``BLOCK`` words
   for each pattern, and streams its documents through it. Any window of a
   phrase holds a whole pattern, so every occurrence is met; words to both sides
   are compared, and what is not the phrase's own first place is removed.

Null and empty texts have no words. Equal rows (same id, same text) are one
document and get the same result; of different texts under one id the order is
that of a hash of the text. Rows without an id come after all others. Texts are
read whole, of any length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import textbatch as T

SEED = 8
BLOCK = 10
#: Words of phrases in a shard, and documents in a part of one, on the average.
SHARD_WORDS = 40_000
PART_DOCUMENTS = 500
LAST = 2**63 - 1


def window_anchors(values: np.ndarray, rows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the place of each one's anchor, and hashes of anchors by place."""
    n = len(values)
    span = window - SEED + 1
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, T.U64)
    found, at = T.grams(values, rows, SEED)
    seeds = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    seeds[at] = found
    starts = np.flatnonzero(rows[: n - window + 1] == rows[window - 1 :])
    nearest = np.lib.stride_tricks.sliding_window_view(seeds, span)[starts].argmin(axis=1)
    return starts, starts + nearest, seeds


def read_words(data: np.ndarray, offsets: np.ndarray):
    starts, ends, rows = T.words(data, offsets)
    return starts, ends, rows, T.hashes(data, starts, ends)


def anchors(documents: DataFrame, window: int, places: bool) -> DataFrame:
    """Anchors of all documents (u, body); with places: the document and the word's number as well."""
    names = ["anchor", "u", "place"] if places else ["anchor"]

    def find(found):
        for batch in found:
            for low, high, data, offsets in T.slices(batch.column(1)):
                _, _, rows, values = read_words(data, offsets)
                _, at, seeds = window_anchors(values, rows, window)
                at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
                columns = [pa.array(seeds[at].astype(np.int64) if len(at) else np.zeros(0, np.int64))]
                if places:
                    begin = np.searchsorted(rows, np.arange(high - low))
                    u = np.asarray(batch.column(0).slice(low, high - low))
                    columns += [pa.array(u[rows[at]]), pa.array((at - begin[rows[at]]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return documents.select("u", "body").mapInArrow(find, "anchor long, u long, place int" if places else "anchor long")


def windows(candidates: DataFrame, window: int) -> DataFrame:
    """Hash and place of every window whose anchor is among the document's recurring ones."""

    def find(found):
        for batch in found:
            lists = batch.column(3)
            sizes = np.asarray(lists.value_lengths())
            flat = np.asarray(lists.flatten())
            ends = np.cumsum(sizes)
            for low, high, data, offsets in T.slices(batch.column(2)):
                _, _, rows, values = read_words(data, offsets)
                starts, at, _ = window_anchors(values, rows, window)
                begin = np.searchsorted(rows, np.arange(high - low))
                of = np.repeat(np.arange(high - low), sizes[low:high])
                recurring = np.zeros(len(values) + 1, bool)
                recurring[begin[of] + flat[ends[low] - sizes[low] : ends[high - 1]]] = True
                starts = starts[recurring[at]]
                whole, gram_at = T.grams(values, rows, window)
                hashed = whole[np.searchsorted(gram_at, starts)] if len(starts) else np.zeros(0, T.U64)
                row = rows[starts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashed.astype(np.int64)), batch.column(0).slice(low, high - low).take(pa.array(row)),
                        batch.column(1).slice(low, high - low).take(pa.array(row)), pa.array((starts - begin[row]).astype(np.int32)),
                    ],
                    ["hash", "d", "u", "place"],
                )

    return candidates.select("d", "u", "body", "places").mapInArrow(find, "hash long, d long, u long, place int")


def phrases(holders: DataFrame, window: int) -> DataFrame:
    """Runs of confirmed windows: u, start and the words, joined by one blank. ``holders`` has u, body and places of first windows."""

    def cut(found):
        for batch in found:
            out = [[], [], []]
            for u, body, places in zip(*(batch.column(i).to_pylist() for i in range(3))):
                texts = split_words(body)
                places = np.unique(np.array(places, np.int64))
                for run in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1):
                    out[0].append(u)
                    out[1].append(int(run[0]))
                    out[2].append(" ".join(texts[run[0] : run[-1] + window]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], ["u", "start", "body"])

    return holders.select("u", "body", "places").mapInArrow(cut, "u long, start int, body string")


def split_words(text: str) -> list[str]:
    """Words between ASCII white space only."""
    return [w for w in text.translate(_BLANKS).split(" ") if w]


_BLANKS = {c: " " for c in (*range(0x09, 0x0E),)}


class Shard:
    """The automaton of a shard's phrases."""

    def __init__(self, window: int):
        import ahocorasick

        self.window, self.machine, self.patterns, self.phrases = window, ahocorasick.Automaton(), {}, []

    def add(self, holder: int, start: int, body: str) -> None:
        texts = body.split(" ")
        number = len(self.phrases)
        self.phrases.append((holder, start, texts))
        for at in range(0, len(texts) - BLOCK + 1, BLOCK):
            self.patterns.setdefault(" " + " ".join(texts[at : at + BLOCK]) + " ", []).append((number, at))

    def compile(self) -> None:
        for pattern, places in self.patterns.items():
            self.machine.add_word(pattern, places)
        self.machine.make_automaton()
        self.patterns = {}

    def removals(self, u: int, body: str) -> list[int]:
        """Starts of windows that stand earlier elsewhere."""
        texts = split_words(body)
        flat = " " + " ".join(texts) + " "
        if len(texts) < self.window or not len(self.machine):
            return []
        ends = np.cumsum(np.array([len(w) + 1 for w in texts]))
        seeds: dict[tuple[int, int], list[int]] = {}
        for end, places in self.machine.iter(flat):
            first = int(np.searchsorted(ends, end)) - BLOCK + 1
            for number, at in places:
                seeds.setdefault((number, first - at), []).append(at)
        out: set[int] = set()
        for (number, shift), _ in seeds.items():
            holder, start, words = self.phrases[number]
            if holder == u and shift == start:
                continue
            low, high = max(0, -shift), min(len(words), len(texts) - shift)
            run = 0
            for i in range(low, high):
                run = run + 1 if words[i] == texts[i + shift] else 0
                if run >= self.window:
                    out.add(i + shift - self.window + 1)
        return sorted(out)


def locate(shards: DataFrame, window: int) -> DataFrame:
    """Starts of windows to remove. ``shards`` is sorted by shard, part and kind: phrases (0) before documents (1)."""

    def run(found):
        here, shard, ready = None, None, False
        for batch in found:
            out = [[], []]
            for key, part, kind, u, start, body in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if here != (key, part):
                    here, shard, ready = (key, part), Shard(window), False
                if kind == 0:
                    shard.add(u, start, body)
                    continue
                if not ready:
                    shard.compile()
                    ready = True
                places = shard.removals(u, body)
                if places:
                    out[0].append(u)
                    out[1].append(places)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int32()))], ["u", "places"])

    return shards.select("shard", "part", "kind", "u", "start", "body").mapInArrow(run, "u long, places array<int>")


def without(removed: DataFrame, window: int) -> DataFrame:
    """u, n_removed and the words that are left, joined by one blank. ``removed`` has u, body and lists of window starts."""

    def cut(found):
        for batch in found:
            out = [[], [], []]
            for u, body, lists in zip(*(batch.column(i).to_pylist() for i in range(3))):
                texts = split_words(body)
                edge = np.zeros(len(texts) + 1, np.int64)
                for places in lists:
                    at = np.array(places, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                out[0].append(u)
                out[1].append(int(gone.sum()))
                out[2].append(" ".join(w for w, g in zip(texts, gone.tolist()) if not g))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["u", "n_removed", "kept_text"])

    return removed.select("u", "body", "lists").mapInArrow(cut, "u long, n_removed long, kept_text string")


def identity(doc_id: Column, text: Column) -> Column:
    """One number for a row: equal rows have equal numbers."""
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))


def removals(documents: DataFrame, window: int = 20, id_column="doc_id", text_column="text") -> DataFrame:
    """u (see ``identity``), n_removed and kept_text of the documents from which words go."""
    if window < 2 * BLOCK - 1:
        # A shorter passage may hold no whole block of the automata.
        raise ValueError(f"window must be at least {2 * BLOCK - 1} words")
    rows = documents.select(
        F.coalesce(F.col(id_column), F.lit(LAST)).cast("long").alias("d"), identity(F.col(id_column), F.col(text_column)).alias("u"),
        F.coalesce(F.col(text_column), F.lit("")).alias("body"),
    )
    counted = anchors(rows, window, False).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    recurring = materialize(counted.where("n > 1").select("anchor"), tidy=True)
    placed = anchors(rows, window, True).join(recurring, "anchor")
    places = materialize(placed.groupBy("u").agg(F.collect_set("place").alias("places")), tidy=True)
    candidates = materialize(rows.join(places, "u").dropDuplicates(["u"]), compression="zstd", tidy=True)
    found = windows(candidates, window)
    first = F.min(F.struct("d", "u", "place")).alias("first")
    confirmed = materialize(
        found.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1")
        .select("hash", F.col("first.u").alias("holder"), F.col("first.place").alias("at")), tidy=True,
    )
    routes = materialize(found.select("hash", "u").join(confirmed.select("hash", "holder"), "hash").select("u", "holder").distinct(), tidy=True)
    bodies = candidates.select("u", "body")
    held = confirmed.groupBy("holder").agg(F.collect_list("at").alias("places")).withColumnRenamed("holder", "u")
    cut = phrases(bodies.join(held, "u"), window)
    n_shards = confirmed.count() // SHARD_WORDS + 1
    shard = F.pmod(F.xxhash64("holder"), F.lit(n_shards)).alias("shard")
    asked = routes.select("u", shard).distinct()
    parts = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PART_DOCUMENTS).cast("int").alias("parts"))
    dealt = asked.join(parts, "shard").select("u", "shard", F.pmod(F.xxhash64("u", "shard"), F.col("parts")).cast("int").alias("part"))
    streamed = dealt.join(bodies, "u").select("shard", "part", F.lit(1).alias("kind"), "u", F.lit(0).alias("start"), "body")
    held_here = cut.withColumnRenamed("u", "holder").select("holder", "start", "body", shard).join(parts, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("holder").alias("u"), "start", "body"
    )
    together = held_here.unionByName(streamed).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind", "u", "start")
    removed = materialize(locate(together, window), tidy=True)
    lists = removed.groupBy("u").agg(F.collect_list("places").alias("lists"))
    return materialize(without(bodies.join(lists, "u"), window), compression="zstd", tidy=True)


def digests(documents: DataFrame, id_column="doc_id", text_column="text") -> DataFrame:
    """doc_id, u, n_words and sha256 of all words joined by one blank."""
    fields = {"doc_id": pa.int64(), "u": pa.int64(), "n_words": pa.int64(), "whole_sha256": pa.string()}

    def words(found):
        for batch in found:
            parts = {k: [] for k in fields}
            for low, high, data, offsets in T.slices(batch.column(2)):
                starts, ends, rows = T.words(data, offsets)
                size = ends - starts + 1
                text = np.full(int(size.sum()), 0x20, np.uint8)
                of, place = T.spread(ends - starts)
                where = np.cumsum(size) - size
                text[where[of] + place] = data[starts[of] + place]
                stops = np.cumsum(np.bincount(rows, weights=size, minlength=high - low).astype(np.int64))
                raw = text.tobytes()
                begins = np.concatenate([[0], stops[:-1]])
                parts["doc_id"].append(batch.column(0).slice(low, high - low))
                parts["u"].append(batch.column(1).slice(low, high - low))
                parts["n_words"].append(T.per_row(rows, high - low))
                parts["whole_sha256"].append([hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(begins.tolist(), stops.tolist())])
            yield T.batches(fields, parts)

    named = documents.select(F.col(id_column).alias("doc_id"), identity(F.col(id_column), F.col(text_column)).alias("u"), F.col(text_column).alias("body"))
    return named.mapInArrow(words, "doc_id long, u long, n_words long, whole_sha256 string")


def passage_digest(documents: DataFrame, window: int = 20, id_column="doc_id", text_column="text") -> DataFrame:
    """doc_id, n_words, n_removed and sha256 of what is left of every text."""
    gone = removals(documents, window, id_column, text_column).select("u", "n_removed", F.sha2("kept_text", 256).alias("left_sha256"))
    return digests(documents, id_column, text_column).join(gone, "u", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("left_sha256", "whole_sha256").alias("kept_sha256")
    )


def without_repeats(documents: DataFrame, window: int = 20, id_column="doc_id", text_column="text") -> DataFrame:
    """The documents with repeated passages taken out of their texts; untouched texts stay as they are."""
    gone = removals(documents, window, id_column, text_column).select(F.col("u").alias("_u"), "kept_text")
    return documents.join(gone, identity(F.col(id_column), F.col(text_column)) == F.col("_u"), "left").withColumn(
        text_column, F.coalesce("kept_text", text_column)
    ).drop("_u", "kept_text")
