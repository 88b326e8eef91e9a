"""Quality rules on repetition: a suffix array of each document's words.

The documents in which a window of ``least`` words occurs again are sorted by
prefix doubling; in the others no substring of that length is repeated. Longest
common prefixes of neighbours in the array come from prefix sums of word hashes
by binary lifting. Every suffix covers as many words as it shares with its nearer
neighbour; the union of these spans and the longest of them are judged.

Null and empty texts have no word, so the base rule rejects them. Repeated rows
are judged alike, ties in the order of suffixes do not change the spans. A text
of any length is sorted as a whole; memory follows the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbatch as T

FIELDS = {
    "doc_id": pa.int64(), "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "covered_words": pa.int64(), "longest_repeat": pa.int64(),
    "kept": pa.bool_(),
}
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "covered_words long, longest_repeat long, kept boolean"
)
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def suffix_array(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All suffixes in order, a document's together, by prefix doubling; after each round only tied ones are sorted again."""
    n = len(values)
    words = np.unique(values, return_inverse=True)[1].astype(np.int64)
    key = rows * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    length = 1
    while True:
        # The rank of a class is the place of its first member, so ranks of other classes stay.
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = first
        tied = ~new
        tied[:-1] |= ~new[1:]
        spots = np.flatnonzero(tied)
        if not len(spots):
            return order
        part = order[spots]
        then = part + length
        inside = then < n
        inside[inside] = rows[then[inside]] == rows[part[inside]]
        second = np.where(inside, rank[np.where(inside, then, 0)] + 1, 0)
        turn = np.lexsort((second, rank[part]))
        order[spots] = part[turn]
        second, class_of = second[turn], first[spots]
        split = np.zeros(len(spots), bool)
        split[1:] = (class_of[1:] != class_of[:-1]) | (second[1:] != second[:-1])
        split[0] = True
        new[spots] = split
        length *= 2


def common(sums: np.ndarray, inverse: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Longest common prefixes, at most ``most`` words, by binary lifting over prefix sums."""
    got = np.zeros(len(a), np.int64)
    step = 1 << int(most.max(initial=0)).bit_length()
    while step:
        fits = np.flatnonzero(got + step <= most)
        x, y = a[fits] + got[fits], b[fits] + got[fits]
        same = (sums[x + step] - sums[x]) * inverse[x] == (sums[y + step] - sums[y]) * inverse[y]
        got[fits[same]] += step
        step >>= 1
    return got


def union(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Marks of the places that ranges cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def repeats(values: np.ndarray, rows: np.ndarray, n_rows: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: words in repeated windows of ``least`` words, words under repeated substrings, the longest of these."""
    zero = np.zeros(n_rows, np.int64)
    gram, at = T.grams(values, rows, least)
    if not len(at):
        return zero, zero, zero
    key = T.mix(gram ^ T.mix(rows[at].astype(T.U64) + T.U64(1)))
    _, rank, count = np.unique(key, return_inverse=True, return_counts=True)
    again = count[rank] > 1
    at, rank = at[again], rank[again]
    if not len(at):
        return zero, zero, zero
    n = len(values)
    base = T.per_row(rows[union(at, np.full(len(at), least), n)], n_rows)
    # Documents without such a window have no repeat of this length.
    some = np.zeros(n_rows, bool)
    some[rows[at]] = True
    inside = some[rows]
    values, rows = values[inside], rows[inside]
    n = len(values)
    order = suffix_array(values, rows)
    power, inverse = T._tables(n + 1)
    sums = np.zeros(n + 1, T.U64)
    np.cumsum(values * power[:n], out=sums[1:])
    ends = np.searchsorted(rows, np.arange(n_rows), "right")
    a, b = order[:-1], order[1:]
    mate = rows[a] == rows[b]
    shared = np.zeros(n + 1, np.int64)
    shared[1:-1][mate] = common(sums, inverse, a[mate], b[mate], (ends[rows[a]] - np.maximum(a, b))[mate])
    reach = np.maximum(shared[:-1], shared[1:])
    far = reach >= least
    place, reach = order[far], reach[far]
    longest = zero.copy()
    np.maximum.at(longest, rows[place], reach)
    return base, T.per_row(rows[union(place, reach, n)], n_rows), longest


def measure(data: np.ndarray, offsets: np.ndarray, window: int, least: int):
    """Counts of every row of a slice."""
    n = len(offsets) - 1
    starts, ends, rows = T.words(data, offsets)
    row_of = np.repeat(np.arange(n), np.diff(offsets))
    inside = ~T.WHITE[data]
    chars = T.per_row(row_of[inside & ((data & 0xC0) != 0x80)], n)
    symbols = T.per_row(row_of[SYMBOL[data]], n)
    low, high, line_row = T.runs(data != 10, offsets)
    # A line counts if a word starts in it; a word holds no \n.
    full = np.searchsorted(starts, high) > np.searchsorted(starts, low)
    low, high, line_row = low[full], high[full], line_row[full]
    lines = T.mix(T.hashes(data, low, high) ^ T.mix(line_row.astype(T.U64) + T.U64(1)))
    first = np.unique(lines, return_index=True)[1]
    dup = T.per_row(line_row, n) - T.per_row(line_row[first], n)
    values = T.hashes(data, starts, ends)
    repeated, covered, longest = repeats(values, rows, n, window)
    if least != window:
        _, covered, longest = repeats(values, rows, n, least)
    return T.per_row(rows, n), chars, symbols, dup, repeated, covered, longest


def quality_rules(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 8, least: int = 8,
    most_covered: float = 0.3, most_longest: float = 0.2, free_words: int = 30,
) -> DataFrame:
    """Counts, base rule and verdict of every text.

    A text fails the method if repeated substrings of ``least`` words or more
    cover over ``most_covered`` of its words, or if the longest of them is over
    ``free_words`` and over ``most_longest`` of its words.
    """

    def judge(found):
        for batch in found:
            parts = {k: [] for k in FIELDS}
            for low, high, data, offsets in T.slices(batch.column(1)):
                n, chars, symbols, dup, repeated, covered, longest = measure(data, offsets, window, least)
                failed = (n < 20) | (100 * repeated > 30 * n)
                bad = (covered > most_covered * n) | ((longest > free_words) & (longest > most_longest * n))
                rows = (batch.column(0).slice(low, high - low), n, chars, symbols, dup, repeated, failed, covered, longest, ~failed & ~bad)
                for name, values in zip(FIELDS, rows):
                    parts[name].append(values)
            yield T.batches(FIELDS, parts)

    return documents.select(id_column, text_column).mapInArrow(judge, SCHEMA)
