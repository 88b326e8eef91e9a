"""Short licence notices in texts, exact and with errors.

Letters A to Z are lowered and a text becomes its words with one blank between
them. Exact phrases are found on hashes of words. For notices with errors the
pigeonhole principle gives seeds: a notice that may differ in k characters is
split into k + 1 pieces, and any passage within k errors holds one of them
unchanged. Places of seeds give windows just wide enough for the notice, one
for the seeds of one alignment. The regex library's bounded-error matching
decides there, and again before and behind each match it reports with its span
and number of errors, so no worse match beside a better one is lost.

Null and empty texts have no words and no labels. Repeated rows get the same
result. A text of any length is searched whole.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as T

WORD = np.ones(256, bool)
WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False

#: label and words of exact phrases.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
#: label and wording of notices that are searched with errors.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("cc", "licensed under a creative commons attribution"),
    ("cc0", "dedicated to the public domain under cc0"),
    ("copyright", "copyright all rights reserved"),
]
#: Characters of a notice for each error that is allowed.
CHARS_PER_ERROR = 10


class Notice:
    """A notice, its seeds and its pattern."""

    def __init__(self, label: str, wording: str, chars_per_error: int):
        import regex

        self.label, self.text = label, wording
        self.errors = max(1, len(wording) // chars_per_error)
        cuts = [round(i * len(wording) / (self.errors + 1)) for i in range(self.errors + 2)]
        self.seeds = [(wording[a:b].encode(), a) for a, b in zip(cuts, cuts[1:])]
        self.pattern = regex.compile(f"(?b)(?:{regex.escape(wording, literal_spaces=True)}){{e<={self.errors}}}")

    def spans(self, text: bytes, low: int = 0, high: int | None = None) -> list[tuple[int, int, int]]:
        """(start byte, end byte, errors) of every match; of matches that overlap by more than the errors, the best one."""
        high = len(text) if high is None else high
        size, near, windows = len(self.text), self.errors, []
        for seed, offset in self.seeds:
            at = text.find(seed, low, high)
            while at >= 0:
                a, b = max(low, at - offset - 4 * near), min(high, at - offset + size + 4 * near)
                # A line break ends a text, and no window goes beyond it.
                stop = text.find(b"\n", at, b)
                windows.append((at - offset, text.rfind(b"\n", a, at) + 1 or a, b if stop < 0 else stop))
                at = text.find(seed, at + 1, high)
        # One window for the seeds of one alignment, which may differ by the errors on both sides; so its size is bounded.
        grouped: list[list[int]] = []
        for place, a, b in sorted(windows):
            if grouped and place - grouped[-1][0] <= 2 * near and a < grouped[-1][2]:
                grouped[-1][1:] = [min(a, grouped[-1][1]), max(b, grouped[-1][2])]
            else:
                grouped.append([place, a, b])
        found: set[tuple[int, int, int]] = set()
        for _, a, b in grouped:
            # Bytes of other scripts count one error each, as any other change.
            piece = text[a:b].decode("latin-1")
            parts = [(0, len(piece))]
            while parts:
                # The best match of a part comes first; worse ones lie before and behind it.
                i, j = parts.pop()
                m = self.pattern.search(piece, i, j) if j - i >= size - near else None
                if m and m.end() > m.start():
                    found.add((a + m.start(), a + m.end(), sum(m.fuzzy_counts)))
                    parts += [(i, min(m.start() + near, m.end() - 1)), (max(m.end() - near, m.start() + 1), j)]
        return apart(found, near)


def apart(found: set[tuple[int, int, int]], near: int) -> list[tuple[int, int, int]]:
    """Spans with fewest errors first, each one that overlaps none taken before by more than ``near``."""
    taken: list[tuple[int, int, int]] = []
    run: list[tuple[int, int, int]] = []
    end = -1

    def settle():
        chosen: list[tuple[int, int, int]] = []
        for a, b, errors in sorted(run, key=lambda f: (f[2], f[0], f[1])):
            # Spans taken lie apart, so only the next ones on both sides can overlap.
            i = bisect_left(chosen, (a, b, errors))
            if all(min(b, d) - max(a, c) <= near for c, d, _ in chosen[max(0, i - 2) : i + 2]):
                chosen.insert(i, (a, b, errors))
        taken.extend(chosen)

    for one in sorted(found):
        if one[0] >= end:
            settle()
            run = []
        run.append(one)
        end = max(end, one[1])
    settle()
    return taken


def phrase_places(values: np.ndarray, rows: np.ndarray, phrases=PHRASES) -> list[tuple[str, np.ndarray]]:
    """Positions at which the words of each phrase stand one after another in one text."""
    out = []
    for label, phrase in phrases:
        raw = phrase.encode()
        data = np.frombuffer(raw, np.uint8)
        starts, ends, _ = T.words(data, np.array([0, len(raw)]))
        want = T.hashes(data, starts, ends)
        k = len(want)
        last = len(values) - k + 1
        if last <= 0:
            out.append((label, np.zeros(0, np.int64)))
            continue
        same = rows[:last] == rows[k - 1 :]
        for j in range(k):
            same &= values[j : last + j] == want[j]
        out.append((label, np.flatnonzero(same)))
    return out


def scan_slice(data: np.ndarray, offsets: np.ndarray, notices: list[Notice]):
    """n_words, n_base, first_word, last_word, base labels, spans (label, start word, end word, errors) of every text."""
    n = len(offsets) - 1
    low = T.LOWER[data]
    starts, ends, rows = T.runs(WORD[low], offsets)
    values = T.hashes(low, starts, ends)
    n_words = T.per_row(rows, n)
    begin = np.cumsum(n_words) - n_words
    n_base = np.zeros(n, np.int64)
    first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    base: list[set] = [set() for _ in range(n)]
    for label, at in phrase_places(values, rows):
        of = rows[at]
        np.add.at(n_base, of, 1)
        np.minimum.at(first, of, at - begin[of])
        np.maximum.at(last, of, at - begin[of])
        for r in set(of.tolist()):
            base[r].add(label)
    # Words of a text with one blank between them; a line break ends a text.
    size = ends - starts + 1
    where = np.cumsum(size) - size
    text = np.full(int(size.sum()), 0x20, np.uint8)
    place_rows, place = T.spread(ends - starts)
    text[where[place_rows] + place] = low[starts[place_rows] + place]
    if len(rows):
        text[(where + size - 1)[np.append(rows[1:] != rows[:-1], True)]] = 0x0A
    raw = text.tobytes()
    spans: list[list] = [[] for _ in range(n)]
    for notice in notices:
        for a, b, errors in notice.spans(raw):
            word = int(np.searchsorted(where, a, "right")) - 1
            row = int(rows[word])
            if b > a and row == rows[int(np.searchsorted(where, b - 1, "right")) - 1]:
                stop = int(np.searchsorted(where, b, "left"))
                spans[row].append((notice.label, word - int(begin[row]), stop - int(begin[row]), errors, 1 - errors / len(notice.text)))
    return n_words, n_base, first, last, base, spans


def license_notices(documents: DataFrame, id_column="doc_id", text_column="text", notices=NOTICES, chars_per_error: int = CHARS_PER_ERROR) -> DataFrame:
    """Base counts, labels, score and spans (label, first word, end word, errors) of every text.

    The score is 1 for a text with an exact phrase, else the likeness of the
    best notice found in it, else 0.
    """
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("errors", pa.int64())])
    fields = {
        "doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
        "base_labels": pa.list_(pa.string()), "labels": pa.list_(pa.string()), "score": pa.float64(), "spans": pa.list_(span),
    }

    def scan(found):
        compiled = [Notice(label, wording, chars_per_error) for label, wording in notices]
        for batch in found:
            parts = {k: [] for k in fields}
            for low, high, data, offsets in T.slices(batch.column(1)):
                n_words, n_base, first, last, base, spans = scan_slice(data, offsets, compiled)
                none = n_base == 0
                parts["doc_id"].append(batch.column(0).slice(low, high - low))
                parts["n_words"].append(n_words)
                parts["n_base"].append(n_base)
                parts["first_word"].append(pa.array(first, mask=none))
                parts["last_word"].append(pa.array(last, mask=none))
                parts["base_labels"].append(pa.array([sorted(b) for b in base], fields["base_labels"]))
                parts["labels"].append(pa.array([sorted(b | {s[0] for s in f}) for b, f in zip(base, spans)], fields["labels"]))
                parts["score"].append(np.array([1.0 if b else max((s[4] for s in f), default=0.0) for b, f in zip(base, spans)], float))
                rows = [[dict(zip(("label", "first_word", "end_word", "errors"), s)) for s in f] for f in spans]
                parts["spans"].append(pa.array(rows, fields["spans"]))
            yield T.batches(fields, parts)

    return documents.select(id_column, text_column).mapInArrow(
        scan,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
        "score double, spans array<struct<label: string, first_word: long, end_word: long, errors: long>>",
    )


def license_digest(found: DataFrame) -> DataFrame:
    """Labels joined by commas, spans counted."""
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score", F.size("spans").cast("long").alias("n_spans"),
    )
