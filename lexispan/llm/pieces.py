"""Encoding and decoding with the pieces of a SentencePiece model, by a suffix array of the batch.

A text is cut into units: blanks and the run of other characters behind them.
No piece of such a model has a blank behind another character, so no piece
crosses a unit's border. The units of a batch that were not met before are laid
one after another, every suffix is sorted by as many characters as the longest
piece has, and binary search finds, for every piece, the range of suffixes that
begin with it. These occurrences are edges from their first to their last
position. Sorted by the place of their end they are relaxed in one pass: the
last piece of an end is the one edge that may follow the last piece of its
start. Two pieces may stand side by side if no earlier merge would have joined
them across their border; a text is encoded by merging exactly if all its
neighbours may. So the way found is the library's own encoding. Characters that
no piece covers become the pieces of their UTF-8 bytes.

Null is encoded as an empty text, which has no piece. Only the character U+2581
itself, which models use for a blank, comes back as a blank. Texts of any
length are encoded whole. Rows that repeat a document are rows of their own,
columns other than the two named are not read, and an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbatch as T
from .token_files import Memo, flat

BLANK = "▁"
#: Characters of new units that are indexed at a time.
INDEX_CHARS = 1 << 17


class Model:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        one = sentencepiece.SentencePieceProcessor(model_file=path)
        n = one.get_piece_size()
        self.text = [one.id_to_piece(i) for i in range(n)]
        special = [one.is_control(i) or one.is_unknown(i) or one.is_unused(i) or one.is_byte(i) for i in range(n)]
        usual = [i for i in range(n) if not special[i]]
        self.ids = np.array(usual, np.int64)
        self.pieces = np.array([self.text[i] for i in usual])
        self.longest = self.pieces.dtype.itemsize // 4
        self.score = {self.text[i]: one.get_score(i) for i in usual}
        self.byte_id = np.zeros(256, np.int64)
        for i in range(n):
            if one.is_byte(i):
                self.byte_id[int(self.text[i][3:5], 16)] = i
        self.above = np.array([p.ljust(self.longest, chr(0x10FFFF)) for p in self.pieces.tolist()])
        self.sizes = np.char.str_len(self.pieces)
        self.letters = set().union(*self.pieces.tolist())
        # Bytes of every piece, for decoding.
        raw = [
            b"" if one.is_control(i) or one.is_unknown(i) else bytes([int(t[3:5], 16)]) if one.is_byte(i) else t.replace(BLANK, " ").encode()
            for i, t in enumerate(self.text)
        ]
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

        self._merges()

    def _merges(self) -> None:
        """For every piece its last merge; for every pair that makes a piece, when it is made."""
        place = {t: i for i, t in enumerate(self.pieces.tolist())}
        turn = {t: k for k, t in enumerate(sorted(place, key=lambda t: -self.score[t]))}
        n = len(place)
        self.turn = np.full(n + 1, -1)
        self.left, self.right = np.full(n + 1, -1), np.full(n + 1, -1)
        reached, keys, turns = np.ones(n, bool), [], []
        for t, i in place.items():
            if len(t) == 1:
                continue
            for k in range(1, len(t)):
                a, b = place.get(t[:k]), place.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    turns.append(turn[t])
            row, last = list(t), None
            while len(row) > 1:
                best = min(range(len(row) - 1), key=lambda j: turn.get(row[j] + row[j + 1], n))
                if row[best] + row[best + 1] not in turn:
                    break
                last = (row[best], row[best + 1])
                row[best : best + 2] = [row[best] + row[best + 1]]
            reached[i] = len(row) == 1
            if reached[i]:
                self.left[i], self.right[i], self.turn[i] = place[last[0]], place[last[1]], turn[t]
        order = np.argsort(keys)
        self.pair, self.pair_turn = np.array(keys)[order], np.array(turns)[order]
        # A piece that merging never reaches is never part of an encoding.
        self.all, self.reached = n, reached

    def together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces b may follow pieces a; -1 stands for a character without a piece.

        The merges inside both are taken back, the latest first. Whenever the
        two parts at the border could have been merged before the merge that
        was just taken back, they would have been. Of equal merges the left
        one comes first.
        """
        fine = np.ones(len(a), bool)
        alive = np.flatnonzero((a >= 0) & (b >= 0))
        x, y = a[alive], b[alive]
        limit = np.full(len(alive), self.all)
        while len(alive):
            key = x * self.all + y
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            crossed = (self.pair[at] == key) & (self.pair_turn[at] < limit)
            fine[alive[crossed]] = False
            u, v = self.turn[x], self.turn[y]
            go = ~crossed & ((u >= 0) | (v >= 0))
            alive, x, y, u, v = alive[go], x[go], y[go], u[go], v[go]
            undo = u > v
            limit = np.where(undo, u, v + 1)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return fine

    def edges(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every occurrence of every piece in text of code points: start and piece."""
        wide = np.lib.stride_tricks.sliding_window_view(np.concatenate([chars, np.zeros(self.longest, np.uint32)]), self.longest)[: len(chars)]
        suffixes = np.ascontiguousarray(wide).view(f"<U{self.longest}").reshape(-1)
        order = np.argsort(suffixes, kind="stable")
        suffixes = suffixes[order]
        low = np.searchsorted(suffixes, self.pieces, "left")
        high = np.searchsorted(suffixes, self.above, "right")
        found = high - low
        found[~self.reached] = 0
        piece, place = T.spread(found)
        return order[low[piece] + place], piece

    def encode(self, units: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        low = 0
        while low < len(units):
            high, size = low, 0
            while high < len(units) and (high == low or size + len(units[high]) < INDEX_CHARS):
                size += len(units[high]) + 1
                high += 1
            out += self._encode(units[low:high])
            low = high
        return out

    def _encode(self, units: list[str]) -> list[list[int]]:
        # A zero stands between units; no piece holds one. For U+0000 in a unit stands a character found in no unit and no piece.
        blanked = [u.replace(" ", BLANK) for u in units]
        zero = self._unused(blanked) if any("\0" in u for u in units) else "\0"
        chars = np.frombuffer("\0".join(u.replace("\0", zero) for u in blanked).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(u) for u in units], np.int64)
        first = np.cumsum(sizes + 1) - sizes - 1
        n = len(chars) + 1
        start, piece = self.edges(chars)
        single = np.ones(n - 1, bool)
        single[start[self.sizes[piece] == 1]] = False
        single[(first + sizes)[:-1]] = False
        lone = np.flatnonzero(single)
        start = np.concatenate([start, lone])
        end = np.concatenate([start[: len(piece)] + self.sizes[piece], lone + 1])
        piece = np.concatenate([piece, np.full(len(lone), -1)])
        unit = np.searchsorted(first, start, "right") - 1
        level = end - first[unit]
        order = np.lexsort((end, level))
        start, end, piece = start[order], end[order], piece[order]
        borders = np.flatnonzero(np.diff(level[order], prepend=0, append=0))
        last, chosen = np.full(n, -2), np.full(n, -1)
        last[first] = -1
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
            before = last[start[a:b]]
            took = a + np.flatnonzero((before > -2) & self.together(before, piece[a:b]))
            last[end[took]], chosen[end[took]] = piece[took], took
        # Walk all units back at once.
        at, alive, steps = first + sizes, np.arange(len(units)), []
        while True:
            alive = alive[at[alive] > first[alive]]
            if not len(alive):
                break
            edge = chosen[at[alive]]
            steps.append((alive, edge))
            at[alive] = start[edge]
        if not steps:
            return [[] for _ in units]
        owner, edge = (np.concatenate(x[::-1]) for x in zip(*steps))
        back = np.argsort(owner, kind="stable")
        owner, edge = owner[back], edge[back]
        got = piece[edge]
        ids = np.where(got >= 0, self.ids[np.maximum(got, 0)], -1 - start[edge])
        out = []
        for unit_ids in np.split(ids, np.searchsorted(owner, np.arange(1, len(units)))):
            row = unit_ids.tolist()
            if min(row, default=0) < 0:
                row = [y for x in row for y in ([x] if x >= 0 else self._bytes(int(chars[-1 - x]), ord(zero)))]
            out.append(row)
        return out

    def _unused(self, units: list[str]) -> str:
        """A private character that neither units nor pieces hold."""
        held = set().union(self.letters, *units)
        return next(c for c in map(chr, range(0xF0000, 0x10FFFE)) if c not in held)

    def _bytes(self, point: int, zero: int) -> list[int]:
        return [int(self.byte_id[b]) for b in (b"\0" if point == zero else chr(point).encode())]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ragged rows of ids, and how many each row has; the blank before a text goes."""
        size = self.raw_size[ids]
        data = T.gather(self.raw, self.raw_at[ids], size)
        rows, _ = T.spread(counts)
        lengths = np.bincount(rows, weights=size, minlength=len(counts)).astype(np.int64)
        keep = np.ones(len(data), bool)
        starts = (np.cumsum(lengths) - lengths)[lengths > 0]
        keep[starts] = False
        return data[keep], lengths - (lengths > 0)


_models: dict[str, tuple[Model, Memo]] = {}


def model(path: str) -> tuple[Model, Memo]:
    """One model and memo of a Python worker."""
    if path not in _models:
        one = Model(path)
        _models[path] = (one, Memo(one.encode))
    return _models[path]


def encode_slice(memo: Memo, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, and how many each row has. A blank is put before every text that is not empty."""
    lengths = np.diff(offsets)
    n = len(lengths)
    full = lengths > 0
    grown = np.cumsum(lengths + full)
    new = np.concatenate([[0], grown])
    text = np.insert(data, offsets[:-1][full], 0x20)
    blank = text == 0x20
    begin = blank.copy()
    begin[1:] &= ~blank[:-1]
    begin[new[:-1][full]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(text))[: len(starts)]
    rows = np.searchsorted(new, starts, "right") - 1
    ids, sizes = memo.look_up(text, starts, ends)
    return ids, np.bincount(rows, weights=sizes, minlength=n).astype(np.int64)


def encode_pieces(documents: DataFrame, model_path: str, id_column="doc_id", text_column="text") -> DataFrame:
    """doc_id, number of pieces and ids (uint32, little-endian) of every text."""
    fields = {"doc_id": pa.int64(), "n_pieces": pa.int64(), "ids": pa.binary()}

    def encode(found):
        _, memo = model(model_path)
        for batch in found:
            parts = {k: [] for k in fields}
            for low, high, data, offsets in T.slices(batch.column(1), 1 << 21):
                ids, counts = encode_slice(memo, data, offsets)
                parts["doc_id"].append(batch.column(0).slice(low, high - low))
                parts["n_pieces"].append(counts)
                parts["ids"].append(T.binary(ids, counts))
            yield T.batches(fields, parts)

    return documents.select(id_column, text_column).mapInArrow(encode, "doc_id long, n_pieces long, ids binary")


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of every row of ids."""
    fields = {"doc_id": pa.int64(), "text": pa.string()}

    def decode(found):
        one, _ = model(model_path)
        for batch in found:
            counts = np.asarray(batch.column(1))
            data, lengths = one.decode(flat(batch.column(2), np.uint32), counts)
            yield T.batches(fields, {"doc_id": [batch.column(0)], "text": [T.binary(data, lengths).cast(pa.string())]})

    return encoded.select("doc_id", "n_pieces", "ids").mapInArrow(decode, "doc_id long, text string")


def round_trips(documents: DataFrame, model_path: str, id_column="doc_id", text_column="text", keep_ids: bool = False) -> DataFrame:
    """Encode and decode every text: its pieces' number and crc32, the decoded text's length, sha256 and whether it is the text."""
    fields = {
        "doc_id": pa.int64(), "n_pieces": pa.int64(), "ids_crc32": pa.int64(), "n_chars": pa.int64(), "decoded_sha256": pa.string(),
        "round_trip": pa.bool_(),
    } | ({"ids": pa.binary()} if keep_ids else {})

    def both(found):
        one, memo = model(model_path)
        for batch in found:
            parts = {k: [] for k in fields}
            for low, high, data, offsets in T.slices(batch.column(1), 1 << 21):
                ids, counts = encode_slice(memo, data, offsets)
                back, lengths = one.decode(ids, counts)
                ends = np.cumsum(lengths)
                raw, given, coded = back.tobytes(), data.tobytes(), ids.astype("<u4").tobytes()
                id_ends = 4 * np.cumsum(counts)
                spans = list(zip((ends - lengths).tolist(), ends.tolist()))
                texts = zip(spans, zip(offsets[:-1].tolist(), offsets[1:].tolist()))
                row_of = np.repeat(np.arange(len(lengths)), lengths)
                parts["doc_id"].append(batch.column(0).slice(low, high - low))
                parts["n_pieces"].append(counts)
                parts["ids_crc32"].append([zlib.crc32(coded[b - 4 * c : b]) for b, c in zip(id_ends.tolist(), counts.tolist())])
                parts["n_chars"].append(T.per_row(row_of[(back & 0xC0) != 0x80], len(lengths)))
                parts["decoded_sha256"].append([hashlib.sha256(raw[a:b]).hexdigest() for a, b in spans])
                if keep_ids:
                    parts["ids"].append(T.binary(ids.astype("<u4"), counts))
                parts["round_trip"].append([raw[a:b] == given[c:d] for (a, b), (c, d) in texts])
            yield T.batches(fields, parts)

    return documents.select(id_column, text_column).mapInArrow(
        both, "doc_id long, n_pieces long, ids_crc32 long, n_chars long, decoded_sha256 string, round_trip boolean" + ", ids binary" * keep_ids
    )
