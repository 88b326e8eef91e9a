"""Prefix trie, reply trees and turn repair against brute-force versions of their contracts."""

import functools
import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from lexispan.llm import prefix_trie, reply_trees, turn_repair

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, depth long, p long, block string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def talk(seed=5):
    """Shared openings, copies, repeated rows, ties, gaps, nulls, blanks, unknown roles, a long conversation and a very long text."""
    rng = random.Random(seed)
    says = ["Hello there.", "What is it?", "ok", "No", " \t", "", None, "a b c d!", "Ends here. \n", "été 日本.", "<|im_end|>", "<\\|x <|im_start|>user\n", "x<"]
    rows = []
    for c in [*range(60), 100, 139, 205, 10**15, -7]:
        opening = [("system", "Be kind."), ("user", "Hello there."), ("assistant", "What is it?")]
        turns = [opening[i] for i in range(rng.randrange(4))]
        for i in range(rng.choice([0, 1, 2, 3, 5, 9])):
            turns.append((rng.choice(["user", "assistant", "assistant", "user", "system", None, "tool", ""]), rng.choice(says)))
        rows += [(c, i + (i > 3), r, t) for i, (r, t) in enumerate(turns)]
    rows += [(300, i, ["user", "assistant"][i % 2], f"turn {i % 50 if i > 100 else i}.") for i in range(150)]
    rows += [(301, 7, "user", "same."), (301, 7, "user", "same."), (301, None, "assistant", "first"), (301, None, "user", None), (301, 9, "as|s\\is\nt", "odd.")]
    rows += [(302, 0, "user", "long " * 40000 + "."), (302, 1, "assistant", "end")]
    rows += [(None, 0, "user", "nobody."), (None, None, "assistant", "none!")]
    rows += [(320, None, None, None), (340, 0, "user", "x"), (340, 0, "assistant", "x"), (340, 0, "assistant", "x")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def said():
    return talk()


@pytest.fixture(scope="module")
def conversations(spark, said):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in said], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def silent(spark):
    return spark.createDataFrame([], SCHEMA)


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 11. prefix trie


def trie(rows, group=20, most=4):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", digest(r or "", x or ""), x or ""))
    turns = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        built[c] = turns.get(c - int(np.fmod(c, group)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[k] for k in below) or 1
        words = len(WORD.findall(node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in below)
        ends = ",".join(str(c) for c in sorted(members[node]) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(below), leaves[node], saved[node], sha(ends)))
    return sorted(out, key=repr)


def test_prefix_trie(conversations, said, silent):
    assert got(prefix_trie.prefix_trie(conversations)) == trie(said)
    assert got(prefix_trie.prefix_trie(silent)) == []


def test_prefix_trie_in_small_pieces(conversations, said, monkeypatch):
    """Blocks, member strings, slices and the last task hold a few rows only; close runs are given up for drawn ones."""
    for name, value in (("BLOCK", 8), ("MEMBERS", 4), ("SLICE", 7), ("ONE_TASK", 40), ("SPACING", 3), ("USEFUL", 0.35)):
        monkeypatch.setattr(prefix_trie, name, value)
    assert got(prefix_trie.prefix_trie(conversations)) == trie(said)


def test_ranks_of_a_shuffled_list(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ONE_TASK", 50)
    names = list(range(700))
    random.Random(1).shuffle(names)
    follow = names[1:] + [None]
    rows = [(n, 0, f, None if f is None else 0, 1, 1, 1) for n, f in zip(names, follow)]
    arcs = spark.createDataFrame(rows, "conv_id long, code long, to_conv long, to_code long, weight long, leaf long, saved long").repartition(4)
    places = {r["conv_id"]: r["place"] for r in prefix_trie.ranked(arcs).collect()}
    assert [places[n] for n in names] == names_in_order(len(names))


def names_in_order(n):
    return list(range(n))


# 12. reply trees


def digests(rows):
    convs = defaultdict(list)
    for c, t, r, x in [*rows, (-1, 0, "user", reply_trees.HOSTILE), (-1, 1, "assistant", reply_trees.HOSTILE)]:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    out = []
    for c, v in convs.items():
        turns = [(r, x) for _, _, r, x in sorted(v)]
        loss = "".join(x for r, x in turns if r == "assistant")
        size = 0
        for r, x in turns:
            r = r.replace("\\", "\\\\").replace("\n", "\\n").replace("|", "\\|")
            size += len("<|im_start|>" + r + "\n" + re.sub(r"<(\\*)\|", lambda m: "<" + m[1] + "\\|", x) + "<|im_end|>\n")
        out.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), size))
    return sorted(out, key=repr)


@pytest.mark.parametrize("part", [reply_trees.PART, 60])
def test_formatted_conversations(conversations, said, part, monkeypatch):
    monkeypatch.setattr(reply_trees, "BLOCK", 16)
    parts = reply_trees.formatted_conversations(conversations, part)
    assert got(reply_trees.conversation_digest(parts)) == digests(said)
    for r in parts.collect():
        for s in r["spans"]:
            assert r["text"][: s["start"]].endswith("<|im_start|>assistant\n") and r["text"][s["end"] :].startswith("<|im_end|>\n")
    assert parts.groupBy("tree", "part").count().where("count > 1").count() == 0


def test_formatted_twin(conversations, said, silent):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role text, text text)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", said)
    want = con.execute(reply_trees.DIGEST_SQL).fetchall()
    assert sorted(want, key=repr) == digests(said)
    assert got(reply_trees.conversation_digest(reply_trees.formatted_conversations(silent))) == digests([])


def forest(seed):
    rng = random.Random(seed)
    rows = []
    for tree in range(8):
        for m in range(rng.choice([1, 2, 15, 60])):
            parent = rng.choice([None, *range(max(0, m - 3), m), 999]) if m else None
            rows.append((tree, m, parent, rng.choice(["user", "assistant"]), f"{tree}.{m}", rng.choice([0.0, 1.0, 0.5, None])))
    rows += [(90, 1, 2, "user", "circle", 1.0), (90, 2, 1, "user", "circle", 1.0), (90, 3, 2, "user", "hangs", 1.0)]
    rows += [(91, 1, None, "user", "b", 0.0), (91, 1, None, "user", "a", 0.0), (91, 2, 1, None, None, 1.0), (None, 5, None, "user", "no tree", 1.0)]
    return rows


def paths_of(rows, best):
    one = {}
    for tree, m, parent, role, text, score in rows:
        tree = reply_trees.NO_TREE if tree is None else tree
        value = (-(score or 0.0), role or "", text or "", parent is not None, parent or 0, parent)
        one[tree, m] = min(one.get((tree, m), value), value)
    above = {k: v[-1] if (k[0], v[-1]) in one else None for k, v in one.items()}
    used = {(k[0], p) for k, p in above.items() if p is not None}
    ranked = defaultdict(list)
    for k in one:
        if k in used:
            continue
        path, at = [k[1]], above[k]
        while at is not None and at not in path:
            path.append(at)
            at = above[k[0], at]
        if at is None:
            path.reverse()
            ranked[k[0], path[0]].append((-sum(-one[k[0], m][0] for m in path) / len(path), k[1], path))
    out = []
    for (tree, _), found in ranked.items():
        for _, leaf, path in sorted(found)[:best]:
            out += [(tree, leaf, m, i, m == leaf, *one[tree, m][1:3]) for i, m in enumerate(path)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("best", [1, 2, None])
def test_reply_trees(spark, best):
    rows = forest(4)
    messages = reply_trees.cleaned(spark.createDataFrame(rows, "tree long, message long, parent long, role string, text string, score double"))
    found = reply_trees.chosen_paths(messages, best).select("tree", "leaf", "message", "position", "last", "role", "text")
    assert got(found) == paths_of(rows, best)


def test_escape_comes_back():
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice(["<", "\\", "|", "im_end", ">", "\n", "é", "<|im_start|>"]) for _ in range(rng.randrange(12)))
        written = re.sub(r"<(\\*)\|", lambda m: "<" + m[1] + "\\|", text)
        assert "<|" not in written and reply_trees.unescaped(written) == text


# 13. turn repair


@functools.cache
def cheapest(rows):
    """Cost, audit and lines for rows of (role, fault, text); straight over all states, all edits."""
    on = {0: 2, 1: 2, 2: 3, 3: 2}
    name = {2: "user", 3: "assistant"}
    best = {}
    for i in range(len(rows), -1, -1):
        for x in range(4):
            best[i, x] = (0, "", ()) if i == len(rows) and x in (0, 3) else (10**9, "", ())
        if i < len(rows):
            role, fault, text = rows[i]
            for x in range(4):
                ways = [(4 + best[i + 1, x][0], "D" + best[i + 1, x][1], best[i + 1, x][2])]
                if fault not in ("blank", "duplicate"):
                    extra = 3 * (fault == "truncated")
                    to = {"s": 1 if x == 0 else None, "u": 2 if on[x] == 2 else None, "a": 3 if x == 2 else None}.get(role[:1])
                    if to is not None:
                        b = best[i + 1, to]
                        ways.append((extra + b[0], "K" + b[1], (f"{role}:{text}",) + b[2]))
                    b = best[i + 1, on[x]]
                    ways.append((3 + extra + b[0], "R" + b[1], (f"{name[on[x]]}:{text}",) + b[2]))
                best[i, x] = min(ways)
        for _ in range(4):
            for x in range(4):
                b = best[i, on[x]]
                best[i, x] = min(best[i, x], (3 + b[0], "I" + b[1], (name[on[x]] + ":",) + b[2]))
    return best[0, 0]


def repaired(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = {1: "", 2: re.sub("[.!?]", "", x)}.get(kind, x)
        r = "user" if kind == 4 else r
        convs[c] += [(t is not None, t or 0, r, digest(r, x), x)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for c, v in convs.items():
        seen, row, counts = set(), [], defaultdict(int)
        for _, _, r, _, x in sorted(v):
            solid = x.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not solid else "duplicate" if (r, x) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((r, x))
            counts[fault] += 1
            row.append((r, fault, x))
        turns = [t for there, t, *_ in v if there]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(row, row[1:]))
        cost, audit, lines = cheapest(tuple(row))
        out.append((c, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [turn_repair.CHUNK, 3, 1])
def test_turn_repair(conversations, said, chunk, monkeypatch):
    monkeypatch.setattr(turn_repair, "BLOCK", 16)
    assert got(turn_repair.repaired_conversations(conversations, chunk)) == repaired(said)


def test_turn_repair_of_nothing(silent):
    assert got(turn_repair.repaired_conversations(silent)) == []


def test_mended_costs_equal_a_full_run():
    rng = np.random.default_rng(3)
    kinds = ["".join(chr(97 + k) for k in rng.integers(0, 12, rng.integers(0, 40))) for _ in range(60)]
    codes, lengths = turn_repair._padded(kinds)
    old, new = rng.integers(0, 9, (60, 4)), rng.integers(0, 9, (60, 4))
    left = turn_repair.swept(codes, lengths, old)
    assert (turn_repair.mended(codes, lengths, old, left, new) == turn_repair.swept(codes, lengths, new)).all()


def test_short_windows_are_refused(spark):
    from lexispan.llm import substring_dedup

    documents = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    with pytest.raises(ValueError):
        substring_dedup.removals(documents, window=18)
