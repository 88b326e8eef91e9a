"""Every operator against a brute-force version of its contract."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from lexispan.llm import (
    fingerprints, host_text, license_scan, mixing, near_dedup, pieces, quality_ranking, repetition, substring_dedup, token_files,
)
from lexispan.session import staged_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# 1. fingerprints


def cut_up(text):
    """Pieces of four characters; one at every character that has 24 or more without white space behind or before it."""
    out = []
    for m in WORD.finditer(text):
        run, at = m[0], 0
        while at < len(run):
            out.append(run[at : at + 4])
            at += 1 if at >= 24 or len(run) - at >= 25 else 4
    return out


def hashed(value):
    return np.int64(np.uint64(xxhash.xxh64_intdigest(value.encode(), seed=42))).item()


def winnowed(text, k=5, w=6):
    values = [hashed(p) % 2147483647 for p in cut_up(text)]

    def roll(vs):
        total = 0
        for v in vs:
            total = (total * 1000003 + v) % 2147483647
        return total

    grams = [roll(values[i : i + k]) for i in range(len(values) - k + 1)] if len(values) >= k else [roll(values)] if values else []
    picked = []
    for s in range(max(len(grams) - w + 1, min(len(grams), 1))):
        part = list(enumerate(grams))[s : s + w]
        at, h = min(part, key=lambda x: (x[1], -x[0]))
        if (h, at) not in picked:
            picked.append((h, at))
    return picked


def test_winnowing(spark, texts, documents):
    marked = fingerprints.fingerprints(documents).select(
        "body", F.transform("marks", lambda m: F.shiftright(m, 32)).alias("h"), fingerprints.positions(F.col("marks")).alias("p")
    )
    for r in marked.collect():
        assert list(zip(r["h"], r["p"])) == winnowed(r["body"] or "")


def test_edits(spark, texts, documents, nothing):
    order = sorted({(d, t or "") for d, t in texts}, key=lambda x: (x[0] is None, -(x[0] or 0)))
    full = sorted(((d, t or "") for d, t in texts), key=lambda x: (x[0] is None, -(x[0] or 0), -hashed(x[1]) if x[0] is None else 0, x[1]))
    want = []
    for i, (d, t) in enumerate(full):
        following = full[(i + 1) % len(full)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        a, b, c = ({h for h, _ in winnowed(x)} for x in (t, edited, following))
        alike = lambda x, y: 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(alike(a, b), 9), round(alike(a, c), 9)))
    got = [
        (r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9))
        for r in fingerprints.edit_test(documents).collect()
    ]
    same(got, want)
    assert len(order) < len(full)
    assert fingerprints.edit_test(nothing).count() == 0


def test_shared_run_is_found():
    """Any run of k + window - 1 pieces that two texts share has a chosen hash in both."""
    shared = " ".join(f"p{i}" for i in range(10))
    a, b = winnowed("aa bb cc " + shared), winnowed("zz " * 9 + shared + " yy")
    assert {h for h, _ in a} & {h for h, _ in b}


def test_insertion_into_a_text_without_white_space(spark):
    letters = np.random.default_rng(3).integers(0x4E00, 0x4E00 + 2000, 3000)
    text = "".join(map(chr, letters))
    rows = spark.createDataFrame([(text, text[:1201] + "x" + text[1201:])], "a string, b string")
    marks = [fingerprints.hashes(fingerprints.winnow(F.col(c))) for c in ("a", "b")]
    assert 0.97 < rows.select(fingerprints.likeness(*marks)).first()[0] < 1


@pytest.mark.parametrize("ids", [[*range(1, 1001), 10**15], [*range(50), *(7 * 2**40 + i * 2**33 for i in range(200))], [None] * 400 + [-(2**62), 2**62], [3] * 90])
def test_next_document_over_blocks(spark, monkeypatch, ids):
    """Every row is followed by the next one, however the ids lie, and no block takes all rows."""
    monkeypatch.setattr(fingerprints, "BLOCK", 8)
    rows = [(d, f"text {i} of {d}") for i, d in enumerate(ids)]
    full = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), -hashed(x[1]) if x[0] is None else 0, x[1]))
    table = spark.createDataFrame(rows, "doc_id long, body string")
    found = fingerprints.with_next(table).collect()
    blocks = defaultdict(list)
    for r in found:
        blocks[r["block"]].append((r["ghost"], -r["key"], -r["spot"], r["body"]))
    following = {}
    for block in blocks.values():
        assert len(block) < 60 or len(set(ids)) == 1
        ordered = [x[3] for x in sorted(block)]
        following |= dict(zip(ordered, ordered[1:]))
    assert following == {a[1]: b[1] for a, b in zip(full, full[1:] + full[:1])}


# 2. token files


def test_token_files(spark, texts, documents, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    one = Tokenizer.from_file(path)
    folder = staged_path(spark)
    extra = spark.createDataFrame([(900, "a <|endoftext|> b it's O'Neil's 'tis x2y!?—…")], "doc_id long, text string")
    docs = documents.select("doc_id", "text").union(extra)
    token_files.tokenize_to_files(docs, folder, path, end_id=1)
    got = token_files.read_token_files(spark, folder).collect()
    coded = {}
    for r in docs.collect():
        coded.setdefault(r["doc_id"], []).append(one.encode(r["text"] or "", add_special_tokens=False).ids + [1])
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        ids = np.frombuffer(r["ids"], np.uint32).tolist()
        coded[r["doc_id"]].remove(ids)
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        start += len(ids)
    assert not any(coded.values())
    listed = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert listed == sorted(listed, key=lambda d: (d is not None, d))
    sums = token_files.checksums(token_files.read_token_files(spark, folder))
    assert {r["ids_crc32"] for r in sums.collect()} == {zlib.crc32(r["ids"]) for r in got}
    empty = staged_path(spark)
    token_files.tokenize_to_files(nothing, empty, path)
    assert token_files.read_token_files(spark, empty).count() == 0


@pytest.mark.parametrize("top", [2**8, 2**16, 2**24, 2**32])
def test_variable_length_coding(top):
    rng = np.random.default_rng(top)
    counts = rng.integers(0, 9, 200)
    ranks = rng.integers(0, top, counts.sum()).astype(np.uint32)
    control, n_control, data, n_data = token_files.pack(ranks, counts)
    assert (token_files.unpack(control, data, counts) == ranks).all()
    assert n_control.sum() == len(control) and n_data.sum() == len(data)


# 3. quality


def test_quality(spark, nothing):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 200_000)], "doc_id long, text string")
    model = quality_ranking.learn(docs, labels.unionByName(labels.limit(5)).withColumn("text", F.lit("clash")).drop("text"))
    scored = quality_ranking.quality_scores(docs.select("doc_id", "text").union(odd), model)
    assert scored.where("score between 0 and 1").count() == docs.count() + 3
    judged = scored.join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert sum(r["predicted"] == r["quality"] for r in judged) / len(judged) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored.collect())
    assert quality_ranking.learn(docs, labels.where("quality = 1")) is None
    assert {r["score"] for r in quality_ranking.quality_scores(docs, None).collect()} == {0.5}
    assert quality_ranking.quality_scores(nothing, model).count() == 0
    assert quality_ranking.good_documents(docs, model).columns == docs.columns


def test_held_out_labels_are_not_read(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality_ranking.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_ranking.learn(docs, labels), quality_ranking.learn(docs, turned)
    assert (a["w"] == b["w"]).all() and a["cut"] == b["cut"]


def test_repeated_labels_and_documents(spark):
    """Copies of labels or documents change nothing about what the fit may read."""
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    a, b = quality_ranking.learn(docs, labels), quality_ranking.learn(docs, labels.unionByName(labels))
    assert (a["w"] == b["w"]).all() and a["cut"] == b["cut"]
    first = labels.where("quality = 1").where(~quality_ranking.held_out(F.col("doc_id"))).select("doc_id").first()[0]
    copies = docs.where(F.col("doc_id") == first).select("*", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("col")
    few = quality_ranking.learn(docs.unionByName(copies), labels, sample_per_label=5)
    assert few is not None and np.isfinite(few["w"]).all()


# 4. pages

PAGE = (
    '<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body><header>no</header>'
    '<nav><ul><li><a href="/">no</a></ul></nav><div class="cookie-notice">no</div><article><header><h1>Head &amp; more</h1></header>'
    '<p><b>First\n  para<br>next &lt;b&gt;<br><p>Second&nbsp;&copy &am</p><div class="ad">no</div><p class="lead">Third</p>'
    '<section id="comments"><p>no</p></section><form><p>no</p></form></article><aside>no</aside><footer>no</footer></body></html>'
)


def test_structure():
    main, _, marked = host_text.read_page(PAGE)
    assert marked and main == ["Head & more", "First para next <b>", "Second © &am", "Third"]
    assert host_text.read_page("<p>a<p>b<div>c</div>tail <broken") == ([], ["a", "b", "c", "tail"], False)
    assert host_text.read_page('<article><p>x <a title="a>b">y</a></p>') == (["x y"], [], True)
    # An element marks the article better than a class; a class does where no element does.
    assert host_text.read_page('<div id="content"><p>a</p><article>b</article></div>') == (["b"], [], True)
    assert host_text.read_page('<p>x</p><div class="post-body"><p>a</p><div class="share">b</div></div>') == (["a"], [], True)


@pytest.mark.parametrize(
    "page",
    [
        '<body class="single no-sidebar"><article><p>a</p></article></body>',
        '<body class="header-fixed"><article><p>a</p></article></body>',
        '<article class="post comments-open"><p>a</p></article>',
        '<main class="main sidebar"><p>a</p></main>',
        '<div id="content" class="has-sidebar"><p>a</p></div>',
        '<div id="content" class="sidebar-left"><p>a</p></div>',
        '<div class="sidebar-left header-top"><nav>no</nav><article><p>a</p></article></div>',
        '<article></article><div id="content"><p>a</p></div>',
        '<article><p>a</p><article class="comment"><p>no</p></article></article>',
        '<article><p>a</p></article><section id="comments"><article class="comment"><p>no</p></article></section>',
        '<svg class="i"/><article><p>a</p></article>',
        '<article><video src=x/><p>a</p></article>',
        '<svg><g><svg><text>no</text></svg><text>no</text></g></svg><article><p>a</p></article>',
        '<article><div><svg><path d="m"></div><p>a</p></article>',
        '<article><section class="discussion"><p>a</p></section></article>',
        '<article><div class="related-work"><p>a</p></div></article>',
        '<article><p>a</p><div class="related"><ul><li><a href="/x">no</a><li><a href="/y">no no</a></ul></div></article>',
        '<article><p>a</p><section class="discussion"><p>no</p><div class="comment">no</div></section></article>',
    ],
)
def test_class_words_lose_no_article(page):
    assert host_text.read_page(page) == (["a"], [], True)


def test_host_repeats_beside_an_article(spark):
    """Text beside a marked article is kept unless it repeats; a repeat inside stays."""
    legal = "all content of this site belongs to somebody else entirely and always"
    page = '<div id="content"><p>before {0} {1}</p><p>Home</p><article><p>own {0}</p><p>{1}</p></article><p>after {0}</p></div>'
    rows = [(i, f"http://a.org/{i}", page.format(i, legal)) for i in range(3)]
    rows.append((9, "http://a.org/9", '<article></article><div class="text"><p>alone</p></div>'))
    got = {r["page_id"]: r["text"] for r in host_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"before {i}\nown {i}\n{legal}\nafter {i}" for i in range(3)} | {9: "alone"}


def test_host_repeats(spark, nothing):
    legal = "all content of this site belongs to somebody else entirely and always"
    rows = [(1, "http://a.org/1", PAGE), (2, None, None), (3, "http://a.org/x", ""), (3, "http://a.org/x", "")]
    for i in range(600):
        body = f"<div><p>Home</p><p>own words of page {i} {'and so on ' * 3}</p><p>start{i} {legal} end{i}</p></div>"
        rows.append((10 + i, f"https://B.org:80/{i}", body))
    rows.append((9000, "https://c.org/", f"<p>{legal}</p>"))
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in host_text.main_texts(pages).collect()}
    assert got[1].split("\n") == ["Head & more", "First para next <b>", "Second © &am", "Third"]
    assert got[2] == got[3] == ""
    assert got[9000] == legal
    for i in (0, 599):
        # The number's neighbours recur, but no run of eight words with it does.
        assert got[10 + i].split("\n")[-1] == f"start{i} end{i}" and "Home" not in got[10 + i].split("\n")
        assert f"of page {i}" in got[10 + i] and legal not in got[10 + i]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert host_text.main_texts(empty).count() == 0


# 5. near duplicates


def shingles(text, k):
    words = WORD.findall(lower(text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def near(texts, k):
    sets = {}
    for i, (d, t) in enumerate(texts):
        sets[i] = shingles(t, k)
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if texts[a][0] is None or texts[b][0] is None:
            continue
        union = len(sets[a] | sets[b])
        if union and 100 * len(sets[a] & sets[b]) >= 80 * union:
            label[find(a)] = find(b)
    smallest = defaultdict(lambda: 10**9)
    for i, (d, _) in enumerate(texts):
        if d is not None:
            smallest[find(i)] = min(smallest[find(i)], d)
    return [(d, len(sets[i]), None if d is None else smallest[find(i)]) for i, (d, _) in enumerate(texts)]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(texts, documents, nothing, k):
    got = near_dedup.near_duplicates(documents, k=k)
    want = near(texts, k)
    # Two rows of id 7 hold one text.
    same([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()], want)
    assert near_dedup.near_duplicates(nothing, k=k).count() == 0
    stay = near_dedup.without_near_duplicates(documents, k=k)
    same([r["doc_id"] for r in stay.collect()], list({d for d, _, c in want if d is not None and d == c}) + [None])
    assert stay.columns == documents.columns


def test_unlike_members_of_a_large_node(spark):
    """Copies with few and with many changes: some link to others only, some to none."""
    import random

    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(90):
        words = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 4, 6, 8, 10])):
            words[at] = f"x{i}.{at}"
        rows.append((i, " ".join(words)))
        if i % 9 == 0:  # shares the changes of the one before
            words[rng.randrange(150)] = "again"
            rows.append((1000 + i, " ".join(words)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4)
    want = near(rows, 4)
    assert len({c for _, _, c in want}) > 5
    same([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()], want)
    ids = spark.createDataFrame(rows, "id long, body string")
    alone = ids.select("id", F.col("id").alias("label"))
    pairs = {(r["a"], r["b"]) for r in near_dedup.pairs_of_rest(ids.select("id"), ids.select("id"), alone, ids, 4, 80).collect()}
    linked = {
        (a, b) for (a, s), (b, t) in itertools.combinations(sorted(rows), 2)
        if 100 * len(shingles(s, 4) & shingles(t, 4)) >= 80 * len(shingles(s, 4) | shingles(t, 4))
    }
    assert linked <= pairs


def test_one_id_with_two_texts(spark):
    """Each text keeps its own links; of each group one document stays."""
    other, base = (" ".join(f"{c}{i}" for i in range(100)) for c in "op")
    rows = [(1, other), (1, base), (2, base + " word"), (3, other + " word"), (4, "alone by itself here now"), (5, other), (5, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = near(rows, 4)
    assert [c for _, _, c in want] == [1, 1, 1, 1, 4, 1, 5]
    same([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame, k=4).collect()], want)
    stay = near_dedup.without_near_duplicates(frame, k=4).collect()
    same([(r["doc_id"], r["text"]) for r in stay], [rows[0], rows[1], rows[4], rows[6]])


def test_planted_pairs_at_the_threshold(spark):
    """A thousand pairs that reach the similarity by little, each of a size of its own; none may be missed."""
    import random

    rng = random.Random(11)
    rows, linked = [], 0
    for i in range(1000):
        n = rng.randrange(40, 120)
        words = [f"p{i}w{j}" for j in range(n)]
        size = n - 3
        # Words put on at the end take no shingle away: the union grows by as many.
        more = int(size * 100 / 80) - size
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words + [f"e{i}.{j}" for j in range(more)]))]
        linked += 100 * size >= 80 * (size + more)
    assert linked == 1000
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k=4).collect()
    assert sum(r["component_id"] != r["doc_id"] for r in got) == 1000


def test_lost_branches_of_large_nodes(spark, monkeypatch):
    """Whatever the levels below the first one lose, groups of more than a small node come out whole."""
    import random

    rng = random.Random(4)
    rows = []
    for group in range(3):
        base = [f"g{group}w{i}" for i in range(120)]
        for i in range(22):
            words = list(base)
            for at in rng.sample(range(120), rng.choice([1, 2, 3])):
                words[at] = f"x{group}.{i}.{at}"
            rows.append((100 * group + i, " ".join(words)))
    every = near_dedup.branches
    lossy = lambda members, similarity, trees: every(members, similarity, trees).where(F.lit(trees > 1))
    monkeypatch.setattr(near_dedup, "branches", lossy)
    # At the first level only what lies in large nodes is left, as for a pair whose nodes are all large.
    monkeypatch.setattr(near_dedup, "pairs_of_small", lambda small, brief, percent: spark.createDataFrame([], "a long, b long"))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4)
    same([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()], near(rows, 4))


# 6. mixing


def test_mixture(spark, texts, documents, nothing):
    db = duckdb.connect()
    db.register("documents", documents.select("doc_id", "text", "source").toArrow())
    columns = ("doc_id", "size", "source_size", "target", "repeats", "taken")
    want = db.execute(f"select {', '.join(columns)} from ({mixing.mixture_sql()})").fetchall()
    got = [tuple(r[c] for c in columns) for r in mixing.mixture(documents).collect()]
    tidy = lambda rows: [(a, b, c, round(d, 6), e, f) for a, b, c, d, e, f in rows]
    same(tidy(got), tidy(want))
    assert all(f <= 3 * b for _, b, _, _, _, f in got)
    assert mixing.mixture(nothing).count() == 0
    mixed = mixing.mixed_documents(documents)
    numbered = documents.withColumn("_row", F.xxhash64(*documents.columns))
    often = mixing.mixture(numbered, id_column="_row").agg(F.sum("repeats")).first()[0]
    assert mixed.count() == often and mixed.columns == documents.columns


def test_empty_documents_take_no_extra(spark):
    rows = [(i, "", "a") for i in range(40)] + [(100, "one two three", "a"), (101, "x " * 50, "b")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture(table).collect()
    assert all(r["repeats"] <= 3 for r in got) and {r["size"] for r in got} == {0, 3, 50}


def test_clamped_sources(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 90)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes, (5.0, 2.0, 1.0), 3.0).collect()}
    # a holds 30 and null (weight 5) 270; the rest goes to b and c by 2 to 1.
    assert got["a"] == 30 and got[None] == 270
    assert abs(got["b"] - 1800 * 2 / 3) < 1e-6 and abs(got["c"] - 600) < 1e-6


# 7. repeated passages


def passages(texts, window=20):
    rows = sorted({(10**18 if d is None else d, t or "") for d, t in texts})
    seen, out = set(), {}
    for d, t in rows:
        words = WORD.findall(t)
        gone = set()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        left = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[d, t] = (len(words), len(gone), hashlib.sha256(left.encode()).hexdigest())
    return [(d, *out[10**18 if d is None else d, t or ""]) for d, t in texts]


def test_passages(texts, documents, nothing):
    got = substring_dedup.passage_digest(documents)
    same(by_id(got, "doc_id", "n_words", "n_removed", "kept_sha256"), passages(texts))
    assert substring_dedup.passage_digest(nothing).count() == 0
    left = substring_dedup.without_repeats(documents)
    assert left.columns == documents.columns and left.count() == len(texts)


# 8. licences


def notices(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    places = []
    for label, phrase in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")):
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places}))


def test_licences(spark, texts, nothing):
    cases = [
        *texts, (500, "x MIT\nLicense, and the Apache-License! mit license"), (501, "GNU General  Public (License) é"),
        (502, "Relased under the MIT Licence."), (503, "Permision is hereby granted, free of charge, to any persn obtaining a copy"),
        (504, "mit"), (505, "license mit general public"), (506, "Licensed under the Apache Licence, Version 2.0"),
    ]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in cases], "doc_id long, text string, labels string")
    found = license_scan.license_notices(docs)
    got = {(r["doc_id"], r["n_words"]): r for r in license_scan.license_digest(found).collect()}
    for d, t in cases:
        n, *rest = notices(t)
        r = got[d, n]
        assert [r[c] for c in ("n_base", "first_word", "last_word", "base_labels")] == rest
        assert set(filter(None, rest[3].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    by_doc = {r["doc_id"]: r for r in got.values()}
    assert by_doc[502]["labels"] == by_doc[503]["labels"] == "mit" and by_doc[506]["labels"] == "apache"
    assert 0.8 < by_doc[502]["score"] < 1 and by_doc[505]["labels"] == ""
    span = next(r["spans"] for r in found.collect() if r["doc_id"] == 502)[0]
    assert (span["first_word"], span["end_word"]) == (0, 5) and span["errors"] == 2
    assert license_scan.license_notices(nothing).count() == 0


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_seeds_meet_every_match(edits):
    """Pigeonhole: any passage within the allowed errors is found."""
    import random

    rng = random.Random(edits)
    one = license_scan.Notice("x", "released under the mit license", 10)
    for _ in range(60):
        s = list(one.text)
        for _ in range(edits):
            i = rng.randrange(len(s))
            s[i : i + rng.randrange(2)] = rng.choice([["q"], [], ["z"]])
        assert one.spans(("word " + "".join(s) + " other\n").encode()), "".join(s)


@pytest.mark.parametrize("gap", [" ", " and ", " x ", " some more words between them "])
def test_notices_close_together(gap):
    """A worse match beside a better one, and many of them, are all found."""
    one = license_scan.Notice("x", "released under the mit license", 10)
    good, bad, worse = one.text, "released under the mit licence", "relased under the mit licence"
    for texts in ([bad, good], [good, bad], [worse, bad, good, bad, worse], [bad] * 40, [good] * 5, [worse, good, worse]):
        text = ("a " + gap.join(texts) + " z\n").encode()
        got = one.spans(text)
        assert len(got) == len(texts), texts
        assert [e for _, _, e in got] == [{good: 0, bad: 1, worse: 2}[x] for x in texts]
        starts = [2 + sum(len(x) + len(gap) for x in texts[:i]) for i in range(len(texts))]
        assert all(abs(a - s) <= 1 for (a, _, _), s in zip(got, starts))
    assert len(one.spans(f"{good}\n{bad}\n{good}\n".encode())) == 3


# 9. quality rules


def rules(text):
    text = text or ""
    w = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    starts = [i for v in at.values() if len(v) > 1 for i in v]
    covered = {i + j for i in starts for j in range(8)}
    longest = 0
    for v in at.values():
        for a, b in itertools.combinations(v, 2):
            n = 8
            while b + n < len(w) and w[a + n] == w[b + n]:
                n += 1
            longest = max(longest, n)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed, longest


def test_rules(spark, texts, nothing):
    cases = [*texts, (600, "a b c d\n" * 30), (601, "p q r s t u v w x y\n" * 3 + " ".join(f"n{i}" for i in range(400))), (602, "k\r\nk\r\n k\n" + "ab " * 9)]
    docs = spark.createDataFrame([(d, t, 5) for d, t in cases], "doc_id long, text string, kept int")
    got = by_id(
        repetition.quality_rules(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "longest_repeat", "kept"
    )
    same([g[:-1] for g in got], [(d, *rules(t)) for d, t in cases])
    assert all(not (failed and kept) for *_, failed, _, kept in got)
    assert {g[0]: g[-1] for g in got}[601] and repetition.quality_rules(nothing).count() == 0


# 10. pieces


def test_pieces(spark, texts, documents, nothing):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    one = sentencepiece.SentencePieceProcessor(model_file=path)
    cases = [*texts, (700, "  two  blanks \n\t tab\0zero 🦀🦀 <s> </s> <0x41> ﬁne"), (701, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab" * 30)]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in cases], "doc_id long, text string, ids string")
    encoded = pieces.encode_pieces(docs, path)
    got = [(r["doc_id"], np.frombuffer(r["ids"], np.uint32).tolist()) for r in encoded.collect()]
    same([g for g in got if g[0] != 700], [(d, one.encode(t or "")) for d, t in cases if d != 700])
    same([tuple(r) for r in pieces.decode_pieces(encoded, path).collect()], [(d, t or "") for d, t in cases])
    checked = pieces.round_trips(docs, path).collect()
    assert all(r["round_trip"] for r in checked)
    assert pieces.round_trips(nothing, path).count() == 0


def test_zero_beside_private_characters(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = pieces.Model(path)
    text = "a\0b\ue000\ue000c\U000f0000d"
    want = [y for x in (b"a", b"\0", b"b", "\ue000\ue000".encode(), b"c", "\U000f0000".encode(), b"d") for y in x]
    (row,) = model.encode([text])
    assert [b for i in row for b in model.raw[model.raw_at[i] : model.raw_at[i] + model.raw_size[i]].tolist()] == want
    docs = spark.createDataFrame([(1, text), (2, "\0"), (3, " \0 \0\0")], "doc_id long, text string")
    assert all(r["round_trip"] for r in pieces.round_trips(docs, path).collect())


def test_full_memo_keeps_chunks_met_again(monkeypatch):
    from lexispan.llm import textbatch as T
    from lexispan.llm import token_files as K

    monkeypatch.setattr(K, "MEMO", 20)
    asked = []

    def encode(chunks):
        asked.extend(chunks)
        return [[len(c), *c.encode()] for c in chunks]

    memo = K.Memo(encode)
    for turn in range(12):
        chunks = ["often", "twice", *(f"n{turn}x{i}" for i in range(7)), "often"]
        ends = np.cumsum([len(c) for c in chunks])
        data = np.frombuffer("".join(chunks).encode(), np.uint8)
        ids, sizes = memo.look_up(data, ends - [len(c) for c in chunks], ends)
        want = [[len(c), *c.encode()] for c in chunks]
        assert ids.tolist() == [x for w in want for x in w] and sizes.tolist() == [len(w) for w in want]
        assert len(memo.keys) <= 20 + 9 and (np.diff(memo.keys.astype(object)) > 0).all()
    assert asked.count("often") == 1 and T.hashes(data, ends - 1, ends).size == len(chunks)


def test_the_centre_of_a_node_is_the_member_most_like_the_others(spark):
    rows = []
    for i in range(12):
        tokens = bytearray(near_dedup.TOKENS)
        if i != 5:
            # Each differs from member 5 in bytes of its own, so two of them are less alike than either and 5.
            tokens[5 * i % 60 : 5 * i % 60 + 4] = bytes([i + 1] * 4)
        rows.append((i, 100, bytes(tokens)))
    brief = spark.createDataFrame(rows, "id long, n long, brief binary")
    nodes = spark.createDataFrame([(node, i) for node in (1, 2) for i in range(12)] + [(3, 4)], "node long, id long")
    got = {r.node: r.centre for r in near_dedup.centres(nodes, brief).collect()}
    assert got == {1: 5, 2: 5, 3: 4}
