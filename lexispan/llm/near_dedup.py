"""Near-duplicate documents by chosen-path set similarity join.

A document is the set of hashes of its runs of ``k`` words. Equal sets become
one class at once, with a number of its own, and only classes go on. Each class
has ``TOKENS`` minwise tokens. ``TREES`` independent trees hand a class down one
branch for every token whose hash, drawn anew for each tree, is below
1 / (similarity * TOKENS). Two classes at the threshold share about one branch
of each tree on the average, others fewer, so nodes mostly hold alike members,
and the trees bring two classes at the threshold together with a chance of over
0.999999.

A node of at most ``SMALL`` members is compared exhaustively. A larger one holds
copies of one text, or texts with one common phrase. Members are compared with the
centre of their ``STARS`` largest nodes, and components are made. Members outside
the commonest component of a node are compared with the centre of that component,
in each of their nodes (see ``centres``). Members in that component need no
further link there, and members with ``ENOUGH`` nodes that are not large have met their partners in
these. Every other member meets all members of its nodes exactly, on rare
shingles (see ``pairs_of_rest``). There the recursion ends: copies are never
expanded into pairs, and no further chance enters.

Comparisons use one byte of each token and leave a margin: a pair at the
threshold is passed over with a chance of 1e-6. Every link is confirmed on the
full sets made from the whole texts.

Null, empty and blank texts have empty sets and are linked with nothing.
Repeated rows are linked as equal sets; rows with one id and different texts are
documents of their own that may lie in different components. Rows without a
document id are returned, linked with nothing. Ties of ids cannot change a
component's label, which is its smallest id. Long texts are read whole, in
slices. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import textbatch as T
from .components import components

TOKENS = 64
TREES = 16
SMALL = 16
#: Standard deviations that an estimate may lie below the threshold; by the binomial distribution, 1e-6 of the pairs at it lie lower.
MARGIN = 5.5
#: Large nodes in which a member is compared with one other before the exact step.
STARS = 4
#: Nodes that are not large and still miss every partner at the threshold with a chance of 0.2 ** 9, or 5e-7.
ENOUGH = 9
#: Ratio of set sizes that share a key among the rest of large nodes.
STEP = 1.02

_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(0, 1 << 63, TOKENS, dtype=np.int64).astype(T.U64) * T.U64(2) + T.U64(1)
_SALTS = T.mix(_rng.integers(0, 1 << 63, TOKENS, dtype=np.int64).astype(T.U64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their rows, in row order."""
    n = len(offsets) - 1
    low = T.LOWER[data]
    starts, ends, rows = T.words(low, offsets)
    values = T.hashes(low, starts, ends)
    found, at = T.grams(values, rows, k)
    parts, of = [found], [rows[at]]
    counts = T.per_row(rows, n)
    for few in range(1, k):
        short = (counts == few)[rows]
        if short.any():
            whole, at = T.grams(values[short], rows[short], few)
            parts.append(whole)
            of.append(rows[short][at])
    found, of = np.concatenate(parts), np.concatenate(of)
    first = np.unique(T.mix(found ^ T.mix(of.astype(T.U64) + T.U64(3))), return_index=True)[1]
    first = first[np.argsort(of[first], kind="stable")]
    return found[first], of[first]


def sketch_slice(data: np.ndarray, offsets: np.ndarray, k: int):
    """Set size, two digests of the set, and minwise tokens of every row."""
    n = len(offsets) - 1
    found, of = shingle_sets(data, offsets, k)
    size = T.per_row(of, n)
    tokens = np.zeros((n, TOKENS), np.uint32)
    digest = np.zeros((2, n), T.U64)
    full = np.flatnonzero(size)
    if len(full):
        at = (np.cumsum(size) - size)[full]
        digest[0, full] = np.add.reduceat(T.mix(found), at)
        digest[1, full] = np.add.reduceat(T.mix(found ^ T.U64(0x5851F42D4C957F2D)), at)
        for i in range(TOKENS):
            tokens[full, i] = np.minimum.reduceat(((found * _FACTORS[i]) >> T.U64(32)).astype(np.uint32), at)
    return size, digest[0].astype(np.int64), digest[1].astype(np.int64), tokens


def sketches(documents: DataFrame, k: int, id_column="doc_id", text_column="text") -> DataFrame:
    fields = {"doc_id": pa.int64(), "body_hash": pa.int64(), "n_shingles": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "tokens": pa.binary()}

    def sketch(found):
        for batch in found:
            parts = {name: [] for name in fields}
            for low, high, data, offsets in T.slices(batch.column(1)):
                size, d1, d2, tokens = sketch_slice(data, offsets, k)
                own = (batch.column(c).slice(low, high - low) for c in (0, 2))
                row = (*own, size, d1, d2, T.binary(tokens.reshape(-1), np.full(len(size), TOKENS)))
                for name, values in zip(fields, row):
                    parts[name].append(values)
            yield T.batches(fields, parts)

    rows = documents.select(id_column, text_column, F.xxhash64(text_column))
    return rows.mapInArrow(sketch, "doc_id long, body_hash long, n_shingles long, d1 long, d2 long, tokens binary")


def token_matrix(column: pa.Array, kind=np.uint32) -> np.ndarray:
    from .token_files import flat

    return flat(column, kind).reshape(-1, TOKENS)


def branches(members: DataFrame, similarity: float, trees: int) -> DataFrame:
    """Children of every (node, id, tokens): the branches that the member is handed down, and how many these are."""
    bar = T.U64(int(2.0**64 / (similarity * TOKENS)))

    def branch(found):
        for batch in found:
            node = np.asarray(batch.column(0)).astype(T.U64)
            ids = np.asarray(batch.column(1))
            base = T.mix(token_matrix(batch.column(2)).astype(T.U64) ^ _SALTS)
            rows, nodes = [], []
            for tree in range(trees):
                drawn = T.mix(base ^ T.mix(node + T.U64(tree) * T.U64(0x9E3779B97F4A7C15))[:, None])
                row, token = np.nonzero(drawn < bar)
                rows.append(row)
                nodes.append(T.mix(drawn[row, token]).astype(np.int64))
            total = np.bincount(np.concatenate(rows), minlength=len(ids))
            for row, below in zip(rows, nodes):
                yield pa.RecordBatch.from_arrays([pa.array(below), pa.array(ids[row]), pa.array(total[row])], ["node", "id", "total"])

    return members.select("node", "id", "tokens").mapInArrow(branch, "node long, id long, total long")


def crowded(rows: DataFrame) -> DataFrame:
    """Rows of nodes with two members or more, with the number of these."""
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return materialize(rows.join(sizes, "node"), tidy=True)


def leaves(members: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(node, id) of small nodes, and (node, id, size, total) of large ones."""
    alive = crowded(branches(members.withColumn("node", F.lit(0).cast("long")), similarity, TREES))
    return alive.where(F.col("size") <= SMALL).select("node", "id"), alive.where(F.col("size") > SMALL)


def hardly_compared(large: DataFrame) -> DataFrame:
    """id of members with fewer than ``ENOUGH`` nodes that are not large, a node of its own included."""
    counted = large.groupBy("id").agg(F.count(F.lit(1)).alias("n_large"), F.max("total").alias("total"))
    return counted.where(F.col("total") - F.col("n_large") < ENOUGH).select("id")


def least_alike(similarity: float) -> float:
    """Share of equal token bytes that a pair must have to be confirmed."""
    chance = similarity + (1 - similarity) / 256
    return chance - MARGIN * (chance * (1 - chance) / TOKENS) ** 0.5


def fits(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether two set sizes allow the similarity."""
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def pairs_of_small(small: DataFrame, brief: DataFrame, percent: int) -> DataFrame:
    """All pairs of every small node that look alike."""
    nodes = small.join(brief, "id").groupBy("node").agg(F.collect_list(F.struct("id", "n", "brief")).alias("members"))
    bar = least_alike(percent / 100)

    def compare(found):
        for batch in found:
            lists = batch.column(0)
            members = lists.flatten()
            ids, n = (np.asarray(members.field(i)) for i in (0, 1))
            tokens = token_matrix(members.field(2), np.uint8)
            node = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
            low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for step in range(1, SMALL):
                a = np.flatnonzero(node[:-step] == node[step:]) if step < len(node) else np.zeros(0, np.int64)
                a = a[fits(n[a], n[a + step], percent) & (ids[a] != ids[a + step])]
                if not len(a):
                    continue
                a = a[(tokens[a] == tokens[a + step]).mean(axis=1) >= bar]
                low.append(np.minimum(ids[a], ids[a + step]))
                high.append(np.maximum(ids[a], ids[a + step]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(low)), pa.array(np.concatenate(high))], ["a", "b"])

    return nodes.select("members").mapInArrow(compare, "a long, b long").distinct()


def alike(pairs: DataFrame, brief: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that look alike."""
    bar = least_alike(percent / 100)
    joined = pairs.join(brief.toDF("a", "n_a", "brief_a"), "a").join(brief.toDF("b", "n_b", "brief_b"), "b")

    def compare(found):
        for batch in found:
            n = [np.asarray(batch.column(i)) for i in (2, 3)]
            same = (token_matrix(batch.column(4), np.uint8) == token_matrix(batch.column(5), np.uint8)).mean(axis=1)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(fits(*n, percent) & (same >= bar)))

    return joined.select("a", "b", "n_a", "n_b", "brief_a", "brief_b").mapInArrow(compare, "a long, b long")


def centres(members: DataFrame, brief: DataFrame) -> DataFrame:
    """(node, centre): of ``SMALL`` members of a node drawn by hash, the one most like the others.

    What stands in the middle of a group is linked with more of it than a member
    drawn blindly. This only saves work: whom it leaves unlinked goes on.
    """
    order = Window.partitionBy("node").orderBy(F.xxhash64("node", "id"), "id")
    drawn = members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SMALL).select("node", "id")
    nodes = drawn.join(brief, "id").groupBy("node").agg(F.collect_list(F.struct("id", "brief")).alias("members"))

    def middle(found):
        for batch in found:
            lists = batch.column(1)
            flat = lists.flatten()
            ids, tokens = np.asarray(flat.field(0)), token_matrix(flat.field(1), np.uint8)
            at = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
            likeness = np.zeros(len(ids), np.int64)
            for step in range(1, min(SMALL, len(ids))):
                a = np.flatnonzero(at[:-step] == at[step:])
                same = (tokens[a] == tokens[a + step]).sum(axis=1)
                likeness[a] += same
                likeness[a + step] += same
            best = np.lexsort((ids, -likeness, at))
            best = best[np.unique(at[best], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[best])), pa.array(ids[best])], ["node", "centre"])

    return nodes.select("node", "members").mapInArrow(middle, "node long, centre long")


def star_pairs(large: DataFrame, brief: DataFrame) -> DataFrame:
    """Every member with the centre of each of its ``STARS`` largest nodes."""
    order = Window.partitionBy("id").orderBy(F.desc("size"), "node")
    largest = large.withColumn("place", F.row_number().over(order)).where(F.col("place") <= STARS)
    return (
        largest.join(centres(large.select("node", "id"), brief), "node").where("id <> centre")
        .select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    )


def by_component(large: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, id, label, main) of large nodes with more than one component; ``main`` is the commonest."""
    named = large.select("node", "id").join(labels, "id", "left").select("node", "id", F.coalesce("label", "id").alias("label"))
    counted = named.groupBy("node", "label").agg(F.count(F.lit(1)).alias("c"))
    most = counted.groupBy("node").agg(F.max(F.struct("c", "label")).alias("m"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    return named.join(most.select("node", F.col("m.label").alias("main")), "node")


def main_pairs(large: DataFrame, labels: DataFrame, brief: DataFrame) -> DataFrame:
    """Members outside the commonest component, hardly compared elsewhere, with the centre of it in each of their nodes."""
    mixed = materialize(by_component(large, labels), tidy=True)
    middle = centres(mixed.where("label = main").select("node", "id"), brief)
    rest = mixed.where("label <> main").join(hardly_compared(large), "id", "left_semi").select("node", "id")
    return rest.join(middle, "node").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def outside_main(large: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members that are outside a large node's commonest component and hardly compared elsewhere, and all members of the nodes of these."""
    mixed = by_component(large, labels)
    rest = materialize(mixed.where("label <> main").join(hardly_compared(large), "id", "left_semi").select("node", "id"), tidy=True)
    beside = large.select("node", "id").join(rest.select("node").distinct(), "node", "left_semi")
    return rest.select("id").distinct(), materialize(beside.select("id").distinct(), tidy=True)


def shingle_rows(texts: DataFrame, wide: DataFrame, k: int) -> DataFrame:
    """One row for each shingle (id, h) of the members of ``wide``, with the number of these of the member."""

    def explode(found):
        for batch in found:
            for low, high, data, offsets in T.slices(batch.column(1)):
                hashes, of = shingle_sets(data, offsets, k)
                ids = np.asarray(batch.column(0).slice(low, high - low))
                sizes = T.per_row(of, high - low)
                yield pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(hashes.astype(np.int64)), pa.array(sizes[of].astype(np.int64))], ["id", "h", "n"])

    return texts.join(wide, "id", "left_semi").select("id", "body").mapInArrow(explode, "id long, h long, n long")


def pairs_of_rest(wide: DataFrame, rest: DataFrame, labels: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs of a member of ``rest`` with one of ``wide`` in another component that may reach the similarity.

    Two sets of n and m members that reach it share at least s of them, so with
    all members in one order, rarest first, the first n - s + 1 of the one and
    the first m - s + 1 of the other have one in common. What sets a copy apart
    is rare, so copies of one text do not meet on what they all share. Sizes go
    into the key, in steps of ``STEP``, because s depends on both.
    """

    def needed(n, m):
        return F.ceil(percent * (n + m) / (100.0 + percent) - 1e-9)

    # Only what members of the rest hold can be shared with them; other shingles come first in the order, and their number is enough.
    held = shingle_rows(texts, rest, k).select("h").distinct()
    rows = materialize(shingle_rows(texts, wide, k).join(held, "h", "left_semi"), tidy=True)
    common = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ordered = rows.join(common, "h").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("s"))
    n, step = F.col("n"), float(np.log(STEP))
    first = n - F.ceil(n * percent / 100.0 - 1e-9) + 1
    alone = n - F.size("s")
    heads = materialize(
        ordered.where(first > alone)
        .select("id", "n", alone.alias("alone"), F.posexplode(F.slice("s", F.lit(1), (first - alone).cast("int"))).alias("at", "e"))
        .select("id", "n", (F.col("alone") + F.col("at")).alias("at"), F.col("e.h").alias("h"))
        .join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    )
    bucket = lambda size: F.floor(F.log(size.cast("double")) / step)
    least = F.ceil(n * percent / 100.0 - 1e-9)
    smallest = F.greatest(least, F.floor(F.exp(F.col("bucket") * step)))
    asking = heads.join(rest, "id", "left_semi").withColumn(
        "bucket", F.explode(F.sequence(bucket(least), bucket(F.floor(n * 100.0 / percent + 1e-9))))
    ).where(F.col("at") < n - needed(n, smallest) + 1)
    held = heads.select("h", F.col("id").alias("other"), F.col("n").alias("m"), F.col("at").alias("there"), F.col("label").alias("other_label"), bucket(n).alias("bucket"))
    share = needed(n, F.col("m"))
    return (
        asking.join(held, ["h", "bucket"])
        .where((F.col("label") != F.col("other_label")) & (F.col("at") < n - share + 1) & (F.col("there") < F.col("m") - share + 1))
        .select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    )


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough. ``texts`` has id and body."""
    joined = pairs.join(texts.toDF("b", "body_b"), "b").join(texts.toDF("a", "body_a"), "a")

    def confirm(found):
        for batch in found:
            n = batch.num_rows
            both = pa.concat_arrays([T.column(batch.column(2)), T.column(batch.column(3))])
            turn = np.arange(2 * n).reshape(2, n).T.reshape(-1)
            keep = np.zeros(n, bool)
            for low, high, data, offsets in T.slices(both.take(pa.array(turn)), T.SLICE_BYTES, 2):
                found_hashes, of = shingle_sets(data, offsets, k)
                size = T.per_row(of, high - low)
                pair = of // 2
                key, first, count = np.unique(T.mix(found_hashes ^ T.mix(pair.astype(T.U64) + T.U64(9))), return_index=True, return_counts=True)
                shared = T.per_row(pair[first[count > 1]], (high - low) // 2)
                union = size[0::2] + size[1::2] - shared
                keep[low // 2 : high // 2] = (100 * shared >= percent * union) & (union > 0)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep))

    return joined.select("a", "b", "body_a", "body_b").mapInArrow(confirm, "a long, b long")


def labelled(documents: DataFrame, k: int, percent: int, id_column="doc_id", text_column="text") -> DataFrame:
    """Every row with a hash of its text, its set's size, its component, and whether it stands for the component."""
    found = materialize(sketches(documents, k, id_column, text_column))
    key = ["n_shingles", "d1", "d2"]
    usable = found.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # One text of each class stands for it; the number is fixed by writing it.
    stands = F.min(F.struct("doc_id", "body_hash")).alias("rep")
    classes = usable.groupBy(*key).agg(stands, F.any_value("tokens").alias("tokens")).withColumn("id", F.monotonically_increasing_id())
    classes = materialize(classes.select(*key, "id", "rep.doc_id", "rep.body_hash", "tokens"))
    brief = materialize(classes.select("id", F.col("n_shingles").alias("n"), low_bytes(F.col("tokens")).alias("brief")))
    small, large = leaves(classes.select("id", "tokens"), percent / 100)
    first = materialize(pairs_of_small(small, brief, percent).unionByName(alike(star_pairs(large, brief), brief, percent)).distinct(), tidy=True)
    asked = first.select(F.col("a").alias("id")).union(first.select("b")).union(large.select("id")).distinct()
    wanted = classes.select("id", "doc_id", "body_hash").join(asked, "id").hint("merge")
    bodies = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("body"), F.xxhash64(text_column).alias("body_hash"))
    # Merged at every size: how many are asked for has no bound.
    texts = bodies.join(wanted, ["doc_id", "body_hash"]).select("id", "body").dropDuplicates(["id"])
    texts = materialize(texts, compression="zstd", tidy=True)
    links = materialize(confirmed(first, texts, k, percent), tidy=True)
    labels = components(links)
    tested = first
    again = alike(main_pairs(large, labels, brief).join(tested, ["a", "b"], "left_anti"), brief, percent)
    again = materialize(again, tidy=True)
    if not again.isEmpty():
        tested = tested.unionByName(again)
        links = materialize(links.unionByName(confirmed(again, texts, k, percent)), tidy=True)
        labels = components(links)
    rest, beside = outside_main(large, labels)
    if not rest.isEmpty():
        # Members of one prefix already look alike, so these go to the full sets at once.
        more = pairs_of_rest(beside, rest, labels, texts, k, percent).join(tested, ["a", "b"], "left_anti")
        more = materialize(more, tidy=True)
        if not more.isEmpty():
            links = materialize(links.unionByName(confirmed(more, texts, k, percent)), tidy=True)
            labels = components(links)
    ends = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("n_confirmed_links"))
    own = materialize(classes.join(labels, "id", "left").select(*key, "id", "doc_id", "body_hash", F.coalesce("label", "id").alias("label")))
    least = own.groupBy("label").agg(F.min(F.struct("doc_id", "body_hash")).alias("least"))
    named = own.join(least, "label").join(ends, "id", "left").select(
        *[F.col(c).alias(f"_{c}") for c in key], F.col("least.doc_id").alias("component"), F.col("least.body_hash").alias("component_body"),
        F.coalesce("n_confirmed_links", F.lit(0)).alias("n_confirmed_links"),
    )
    rows = found.drop("tokens").join(named, [F.col(c) == F.col(f"_{c}") for c in key], "left")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(linked, F.col("component")).otherwise(F.col("doc_id"))
    first = F.when(linked, (F.col("doc_id") == F.col("component")) & (F.col("body_hash") == F.col("component_body"))).otherwise(F.lit(True))
    return rows.select(
        "doc_id", "body_hash", "n_shingles", component.alias("component_id"), F.coalesce("n_confirmed_links", F.lit(0)).alias("n_confirmed_links"), first.alias("stands")
    )


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80, id_column="doc_id", text_column="text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept and n_confirmed_links of every row.

    The last are the links between classes of equal sets that were found and
    confirmed: enough for all components, not all there are.
    """
    rows = labelled(documents, k, percent, id_column, text_column)
    return rows.select("doc_id", "n_shingles", "component_id", "n_confirmed_links", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80, id_column="doc_id", text_column="text") -> DataFrame:
    """One document of every component, the one with the smallest id; rows that repeat it go as well.

    Rows without id stay. Documents with one id and different texts count apart.
    """
    stand = labelled(documents, k, percent, id_column, text_column).where("stands and doc_id is not null")
    stand = stand.select(F.col("doc_id").alias("_id"), F.col("body_hash").alias("_body")).distinct()
    rows = documents.where(F.col(id_column).isNotNull()).withColumn("_hash", F.xxhash64(text_column))
    stay = rows.join(stand, (F.col(id_column) == F.col("_id")) & (F.col("_hash") == F.col("_body")), "left_semi").dropDuplicates([id_column, "_hash"]).drop("_hash")
    return stay.unionByName(documents.where(F.col(id_column).isNull()))


def low_bytes(tokens):
    """Every fourth byte: the low byte of each token."""
    return F.unhex(F.regexp_replace(F.hex(tokens), "(..)......", "$1"))
