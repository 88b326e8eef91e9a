"""Document fingerprints by winnowing, with DataFrame functions only.

A text becomes pieces of at most ``PIECE`` characters, cut anew at each white
space, so a change moves no piece of another word. Where ``RUN`` characters or
more before a character, or behind it, have no white space (Chinese, Thai,
code, base64), a piece begins at every character, so an inserted character
moves no later piece there either. ``k`` pieces in a row have a rolling
(polynomial) hash. Of every ``window`` hashes in a row the smallest is chosen,
of equal ones the rightmost, and the chosen ones are kept with their positions.
Two texts that share ``k + window - 1`` pieces in a row share a chosen hash, at
the same place of the shared run.

A chosen hash and its position are one long: the hash above, the position,
counted down, below; so the smallest long is the smallest hash and of equal
ones the rightmost. Texts of fewer than ``k`` pieces have one hash of all of
them; null, empty and blank texts have none. Equal texts have equal
fingerprints. Two texts without hashes are alike. Rows that repeat a document
are rows of their own, texts of any length are read whole, columns other than
the two named are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = 4
#: Characters without white space that make a run longer than usual words.
RUN = 24
K = 5
WINDOW = 6
#: Modulus and base of the rolling hash; products stay below 2**62.
PRIME = 2147483647
BASE = 1000003
LOW = 4294967295
#: Documents of a block of neighbours, on the average.
BLOCK = 256
#: Quantiles of doc_id that blocks are cut at: COARSE times COARSE at most.
COARSE = 64


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rolled(values: list[Column]) -> Column:
    total = values[0]
    for v in values[1:]:
        total = (total * F.lit(BASE) + v) % F.lit(PRIME)
    return total


def piece_pattern(piece: int = PIECE, run: int = RUN) -> str:
    """Pieces are group 1; what is taken, one character in a long run and else the piece, tells where the next one begins."""
    inside = r"[^\x20\x09-\x0D]"
    return rf"(?=({inside}{{1,{piece}}}))(?:(?:(?<={inside}{{{run}}})|(?={inside}{{{run + 1}}})){inside}|\1)"


def gram_hashes(text: Column, k: int = K, piece: int = PIECE) -> Column:
    """Rolling hashes of k pieces in a row."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(piece_pattern(piece)), F.lit(1))
    values = F.transform(pieces, lambda p: F.pmod(F.xxhash64(p), F.lit(PRIME).cast("long")))
    none = F.array().cast("array<bigint>")

    def hashes(v):
        n = F.size(v)
        every = F.transform(F.sequence(F.lit(0), n - k), lambda i: rolled([F.get(v, i + j) for j in range(k)]))
        whole = F.array(F.aggregate(v, F.lit(0).cast("long"), lambda a, x: (a * F.lit(BASE) + x) % F.lit(PRIME)))
        return F.when(n >= k, every).when(n > 0, whole).otherwise(none)

    return let(values, hashes)


def winnow(text: Column, k: int = K, window: int = WINDOW, piece: int = PIECE) -> Column:
    """Chosen hashes with positions, as longs, in the order of their positions."""
    packed = let(gram_hashes(text, k, piece), lambda g: F.transform(g, lambda h, i: h * F.lit(LOW + 1) + (F.lit(LOW) - i)))

    def minima(c):
        n = F.size(c)
        every = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.least(*[F.get(c, i + j) for j in range(window)]))
        return F.when(n >= window, every).when(n > 0, F.array(F.array_min(c))).otherwise(c)

    return F.array_distinct(let(packed, minima))


def hashes(marks: Column) -> Column:
    """Distinct chosen hashes."""
    return F.array_distinct(F.transform(marks, lambda m: F.shiftright(m, 32)))


def positions(marks: Column) -> Column:
    """Positions of the chosen hashes: the number of the first piece of each."""
    return F.transform(marks, lambda m: F.lit(LOW) - m.bitwiseAND(F.lit(LOW)))


def likeness(a: Column, b: Column) -> Column:
    """Twice the number of common hashes, by the number of hashes of both: 0 to 1."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def digest(marks: Column) -> Column:
    """Chosen hashes and positions in 64 hexadecimal digits."""
    return F.sha2(F.array_join(marks.cast("array<string>"), ","), 256)


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows of (doc_id, body) with key, spot and block: blocks of neighbours, rising with key, then with spot.

    doc_id is cut at quantiles, COARSE squared at most, and evenly between two
    of them where a part has more than BLOCK rows; so ids far off widen only
    the part they are in. Rows without doc_id have blocks below zero, dealt by
    a hash of the text, ``spot``.
    """
    n, every, last = rows.agg(F.count("doc_id"), F.count(F.lit(1)), F.max("doc_id")).first()
    parts = min(COARSE * COARSE, n // BLOCK + 1)
    found = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(parts)], 4 * COARSE * COARSE)).first()[0] if n else [0]
    bounds = sorted(set(found)) + [(last or 0) + 1]
    coarse, fine = F.array(*map(F.lit, bounds[:-1:COARSE])), F.array(*[F.lit(b).cast("long") for b in bounds])
    cuts = n // (BLOCK * (len(bounds) - 1)) + 1
    none_blocks = min((every - n) // BLOCK + 1, 1 << 24)

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= F.col("doc_id")))

    keyed = rows.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn(
        "spot", F.when(F.col("doc_id").isNull(), F.xxhash64("body")).otherwise(F.lit(0).cast("long"))
    )
    # The part of an id: steps of COARSE bounds first, then the bounds of that step.
    stepped = keyed.withColumn("_step", F.greatest(below(coarse) - 1, F.lit(0)) * COARSE)
    inside = F.greatest(below(F.slice(fine, F.col("_step") + 1, F.least(F.lit(COARSE), F.lit(len(bounds) - 1) - F.col("_step")))) - 1, F.lit(0))
    parted = stepped.withColumn("_part", F.col("_step") + inside)
    low, high = (F.get(fine, F.col("_part") + i).cast("double") for i in (0, 1))
    cut = F.least(F.floor((F.col("doc_id").cast("double") - low) / (high - low) * cuts), F.lit(cuts - 1))
    nowhere = F.floor((F.shiftright("spot", 39) + (1 << 24)).cast("double") * none_blocks / (1 << 25)) - none_blocks
    block = F.when(F.col("doc_id").isNull(), nowhere).otherwise(F.col("_part") * F.lit(cuts) + F.greatest(cut, F.lit(0)))
    return parted.withColumn("block", block.cast("long")).drop("_step", "_part")


def with_next(rows: DataFrame) -> DataFrame:
    """Rows of (doc_id, body) in blocks of neighbours, each block followed by the row that comes next.

    Order is descending doc_id, then text; rows without doc_id come last, in
    the order of a hash of their texts, and the first row follows the last one.
    Returns doc_id, body, key, spot, block and ghost, which marks the row that
    is only there to follow; (ghost, key and spot descending, body) is the
    order in a block.
    """
    keyed = in_blocks(rows)
    heads = keyed.groupBy("block").agg(F.max(F.struct("key", "spot")).alias("head"))
    # The next higher block, by groups of blocks, so that no task sees all of them.
    group = F.floor(F.col("block") / 4096)
    rising = Window.partitionBy("group").orderBy("block")
    grouped = heads.withColumn("group", group).withColumn("above", F.lead("block").over(rising))
    groups = grouped.groupBy("group").agg(F.min("block").alias("lowest"))
    over = Window.orderBy("group")
    ring = groups.select(
        "group", F.coalesce(F.lead("lowest").over(over), F.first("lowest").over(over)).alias("after")
    )
    targets = grouped.join(ring, "group").select(
        F.col("head.key").alias("head"), F.col("head.spot").alias("head_spot"), F.coalesce("above", "after").alias("to"), F.col("block").alias("from")
    )
    first = Window.partitionBy("from").orderBy("body")
    ghosts = (
        keyed.join(targets, (F.col("key") == F.col("head")) & (F.col("spot") == F.col("head_spot")))
        .withColumn("_turn", F.row_number().over(first)).where("_turn = 1")
        .select("doc_id", "body", "key", "spot", F.col("to").alias("block"), F.lit(True).alias("ghost"))
    )
    return keyed.withColumn("ghost", F.lit(False)).unionByName(ghosts)


def fingerprints(documents: DataFrame, id_column="doc_id", text_column="text") -> DataFrame:
    """doc_id, body and marks of every text."""
    return documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("body")).withColumn("marks", winnow(F.col("body")))


def edit_test(documents: DataFrame, id_column="doc_id", text_column="text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third comes from the next text."""
    rows = documents.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("body"))
    dealt = with_next(rows).repartition("block").withColumn("marks", winnow(F.col("body")))
    after = Window.partitionBy("block").orderBy("ghost", F.col("key").desc(), F.col("spot").desc(), "body")
    placed = dealt.select(
        "doc_id", "body", "ghost", "marks", F.lead("body").over(after).alias("next_body"), F.lead("marks").over(after).alias("next_marks")
    ).where(~F.col("ghost"))
    n = F.char_length("body")
    cut = F.floor(n / 3).cast("int")
    edited = placed.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.substring("body", F.lit(1), n - cut), F.substring("next_body", F.lit(1), cut))
    )
    marked = edited.withColumn("edited_marks", winnow(F.col("edited")))
    own = hashes(F.col("marks"))
    return marked.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digest(F.col("marks")).alias("fingerprint"),
        digest(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(own, hashes(F.col("edited_marks"))).alias("near_edited"), likeness(own, hashes(F.col("next_marks"))).alias("near_next"),
        F.size("marks").cast("long").alias("n_marks"),
    )
