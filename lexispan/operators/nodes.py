"""Node-level operators: reading, typing, scoping and neighbour context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions.text import col, collapse, is_translatable, nonempty, strip, text, try_int
from .ordering import carry_forward, dense_number, neighbours


def read_nodes(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """One row per translatable line; ids are dense per document.

    Lines are filtered and numbered inside the document row, so the scan needs
    no shuffle. The first line is the heading and names the section.
    """
    lines = F.filter(F.transform(F.split(text(body), "\n"), lambda s: strip(s)), is_translatable)
    # The section is taken before the lines become rows, so that no row drags all lines along.
    numbered = docs.select(F.col(key).alias("doc_id"), lines.alias("_lines")).withColumn(
        "section", F.get("_lines", F.lit(0))
    ).select("doc_id", "section", F.posexplode("_lines").alias("_i", "text"))
    return numbered.select(
        "doc_id",
        F.col("_i").cast("bigint").alias("node_id"),
        "text",
        "section",
        F.when(F.col("_i") == 0, "heading").otherwise("paragraph").alias("element_type"),
        F.lit("body").alias("source"),
        F.lit("").alias("group"),
        F.lit("xml_text").alias("type"),
        F.lit("docx").alias("doc_format"),
        F.lit(False).alias("is_header"),
        F.lit(None).cast("int").alias("table_index"),
        F.lit(None).cast("string").alias("table_title"),
    )


def element_type(explicit, group, body, node_type) -> Column:
    """Given type, else one inferred from the group and the text."""
    g = F.lower(strip(group))
    plain = F.btrim(F.lower(collapse(body)), F.lit("* "))
    cell = g.isin("table_cell", "sheet_cell")
    return (
        F.when(strip(explicit) != "", strip(explicit))
        .when(cell & plain.isin("blank", "n/a", "na"), "placeholder")
        .when(cell, "table_cell")
        .when(F.startswith(g, F.lit("chart_")), g)
        .when(col(node_type) == "cell", "table_cell")
        .when(col(node_type) == "xml_text", "paragraph")
        .otherwise("")
    )


def container_type(element, table_index, slide_index, sheet_name, group, shape_name, source) -> Column:
    e = strip(element)
    return (
        F.when(e.isin(*K.TABLE_ELEMENTS, "placeholder") | col(table_index).isNotNull(), "table")
        .when(col(slide_index).isNotNull(), "slide")
        .when(text(sheet_name) != "", "sheet")
        .when(F.startswith(text(group), F.lit("chart_")) | F.startswith(e, F.lit("chart_")), "chart")
        .when(e.isin("text_box", "slide_title") | (text(shape_name) != ""), "text_box")
        .when(strip(source).isin("header", "footer"), strip(source))
        .otherwise("paragraph")
    )


def container_id(doc_format, table_index, slide_index, sheet_name, shape_name, source) -> Column:
    fmt, src, sheet = strip(doc_format), strip(source), text(sheet_name)
    office = F.coalesce(nonempty(doc_format), F.lit("office"))
    table, slide = col(table_index), col(slide_index)
    return (
        F.when(
            table.isNotNull() & slide.isNotNull(),
            F.concat(office, F.lit(":slide:"), slide.cast("string"), F.lit(":table:"), table.cast("string")),
        )
        .when(
            table.isNotNull() & (sheet != ""),
            F.concat(office, F.lit(":sheet:"), sheet, F.lit(":table:"), table.cast("string")),
        )
        .when(table.isNotNull(), F.concat(office, F.lit(":table:"), table.cast("string")))
        .when(slide.isNotNull(), F.concat(F.lit("pptx:slide:"), slide.cast("string")))
        .when(sheet != "", F.concat(F.lit("xlsx:sheet:"), sheet))
        .when(text(shape_name) != "", F.concat(office, F.lit(":shape:"), col(shape_name)))
        .when((fmt != "") & (src != ""), F.concat(fmt, F.lit(":"), src))
        .otherwise(src)
    )


def context_scope(slide_index, sheet_name, page_num, source) -> Column:
    return F.coalesce(
        F.concat(F.lit("pptx:slide:"), col(slide_index).cast("string")),
        F.when(text(sheet_name) != "", F.concat(F.lit("xlsx:sheet:"), col(sheet_name))),
        F.concat(F.lit("docx:page:"), col(page_num).cast("string")),
        F.when(text(source) != "", F.concat(F.lit("docx:"), col(source))),
        F.lit(""),
    )


def chunk_id(scope, unit_id) -> Column:
    return F.coalesce(nonempty(scope), F.concat(F.lit("chunk:"), col(unit_id).cast("string")))


def parse_scope(scope) -> Column:
    """Kind, number, sheet name and sort number of a scope name."""
    s = text(scope)
    kind = F.regexp_extract(s, r"^(pptx:slide|docx:page|xlsx:sheet):", 1)
    number = F.when(kind.isin("pptx:slide", "docx:page"), try_int(F.element_at(F.split(s, ":"), -1)))
    return F.struct(
        F.when(kind != "", F.element_at(F.split(kind, ":"), -1)).otherwise("").alias("kind"),
        number.alias("number"),
        F.when(kind == "xlsx:sheet", F.substr(s, F.lit(12), F.length(s))).otherwise("").alias("sheet_name"),
        F.coalesce(number, F.lit(10**9).cast("bigint")).alias("sort_number"),
    )


def normalize_scopes(requests: DataFrame) -> DataFrame:
    """Requested revision scopes: columns ``scope`` (text form) or ``kind``, ``index``, ``name``.

    Gives ``scope_type``, ``scope_number``, ``scope_name`` and drops repeats.
    A scope that cannot be read has a ``scope_error`` instead.
    """
    s = strip("scope")
    kind = F.lower(strip("kind"))
    number = F.coalesce(
        F.when(s.rlike("^(pptx:slide|docx:page):"), try_int(F.element_at(F.split(s, ":"), -1))),
        F.when(s == "", try_int(strip(F.col("index").cast("string")))),
    )
    scope_type = (
        F.when(s.rlike("^pptx:slide:") | ((s == "") & kind.isin("slide", "pptx:slide")), "slide")
        .when(s.rlike("^xlsx:sheet:") | ((s == "") & kind.isin("sheet", "xlsx:sheet")), "sheet")
        .when(
            s.rlike("^docx:page:") | ((s == "") & kind.isin("batch", "section", "page", "docx:page")), "batch"
        )
        .when((s == "") & (kind != ""), kind)
        .when(s == "", "document")
    )
    named = F.when(
        scope_type == "sheet",
        F.when(s != "", strip(F.regexp_replace(s, "^xlsx:sheet:", ""))).when(
            number.isNull(), strip(F.regexp_replace(text("name"), r"(?U)\s+\(\d+\)\s*$", ""))
        ),
    )
    out = requests.select(
        "doc_id", scope_type.alias("scope_type"), number.alias("scope_number"), named.alias("scope_name")
    )
    bad = (
        F.col("scope_type").isNull()
        | (F.col("scope_type").isin("slide", "batch") & F.col("scope_number").isNull())
        | ((F.col("scope_type") == "sheet") & F.col("scope_number").isNull() & (text("scope_name") == ""))
    )
    return out.withColumn("scope_error", bad).distinct()


def nodes_for_scope(nodes: DataFrame, scopes: DataFrame) -> DataFrame:
    """Nodes inside the requested scopes of their document; a sheet goes by 1-based position or name."""
    ok = scopes.where(~F.col("scope_error")).drop("scope_error")
    sheets = (
        nodes.where(text("sheet_name") != "")
        .groupBy("doc_id", "sheet_name").agg(F.min("node_id").alias("_first"))
    )
    sheets = dense_number(sheets, ["doc_id"], ["_first"], "_position", start=1)
    by_position = (
        ok.where("scope_type = 'sheet' and scope_number is not null")
        .join(sheets, (ok.doc_id == sheets.doc_id) & (ok.scope_number == sheets._position))
        .select(ok.doc_id, F.lit("sheet").alias("_t"), F.col("sheet_name").alias("_v"))
    )
    direct = ok.where("scope_type <> 'sheet' or scope_number is null").select(
        "doc_id", F.col("scope_type").alias("_t"),
        F.when(F.col("scope_type") == "document", "")
        .otherwise(F.coalesce("scope_name", F.col("scope_number").cast("string"))).alias("_v"),
    )
    wanted = direct.unionByName(by_position).distinct()
    # Each node carries the few (type, value) pairs it can be asked for.
    spread = nodes.withColumn(
        "_p",
        F.explode(
            F.array(
                F.struct(F.lit("document").alias("t"), F.lit("").alias("v")),
                F.struct(F.lit("slide").alias("t"), F.coalesce("slide_index", F.lit(0)).cast("string").alias("v")),
                F.struct(F.lit("sheet").alias("t"), text("sheet_name").alias("v")),
                F.struct(F.lit("batch").alias("t"), F.coalesce("page_num", F.lit(0)).cast("string").alias("v")),
            )
        ),
    )
    hits = spread.join(
        wanted,
        (spread.doc_id == wanted.doc_id) & (F.col("_p.t") == F.col("_t")) & (F.col("_p.v") == F.col("_v")),
        "left_semi",
    )
    return hits.drop("_p").dropDuplicates(["doc_id", "node_id"])


def neighbour_context(nodes: DataFrame) -> DataFrame:
    """Previous and next text of body, header and footer nodes, cut to the context width."""
    kept = nodes.where(F.col("source").isin("body", "header", "footer") & (strip("text") != ""))
    kept = dense_number(kept, ["doc_id"], ["node_id"], "_seq")
    kept = kept.withColumn("_short", F.left(strip("text"), F.lit(K.NEIGHBOUR_CHARS)))
    near = neighbours(
        kept, ["doc_id"], "_seq", {"previous_text": ("_short", -1), "next_text": ("_short", 1)}
    )
    return near.drop("_short", "_seq")


def table_context(nodes: DataFrame) -> DataFrame:
    """Caption and heading per table: ``doc_id, table_index, table_title, table_section``.

    A caption belongs to the first table that follows it, until a new caption
    appears; the heading is the last one before the table.
    """
    short = F.left(collapse("text"), F.lit(K.TITLE_CHARS))
    kept = nodes.where(F.col("source").isin("body", "header", "footer")).withColumn("_t", short).where("_t <> ''")
    outside = F.col("table_index").isNull()
    caption = F.when(
        outside & F.col("_t").rlike(r"(?iU)^(?:Table|Figure)\s+\d+[.:]?\s+.+"),
        F.struct(F.col("node_id").alias("at"), F.col("_t").alias("t")),
    )
    heading = F.when(outside & (F.col("element_type") == "heading"), F.col("_t"))
    kept = carry_forward(kept, ["doc_id"], ["node_id"], caption, "_caption")
    kept = carry_forward(kept, ["doc_id"], ["node_id"], heading, "_heading").where("table_index is not null")
    bound = (
        kept.where("_caption is not null")
        .groupBy("doc_id", "_caption").agg(F.min_by("table_index", "node_id").alias("table_index"))
        .groupBy("doc_id", "table_index").agg(F.min_by("_caption.t", "_caption.at").alias("table_title"))
    )
    sections = kept.groupBy("doc_id", "table_index").agg(
        F.min_by("_heading", F.when(F.col("_heading").isNotNull(), F.col("node_id"))).alias("table_section")
    )
    return sections.join(bound, ["doc_id", "table_index"], "left").select(
        "doc_id", "table_index", text("table_title").alias("table_title"), text("table_section").alias("table_section")
    )


def context_text(previous, following, section, title) -> Column:
    """The labelled context lines of a node."""

    def line(label, value):
        return F.when(text(value) != "", F.concat(F.lit(label + ": "), col(value)))

    return F.concat_ws(
        "\n",
        line("SECTION_HEADING", section), line("TABLE_TITLE", title),
        line("PREVIOUS", previous), line("NEXT", following),
    )


def slide_context(nodes: DataFrame) -> DataFrame:
    """First, previous (index - 1) and current slide text for every slide.

    A slide's own text is the one unavoidable concatenation; slides of a deck
    stay separate rows.
    """
    kept = nodes.where(F.col("slide_index").isNotNull() & (strip("text") != ""))
    slides = kept.groupBy("doc_id", "slide_index").agg(
        F.sort_array(F.collect_list(F.struct("node_id", strip("text").alias("t")))).alias("_n")
    )
    slides = slides.select("doc_id", "slide_index", F.array_join(F.col("_n.t"), " ").alias("slide_text"))
    first = slides.groupBy("doc_id").agg(F.min("slide_index").alias("slide_index")).join(
        slides, ["doc_id", "slide_index"]
    ).select("doc_id", F.col("slide_text").alias("first_text"))
    previous = slides.select(
        "doc_id", (F.col("slide_index") + 1).alias("slide_index"), F.col("slide_text").alias("previous_text")
    )
    return (
        slides.join(previous, ["doc_id", "slide_index"], "left").join(first, "doc_id")
        .select(
            "doc_id", "slide_index",
            F.concat_ws(" ", "first_text", "previous_text", "slide_text").alias("context_text"),
        )
    )


def grid_context(cells: DataFrame) -> DataFrame:
    """Context lines of every sheet cell from its neighbours in the grid.

    Left and above use the last six of a bounded run; previous rows look three
    rows up; near cells are one row and two columns away. Every list is kept to
    six cells before it is collected.
    """
    n = K.CELL_CONTEXT_ITEMS
    kept = cells.where((text("sheet_name") != "") & F.col("row").isNotNull() & F.col("col").isNotNull())
    kept = kept.where(strip("text") != "")
    ref = text("cell_ref")
    shown = F.concat(
        F.when(ref != "", F.concat(ref, F.lit(": "))).otherwise(""),
        F.left(F.replace(strip("text"), F.lit("\n"), F.lit(" ")), F.lit(K.CELL_CHARS)),
    )
    kept = kept.withColumn("_shown", shown)
    at = F.struct(F.col("row"), F.col("col"), F.col("_shown"))
    left = _last_before(kept, ["doc_id", "sheet_name", "row"], "col", n).withColumnRenamed("_list", "_left")
    both = _last_before(left, ["doc_id", "sheet_name", "col"], "row", n).withColumnRenamed("_list", "_above")
    # Previous rows: the last six cells of rows r-3..r-1; each row offers its own last six.
    tails = _ends(kept, n, last=True)
    up = _row_lists(tails, [1, 2, 3], "_up")
    # Near cells: equi-join on the exact neighbour positions.
    around = [(r, c) for r in (-1, 0, 1) for c in (-2, -1, 0, 1, 2) if (r, c) != (0, 0)]
    offered = kept.select(
        "doc_id", "sheet_name", at.alias("_cell"),
        F.explode(F.array(*[F.struct((F.col("row") - r).alias("row"), (F.col("col") - c).alias("col")) for r, c in around])).alias("_to"),
    )
    near = offered.groupBy("doc_id", "sheet_name", F.col("_to.row").alias("row"), F.col("_to.col").alias("col")).agg(
        F.slice(F.sort_array(F.collect_list("_cell")), 1, n)["_shown"].alias("_near")
    )

    def line(label, items):
        return F.when(F.size(items) > 0, F.concat(F.lit(label + ": "), F.array_join(items, " | ")))

    own = F.when(ref != "", ref).otherwise(F.format_string("R%dC%d", "row", "col"))
    merged = strip("merged_range")
    joined = both.join(up, ["doc_id", "sheet_name", "row"], "left").join(
        near, ["doc_id", "sheet_name", "row", "col"], "left"
    )
    return joined.select(
        "doc_id", "sheet_name", "row", "col",
        F.concat_ws(
            "\n",
            F.concat(F.lit("SHEET: "), "sheet_name"), F.concat(F.lit("CELL: "), own),
            F.when(merged != "", F.concat(F.lit("MERGED_RANGE: "), merged)),
            line("COLUMN_HEADERS_OR_ABOVE", F.col("_above")), line("ROW_LABELS_OR_LEFT", F.col("_left")),
            line("PREVIOUS_ROWS", F.col("_up")), line("NEARBY_CELLS", F.col("_near")),
        ).alias("context_text"),
    )


def _last_before(df, keys, order, n):
    """Up to n shown cells before each cell along one axis."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-n, -1)
    return df.withColumn("_list", F.collect_list("_shown").over(w))


def _ends(df, n, last):
    from .ordering import top_k

    order = F.col("col").desc() if last else F.col("col").asc()
    return top_k(df, ["doc_id", "sheet_name", "row"], [order], n, "_r").select(
        "doc_id", "sheet_name", "row", "col", "_shown"
    )


def _row_lists(tails, steps, name):
    moved = tails.select(
        "doc_id", "sheet_name", F.struct("row", "col", "_shown").alias("_cell"),
        F.explode(F.array(*[(F.col("row") + s) for s in steps])).alias("row"),
    )
    lists = moved.groupBy("doc_id", "sheet_name", "row").agg(F.sort_array(F.collect_list("_cell")).alias("_c"))
    # Eighteen cells at most per list; the last six stay.
    keep = F.slice("_c", F.greatest(F.size("_c") - K.CELL_CONTEXT_ITEMS + 1, F.lit(1)), F.lit(K.CELL_CONTEXT_ITEMS))
    return lists.select("doc_id", "sheet_name", "row", keep["_shown"].alias(name))
