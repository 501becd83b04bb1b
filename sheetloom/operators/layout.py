"""Layout blocks from page lines, from markdown and from raw layout elements, and their types.

Blocks have the columns source_file, page_number, block_id, block_index, block_type, text, char_count, reading_order,
section_heading, bbox and metadata (JSON text). Windows are partitioned by page, or by document where a state is carried
across pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, block_id, cased, contains_any, count_of, is_upper, let, lines, matches_any, raw_lines, strip
from ..plans import terms as T

BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"
COLUMNS = ["source_file", "page_number", "block_id", "block_index", "block_type", "text", "char_count", "reading_order", "section_heading", "bbox", "metadata"]
LONGEST_FIRST = sorted(T.HEADINGS, key=len, reverse=True)


def exact_heading(upper: Column) -> Column:
    """The known heading that upper-cased text is, else null."""
    return F.coalesce(*(F.when(upper == h.upper(), F.lit(h)) for h in LONGEST_FIRST))


def contained_heading(upper: Column) -> Column:
    """The longest known heading within upper-cased text, ties in list order, else null."""
    return F.coalesce(*(F.when(upper.contains(h.upper()), F.lit(h)) for h in LONGEST_FIRST))


def symbol_with_unit(text: Column, upper: Column) -> Column:
    return upper.rlike("(?U)" + T.TABLE_SYMBOLS[0]) & text.rlike("(?iU)" + T.TABLE_UNITS[0])


def list_like(text: Column) -> Column:
    return text.startswith("- ") | text.startswith("* ") | text.startswith("•")


def legal(text: Column, low: Column, otherwise: Column) -> Column:
    short = (F.length(text) < 300) & ~text.contains("Legal Disclaimer")
    return F.when(contains_any(low, T.LEGAL_CUES), F.when(short, "boilerplate").otherwise("legal")).otherwise(otherwise)


def line_type(text: Column, heading: Column) -> Column:
    return let(cased(text), lambda c: line_type_of(c["text"], c["low"], c["up"], heading))


def line_type_of(text: Column, low: Column, upper: Column, heading: Column) -> Column:
    table = (count_of(upper, T.TABLE_CUES) >= 3) | symbol_with_unit(text, upper)
    rest = (
        F.when(contains_any(low, T.PACKAGE_CUES) | F.upper(heading).isin(T.DIMENSION_HEADINGS), "package_drawing")
        .when(matches_any(text, T.LINE_FIGURES), "figure_or_graph")
        .when(table, "table_like")
        .when(text.startswith("•"), "list")
        .when((F.length(text) < 80) & is_upper(text), "heading")
        .otherwise("paragraph")
    )
    return F.when(text == "", "unknown").when(exact_heading(upper).isNotNull(), "heading").otherwise(legal(text, low, rest))


def markdown_type(text: Column, heading: Column) -> Column:
    return let(cased(text), lambda c: markdown_type_of(c["text"], c["low"], c["up"], heading))


def markdown_type_of(text: Column, low: Column, upper: Column, heading: Column) -> Column:
    table = (text.contains("|") & text.contains("---")) | matches_any(text, T.TABLE_CAPTIONS) | (count_of(upper, T.TABLE_CUES) >= 3) | symbol_with_unit(text, upper)
    rest = (
        F.when(contains_any(low, T.PACKAGE_CUES) | F.upper(heading).isin(T.DIMENSION_HEADINGS), "package_drawing")
        .when(matches_any(text, T.LINE_FIGURES), "figure_or_graph")
        .when(table, "table_like")
        .when(list_like(text), "list")
        .when((F.length(text) < 100) & is_upper(text), "heading")
        .otherwise("paragraph")
    )
    return F.when(text == "", "unknown").when(text.startswith("#"), "heading").otherwise(legal(text, low, rest))


#: Element labels that decide alone: parts of the label, and the type.
LABELS = [(["title"], "title"), (["heading", "header", "section"], "heading"), (["list"], "list"), (["table", "tabular"], "table_like"), (["figure", "image", "chart", "graph"], "figure_or_graph"), (["caption"], "figure_caption")]


def element_type(text: Column, label: Column) -> Column:
    both = F.struct(cased(text).alias("own"), strip(F.lower(label)).alias("name"))
    return let(both, lambda c: element_type_of(c["own"]["text"], c["own"]["low"], c["own"]["up"], c["name"]))


def element_type_of(text: Column, low: Column, upper: Column, name: Column) -> Column:
    table = (text.contains("|") & text.contains("---")) | matches_any(text, T.TABLE_CAPTIONS) | (count_of(upper, T.TABLE_CUES) >= 3)
    rest = (
        F.when(contains_any(low, T.ELEMENT_PACKAGE_CUES), "package_drawing")
        .when(matches_any(text, T.ELEMENT_FIGURES), "figure_or_graph")
        .when(table, "table_like")
        .when(list_like(text), "list")
        .when((F.length(text) < 100) & is_upper(text), "heading")
        .when(text != "", "paragraph")
        .otherwise("unknown")
    )
    out = legal(text, low, rest)
    for parts, kind in reversed(LABELS):
        out = F.when(any_of([name.contains(p) for p in parts]), kind).otherwise(out)
    return out


def metadata(**fields) -> Column:
    return F.to_json(F.struct(*(c.alias(n) if isinstance(c, Column) else F.lit(c).alias(n) for n, c in fields.items())), {"ignoreNullFields": "false"})


def finished(blocks: DataFrame, kind: Column, meta: Column) -> DataFrame:
    """Add what follows from page, index, order, text and heading."""
    out = blocks.withColumn("block_type", kind).withColumn("block_id", block_id(F.col("page_number"), F.col("block_index"))).withColumn("char_count", F.length("text"))
    if "bbox" not in out.columns:
        out = out.withColumn("bbox", F.lit(None).cast(BBOX))
    return out.withColumn("metadata", meta).select(*COLUMNS)


def line_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of pages (source_file, page_number, text): a known heading is a block, text runs under the running heading,
    a figure line stands alone behind other text, and an empty page is one unknown block.

    A figure line is alone only if text runs before it, so in a run of figure lines alone and running alternate.
    """
    keys = ["source_file", "page_number"]
    both = F.transform(lines(F.coalesce(F.col("text"), F.lit(""))), lambda x: F.struct(x.alias("line"), F.upper(x).alias("up")))
    line = pages.select(*keys, F.posexplode_outer(both).alias("at", "both")).select(*keys, "at", "both.line", "both.up")
    page = Window.partitionBy(*keys).orderBy("at")
    before = page.rowsBetween(Window.unboundedPreceding, -1)
    to_here = page.rowsBetween(Window.unboundedPreceding, 0)
    upper = F.col("up")
    line = line.withColumn("x", exact_heading(upper).isNotNull()).withColumn("c", F.when(F.col("x"), F.col("line")).otherwise(contained_heading(upper)))
    line = line.withColumn("f", F.coalesce(matches_any(F.col("line"), T.LINE_FIGURES), F.lit(False)))
    # contained headings set the running one unless they repeat it, exact ones always do; a repeat changes no later test
    line = line.withColumn("prev", F.last("c", ignorenulls=True).over(before))
    line = line.withColumn("set", F.col("x") | (F.col("c").isNotNull() & (F.upper(F.coalesce("prev", F.lit(""))) != F.upper("c"))))
    line = line.withColumn("heading", F.last(F.when(F.col("set"), F.col("c")), ignorenulls=True).over(to_here))
    line = line.withColumn("run", F.col("f") & ~F.col("x") & ~F.col("set"))
    # place within a run of plain figure lines, and whether text runs before the run
    line = line.withColumn("last_other", F.max(F.when(~F.col("run"), F.col("at"))).over(to_here))
    line = line.withColumn("before_is_x", F.coalesce(F.last(F.when(~F.col("run"), F.col("x")), ignorenulls=True).over(to_here), F.lit(True)))
    odd = (F.col("at") - F.coalesce("last_other", F.lit(-1))) % 2 == 1
    line = line.withColumn("solo", F.col("run") & (odd != F.col("before_is_x")))
    alone = F.col("x") | F.col("solo")
    cut = F.lag(F.lit(1)).over(page).isNull() | F.col("set") | alone | F.coalesce(F.lag(alone).over(page), F.lit(False))
    line = line.withColumn("block_index", F.sum(cut.cast("int")).over(to_here).cast("int"))
    blocks = line.groupBy(*keys, "block_index").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("own"), F.first("heading").alias("section_heading"))
    text = F.coalesce(F.array_join(F.transform("own", lambda r: r["line"]), "\n"), F.lit(""))
    blocks = blocks.select(*keys, "block_index", F.col("block_index").alias("reading_order"), text.alias("text"), "section_heading")
    how = F.when(F.col("text") == "", "empty_page").otherwise("heading_and_line_based_split")
    return finished(blocks, line_type(F.col("text"), F.col("section_heading")), metadata(source="pypdf_baseline", heuristic=how, confidence=F.lit(None).cast("double")))


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of documents (source_file, markdown): headings alone, table and list runs kept together, blank lines between.

    The page only moves forward, the heading is carried on across pages, and the index counts within the page.
    """
    doc = Window.partitionBy("source_file").orderBy("at")
    to_here = doc.rowsBetween(Window.unboundedPreceding, 0)
    line = docs.select("source_file", F.posexplode(raw_lines(F.coalesce(F.col("markdown"), F.lit("")))).alias("at", "line"))
    c = F.col("line")
    kind = F.when(c == "", "blank").when(c.startswith("#"), "heading").when(c.startswith("|") & c.endswith("|"), "table").when(list_like(c), "list").otherwise("plain")
    line = line.withColumn("kind", kind)
    was = F.lag("kind").over(doc)
    cut = was.isNull() | (was != F.col("kind")) | (F.col("kind") == "heading")
    line = line.withColumn("n", F.sum(cut.cast("int")).over(to_here)).where("kind != 'blank'")
    raw = line.groupBy("source_file", "n").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("own"))
    raw = raw.select("source_file", F.col("n").alias("at"), F.array_join(F.transform("own", lambda r: r["line"]), "\n").alias("text"))
    page = F.regexp_extract("text", r"(?U)Rev\.\s*[\d.]+,\s*[\w-]+\s+(\d+)\s+Document Number", 1).try_cast("int")
    title = let(F.upper(strip(F.ltrim(F.col("text"), F.lit("#")))), lambda t: F.coalesce(exact_heading(t), contained_heading(t)))
    raw = raw.withColumn("page_number", F.greatest(F.lit(1), F.max(page).over(to_here))).withColumn("reading_order", F.row_number().over(doc))
    raw = raw.withColumn("section_heading", F.last(title, ignorenulls=True).over(to_here))
    raw = raw.withColumn("block_index", F.row_number().over(Window.partitionBy("source_file", "page_number").orderBy("reading_order")))
    meta = metadata(source="docling_markdown", source_file=F.col("source_file"), raw_markdown_block_index=F.col("reading_order"), confidence=F.lit(None).cast("double"))
    return finished(raw, markdown_type(F.col("text"), F.col("section_heading")), meta)


# Names under which raw output holds its parts.
CONTAINERS = ["elements", "layout", "blocks", "items", "detections", "pages", "results"]
SIGNALS = ["label", "type", "category", "class", "element_type", "block_type", "text", "content", "markdown", "bbox", "box", "bounding_box"]
TEXTS = ["text", "content", "markdown", "html", "recognized_text", "parsed_text", "value"]
INNER_TEXTS = ["text", "content", "markdown", "html", "value"]
LABEL_NAMES = ["label", "type", "category", "class", "element_type", "block_type"]
ORDER_NAMES = ["reading_order", "order", "index", "block_index"]
BOX_NAMES = ["bbox", "box", "bounding_box"]
ELEMENT = "page_number int, reading_order int, raw_at int, raw_label string, text string, x0 double, y0 double, x1 double, y1 double, raw_element_keys array<string>, confidence string"


def whole(value) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError, OverflowError):
        return None


def page_of(element: dict, hint: int | None) -> int | None:
    """Page hint of a node: the one it inherits, its page, or its zero-based page index, in this order of precedence."""
    for name, shift in (("page_number", 0), ("page", 0), ("page_idx", 1), ("page_index", 1)):
        if name in element and (n := whole(element[name])) is not None:
            hint = n + shift
    return hint


def flattened(payload) -> list[dict]:
    """Elements of a payload of any nesting, in document order, each with its page. Depth is bounded by memory only."""
    found, waiting = [], [(payload, None)]
    while waiting:
        node, hint = waiting.pop()
        if isinstance(node, list):
            waiting.extend((x, hint) for x in reversed(node))
        elif isinstance(node, dict):
            hint = page_of(node, hint)
            inner = next((node[k] for k in CONTAINERS if isinstance(node.get(k), list)), None)
            if inner is not None:
                waiting.append((inner, hint))
            elif any(k in node for k in SIGNALS):
                found.append(node if hint is None or "page_number" in node else {**node, "page_number": hint})
    return found


def text_of(value) -> str:
    if isinstance(value, str):
        return value.strip()
    if isinstance(value, bool | int | float):
        return str(value)
    if isinstance(value, list):
        return "\n".join(t for t in map(text_of, value) if t)
    if isinstance(value, dict):
        return next((text_of(value[k]) for k in INNER_TEXTS if k in value), "")
    return ""


def box_of(element: dict) -> tuple[float, float, float, float] | None:
    """x0, y0, x1, y1 of a list, of a mapping by either naming, or of the element's own fields; malformed boxes are none."""
    box = next((element[k] for k in BOX_NAMES if k in element), None)
    names = [("x0", "left"), ("y0", "top"), ("x1", "right"), ("y1", "bottom")]
    if box is None and all(k in element for k, _ in names):
        box = [element[k] for k, _ in names]
    if isinstance(box, dict):
        box = [box.get(k, box.get(other)) for k, other in names]
    if not isinstance(box, list) or len(box) < 4:
        return None
    try:
        return tuple(float(x) for x in box[:4])
    except (TypeError, ValueError):
        return None


def elements(raw: DataFrame) -> DataFrame:
    """source_file and the elements of `raw` (source_file, payload as JSON text), in document order."""
    import json

    import pandas as pd

    names = [f.split(" ")[0] for f in ELEMENT.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for file, payload in zip(batch["source_file"], batch["payload"], strict=True):
                for at, e in enumerate(flattened(json.loads(payload) if payload else None), 1):
                    page = next((n + s for k, s in (("page_number", 0), ("page", 0), ("page_idx", 1), ("page_index", 1)) if k in e and (n := whole(e[k])) is not None), 1)
                    order = next((n for k in ORDER_NAMES if k in e and (n := whole(e[k])) is not None), at)
                    label = next((e[k].strip() for k in LABEL_NAMES if isinstance(e.get(k), str) and e[k].strip()), "unknown")
                    text = next((t for k in TEXTS if k in e and (t := text_of(e[k]))), "")
                    sure = e.get("confidence", e.get("score"))
                    rows.append((file, page, order, at, label, text, *(box_of(e) or (None,) * 4), sorted(e), None if sure is None else json.dumps(sure)))
            yield pd.DataFrame(rows, columns=["source_file", *names]).astype({k: object for k in ("x0", "y0", "x1", "y1")})

    return raw.select("source_file", "payload").mapInPandas(run, f"source_file string, {ELEMENT}")


def element_blocks(raw: DataFrame) -> DataFrame:
    """Blocks of raw layout output, one document per row. Nesting is free and order matters, so JSON is walked in Python."""
    e = elements(raw).withColumn("block_index", F.row_number().over(Window.partitionBy("source_file", "page_number").orderBy("raw_at")))
    e = e.withColumn("bbox", F.when(F.col("x0").isNotNull(), F.struct("x0", "y0", "x1", "y1"))).withColumn("section_heading", F.lit(None).cast("string"))
    meta = metadata(source="dolphin_adapter", source_file=F.col("source_file"), raw_label=F.col("raw_label"), raw_element_keys=F.col("raw_element_keys"), confidence=F.col("confidence"))
    return finished(e, element_type(F.col("text"), F.col("raw_label")), meta)


def ordered(blocks: DataFrame) -> DataFrame:
    return blocks.orderBy("source_file", "page_number", "reading_order", "block_index")


def block_counts(blocks: DataFrame) -> DataFrame:
    """Numbers of blocks by file, page and type, and each file's last page."""
    counts = blocks.groupBy("source_file", "page_number", "block_type").agg(F.count("*").alias("blocks"))
    return counts.join(blocks.groupBy("source_file").agg(F.max("page_number").alias("page_count")), "source_file")


#: Backends by name; all give blocks with the same columns.
BACKENDS = {"pypdf": line_blocks, "docling": markdown_blocks, "dolphin": element_blocks}


def analyse(backend: str, source: DataFrame) -> DataFrame:
    if backend not in BACKENDS:
        raise ValueError(f"unknown layout backend {backend!r}; known: {', '.join(BACKENDS)}")
    return BACKENDS[backend](source)
