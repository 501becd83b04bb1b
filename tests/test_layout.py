"""Layout operators on crafted pages, and the line splitter against a literal state machine."""

import json
import random

from sheetloom.operators import layout

SCHEMA = "source_file string, page_number int, text string"
HEADS = {h.upper(): h for h in layout.LONGEST_FIRST}


def machine(lines):
    """What the splitter does, one line at a time."""
    blocks, current, heading = [], [], None

    def flush():
        nonlocal current
        if current:
            blocks.append(("\n".join(current), heading))
        current = []

    for line in lines:
        up = line.upper()
        if up in HEADS:
            flush()
            heading, current = line, [line]
            flush()
            continue
        inside = next((h for h in layout.LONGEST_FIRST if h.upper() in up), None)
        if inside and inside.upper() != (heading or "").upper():
            flush()
            heading = inside
        if ("Fig. 1" in line or "figure 2" in line) and current:
            flush()
            current = [line]
            flush()
            continue
        current.append(line)
    flush()
    return blocks


def test_splitter_on_random_lines(spark):
    rng = random.Random(7)
    parts = ["plain text", "Fig. 1 shows", "a figure 2", "FEATURES", "features", "new FEATURES here", "Description", "in the DESCRIPTION of Fig. 1", "REEL DIMENSIONS Fig. 1"]
    pages = [[rng.choice(parts) for _ in range(rng.randint(1, 14))] for _ in range(1500)]
    df = spark.createDataFrame([("f", i, "\n".join(p)) for i, p in enumerate(pages)], SCHEMA)
    found = {}
    for r in layout.line_blocks(df).collect():
        found.setdefault(r.page_number, {})[r.block_index] = (r.text, r.section_heading)
    for i, p in enumerate(pages):
        assert [found[i][k] for k in sorted(found[i])] == machine(p), p


def kinds(spark, texts):
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], SCHEMA)
    return {(r.page_number, r.block_index): r for r in layout.line_blocks(df).collect()}


def test_line_types(spark):
    found = kinds(spark, ["", "All Rights Reserved", "Legal Disclaimer " + "x" * 10, "12 pcs/reel", "PARAMETER SYMBOL UNIT", "VCEO is 5 V", "• one", "SHOUTED WORDS", "plain", "PACKAGE DIMENSIONS\nin a box", "85°C and IC", "85 °C and IC"])
    kind = [found[i, 1].block_type for i in range(9)]
    assert kind == ["unknown", "boilerplate", "legal", "package_drawing", "table_like", "table_like", "list", "heading", "paragraph"]
    assert found[0, 1].block_id == "page_0_block_001" and json.loads(found[0, 1].metadata) == {"source": "pypdf_baseline", "heuristic": "empty_page", "confidence": None}
    assert (found[9, 1].block_type, found[9, 2].block_type, found[9, 2].section_heading) == ("heading", "package_drawing", "PACKAGE DIMENSIONS")
    assert (found[10, 1].block_type, found[11, 1].block_type) == ("table_like", "paragraph")


def test_markdown_pages_and_headings_run_on(spark):
    text = "# Features\n- a\n- b\ntext\n| x | --- |\n\nRev. 1.2, 05-Jan 3 Document Number: 1\nmore\n## Other\nTable 1 here"
    rows = layout.ordered(layout.markdown_blocks(spark.createDataFrame([("f", text)], "source_file string, markdown string"))).collect()
    assert [(r.page_number, r.block_index, r.block_type, r.section_heading) for r in rows] == [
        (1, 1, "heading", "FEATURES"), (1, 2, "list", "FEATURES"), (1, 3, "paragraph", "FEATURES"), (1, 4, "table_like", "FEATURES"),
        (3, 1, "paragraph", "FEATURES"), (3, 2, "heading", "FEATURES"), (3, 3, "table_like", "FEATURES"),
    ]
    assert [r.reading_order for r in rows] == list(range(1, 8))


def test_element_shapes(spark):
    payloads = {
        "flat": [{"type": "Title", "text": " T ", "bbox": [0, 1, 2, 3]}, {"label": "caption", "content": ["a", None, "b"]}],
        "nested": {"pages": [{"page_number": 2, "elements": [{"category": "text", "value": {"html": "x"}, "text": "", "box": {"left": 1, "top": 2, "right": 3, "bottom": 4}}]}, {"page_idx": 4, "blocks": [{"class": "figure_caption", "text": "Fig", "order": "7"}]}]},
        "results": {"results": [{"layout": [{"text": "UPPER", "page_index": 0, "score": 0.5}, {"nothing": 1}, {"bbox": ["a", 1, 2, 3], "x0": 1}]}]},
        "boxed": {"items": [{"text": "t", "x0": "1", "y0": 2, "x1": 3, "y1": 4}]},
        "empty": None,
    }
    df = spark.createDataFrame([(k, json.dumps(v) if v is not None else None) for k, v in payloads.items()], "source_file string, payload string")
    found = {}
    for r in layout.ordered(layout.element_blocks(df)).collect():
        found.setdefault(r.source_file, []).append(r)
    assert [(r.block_type, r.text, r.bbox and tuple(r.bbox)) for r in found["flat"]] == [("title", "T", (0, 1, 2, 3)), ("figure_caption", "a\nb", None)]
    assert [(r.page_number, r.reading_order, r.block_type, r.text) for r in found["nested"]] == [(2, 1, "paragraph", "x"), (5, 7, "figure_or_graph", "Fig")]
    assert tuple(found["nested"][0].bbox) == (1, 2, 3, 4)
    assert [(r.page_number, r.text, r.block_type, r.bbox) for r in found["results"]] == [(1, "UPPER", "heading", None), (1, "", "unknown", None)]
    assert json.loads(found["results"][0].metadata)["confidence"] == "0.5"
    assert tuple(found["boxed"][0].bbox) == (1, 2, 3, 4) and "empty" not in found


def test_backends_share_columns(spark):
    assert set(layout.BACKENDS) == {"pypdf", "docling", "dolphin"}
    assert layout.analyse("pypdf", spark.createDataFrame([("f", 1, "a")], SCHEMA)).columns == layout.COLUMNS
