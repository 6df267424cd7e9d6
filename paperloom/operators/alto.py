"""Text blocks from page XML."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scripts import small_batches

#: Fixed value: how the namespaces of the page format begin, whatever their version.
SPACE = "http://www.loc.gov/standards/alto/ns-v"
#: Bytes of parsed blocks, about, that a task holds before it hands them on.
PARSED = 4 << 20
#: Rows of an Arrow batch of pages at most: a page's XML is many times its text.
PAGES = 64
BLOCK = "id string, height string, width string, hpos string, vpos string, lines array<struct<v:string,h:string,text:string>>"


def int_attr(value: Column) -> Column:
    """A numeric attribute, truncated; 0 where it is missing."""
    return F.coalesce(value.cast("double").cast("int"), F.lit(0))


class _Page:
    """Blocks of one page from the parser's events, without a tree: what lies open is on a stack, with the block or line that it is."""

    def __init__(self) -> None:
        self.blocks: list[dict] = []
        self.open: list[tuple[str, dict | None]] = [("", None)]

    def start(self, name: str, attributes: dict[str, str]) -> None:
        space, _, local = name.rpartition(" ")
        above, holder = self.open[-1]
        made = None
        if local == "TextBlock" and space.startswith(SPACE):
            made = {a.lower(): attributes.get(a) for a in ("ID", "HEIGHT", "WIDTH", "HPOS", "VPOS")} | {"lines": []}
            self.blocks.append(made)
        elif local == "TextLine" and space.startswith(SPACE) and above == "TextBlock" and holder is not None:
            made = {"v": attributes.get("VPOS"), "h": attributes.get("HPOS"), "text": []}
            holder["lines"].append(made)
        elif above == "TextLine" and holder is not None:
            if local == "String":
                holder["text"].append(attributes.get("CONTENT", ""))
            elif local == "SP":
                holder["text"].append(" ")
            elif local == "HYP":
                holder["text"].append(attributes.get("CONTENT") or "-")
        self.open.append((local, made))

    def end(self, name: str) -> None:
        local, made = self.open.pop()
        if local == "TextLine" and made is not None:
            made["text"] = "".join(made["text"])


def page_blocks(xml: bytes | memoryview | pa.Buffer, piece: int = 1 << 16) -> list[dict] | None:
    """The text blocks of a page, which is parsed a piece at a time; None where it isn't well-formed."""
    page, parser = _Page(), expat.ParserCreate("utf-8", " ")
    parser.StartElementHandler, parser.EndElementHandler = page.start, page.end
    data = memoryview(xml)
    try:
        for at in range(0, len(data), piece):
            parser.Parse(data[at : at + piece], False)
        parser.Parse(b"", True)
    except expat.ExpatError:
        return None
    return page.blocks


def parse_pages(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """A row per text block of ``pages`` in document order, with ``block_idx`` and its raw ``lines``; pages that are not
    well-formed have ``bad_xml`` set and no block.  A column of ``pages`` named like one of a block's comes back as ``page_`` and its name.
    The other columns stay Arrow data; any version of the page format's namespace counts."""
    own = ["block_idx", "bad_xml", "id", "height", "width", "hpos", "vpos", "lines", "text"]
    pages = small_batches(pages, PAGES).withColumnsRenamed({c: f"page_{c}" for c in pages.columns if c != xml and c.lower() in own})
    keys = [c for c in pages.columns if c != xml]
    fields = ("id", "height", "width", "hpos", "vpos")
    line = pa.list_(pa.struct([("v", pa.string()), ("h", pa.string()), ("text", pa.string())]))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, places, found, size = [], [], [], 0

            def told() -> pa.RecordBatch:
                columns = [batch.column(c).take(pa.array(of, pa.int64())) for c in keys]  # noqa: B023
                columns += [pa.array(places, pa.int32()), pa.array([f is None for f in found], pa.bool_())]  # noqa: B023
                columns += [pa.array([f and f[n] for f in found], pa.string()) for n in fields] + [pa.array([f and f["lines"] for f in found], line)]  # noqa: B023
                return pa.record_batch(columns, [*keys, "block_idx", "bad_xml", *fields, "lines"])

            for row, text in enumerate(batch.column(xml)):
                blocks = page_blocks(text.as_buffer()) if text.is_valid else None
                for k, block in [(None, None)] if blocks is None else enumerate(blocks):
                    of.append(row)
                    places.append(k)
                    found.append(block)
                    size += 0 if block is None else 1000 + sum(len(x["text"]) + 200 for x in block["lines"])
                if size >= PARSED:
                    yield told()
                    of, places, found, size = [], [], [], 0
            if found:
                yield told()

    types = dict(pages.dtypes)
    return pages.select(*keys, xml).mapInArrow(parsed, ", ".join([f"`{c}` {types[c]}" for c in keys] + ["block_idx int, bad_xml boolean", BLOCK]))


def ordered_lines(lines: Column) -> Column:
    """Line texts by position (stable), stripped, without empty ones."""
    keyed = F.transform(lines, lambda x, i: F.struct(int_attr(x["v"]).alias("v"), int_attr(x["h"]).alias("h"), i.alias("i"), F.regexp_replace(x["text"], r"(?U)^\s+|\s+$", "").alias("text")))
    return F.filter(F.transform(F.array_sort(keyed), lambda x: x["text"]), lambda s: s != "")


def dehyphenate(lines: Column) -> Column:
    """Join a line that ends in a hyphen with the next one where that starts with a letter; what was joined isn't joined again."""

    def step(state: Column, line: Column) -> Column:
        last = state["last"]
        bare = F.regexp_replace(line, r"(?U)^\s+", "")
        joins = last.isNotNull() & state["open"] & F.endswith(last, F.lit("-")) & bare.rlike(r"^\p{L}")
        out = F.when(joins | last.isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(last)))
        return F.struct(out.alias("out"), F.when(joins, F.concat(F.substring(last, F.lit(1), F.length(last) - 1), bare)).otherwise(line).alias("last"), (~joins).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("last"), F.lit(True).alias("open"))
    return F.aggregate(lines, start, step, lambda s: F.when(s["last"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["last"]))))


def block_text(lines: Column, join_with: str = "\n") -> Column:
    return F.array_join(dehyphenate(ordered_lines(lines)), join_with)


def extract_blocks(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """One row per text block with its ``text``."""
    blocks = parse_pages(pages, xml).filter("not bad_xml")
    return blocks.withColumn("text", block_text(F.col("lines"))).drop("lines", "bad_xml")
