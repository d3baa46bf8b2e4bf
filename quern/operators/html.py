"""HTML pages to typed regions, links and quality.

Void elements are not stacked, so a line break or an image inside a paragraph does not end it.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import ids
from quern.session import ship

# Element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PROSE = frozenset("p div article section blockquote figcaption h1 h2 h3 h4 h5 h6".split())
SKIPPED = frozenset(("script", "style"))

REGIONS = "page_id long, ord int, kind string, dom_path string, text string"


class Regions(HTMLParser):
    """Regions (kind, path, text) of one page in document order. A region's text ends where another begins."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str, str]] = []
        self.stack: list[tuple[str, str]] = []
        self.counts: dict[tuple[str, str], int] = {}
        self.kind, self.path, self.buffer = "", "", []
        self.skip = self.lists = 0
        self.items: list[str] | None = None
        self.tables: list[dict] = []

    def _where(self, tag: str) -> str:
        parent = self.stack[-1][1] if self.stack else ""
        n = self.counts[parent, tag] = self.counts.get((parent, tag), 0) + 1
        return f"{parent}/{tag}[{n}]".lstrip("/")

    def _flush(self) -> None:
        text = "".join(self.buffer)
        text = text.strip("\n") if self.kind == "code" else " ".join(text.split())
        if self.kind and text:
            self.out.append((self.kind, self.path, text))
        self.kind, self.buffer = "", []

    def _open(self, kind: str, path: str) -> None:
        self._flush()
        self.kind, self.path = kind, path

    def handle_starttag(self, tag: str, attrs: list) -> None:
        path = self._where(tag)
        for name, value in attrs:
            if tag == "a" and name == "href" and value and not value.startswith("#"):
                self.out.append(("link", path, value))
        if tag in VOID:
            if tag == "br":
                self.handle_data("\n" if self.kind == "code" else " ")
            return
        self.stack.append((tag, path))
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "table":
            self._flush()
            self.tables.append({"path": path, "rows": [], "nested": False})
            if len(self.tables) > 1:
                self.tables[-2]["nested"] = True
        elif self.tables:
            if tag == "tr":
                self.tables[-1]["rows"].append([])
            elif tag in ("td", "th") and self.tables[-1]["rows"]:
                self.tables[-1]["rows"][-1].append("")
        elif tag in ("ul", "ol"):
            if not self.lists:
                self._open("list", path)
                self.items = []
            self.lists += 1
        elif tag == "li" and self.items is not None:
            self.items.append("")
        elif tag in ("pre", "code") and self.kind != "code":
            self._open("code", path)
        elif tag in PROSE and self.items is None:
            self._open("prose", path)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            top, path = self.stack.pop()
            if top in SKIPPED:
                self.skip -= 1
            elif top == "table" and self.tables:
                self._table(self.tables.pop())
            elif top in ("ul", "ol") and self.lists:
                self.lists -= 1
                if not self.lists and self.items is not None:
                    lines = [f"- {t}" for i in self.items if (t := " ".join(i.split()))]
                    if lines:
                        self.out.append(("list", self.path, "\n".join(lines)))
                    self.items, self.kind, self.buffer = None, "", []
            elif path == self.path and (top in PROSE or top in ("pre", "code")):
                self._flush()
            if top == tag:
                return

    def _table(self, table: dict) -> None:
        rows = [[" ".join(c.split()).replace("|", "\\|") for c in r] for r in table["rows"] if r]
        if rows:
            width = len(rows[0])
            fit = [(r + [""] * width)[:width] for r in rows]
            lines = [f"| {' | '.join(r)} |" for r in [fit[0], ["---"] * width, *fit[1:]]]
            self.out.append(("nested_table" if table["nested"] else "table", table["path"], "\n".join(lines)))

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.tables:
            if self.tables[-1]["rows"] and self.tables[-1]["rows"][-1]:
                self.tables[-1]["rows"][-1][-1] += data
        elif self.items is not None:
            if self.items:
                self.items[-1] += data
        elif self.kind:
            self.buffer.append(data)


def parse(html: str | None) -> list[tuple[str, str, str]]:
    p = Regions()
    p.feed(html or "")
    p.close()
    while p.stack:
        p.handle_endtag(p.stack[-1][0])
    p._flush()
    return p.out


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, k, *r) for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, r in enumerate(parse(h))]
        c = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), *(pa.array(x, pa.string()) for x in c[2:])], names=["page_id", "ord", "kind", "dom_path", "text"])


def regions(pages: DataFrame) -> DataFrame:
    """All regions and links of all pages; no shuffle, pages are parsed where they are read."""
    ship(pages.sparkSession)
    found = pages.select(F.col("page_id").cast("long"), "html").mapInArrow(_regions, REGIONS)
    return found.withColumn("region_id", ids.region_id(F.col("kind"), F.col("dom_path")))


def quality(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Per page: regions, characters, whether it is near empty, and the state of its tables."""
    own = found.where("kind <> 'link'")
    by = own.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_regions"), F.sum(F.length("text")).alias("n_chars"), F.max((F.col("kind") == "nested_table").cast("int")).alias("nested"), F.max(F.col("kind").endswith("table").cast("int")).alias("tables"))
    state = F.when(F.col("nested") == 1, "partial").when(F.col("tables") == 1, "full").otherwise("n_a")
    return pages.select("page_id").join(by, "page_id", "left").select("page_id", F.coalesce("n_regions", F.lit(0)).alias("n_regions"), F.when(F.col("n_regions") > 0, 1.0).otherwise(0.0).alias("overall"), (F.coalesce("n_chars", F.lit(0)) < 50).alias("near_empty"), state.alias("table_structure"))
