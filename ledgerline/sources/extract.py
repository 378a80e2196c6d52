"""Items out of pages: feeds, listings by selector, listings by pattern; readable text."""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.text import canonical_feed_url, clean_text, decoded  # noqa: F401  (pages are decoded before they are read)

DETAIL_CHARS = 4000
MAX_ITEMS = 40  # of a page, where its source says nothing else
CHROME = ("script", "style", "noscript", "nav", "header", "footer")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def text(self) -> str:
        parts = (c.text() if isinstance(c, Node) else c.strip() for c in self.children)
        return " ".join(p for p in parts if p)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def _simple(selector: str):
    """Tag, classes, id and attributes of one selector without spaces."""
    import re

    tag = re.match(r"[A-Za-z][\w-]*|\*?", selector)[0]
    classes = re.findall(r"\.([\w-]+)", selector)
    ids = re.findall(r"#([\w-]+)", selector)
    attrs = re.findall(r"\[([\w-]+)(?:=[\"']?([^\"'\]]*)[\"']?)?\]", selector)

    def matches(n: Node) -> bool:
        own = n.attrs.get("class", "").split()
        return (tag in ("", "*") or n.tag == tag.lower()) and all(c in own for c in classes) and all(n.attrs.get("id") == i for i in ids) and all(k in n.attrs and (not v or n.attrs[k] == v) for k, v in attrs)

    return matches


def select(root: Node, selector: str) -> list[Node]:
    """Nodes of a selector of descendants and children (``a b > c``), in document order; commas give alternatives."""
    found: list[Node] = []
    for one in selector.split(","):
        steps, child = [], False
        for part in one.replace(">", " > ").split():
            if part == ">":
                child = True
            else:
                steps.append((_simple(part), child))
                child = False

        def fits(n: Node | None, k: int, steps=steps) -> bool:
            if n is None or not steps[k][0](n):
                return False
            if k == 0:
                return True
            up = n.parent
            if steps[k][1]:
                return fits(up, k - 1)
            while up is not None:
                if fits(up, k - 1):
                    return True
                up = up.parent
            return False

        if steps:
            found += [n for n in root.walk() if fits(n, len(steps) - 1) and n not in found]
    return found


def field(node: Node, selector: str) -> str | None:
    """``css`` gives the text, ``css@attr`` an attribute; an empty selector is the node itself."""
    css, _, attribute = selector.partition("@")
    if css.strip():
        hits = select(node, css.strip())
        if not hits:
            return None
        node = hits[0]
    value = node.attrs.get(attribute) if attribute else node.text()
    return " ".join(value.split()) or None if value is not None else None


@udtf(returnType="position: int, title: string, link: string, summary: string, date_text: string")
class ListingItems:
    """Items of a page by selectors: a DOM is walked in Python, for Spark has none."""

    def eval(self, html: str, list_selector: str, title: str, link: str, summary: str, date: str, max_items: int):
        for k, node in enumerate(select(parse(html), list_selector)[:max_items]):
            head = field(node, title or "")
            if not head:
                continue
            href = field(node, link) if link else None
            if not href:
                anchor = next((n for n in node.walk() if n.tag == "a" and n.attrs.get("href")), None)
                href = anchor.attrs["href"] if anchor else None
            yield k, head, href, field(node, summary) if summary else None, field(node, date) if date else None


def listing_items(pages: DataFrame, selectors: dict[str, str], max_items: int = MAX_ITEMS) -> DataFrame:
    """Items of ``pages`` (source, url, body) by one source's selectors."""
    args = [F.lit(selectors["list"]), F.lit(selectors.get("title", "")), F.lit(selectors.get("link", "")), F.lit(selectors.get("summary", "")), F.lit(selectors.get("date", "")), F.lit(max_items)]
    found = pages.lateralJoin(ListingItems(F.col("body").outer(), *args))
    return _finished(found.select("source", F.col("url").alias("page_url"), "position", "title", "link", "summary", "date_text"))


def _finished(items: DataFrame) -> DataFrame:
    """Titles cleaned; links made absolute against their page, without fragments and tracking."""
    origin = F.concat(F.try_parse_url("page_url", F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url("page_url", F.lit("AUTHORITY")))
    folder = F.regexp_replace(F.regexp_replace("page_url", r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    link = F.trim("link")
    absolute = (
        F.when(link.isNull() | (link == ""), F.col("page_url")).when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.try_parse_url("page_url", F.lit("PROTOCOL")), F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, link)).otherwise(F.concat(folder, F.lit("/"), link))
    )
    return items.withColumns({"title": clean_text(F.col("title")), "summary": clean_text(F.col("summary")), "url": canonical_feed_url(absolute)}).where("title is not null").drop("link", "page_url")


_ITEM = "struct<title:array<string>,link:array<struct<_VALUE:string,_href:string>>,description:array<string>,summary:array<string>,content:array<string>,encoded:array<string>,pubDate:array<string>,published:array<string>,updated:array<string>,date:array<string>>"
_FEED = f"channel struct<item:array<{_ITEM}>>, item array<{_ITEM}>, entry array<{_ITEM}>, _corrupt_record string"


def _feed(body: Column) -> Column:
    return F.from_xml(body, _FEED, {"ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "_VALUE"})


def feed_items(pages: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """Items of RSS, RDF or Atom bodies, parsed as XML in the JVM, namespaces dropped.

    Of several tags of one meaning the first in this order counts: description,
    summary, content, encoded; pubDate, published, updated, date. A body that is no
    XML has no items (``broken_feeds`` tells which).
    """
    parsed = pages.withColumn("feed", _feed(F.col("body")))
    none = F.array().cast(f"array<{_ITEM}>")
    entries = F.concat(*[F.coalesce(c, none) for c in ("feed.channel.item", "feed.item", "feed.entry")])
    each = parsed.select("source", F.col("url").alias("page_url"), F.posexplode(F.slice(entries, 1, max_items)).alias("position", "x"))
    bare = lambda c: F.trim(F.regexp_replace(c, r"(?s)<[^>]+>", " "))
    first = lambda *tags: F.coalesce(*[F.nullif(bare(F.get(f"x.{t}", F.lit(0))), F.lit("")) for t in tags])
    head = F.get("x.link", F.lit(0))
    link = F.coalesce(F.nullif(head["_href"], F.lit("")), F.nullif(F.trim(head["_VALUE"]), F.lit("")))
    return _finished(each.select("source", "page_url", "position", first("title").alias("title"), link.alias("link"), first("description", "summary", "content", "encoded").alias("summary"), first("pubDate", "published", "updated", "date").alias("date_text")))


def broken_feeds(pages: DataFrame) -> DataFrame:
    """source and url of bodies that are no XML: their source failed, though it was fetched."""
    return pages.where(F.col("body").isNull() | _feed(F.col("body"))["_corrupt_record"].isNotNull()).select("source", "url", F.lit("not XML").alias("problem"))


def pattern_items(pages: DataFrame, pattern: str, groups: dict[str, int], max_items: int = MAX_ITEMS) -> DataFrame:
    """Items by a pattern; ``groups`` gives the group numbers of title, link, summary and date."""
    p = "(?is)" + pattern
    column = lambda g: F.regexp_extract_all("body", F.lit(p), F.lit(groups[g])) if g in groups else F.transform(F.regexp_extract_all("body", F.lit(p), F.lit(0)), lambda _: F.lit(None).cast("string"))
    zipped = F.slice(F.arrays_zip(*[column(g).alias(g) for g in ("title", "link", "summary", "date")]), 1, max_items)
    each = pages.select("source", F.col("url").alias("page_url"), F.posexplode(zipped).alias("position", "z"))
    return _finished(each.select("source", "page_url", "position", "z.title", "z.link", "z.summary", F.col("z.date").alias("date_text")))


def readable_text(html: Column, limit: int = DETAIL_CHARS) -> Column:
    """The text of a page without scripts, styles and chrome, white space collapsed, cut at ``limit``."""
    text = html
    for tag in CHROME:
        text = F.regexp_replace(text, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->|<![^>]*>", " "), r"(?s)<[^>]+>", " ")
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit)


PDF = r"stat(\d{4})(\d{2})\.pdf"
LABEL = r"(\d{4})年(\d{1,2})月"


def newest_publication(pages: DataFrame, heading: str, window: int = 240) -> DataFrame:
    """The newest dated link after a heading (anywhere without it), with what is wrong with it, if anything."""
    at = F.instr("html", heading)
    region = F.when(at > 0, F.expr(f"substring(html, instr(html, '{heading}'))")).otherwise(F.col("html"))
    names = F.regexp_extract_all("region", F.lit(PDF), F.lit(0))
    best = F.array_max(F.transform(names, lambda n: F.struct(F.regexp_extract(n, PDF, 1).cast("int").alias("year"), F.regexp_extract(n, PDF, 2).cast("int").alias("month"), n.alias("href"))))
    found = pages.withColumn("region", region).withColumn("b", best)
    near = F.substring(F.expr("substring(region, instr(region, b.href) + length(b.href))"), 1, window)
    label = F.regexp_extract(near, LABEL, 0)
    agrees = (label == "") | ((F.regexp_extract(near, LABEL, 1).try_cast("int") == F.col("b.year")) & (F.regexp_extract(near, LABEL, 2).try_cast("int") == F.col("b.month")))
    problem = F.when(F.col("b").isNull(), "no link").when(~F.col("b.month").isin(3, 6, 9, 12), "not a quarter end").when(~agrees, "label disagrees")
    return found.select("url", "b.href", (F.col("b.year") * 4 + F.col("b.month") / 3).cast("int").alias("q_index"), problem.alias("problem"))


# The summary page's labels, the shape of its figures, its total in prose, its place, the height of a row.
FIGURES = {"land_ready": "已批出土地上可隨時動工的單位數目", "being_built": "建築中的單位數目", "built_not_sold": "已落成但未售出的單位數目"}
NUMBER = r"^[\d,]*\d$"
PRINTED_TOTAL = r"(?s)未來三至四年間.*?([\d,]+)\s*伙"
FIGURES_PAGE = 1
ROW_HEIGHT = 8.0


def figure_for_label(rows: DataFrame, page: list[str], label: str) -> DataFrame:
    """The first number to the right of a label in its row (``rows``: page columns, row, text, x0, x1)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*page, "row").orderBy("x0").rowsBetween(Window.unboundedPreceding, 0)
    prefix = F.array_join(F.collect_list("text").over(w), "")
    seen = rows.withColumn("__end", F.when(F.contains(prefix, F.lit(label)), F.col("x1")))
    ended = seen.withColumn("__from", F.min("__end").over(Window.partitionBy(*page, "row")))
    numbers = ended.where((F.col("x0") >= F.col("__from")) & F.col("text").rlike(NUMBER))
    return numbers.groupBy(*page).agg(F.regexp_replace(F.min_by("text", F.struct("row", "x0")), ",", "").cast("int").alias("figure"))


def summary_figures(words: DataFrame, document: list[str]) -> DataFrame:
    """The three figures of each document's summary page, and what is missing.

    ``words``: document columns, text, x0, x1, top, bottom. Words are put into visual
    rows by their centres; a figure is the first number to the right of its label, in
    the first row that holds the label.
    """
    from pyspark.sql import Window

    centre = (F.col("top") + F.col("bottom")) / 2
    w = Window.partitionBy(*document).orderBy("__centre", "x0")
    placed = words.withColumn("__centre", centre)
    placed = placed.withColumn("__new", F.when(F.col("__centre") - F.lag("__centre").over(w) > ROW_HEIGHT, 1).otherwise(0))
    placed = placed.withColumn("__row", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = placed.groupBy(*document, "__row").agg(F.sort_array(F.collect_list(F.struct("x0", "x1", "text"))).alias("__w"))
    rows = rows.withColumn("__t", F.transform("__w", lambda x: x["text"])).withColumn("__line", F.array_join("__t", ""))

    def figure(label: str) -> Column:
        done = F.filter(F.transform("__w", lambda x, i: F.when(F.contains(F.array_join(F.slice("__t", 1, i + 1), ""), F.lit(label)), x["x1"])), lambda x: x.isNotNull())
        right = F.filter("__w", lambda x: (x["x0"] >= F.get(done, F.lit(0))) & x["text"].rlike(NUMBER))
        number = F.regexp_replace(F.get(F.transform(right, lambda x: x["text"]), F.lit(0)), ",", "").try_cast("int")
        return F.min(F.when(F.contains("__line", F.lit(label)), F.struct(F.col("__row").alias("row"), number.alias("figure"))))

    per = rows.groupBy(*document).agg(*[figure(label).alias(name) for name, label in FIGURES.items()])
    missing = [F.when(F.col(n).isNull(), f"no label for {n}").when(F.col(f"{n}.figure").isNull(), f"no figure for {n}") for n in FIGURES]
    return per.select(*document, *[F.col(f"{n}.figure").alias(n) for n in FIGURES], F.nullif(F.concat_ws("; ", *missing), F.lit("")).alias("problem"))


def printed_total(text: Column) -> Column:
    """The total that the page states in a sentence; null where it states none."""
    return F.regexp_replace(F.regexp_extract(text, PRINTED_TOTAL, 1), ",", "").try_cast("int")


def pdf_words(files: DataFrame, page: int = FIGURES_PAGE) -> DataFrame:
    """The words of one page of landed PDF files (path, content); needs pdfplumber on driver and executors."""
    if importlib.util.find_spec("pdfplumber") is None:
        raise ModuleNotFoundError("pdf_words needs pdfplumber; word boxes from elsewhere go to summary_figures as they are")

    def words(batches):
        import io

        import pandas as pd
        import pdfplumber

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with pdfplumber.open(io.BytesIO(content)) as pdf:
                    found = pdf.pages[page].extract_words() if len(pdf.pages) > page else []
                yield pd.DataFrame([(path, x["text"], float(x["x0"]), float(x["x1"]), float(x["top"]), float(x["bottom"])) for x in found], columns=["path", "text", "x0", "x1", "top", "bottom"])

    return files.select("path", "content").mapInPandas(words, "path string, text string, x0 double, x1 double, top double, bottom double")
