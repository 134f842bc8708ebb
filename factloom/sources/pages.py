"""Scans of captured pages: addresses, typed sections, articles and listings."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIDDEN = {"script", "style", "noscript", "template", "head"}
BLOCK = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "table", "article", "section", "ul", "ol", "br", "blockquote", "header", "footer", "nav", "main", "body"}
CLOSING = re.compile(r"^(?:Reg[íi]strese|Comun[íi]quese|Publ[íi]quese)", re.I)
MARKERS = (("VISTOS", re.compile(r"^VISTO[S]?\b", re.I)), ("CONSIDERANDO", re.compile(r"^CONSIDERANDO\b", re.I)), ("RESOLVE", re.compile(r"^SE\s+(?:RESUELVE|DECRETA)\b", re.I)))
ARTICLE = re.compile(r"^Art[íi]culo\s+\S+", re.I)
#: Least characters of a paragraph of an article's body.
PARAGRAPH = 25


class Blocks(HTMLParser):
    """Visible text of a page, block by block; a table row is one block with its cells parted by ` | `."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.text, self.tag, self.hidden, self.row = [], "p", 0, None

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if self.row is not None:
            if text:
                self.row.append(text)
        elif text:
            self.out.append((self.tag, text))

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += tag != "head"
        elif tag in BLOCK:
            self.flush()
            if tag == "tr":
                self.row = []
            self.tag = tag

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - (tag != "head"))
        elif tag in BLOCK:
            self.flush()
            if tag == "tr" and self.row is not None:
                cells, self.row = self.row, None
                if cells:
                    self.out.append(("tr", " | ".join(cells)))
            self.tag = "p"

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def blocks(html: str | None) -> list[tuple[str, str]]:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.out


def sections(html: str | None) -> list[tuple[str, str | None, str]]:
    """(type, label, text) in order: a state walks from the header over the grounds to the articles and the closing."""
    state, out = "HEADER", []
    for tag, text in blocks(html):
        marker = next((name for name, rule in MARKERS if rule.match(text)), None)
        if tag == "h1":
            out.append(("TITLE", None, text))
        elif marker and state != "CLOSING":
            state = marker
            out.append((f"{marker}_MARKER", None, text))
        elif CLOSING.match(text) and state in ("RESOLVE", "ARTICLE"):
            state = "CLOSING"
            out.append(("CLOSING", None, text))
        elif state in ("RESOLVE", "ARTICLE") and (m := ARTICLE.match(text)):
            state = "ARTICLE"
            out.append(("ARTICLE", m[0].rstrip(".-:"), text))
        elif tag == "tr":
            out.append(("TABLE_ROW", None, text))
        elif state == "ARTICLE" and (tag == "li" or text.startswith(("-", "–", "•"))):
            out.append(("LIST_ITEM", None, text))
        elif state == "CLOSING":
            out.append(("SIGNATURE", None, text))
        else:
            out.append(({"HEADER": "HEADER", "VISTOS": "SEEN", "CONSIDERANDO": "RECITAL", "RESOLVE": "PARAGRAPH", "ARTICLE": "ARTICLE_BODY"}[state], None, text))
    return out


def page_sections(pages: DataFrame) -> DataFrame:
    """(page_id, order_index, type, label, text) of (page_id, html); a page without text gives no rows."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = [(i, k, *s) for i, html in zip(*(b.column(c).to_pylist() for c in (0, 1)), strict=True) for k, s in enumerate(sections(html))]
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], ["page_id", "order_index", "type", "label", "text"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, order_index int, type string, label string, text string")


LD = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", re.S | re.I)
META = re.compile(r"<meta[^>]+property=[\"']og:title[\"'][^>]+content=[\"']([^\"']*)", re.I)
TITLE = re.compile(r"<title[^>]*>(.*?)</title>", re.S | re.I)


def article(html: str | None) -> dict:
    """Headline by structured data, then metadata, then title; body paragraphs once each; how much of it there is."""
    from html import unescape

    html = html or ""
    headline, dated, paid = None, None, False
    for found in LD.findall(html):
        try:
            data = json.loads(found)
        except ValueError:
            continue
        for node in data if isinstance(data, list) else [data]:
            if isinstance(node, dict) and node.get("headline"):
                headline, dated, paid = str(node["headline"]), node.get("datePublished"), node.get("isAccessibleForFree") in (False, "False", "false")
                break
    for rule in (META, TITLE):
        if headline is None and (m := rule.search(html)):
            headline = m[1]
    iso = re.match(r"\d{4}-\d{2}-\d{2}", str(dated or ""))
    body = list(dict.fromkeys(t for tag, t in blocks(html) if tag == "p" and len(t) >= PARAGRAPH))
    return {"headline": " ".join(unescape(headline).split()) if headline else None, "headline_markup": headline, "published_on": iso[0] if iso else None, "paragraphs": body, "body_scope": "METADATA_ONLY" if not body else "PARTIAL_PAYWALL" if paid else "FULL"}


def web_articles(pages: DataFrame) -> DataFrame:
    """(page_id, headline, headline_markup, published_on, paragraphs, body_scope) of (page_id, html); the markup is the headline as the page holds it."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            got = [article(h) for h in b.column(1).to_pylist()]
            col = lambda k, t: pa.array([g[k] for g in got], t)
            yield pa.RecordBatch.from_arrays([b.column(0), col("headline", pa.string()), col("headline_markup", pa.string()), col("published_on", pa.string()), col("paragraphs", pa.list_(pa.string())), col("body_scope", pa.string())], ["page_id", "headline", "headline_markup", "published_on", "paragraphs", "body_scope"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, headline string, headline_markup string, published_on string, paragraphs array<string>, body_scope string")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))


def allowed(pages: DataFrame, publishers: DataFrame, vetoes: DataFrame) -> DataFrame:
    """Pages of a listed publisher (domain or its subdomain) and of no vetoed (domain, path prefix).

    publishers: (domain); vetoes: (domain, prefix). A host meets the lists on each
    of its suffixes, by equi-joins.
    """
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"^$", "/")
    labels = F.split(host(F.col("url")), r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    x = pages.select("page_id", path.alias("path"), suffix.alias("domain"))
    bad = x.join(vetoes, "domain").where(F.col("path").startswith(F.col("prefix"))).select("page_id").distinct()
    return x.join(publishers.select("domain"), "domain").select("page_id").distinct().join(bad, "page_id", "left_anti")


def reference_parts(x: Column) -> Column:
    """struct(series, code) of a page address `.../<series>/<code>` or a bare code; nulls otherwise."""
    series, code = F.regexp_extract(x, r"^https?://[^/]+/([a-z]{2})/(\d+)", 1), F.regexp_extract(x, r"(?:^|/)(\d+)(?:[?#].*)?$", 1)
    return F.struct(F.when(series != "", series).alias("series"), F.when(code != "", code).alias("code"))


def first_entries(entries: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first occurrence of each key; fails where a declared total (column `declared`, if any) differs."""
    from pyspark.sql import Window

    out = entries.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
    if "declared" not in entries.columns:
        return out
    total = out.agg(F.count(F.lit(1)).alias("_n"))
    return out.crossJoin(F.broadcast(total)).where(F.assert_true(F.col("_n") == F.col("declared"), F.lit("entries found differ from the declared total")).isNull()).drop("_n")
