"""Listing pages of a day's edition: entries with guards.

An entry is a card: an `<article>` or `<li>` with a link to a publication. Its
code is the last number-like part of the link; a card whose text states another
code in its footer is not trusted. A page states the range of days and the total
it lists; both are returned on every entry so that a load can refuse the page.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODE = re.compile(r"(\d{5,}(?:-\d+)?)(?:[/?#].*)?$")
STATED = re.compile(r"\b(\d{5,}(?:-\d+)?)\b")
DAY = r"(\d{1,2}[./]\d{1,2}[./]\d{4})"
RANGE = re.compile(rf"(?:del?|desde)\s+{DAY}\s+(?:al|hasta)\s+{DAY}", re.I)
TOTAL = re.compile(r"(\d+)\s+(?:resultados|dispositivos|normas)", re.I)
LISTED = re.compile(DAY)


class Cards(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cards, self.open, self.all = [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "li"):
            self.open.append({"links": [], "text": [], "footer": [], "in_footer": False})
        elif self.open:
            if tag == "a" and (href := dict(attrs).get("href")):
                self.open[-1]["links"].append(href)
            elif tag == "footer":
                self.open[-1]["in_footer"] = True

    def handle_endtag(self, tag):
        if tag in ("article", "li") and self.open:
            self.cards.append(self.open.pop())
        elif tag == "footer" and self.open:
            self.open[-1]["in_footer"] = False

    def handle_data(self, data):
        self.all.append(data)
        if self.open:
            card = self.open[-1]
            card["footer" if card["in_footer"] else "text"].append(data)


def entries(html: str | None) -> list[tuple]:
    """(place, code, summary, listed_on, footer_agrees, range_from, range_to, total) of each card with a code, once a code."""
    parser = Cards()
    parser.feed(html or "")
    parser.close()
    page = " ".join(" ".join(parser.all).split())
    span, total = RANGE.search(page), TOTAL.search(page)
    out, seen = [], set()
    for card in parser.cards:
        code = next((m[1] for link in card["links"] if (m := CODE.search(link))), None)
        if code is None or code in seen:
            continue
        seen.add(code)
        text, footer = (" ".join(" ".join(card[k]).split()) for k in ("text", "footer"))
        stated, day = STATED.search(footer), LISTED.search(f"{text} {footer}")
        out.append((len(out), code, text, day[1] if day else None, stated is None or stated[1] == code, span[1] if span else None, span[2] if span else None, int(total[1]) if total else None))
    return out


def listing_entries(pages: DataFrame) -> DataFrame:
    """Entries of (page_id, html) with their guards; pages without cards give none."""
    import pyarrow as pa

    types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int32())
    names = ["page_id", "place", "code", "summary", "listed_on", "footer_agrees", "range_from", "range_to", "total"]

    def run(batches):
        for b in batches:
            rows = [(i, *e) for i, html in zip(*(b.column(c).to_pylist() for c in (0, 1)), strict=True) for e in entries(html)]
            cols = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    schema = "page_id long, place int, code string, summary string, listed_on string, footer_agrees boolean, range_from string, range_to string, total int"
    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, schema)


def refused(found: DataFrame, requested: str) -> DataFrame:
    """(page_id, reason) of pages whose range is not the requested day, whose total differs, or with a card that contradicts itself."""
    g = found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("total"), F.min("range_from").alias("a"), F.max("range_to").alias("b"), F.bool_and("footer_agrees").alias("ok"))
    reason = F.when((F.col("a") != requested) | (F.col("b") != requested), "other days").when(F.col("total") != F.col("n"), "total differs").when(~F.col("ok"), "card contradicts itself")
    return g.select("page_id", reason.alias("reason")).where("reason is not null")


#: Entries of a listing page, and pages after which a walk fails.
PAGE, PAGES = 20, 25


def page_walk(listings: DataFrame, key: str, total: str) -> DataFrame:
    """(key, starts, failed): the pages a walk over a listing of so many entries visits, in order; beyond PAGES pages it fails."""
    pages = F.ceil(F.col(total) / PAGE)
    starts = F.transform(F.sequence(F.lit(1), F.least(pages, F.lit(PAGES))), lambda i: (i - 1) * PAGE)
    return listings.select(key, F.when(pages > 0, starts).otherwise(F.array().cast("array<bigint>")).alias("starts"), (pages > PAGES).alias("failed"))
