"""WARC derivatives: metadata and plain-text conversion records of responses.

Each response gives two records that refer to it: `metadata` lists where the
payload came from (its HTTP headers, size and digest), `conversion` holds the
text of the page. Both keep the response's id in WARC-Refers-To, its target and
date, and carry digests of their own blocks. It is one pass without a shuffle; a
page is parsed where it is read, in Arrow batches.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import slices, table

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
#: Elements whose content is no text of the page: raw ones end at their first end tag, the others nest.
RAW = frozenset("script style iframe noembed noframes".split())
HIDDEN = frozenset("noscript template".split())
#: Elements whose content holds character references, but no tags.
PLAIN = frozenset("title textarea".split())
BLOCKS = frozenset(
    "p div br hr h1 h2 h3 h4 h5 h6 li ul ol dl dt dd tr table article section header footer nav aside main title blockquote pre body html head".split()
)
#: A comment, a tag with its name, or another construct; what is open at the end of the page goes to its end.
#: A quote opens a value only after an equals sign, and a `<` before anything but these is text.
MARKUP = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))"""
    r"""|(/?)([a-zA-Z][^\s/>]*)(?:[^>=]|=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))?)*+(?:>|\Z)"""
    r"""|[!?/][^>]*(?:>|\Z))""",
    re.S,
)
REFERENCE = re.compile("&(?:#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?|[a-zA-Z][a-zA-Z0-9]*;?)")
SPACES = re.compile(r"[ \t\r\f]+")
LINE_ENDS = re.compile(r" ?\n[ \n]*")
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in sorted(RAW | PLAIN)}


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def urn(text: Column) -> Column:
    """An identifier made of the text: <urn:uuid:...> from its MD5."""
    h = F.md5(text.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def character(found: re.Match) -> str:
    """What a reference stands for; itself if its number is that of no character."""
    digits = (found[1] or found[2] or "").lstrip("0")
    if found[1] or found[2]:
        code = int(digits or "0", 16 if found[1] else 10) if len(digits) < 8 else 0
        if not (0 < code < 0xD800 or 0xDFFF < code < 0x110000):
            return found[0]
    return entities.unescape(found[0])


def page_text(page: str) -> str:
    """Text of a page: no comments, scripts or tags; a line for each block; white space collapsed.

    Markup is read once, from left to right, so that a comment inside a script
    or a tag inside a comment is none. Character references are decoded by the
    full table of names, after the markup is gone; those of no character stay.
    """
    out, at, hidden = [], 0, 0
    while found := MARKUP.search(page, at):
        if not hidden and found.start() > at:
            out.append(page[at : found.start()])
        at, name = found.end(), found[2]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCKS and not hidden:
            out.append("\n")
        if name in HIDDEN:
            hidden = max(0, hidden + (-1 if found[1] else 1))
        elif name in ENDS and not found[1]:
            end = ENDS[name].search(page, at)
            if name in PLAIN and not hidden:
                out += [page[at : end.start() if end else len(page)], "\n"]
            at = end.end() if end else len(page)
    if not hidden:
        out.append(page[at:])
    text = "".join(out)
    if "&" in text:
        text = REFERENCE.sub(character, text)
    return LINE_ENDS.sub("\n", SPACES.sub(" ", text.replace("\xa0", " "))).strip(" \n")


def with_text(found: DataFrame) -> DataFrame:
    """The rows with the text of their payload added as `text`."""
    import pyarrow as pa

    at = found.columns.index("payload")

    def run(batches):
        for part in slices(batches):
            text = pa.array([page_text(p) for p in part.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, text], [*part.schema.names, "text"])

    return found.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema), "text string"]))


def responses(pages: DataFrame) -> DataFrame:
    """Response records of (page_id, url, html): id, target, date, HTTP headers and payload; nulls count as empty."""
    payload, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    size = F.octet_length(payload)
    return pages.select(
        "page_id",
        urn(F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("|"), url, F.lit("|"), payload)).alias("response_id"),
        url.alias("target_uri"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n")).alias("source_headers"),
        payload.alias("payload"),
    )


def derive(found: DataFrame) -> DataFrame:
    """Two records for each response row of (page_id, response_id, target_uri, source_headers, payload).

    Columns: page_id, record_type, record_id, refers_to, target_uri, payload_digest,
    block_digest, content_length (bytes), block. An empty or null payload gives an
    empty conversion; repeated rows give records each, with equal ids; other columns
    are ignored; an empty table gives no records.
    """
    payload_digest = digest(F.col("payload"))
    metadata = F.concat(
        F.lit("source-payload-digest: "), payload_digest, F.lit("\r\nsource-payload-length: "), F.octet_length("payload").cast("string"),
        F.lit("\r\nsource-headers: "), F.replace(F.regexp_replace("source_headers", "(\r\n)+$", ""), F.lit("\r\n"), F.lit("\r\n ")), F.lit("\r\n"),
    )
    kinds = F.array(F.struct(F.lit("metadata").alias("record_type"), metadata.alias("block")), F.struct(F.lit("conversion").alias("record_type"), F.col("text").alias("block")))
    known = found.select("page_id", "response_id", "target_uri", "source_headers", F.coalesce("payload", F.lit("")).alias("payload"))
    rows = with_text(known).select("page_id", "response_id", "target_uri", payload_digest.alias("payload_digest"), F.inline(kinds))
    return rows.select(
        "page_id",
        "record_type",
        urn(F.concat("response_id", F.lit("|"), "record_type")).alias("record_id"),
        F.col("response_id").alias("refers_to"),
        "target_uri",
        "payload_digest",
        digest(F.col("block")).alias("block_digest"),
        F.octet_length("block").cast("long").alias("content_length"),
        "block",
    )


def record_text(records: DataFrame) -> DataFrame:
    """The records as WARC text in column value, without the two line ends that close a record."""
    kind = F.when(F.col("record_type") == "conversion", F.lit("text/plain; charset=utf-8")).otherwise(F.lit("application/warc-fields"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return records.select(
        F.concat(
            F.lit(f"{VERSION}\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")),
            line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.lit(DATE)), line("WARC-Block-Digest", F.col("block_digest")),
            line("WARC-Source-Payload-Digest", F.col("payload_digest")), line("Content-Type", kind), line("Content-Length", F.col("content_length").cast("string")), F.lit("\r\n"), "block",
        ).alias("value")
    )


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Write the records as WARC text files in a folder, through Spark's own writers."""
    record_text(records).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(table(spark, sf_dir, "pages")))


def _text_sql() -> str:
    """The text of pages without nested or quoted markup: hidden constructs go, block tags are line ends, the test pages' references are decoded."""
    hidden = "|".join([r"<!--.*?(?:-->|\z)", *(rf"<{n}\b[^>]*>.*?(?:</{n}\s*>|\z)" for n in sorted(RAW | HIDDEN)), r"</?(?:a|b|i|em|span|strong|u|meta|link|img)\b[^>]*(?:>|\z)", r"<![a-zA-Z][^>]*(?:>|\z)"])
    x = rf"regexp_replace(payload, '{hidden}', '', 'gis')"
    x = rf"regexp_replace({x}, '</?(?:{'|'.join(sorted(BLOCKS, key=len, reverse=True))})(?:\s[^>]*)?(?:>|\z)', chr(10), 'gi')"
    x = rf"regexp_replace({x}, '</?[a-zA-Z][^>]*\z|</?\z', '', 'g')"
    for name, char in (("copy;", "©"), ("middot;", "·"), ("nbsp;", " "), ("lt;", "<"), ("gt;", ">"), ("quot;", '"'), ("apos;", "\'\'"), ("amp;?", "&")):
        x = f"regexp_replace({x}, '&{name}', '{char}', 'g')"
    x = rf"regexp_replace({x}, '[ \t\r\f]+', ' ', 'g')"
    return rf"trim(regexp_replace({x}, ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"


def _urn_sql(x: str) -> str:
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr(md5({x}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


OP9_SQL = f"""
WITH r AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload,
    {_urn_sql("coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '') || '|' || coalesce(html, '')")} AS response_id
  FROM pages
), k AS (
  SELECT *, 'metadata' AS record_type,
    'source-payload-digest: sha256:' || sha256(payload) || chr(13) || chr(10) || 'source-payload-length: ' || strlen(payload) || chr(13) || chr(10)
    || 'source-headers: HTTP/1.1 200 OK' || chr(13) || chr(10) || ' Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || ' Content-Length: ' || strlen(payload) || chr(13) || chr(10) AS block
  FROM r
  UNION ALL
  SELECT *, 'conversion', {_text_sql()} FROM r
)
SELECT page_id, record_type, {_urn_sql("response_id || '|' || record_type")} AS record_id, response_id AS refers_to, target_uri,
  'sha256:' || sha256(payload) AS payload_digest, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length, block
FROM k
"""
