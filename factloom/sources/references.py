"""What documents refer to: norms by section, identifiers and paths in texts, cells, signatories."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import normalize as N
from factloom.sources import gazette

#: Fixed values, folded: verbs of a prior appointment, and how a recital of norms opens.
APPOINTED = ("SE DESIGNA", "SE DESIGNO", "SE ENCARGA", "SE ENCARGO")
NORMATIVE = "DE CONFORMIDAD"
#: Limits of a signatory's lines and of all that follow the name.
LINE, TOTAL = 120, 380


def document_references(sections: DataFrame) -> DataFrame:
    """(document_id, relation, kind, number) of sections (document_id, order_index, type, text), once for each.

    SEEN in VISTOS, PRIOR_APPOINTMENT in recitals that tell of one, NORMATIVE in
    recitals that open with `De conformidad`. The spelling of the first place counts.
    """
    text = N.folded(F.col("text"))
    told = F.exists(F.array(*map(F.lit, APPOINTED)), lambda p: text.contains(p))
    relation = F.when(F.col("type") == "VISTOS", "SEEN").when((F.col("type") == "CONSIDERANDO") & text.startswith(NORMATIVE), "NORMATIVE").when((F.col("type") == "CONSIDERANDO") & told, "PRIOR_APPOINTMENT")
    x = sections.select("document_id", "order_index", relation.alias("relation"), F.posexplode(N.norm_citations(F.col("text"))).alias("place", "c")).where("relation is not null")
    key = ["document_id", "relation", F.lower("c.kind").alias("k"), F.upper("c.number").alias("n")]
    first = x.groupBy(*key).agg(F.min_by("c", F.struct("order_index", "place")).alias("c"))
    return first.select("document_id", "relation", "c.kind", "c.number")


def cells(text: Column) -> Column:
    """array of struct(cell, char_start, char_end) of a table row, whose cells ` | ` parts."""
    parts = F.split(text, r" \| ")
    before = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda n, p: n + F.length(p) + 3)
    return F.transform(parts, lambda p, i: F.struct(p.alias("cell"), before(i).alias("char_start"), (before(i) + F.length(p)).alias("char_end")))


def table_columns(header: Column) -> Column:
    """struct(name_at, identifier_at, organization_at): places of the columns a header row names, null where it names none."""
    labels = F.transform(F.split(header, r" \| "), N.folded)
    taken = F.transform(labels, lambda x: F.coalesce(*(F.when(F.exists(F.array(*map(F.lit, words)), lambda w: x.contains(w)), F.lit(kind)) for kind, words in gazette.COLUMNS)))
    at = lambda kind: F.nullif(F.array_position(taken, kind), F.lit(0)).cast("int") - 1
    return F.struct(*(at(kind).alias(f"{kind}_at") for kind, _ in gazette.COLUMNS))


def _rows(frame: DataFrame, key: str, columns: list[str], schema: str, f) -> DataFrame:
    """Rows (key, ...) of f(values of the columns), in Arrow batches."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = frame.schema[key].dataType.simpleString()
    full = f"`{key}` {kind}, {schema}"
    types = to_arrow_schema(StructType.fromDDL(full))

    def run(batches):
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(len(columns) + 1)]
            out = [(k, *row) for k, *values in zip(*cols, strict=True) for row in f(*values)]
            data = list(zip(*out, strict=True)) if out else [[]] * len(types.names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, types.types, strict=True)], types.names)

    return frame.select(key, *columns).mapInArrow(run, full)


def identifiers(texts: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """(key, scheme, value, char_start, char_end) of the labelled numbers in texts; with a name column, of those that belong to it."""
    found = (lambda text, who: gazette.identifiers_of(text or "", who or "")) if name else (lambda text: gazette.identifiers(text or ""))
    return _rows(texts, key, ["text", name] if name else ["text"], "scheme string, value string, char_start int, char_end int", found)


def paths(texts: DataFrame, key: str) -> DataFrame:
    """(key, role, unit, organization) of the posts in column text."""

    def split(text):
        role, units, body = gazette.path(text or "")
        return [(role, " > ".join(units) or None, body)]

    return _rows(texts, key, ["text"], "role string, unit string, organization string", split)


def unescaped(frame: DataFrame, key: str, column: str) -> DataFrame:
    """(key, text) with every character reference of a whole column decoded; null stays null."""
    return _rows(frame, key, [column], "text string", lambda x: [(None if x is None else html.unescape(x),)])


def signature_groups(lines: DataFrame, document: str, order: str) -> DataFrame:
    """(document, island, capacity): what follows each signatory's name, joined by commas.

    lines: (document, order, text, is_name). A line of more than LINE characters,
    one with a digit, or a total of more than TOTAL closes the group: nothing
    after it joins, not even a short line. Lines before the first name are left out.
    """
    w = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumn("island", F.sum(F.col("is_name").cast("int")).over(w)).where("island > 0")
    own = Window.partitionBy(document, "island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    closes = ~F.col("is_name") & ((F.length("text") > LINE) | F.col("text").rlike("[0-9]"))
    size = F.when(F.col("is_name"), 0).otherwise(F.length("text") + 2)
    x = x.withColumn("closed", F.max(closes.cast("int")).over(own)).withColumn("total", F.sum(size).over(own))
    keep = ~F.col("is_name") & (F.col("closed") == 0) & (F.col("total") - 2 <= TOTAL)
    got = x.groupBy(document, "island").agg(F.array_sort(F.collect_list(F.when(keep, F.struct(F.col(order).alias("o"), "text")))).alias("kept"))
    return got.select(document, "island", F.array_join(F.transform("kept", lambda s: s["text"]), ", ").alias("capacity"))
