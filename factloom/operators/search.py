"""Full-text search over an inverted table: terms, phrases, alternatives and exclusions.

Terms are words without accents, in lower case, reduced by a light suffix rule
for the source language. The inverted table has a row for each term of a text,
with its places; a query reads only the rows of its own terms. A query
`a "b c" or d -e` matches what satisfies any of its alternatives; rank is the sum
over terms of 1 + ln(occurrences), divided by 1 + ln(words). It is an ordering of
its own, not that of any database.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.normalize import strip_accents

#: Words that carry no meaning of their own.
STOP = ("a", "al", "con", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "o", "para", "por", "que", "se", "su", "un", "una", "y")


def terms(text: Column) -> Column:
    """Terms of a text in order, repeats and stop words included (the latter as empty, to keep places)."""
    words = F.filter(F.split(F.lower(strip_accents(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.when(w.isin(*STOP), F.lit("")).otherwise(stem(w)))


#: Endings that a term loses after three letters or more, the longest first.
ENDINGS = ("aciones", "acion", "mente", "es", "os", "as", "s", "o", "a", "e")


def stem(word: Column) -> Column:
    return F.regexp_replace(word, rf"(?<=\p{{L}}{{3}})(?:{'|'.join(ENDINGS)})$", "")


def query_terms(words: list[str]) -> list[tuple[int, str]]:
    """(place, term) of the words of a phrase, without stop words; the same terms as `terms` makes."""
    plain = "".join(c for c in unicodedata.normalize("NFD", " ".join(words)) if unicodedata.category(c) != "Mn").lower()
    out = []
    for k, w in enumerate(re.findall(r"[^\W_]+", plain)):
        if w not in STOP:
            ending = next((e for e in ENDINGS if w.endswith(e) and len(w) - len(e) >= 3 and w[: -len(e)][-3:].isalpha()), "")
            out.append((k, w[: len(w) - len(ending)]))
    return out


def parse(query: str) -> list[tuple[list[list[str]], list[str]]]:
    """Alternatives, each (phrases that must occur, words that must not)."""
    out, must, never = [], [], []
    for neg, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word.lower() == "or" and not neg:
            out.append((must, never))
            must, never = [], []
        elif neg:
            never += (quoted or word).split()
        else:
            must.append((quoted or word).split())
    return [(m, n) for m, n in [*out, (must, never)] if m]


def index(docs: DataFrame) -> DataFrame:
    """(term, doc_id, size, places) of documents (doc_id, text): the inverted table; size counts all words."""
    x = docs.select("doc_id", terms(F.col("text")).alias("terms"))
    each = x.select("doc_id", F.size("terms").alias("size"), F.posexplode("terms").alias("place", "term")).where("term <> ''")
    return each.groupBy("term", "doc_id", "size").agg(F.array_sort(F.collect_list("place")).alias("places"))


def search_index(postings: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """(doc_id, rank) of the documents of an inverted table that match, best first, ties by id; limit only cuts the report."""
    wanted = [([query_terms(p) for p in must], [query_terms([w]) for w in never]) for must, never in parse(query)]
    wanted = [([p for p in must if p], [p for p in never if p]) for must, never in wanted]
    wanted = [(must, never) for must, never in wanted if must]
    used = sorted({w for must, _ in wanted for p in must for _, w in p})
    read = sorted({w for must, never in wanted for p in [*must, *never] for _, w in p})
    rows = postings.where(F.col("term").isin(*read)) if read else postings.where(F.lit(False))
    x = rows.groupBy("doc_id", "size").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at"))
    places = lambda w: F.coalesce(F.col("at")[w], F.array().cast("array<int>"))

    def stands(phrase: list[tuple[int, str]]) -> Column:
        (first, head), *rest = phrase
        together = F.lit(True)
        if not rest:
            return F.size(places(head)) > 0

        def follows(p: Column) -> Column:
            out = together
            for k, w in rest:
                out = out & F.array_contains(places(w), p + (k - first))
            return out

        return F.exists(places(head), follows)

    matched = F.lit(False)
    for must, never in wanted:
        ok = F.lit(True)
        for phrase in must:
            ok = ok & stands(phrase)
        for phrase in never:
            ok = ok & ~stands(phrase)
        matched = matched | ok
    count = lambda w: F.size(places(w)).cast("double")
    score = sum((F.when(count(w) > 0, 1 + F.log(count(w))).otherwise(0.0) for w in used), F.lit(0.0)) / (1 + F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")))
    out = x.where(matched).select("doc_id", score.alias("rank")).orderBy(F.desc("rank"), "doc_id")
    return out.limit(limit) if limit else out


def search(docs: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """The same over documents (doc_id, text) whose inverted table is not kept."""
    return search_index(index(docs), query, limit)


#: Passages of one or two words that are looked for in one pass over the texts.
BLOCK = 500


def quoting(docs: DataFrame, doc_key: str, passages: DataFrame, key: str) -> DataFrame:
    """(doc_key, key) of every document that holds a passage literally, from (doc_key, text) and (key, text).

    A passage of three words or more meets texts on its longest inner word, which
    stands whole in them; shorter ones are looked for in blocks. Null and empty
    passages are in no document.
    """
    words = lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")
    p = passages.select(key, F.col("text").alias("passage"), words(F.col("text")).alias("parts")).where("size(parts) > 0")
    inner = F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    long_ = p.where("size(parts) > 2").select(key, "passage", longest["w"].alias("word"))
    d = docs.select(doc_key, "text").where("text is not null")
    hit = d.select(doc_key, F.explode(F.array_distinct(words(F.col("text")))).alias("word")).join(long_, "word").select(F.col(doc_key).alias("of"), key, "passage").distinct()
    found = d.join(hit, F.col(doc_key) == F.col("of")).where(F.col("text").contains(F.col("passage"))).select(doc_key, key)
    short = p.where("size(parts) <= 2").select(key, "passage").distinct().collect()
    for at in range(0, len(short), BLOCK):
        block = F.array(*(F.struct(F.lit(r[key]).alias(key), F.lit(r["passage"]).alias("passage")) for r in short[at : at + BLOCK]))
        own = d.select(doc_key, F.explode(F.filter(block, lambda r: F.col("text").contains(r["passage"]))).alias("r"))
        found = found.unionByName(own.select(doc_key, F.col(f"r.{key}").alias(key)))
    return found.distinct()
