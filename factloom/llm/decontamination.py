"""Benchmark decontamination with SimHash over item-sized windows, in DataFrame functions only.

Texts become lower-case words of letters and digits. Any window that reaches the
similarity s shares at least s / (1 + s) of both's shingles with its item, so
windows as long as an item are laid at every start from which the text has as
many of that item's shingles, whatever their order. Each distinct window, found
in however many documents, gets a 64-bit SimHash of its shingles, repeats
included, and so does each distinct item.

Candidates come from a multi-index of the fingerprints alone: they are cut into
BLOCKS blocks, and of two fingerprints within RADIUS bits some block differs in
at most RADIUS // BLOCKS bits. The index holds each item under all such values
of its blocks, a window looks up its own, and all pairs within the radius are
found. They are verified by the exact weighted Jaccard similarity of the
shingles (the sum of the lesser over the sum of the greater counts).

While the benchmark has at most `LITERAL_SHINGLES` distinct shingles, counted
first, each text is searched where it is read, against a hashed set of literals,
and only texts with a shared shingle go on. Beyond that the distinct shingles of
the texts are joined with the benchmark's by their hashes. Explodes here are
outer, with nulls dropped after, and the few windows and pairs are checkpointed:
Spark would else push filters down and repeat the splitting of a text for each
of its words, or the making of a fingerprint for each of its bits.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import saved, table

SHINGLE = 5
SIMILARITY = 0.8
#: At similarity 0.8 the expected distance is below 10 bits with a deviation of 2.9.
RADIUS, BLOCKS = 17, 6
LITERAL_SHINGLES = 20_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(array: str, size: str) -> str:
    """SQL of the shingles of a word array; the whole array where it is shorter; none without words."""
    return f"if(size({array}) = 0, array(), transform(sequence(1, greatest(1, size({array}) - {size} + 1)), i -> slice({array}, i, {size})))"


def fingerprint(hashes: str) -> str:
    """SQL of the SimHash of an array of hashes: a bit is set where over half of them have it set."""
    return (
        f"aggregate(sequence(0, 63), 0L, (f, b) -> f | if(2 * size(filter({hashes}, h -> (shiftright(h, b) & 1L) = 1L)) > size({hashes}), shiftleft(1L, b), 0L))"
    )


def cuts() -> list[tuple[int, int]]:
    """First bit and width of each block of a fingerprint."""
    ends = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def blocks(fp: Column) -> Column:
    """The fingerprint's blocks, each as its number above its bits."""
    return F.array(*(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(k << 32)) for k, (at, width) in enumerate(cuts())))


def around(fp: Column) -> Column:
    """Each block with every value that differs in at most RADIUS // BLOCKS bits."""
    near = [[k, mask] for k, (_, width) in enumerate(cuts()) for r in range(RADIUS // BLOCKS + 1) for mask in map(sum, combinations([1 << i for i in range(width)], r))]
    flips = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(mask).cast("long").alias("mask")) for k, mask in near))
    own = blocks(fp)
    return F.transform(flips, lambda x: F.element_at(own, x["k"] + 1).bitwiseXOR(x["mask"]))


def weighted_similarity(a: str, b: str) -> str:
    """SQL of the weighted Jaccard similarity of two arrays of shingles."""
    count = lambda x: f"cast(size(filter({x}, s -> s = e)) as double)"
    both = f"array_union({a}, {b})"
    low, high = (f"aggregate({both}, 0D, (t, e) -> t + {f}({count(a)}, {count(b)}))" for f in ("least", "greatest"))
    return f"{low} / {high}"


def with_fingerprint(df: DataFrame, array: str, out: str) -> DataFrame:
    """Adds the shingles of a word array as `<out>_shingles` and their fingerprint as `<out>_fp`."""
    df = df.withColumn(f"{out}_shingles", F.expr(shingles(array, str(SHINGLE))))
    df = df.withColumn(f"{out}_hashes", F.expr(f"transform({out}_shingles, s -> xxhash64(s))"))
    return df.withColumn(f"{out}_fp", F.expr(fingerprint(f"{out}_hashes"))).drop(f"{out}_hashes")


def hits(texts: DataFrame, hashes: list[int], k: int) -> DataFrame:
    """Adds the places (from 1) of the k-word shingles whose hash is in a bounded list."""
    known = ", ".join(f"{h}L" if h > -(1 << 63) else "(-9223372036854775807L - 1L)" for h in hashes)
    return texts.withColumn("hits", F.expr(f"if(size(words) < {k}, array(), filter(sequence(1, size(words) - {k - 1}), i -> xxhash64(slice(words, i, {k})) in ({known})))"))


def hits_by_join(texts: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """The same for a benchmark of any size: the texts' distinct shingles meet the benchmark's in a shuffle."""
    every = texts.withColumn("hashes", F.expr(f"if(size(words) < {k}, array(), transform(sequence(1, size(words) - {k - 1}), i -> xxhash64(slice(words, i, {k}))))"))
    own = every.select(F.col("doc_id").alias("hit_id"), F.explode_outer(F.array_distinct("hashes")).alias("hash")).where("hash is not null")
    shared = own.join(places.select("hash").distinct(), "hash", "left_semi").groupBy("hit_id").agg(F.collect_set("hash").alias("shared"))
    back = every.join(shared, F.col("doc_id").eqNullSafe(F.col("hit_id")))
    return back.select("doc_id", "words", F.expr("transform(filter(transform(hashes, (h, i) -> struct(h, i + 1 as i)), x -> array_contains(shared, x.h)), x -> x.i)").alias("hits"))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, start_word) of each document that holds a window like an item.

    docs: (doc_id, text); benchmark: (item_id, text). similarity is that of the
    best window, start_word its first word (from 0), the earliest of equal ones.
    Null and empty texts and items without a word match nothing. Items of fewer
    than five words are one shingle. Rows that repeat a doc_id or item_id are
    taken together; null ids are ids like others. Other columns are ignored.
    """
    named = saved(benchmark.select("item_id", words(F.col("text")).alias("item")).where("size(item) > 0").withColumn("key", F.xxhash64("item")))
    items = named.dropDuplicates(["key"]).select("key", "item", F.size("item").alias("n"), F.least(F.size("item"), F.lit(SHINGLE)).alias("k"))
    items = saved(with_fingerprint(items, "item", "item"))
    places = saved(items.select("key", "n", "k", F.explode(F.array_distinct(F.expr("transform(item_shingles, s -> xxhash64(s))"))).alias("hash")))
    hashes = [r["hash"] for r in places.select("hash").distinct().limit(LITERAL_SHINGLES + 1).collect()]
    bounded = len(hashes) <= LITERAL_SHINGLES and places.count() <= 4 * LITERAL_SHINGLES
    texts = docs.select("doc_id", words(F.col("text")).alias("words"))
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most five
    found = None
    for k in sizes:
        own = places.where(F.col("k") == k).select("key", "n", "hash")
        hit = hits(texts, hashes, k) if bounded else hits_by_join(texts, own, k)
        at = hit.select("doc_id", "words", "hits", F.posexplode_outer("hits").alias("nth", "at")).where("at is not null").withColumn("hash", F.expr(f"xxhash64(slice(words, at, {k}))"))
        met = at.join(F.broadcast(own) if bounded else own, "hash")
        met = met.withColumn("own", F.least(F.col("n"), F.size("words")) - k + 1)
        met = met.withColumn("need", F.greatest(F.lit(1), F.ceil(similarity / (1 + similarity) * (F.col("own") + F.col("n") - k + 1) - 1e-9).cast("int")))
        # starts of windows whose first hit of the item this is: what comes before leaves room for `need` hits, and so many end inside
        last = F.try_element_at("hits", F.col("nth") + F.col("need"))
        met = met.withColumn("low", F.greatest(F.lit(0), F.col("at") - 1 - F.col("own") + F.col("need"), last - F.col("own")))
        met = met.withColumn("high", F.least(F.col("at") - 1, F.greatest(F.lit(0), F.size("words") - F.col("n"))))
        met = met.where(last.isNotNull() & (F.col("low") <= F.col("high"))).withColumn("start", F.explode(F.sequence("low", "high")))
        met = met.select("doc_id", "start", F.slice("words", F.col("start") + 1, F.col("n")).alias("window"))
        found = met if found is None else found.unionByName(met)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, similarity double, start_word int")
    found = saved(found.withColumn("window_key", F.xxhash64("window")))
    laid = found.select("doc_id", "start", "window_key").distinct()
    windows = saved(with_fingerprint(found.select("window_key", "window").dropDuplicates(["window_key"]), "window", "window").select("window_key", "window_shingles", "window_fp"))
    index = items.select(F.col("key").alias("near_key"), "item_fp", F.explode(around(F.col("item_fp"))).alias("item_block"))
    looked = windows.select(F.col("window_key").alias("near_window"), "window_fp", F.explode(blocks(F.col("window_fp"))).alias("block"))
    near = F.bit_count(F.col("window_fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS
    pairs = looked.join(index, (F.col("block") == F.col("item_block")) & near).select("near_window", "near_key").distinct()
    pairs = pairs.join(windows, F.col("near_window") == F.col("window_key")).join(items.select("key", "item_shingles"), F.col("near_key") == F.col("key"))
    pairs = saved(pairs.select("near_window", "near_key", "window_shingles", "item_shingles"))
    scored = pairs.select("near_window", "near_key", F.expr(weighted_similarity("window_shingles", "item_shingles")).alias("similarity")).where(F.col("similarity") >= similarity)
    best = laid.join(scored, F.col("window_key") == F.col("near_window")).groupBy("doc_id", "near_key").agg(F.max(F.struct("similarity", -F.col("start"))).alias("best"))
    of = named.select("item_id", F.col("key").alias("of_key")).distinct()
    return best.join(of, F.col("near_key") == F.col("of_key")).groupBy("doc_id", "item_id").agg(F.max("best").alias("best")).select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.col2")).alias("start_word"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark passage, with exactly their columns.

    Null and empty texts stay, and repeated rows stay or go together: a row goes
    if any row of its doc_id (null counts as an id) holds a passage. Without
    documents no rows, without items all rows.
    """
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("leaking_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["leaking_id"]), "left_anti")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
