"""SimHash near-duplicates by a grid range join over segment popcounts.

A 64-bit fingerprint is cut into 32 segments of two bits and mapped to the
vector of their bit counts (each 0, 1 or 2). The Manhattan distance of two such
vectors never exceeds the Hamming distance of the fingerprints, so a range join
under Manhattan distance finds every pair within a radius, and a check of the
bits themselves removes the rest.

The join is an equi-join on grid cells. Of the two halves of a vector one is
within half the radius, so within 2 for a radius of 4 or 5; a half enters its
own cell of the integer grid and those one step away, at most 33, and two halves
within 2 steps of each other always meet in a cell. Counts are kept in unary
(00, 01, 11), where a step flips one bit and a distance is a popcount, all in
generated JVM code. Equal fingerprints are one node, whatever their number.

A dense group would give all its pairs. So nodes first meet only one other, the
head of each of their cells: the one that most documents have, then one drawn
by a hash. What these links join is one root, and only nodes of still different
roots meet each other, so no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import id_type, saved, shuffles_dropped, slices, table
from factloom.llm.components import components

WORDS = 4
SEED = 42
RADIUS = 4
#: Rounds of links to heads before all nodes of different roots meet.
HEADS = 2
#: Bits of the even places of a long.
EVEN = 0x5555555555555555


def bit_votes(digests: bytes) -> np.ndarray:
    """How many of the 8-byte digests have each of the 64 bits set, highest bit first."""
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    total = np.zeros(64, np.int64)
    for at in range(0, len(rows), 65_280):
        bits = np.unpackbits(rows[at : at + 65_280], axis=1)
        total += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned SimHash of the text's word shingles, repeats included; 0 without a word."""
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    k = min(words, len(tokens))
    first, last = (ends - sizes)[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_digest
    votes = bit_votes(b"".join([digest(joined[a:b], seed) for a, b in zip(first, last, strict=True)]))
    return int.from_bytes(np.packbits(2 * votes > len(first)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) as a signed long for every row of (doc_id, text)."""
    import pyarrow as pa

    def run(batches):
        for part in slices(batches):
            fp = np.array([fingerprint(t, words, seed) for t in part.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, fp long")


def unary(fp: Column) -> Column:
    """Bit counts of the two-bit segments in unary: 00, 01 or 11."""
    shifted, even = F.shiftrightunsigned(fp, 1), F.lit(EVEN)
    some, all_ = fp.bitwiseOR(shifted).bitwiseAND(even), fp.bitwiseAND(shifted).bitwiseAND(even)
    return some.bitwiseOR(F.shiftleft(all_, 1))


def cells(counts: Column, steps: int) -> Column:
    """Grid cells of both halves: their own and, with one step, each neighbour; null where there is none.

    A cell is the half's number above its 32 bits. The low bit of a segment may
    flip while the high one is 0, the high bit while the low one is 1.
    """
    out = []
    for half in range(2):
        own = F.shiftrightunsigned(counts, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(half << 32))
        out.append(own)
        for i in range(0, 32 if steps else 0, 2):
            low, high = F.lit(1 << i), F.lit(2 << i)
            out.append(F.when(own.bitwiseAND(high) == 0, own.bitwiseXOR(low)))
            out.append(F.when(own.bitwiseAND(low) != 0, own.bitwiseXOR(high)))
    return F.array(*out)


def grid(nodes: DataFrame, radius: int) -> DataFrame:
    """Rows (fp, ...) in each of their cells; two fingerprints within the radius share one."""
    if not 0 <= radius <= 5:
        raise ValueError("the grid covers radii of 0 to 5 bits")
    steps = 1 if radius >= 2 else 0
    return nodes.select("*", F.explode(cells(unary(F.col("fp")), steps)).alias("cell")).where("cell is not null")


def near(a: Column, b: Column, radius: int) -> Column:
    """The Manhattan bound of the bit counts, then the bits themselves."""
    return (F.bit_count(unary(a).bitwiseXOR(unary(b))) <= radius) & (F.bit_count(a.bitwiseXOR(b)) <= radius)


def links_to_heads(nodes: DataFrame, radius: int, weight: Column) -> DataFrame:
    """Links (a, b) of roots: each node's and, within the radius, that of the weightiest node of each of its cells."""
    placed = grid(nodes, radius)
    heads = placed.groupBy(F.col("cell").alias("of")).agg(F.max(F.struct(weight.alias("weight"), "fp", "root")).alias("head"), F.min("root").alias("low"), F.max("root").alias("high"))
    heads = heads.where("low < high").select("of", F.col("head.fp").alias("head_fp"), F.col("head.root").alias("head_root"))
    met = placed.join(heads, (F.col("cell") == F.col("of")) & (F.col("root") != F.col("head_root")) & near(F.col("fp"), F.col("head_fp"), radius))
    return met.select(F.col("root").alias("a"), F.col("head_root").alias("b")).distinct()


def links_across(nodes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b), a < b, of roots that have nodes within the radius of each other, from rows (fp, root)."""
    placed = grid(nodes.select("fp", "root"), radius)
    closed = placed.groupBy(F.col("cell").alias("of")).agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("n > 1 and low = high").select("of")
    placed = placed.join(closed, F.col("cell") == F.col("of"), "left_anti")
    left, right = (placed.select("cell", F.col("root").alias(n), F.col("fp").alias(f"{n}_fp")) for n in "ab")
    return left.join(right, (left.cell == right.cell) & (F.col("a") < F.col("b")) & near(F.col("a_fp"), F.col("b_fp"), radius)).select("a", "b").distinct()


def joined(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The rows (fp, n, first_id, root) with roots replaced by the least root that the links reach."""
    found = components(links).select(F.col("node").alias("was"), F.col("root").alias("now"))
    return saved(nodes.join(found, F.col("root") == F.col("was"), "left").select("fp", "n", "first_id", F.coalesce("now", "root").alias("root")))


def near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of (doc_id, text); all links count, none is lost.

    component_id is the least doc_id reachable over links. Texts that are null,
    empty or without a word have fingerprint 0 and link like any other.
    Repeated rows keep a row each; null ids get a row, but never name a
    component unless it has no other. Other columns are ignored; an empty table
    gives no rows.
    """
    prints = saved(fingerprints(docs, words, seed))
    with shuffles_dropped(docs.sparkSession):
        nodes = grouped(prints, radius)
    least = nodes.groupBy("root").agg(F.min("first_id").alias("component_id")).select(F.col("root").alias("of"), "component_id")
    classes = nodes.join(least, F.col("root") == F.col("of")).select(F.col("fp").alias("class"), "component_id")
    return prints.join(classes, F.col("fp") == F.col("class")).select("doc_id", "fp", "component_id")


def grouped(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, n, first_id, root) of each distinct fingerprint of rows (doc_id, fp); root is the least that links reach."""
    nodes = saved(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).withColumn("root", F.col("fp")))
    for weight in (F.col("n"), *(F.xxhash64(F.lit(k), "fp") for k in range(HEADS - 1))):
        nodes = joined(nodes, links_to_heads(nodes, radius, weight))
    return joined(nodes, links_across(nodes, radius))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
