"""Language-model scoring by deleted interpolation.

P(w | h) mixes the maximum-likelihood estimates of all orders, by default of the
trigram, the bigram and the word, with the uniform distribution. The weights
depend on the bucket of the frequency of the longest context that was seen, and
are learned by expectation-maximisation on held-out counts: one fold of the
training documents is deleted from the counts, and the rest's estimates are
mixed so as to make that fold likely. Scores then use the counts of all training
documents.

Counts are of the whole corpus and are held by no single task. Texts are read
once, where they lie, into blocks of at most `BLOCK` documents and about `TOKENS`
tokens: compressed arrays of word numbers, checkpointed in place of the texts. A
block asks for its distinct n-grams, an order after the other (64-bit hashes,
with its own counts), sorted and cut by ranges of the hash; each range adds up what all blocks
sent and answers every block with the totals of just its keys, in the order
asked. A key comes at most once from a block, so frequent words and copies load
no range more than others; there are as many ranges as keep about `KEYS` keys in
each, and a request holds a key at least. What was shuffled for the answers is
deleted when they are written. Only the held-out fold's histogram of quantised
estimates, bounded by its grid, reaches the driver.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import fold, id_type, saved, shuffles_dropped, slices, table

BLOCK, TOKENS = 3_000, 2_000_000
#: Keys of all blocks that a range adds up at a time, about 60 bytes each.
KEYS = 1 << 22
FOLDS, HELD_OUT, DELETED = 5, 1, 0
ORDER = 3
#: Frequency buckets of the contexts of one order: by powers of two, the last open.
CONTEXTS = 14
#: Steps of quantised logarithms to the base 2.
STEPS = 2
#: Levels of such a logarithm, with one for zero; the last is open.
LEVELS = 256
END, START = xxhash.xxh64_intdigest(b" end"), xxhash.xxh64_intdigest(b" start")


class Hashes(dict):
    """Hash of a word's bytes, computed once."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


class Block:
    """Tokens of a block's documents as numbers of its distinct words; each document ends with the end token."""

    def __init__(self, ids: list, sizes: np.ndarray, words: np.ndarray, word: np.ndarray):
        self.ids, self.sizes = ids, sizes
        self.first = np.cumsum(sizes) - sizes
        self.folds = np.array([-1 if (f := fold(i, FOLDS)) is None else f for i in ids], np.int64)
        # the words' keys also hold the start, counted once a document: the context of first tokens in every order
        self.words, self.word, self.start = words, word, int(np.searchsorted(words, np.uint64(START)))

    def grams(self, order: int):
        """(keys, place of each token's n-gram in them) of the orders from 1 to `order`, shortest first."""
        keys, of = self.words, self.word
        yield keys, of
        for n in range(2, order + 1):
            before = np.empty(len(of), np.uint64)
            before[1:] = keys[of[:-1]]
            before[self.first] = np.uint64(START)
            mixed = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (self.words[self.word] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(n))
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            keys, of = np.unique(mixed ^ (mixed >> np.uint64(29)), return_inverse=True)
            yield keys, of

    @classmethod
    def of_row(cls, ids: list, sizes: bytes, words: bytes, word: bytes) -> Block:
        return cls(ids, released(sizes), unpacked(zlib.decompress(words)), released(word))

    def counts(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of an order with their counts in the block's training documents."""
        for keys, of in self.grams(order):
            pass
        learned = (self.folds >= 0) & (self.folds != HELD_OUT)
        n = np.bincount(of[np.repeat(learned, self.sizes)], minlength=len(keys))
        if order == 1:
            n[self.start] = learned.sum()
        return keys, n


def squeezed(numbers: np.ndarray) -> bytes:
    """Small unsigned numbers as compressed byte planes."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def released(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as the byte planes of their differences, of which the high ones compress to nothing."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


class Gathering:
    """Documents on their way into a block."""

    def __init__(self):
        self.ids, self.sizes, self.tokens, self.known, self.total = [], [], [], Hashes(), 0

    def add(self, doc_id, text: str | None) -> None:
        known = self.known
        own = [known[w] for w in text.encode().lower().split()] if text else []
        own.append(END)
        self.ids.append(doc_id)
        self.sizes.append(len(own))
        self.tokens.append(np.array(own, np.uint64))
        self.total += len(own)

    def full(self) -> bool:
        return len(self.ids) >= BLOCK or self.total >= TOKENS

    def row(self) -> tuple:
        words, word = np.unique(np.concatenate([*self.tokens, [np.uint64(START)]]), return_inverse=True)
        return self.ids, self.total, squeezed(np.array(self.sizes)), zlib.compress(packed(words), 1), squeezed(word[:-1])


def blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, tokens, sizes, words, word) of all rows; the deleted fold has blocks of its own, below 0."""
    import pyarrow as pa

    doc_type = id_type(docs)

    def run(batches):
        base, n = TaskContext.get().partitionId() << 32, 0
        open_ = {False: Gathering(), True: Gathering()}

        def row(deleted: bool):
            nonlocal n
            block = base + n
            n += 1
            ids, tokens, *data = open_[deleted].row()
            open_[deleted] = Gathering()
            return pa.RecordBatch.from_arrays([pa.array([-1 - block if deleted else block], pa.int64()), pa.array([ids], pa.list_(id_kind)), pa.array([tokens], pa.int64()), *(pa.array([d], pa.binary()) for d in data)], ["block", "ids", "tokens", "sizes", "words", "word"])

        id_kind = pa.int64()
        for part in slices(batches):
            id_kind = part.column(0).type
            for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                deleted = fold(i, FOLDS) == DELETED
                open_[deleted].add(i, text)
                if open_[deleted].full():
                    yield row(deleted)
        for deleted, g in open_.items():
            if g.ids:
                yield row(deleted)

    return docs.select("doc_id", "text").mapInArrow(run, f"block long, ids array<{doc_type}>, tokens long, sizes binary, words binary, word binary")


def block_of(rows, i: int = 0) -> Block:
    return Block.of_row(*(rows.column(c)[i].as_py() for c in ("ids", "sizes", "words", "word")))


def requests(dealt: DataFrame, order: int, ranges: int) -> DataFrame:
    """(range, block, keys, counts): what each block asks of each range of hashes, for n-grams of one order."""
    import pyarrow as pa

    shift = np.uint64(64 - (ranges.bit_length() - 1))
    names = ["range", "block", "keys", "counts"]
    types = (pa.int32(), pa.int64(), pa.binary(), pa.binary())

    def ask(batches):
        for rows in slices(batches, 1):
            keys, n = block_of(rows).counts(order)
            name = rows.column("block")[0].as_py()
            cuts = np.searchsorted(keys >> shift, np.arange(ranges + 1, dtype=np.uint64)) if ranges > 1 else [0, len(keys)]
            out = [(r, name, packed(keys[a:b]), squeezed(n[a:b])) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return dealt.mapInArrow(ask, "range int, block long, keys binary, counts binary")


def answers(asked: DataFrame, order: int) -> DataFrame:
    """(block, kind, range, all, kept, sums): totals for each request, in its order of keys.

    all: of all training documents; kept: without the deleted fold, for that
    fold's blocks alone; sums: on one answer of each range of words the tokens
    and distinct words it holds, of the kept folds and of all, else zeros;
    kind: the order.
    """
    import pyarrow as pa

    def add(rows):
        parts = [unpacked(k) for k in rows.column("keys").to_pylist()]
        blocks = rows.column("block").to_numpy()
        keys, at = np.unique(np.concatenate(parts), return_inverse=True)
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        counts = np.concatenate([released(x) for x in rows.column("counts").to_pylist()])
        deleted = np.repeat(blocks < 0, [len(p) for p in parts])
        all_ = np.bincount(at, counts, len(keys)).astype(np.uint32)
        kept = all_ - np.bincount(at[deleted], counts[deleted], len(keys)).astype(np.uint32)
        sums = [[0, 0, 0, 0] for _ in parts]
        if order == 1:
            own = keys != np.uint64(START)
            sums[0] = [int(f(x[own])) for x in (kept, all_) for f in (lambda x: x.sum(dtype=np.int64), np.count_nonzero)]
        every = [squeezed(x) for x in np.split(all_[at], cuts)]
        some = [squeezed(kept[x]) if b < 0 else None for b, x in zip(blocks.tolist(), np.split(at, cuts), strict=True)]
        return pa.Table.from_arrays(
            [rows.column("block"), pa.array([order] * len(parts), pa.int32()), rows.column("range"), pa.array(every, pa.binary()), pa.array(some, pa.binary()), pa.array(sums, pa.list_(pa.int64()))],
            ["block", "kind", "range", "all", "kept", "sums"],
        )

    return asked.groupBy("range").applyInArrow(add, "block long, kind int, range int, all binary, kept binary, sums array<long>")


def told(rows, order: int, of: str) -> np.ndarray:
    """A block's totals of an order, `all` or `kept`, in the order of its keys."""
    mine = sorted((r, x) for k, r, x in zip(*(rows.column(c).to_pylist() for c in ("kind", "range", of)), strict=True) if k == order)
    return np.concatenate([released(x) for _, x in mine])


def bucket(context_count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context_count + 1).astype(np.int64), CONTEXTS - 1)


def estimates(block: Block, rows, of: str, n: int, order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Context bucket and maximum-likelihood estimates of each token, longest first, and the counts of its word.

    The bucket is that of the longest context that was seen: CONTEXTS buckets for
    each order, the longest last.
    """
    context, found, own, before = np.zeros(len(block.word), np.int64), [], None, None
    for k, (_, at) in enumerate(block.grams(order), 1):
        totals = told(rows, k, of)
        count = totals[at]
        if k == 1:
            own, start = count, totals[block.start]
            found.append(own / max(n, 1))
        else:
            seen = np.empty_like(count)
            seen[1:] = before[:-1]
            seen[block.first] = start
            found.append(count / np.maximum(seen, 1))
            context = np.where(seen > 0, (k - 2) * CONTEXTS + bucket(seen), context)
        before = count
    return context, found[::-1], own


def held_out_histogram(dealt: DataFrame, answered: DataFrame, n: int, order: int) -> DataFrame:
    """(context, levels, n): tokens of the deleted fold's blocks by context bucket and quantised estimates of the kept folds."""
    import pyarrow as pa

    def observe(docs, rows):
        none = pa.schema([("context", pa.int32()), ("levels", pa.int64()), ("n", pa.int64())]).empty_table()
        if not docs.num_rows or not rows.num_rows:
            return none
        context, found, _ = estimates(block_of(docs), rows, "kept", n, order)
        code = np.zeros(len(context), np.int64)
        for p in found:
            code = code * LEVELS + np.where(p > 0, np.minimum(np.round(-STEPS * np.log2(np.maximum(p, 1e-300))) + 1, LEVELS - 1), 0).astype(np.int64)
        code, count = np.unique(context * LEVELS**order + code, return_counts=True)
        return pa.Table.from_arrays([pa.array((code // LEVELS**order).astype(np.int32)), pa.array(code % LEVELS**order), pa.array(count)], none.schema.names)

    found = dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(observe, "context int, levels long, n long")
    return found.groupBy("context", "levels").agg(F.sum("n").alias("n"))


def learn_weights(context: np.ndarray, levels: np.ndarray, count: np.ndarray, uniform: float, order: int = ORDER, rounds: int = 60) -> np.ndarray:
    """(buckets, order + 1) mixture weights, longest n-gram first and uniform last, by EM on the histogram.

    Buckets without held-out tokens keep the first guess, which trusts the word most.
    """
    buckets = max(1, order - 1) * CONTEXTS
    p, rest = [], levels.astype(np.int64)
    for _ in range(order):
        q = rest % LEVELS
        p.append(np.where(q > 0, 2.0 ** (-(q - 1) / STEPS), 0.0))
        rest //= LEVELS
    p = np.stack([*p[::-1], np.full(len(context), uniform)], axis=1)
    weights = np.tile([0.1 / order] * (order - 1) + [0.8, 0.2 - 0.1 * (order - 1) / order], (buckets, 1))
    for _ in range(rounds):
        share = weights[context] * p
        share *= (count / share.sum(axis=1))[:, None]
        total = np.stack([np.bincount(context, share[:, k], buckets) for k in range(order + 1)], axis=1)
        n = total.sum(axis=1)
        prior = np.array([1e-6] * order + [1e-3])
        weights[n > 0] = (total[n > 0] + prior) / (n[n > 0] + prior.sum())[:, None]
    return weights


def scores(dealt: DataFrame, answered: DataFrame, n: int, v: int, weights: np.ndarray, order: int, doc_type: str) -> DataFrame:
    import pyarrow as pa

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(docs, rows):
        kind = docs.schema.field("ids").type.value_type
        if not docs.num_rows or not rows.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in (kind, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names)
        block = block_of(docs)
        ids = pa.array(block.ids, kind)
        context, found, own = estimates(block, rows, "all", n, order)
        model = weights[context, -1] / (v + 1)
        for k, p in enumerate(found):
            model += weights[context, k] * p
        model = np.log10(model)
        base = np.log10((own + 0.5) / (n + 0.5 * (v + 1)))
        add = lambda x: np.add.reduceat(x, block.first)
        held = [f in (HELD_OUT, -1) for f in block.folds.tolist()]
        return pa.Table.from_arrays([ids, pa.array(held), pa.array(block.sizes), pa.array(add((own > 0).astype(np.int64))), pa.array([n] * len(held), pa.int64()), pa.array(add(base)), pa.array(add(model))], names)

    schema = f"doc_id {doc_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(run, schema)


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Scores of every row of (doc_id, text) by n-grams of up to `order` words (1 to 6).

    A null or empty text is the end token alone. A null id counts as held out:
    its text is scored and not learned from. Repeated rows are learned from and
    scored each. Other columns are ignored. Without training documents every
    estimate but the uniform one is 0. An empty table gives no rows.
    """
    if not 1 <= order <= 6:
        raise ValueError("orders of 1 to 6 words are supported")
    spark = docs.sparkSession
    dealt = saved(blocks(docs))
    tokens = dealt.agg(F.sum("tokens")).first()[0] or 0
    ranges = 1 << (tokens // KEYS).bit_length()
    with shuffles_dropped(spark):
        told_ = [saved(answers(requests(dealt, k, ranges), k)) for k in range(1, order + 1)]
        kept_n, kept_v, n, v = (s or 0 for s in told_[0].select(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(4))).first())
        answered = reduce(DataFrame.unionByName, (t.drop("sums") for t in told_))
        seen = held_out_histogram(dealt.where("block < 0"), answered.where("block < 0").drop("all"), kept_n, order).toArrow()
    weights = learn_weights(*(seen.column(c).to_numpy() for c in ("context", "levels", "n")), 1 / (kept_v + 1), order)
    return scores(dealt, answered.drop("kept"), n, v, weights, order, id_type(docs))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
