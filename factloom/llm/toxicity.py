"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

The field has two states, clean and toxic. The emission of a token is a sum of
hashed features of its form (the word, its prefix and suffix), transitions are
four weights. It is trained on tokens labelled from the documents' labels: in
toxic documents the words that are far likelier there than elsewhere are toxic
tokens. Forward-backward marginals give each token's probability; spans are runs
of tokens at or above one half, with character offsets; a logistic model of the
largest marginal and the expected number of toxic tokens gives the document's
score. Only texts are read for a score.

Training takes a sample bounded by `SAMPLE_ROWS` labels, those with the least
hash of doc_id, and `SAMPLE_SEGMENTS` segments of `SEGMENT` tokens of their texts,
again those with the least hashes: a longer text gives more segments, none is cut
off. Scoring is one pass over all rows in which documents advance together, a
token a step.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import fold_column, id_type, lean, release_memory, slices, table

SAMPLE_ROWS = 4_000
SAMPLE_SEGMENTS = 40_000
HASHED = 1 << 18
THRESHOLD = 0.3
EDGES = ".,;:!?()[]{}\"'«»…-|*#$%&<>"
#: Tokens of a training segment, and steps of gradient ascent.
SEGMENT, EPOCHS = 256, 40
#: Tokens whose marginals are held at a time in training.
STRETCH = 200_000
#: A word is a toxic token if so many times likelier in toxic documents, and in so many of them.
LIKELIER, SUPPORT = 8.0, 3


def forms(text: str | None) -> list[str]:
    return [w.strip(EDGES) for w in text.lower().split()] if text else []


def features(form: str) -> list[int]:
    if not form:
        return []
    return [zlib.crc32(f.encode()) % HASHED for f in (f"w={form}", f"p={form[:4]}", f"s={form[-4:]}")]


def marginals(emission: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(toxic) of each token of concatenated sequences, by forward-backward on odds.

    emission: log weight of toxic over clean of each token; trans: 2 x 2 weights.
    """
    x = np.exp(np.clip(emission, -30, 30))
    order = np.argsort(-sizes, kind="stable")
    ordered = sizes[order]
    starts = (np.cumsum(sizes) - sizes)[order]
    longest = int(ordered[0]) if len(ordered) else 0
    active = np.searchsorted(-ordered, -np.arange(longest), side="left")
    forward, backward = np.empty_like(x), np.ones_like(x)
    odds = np.ones(0)
    for t in range(longest):
        at = starts[: active[t]] + t
        odds = x[at] if t == 0 else x[at] * (trans[0, 1] + trans[1, 1] * odds[: active[t]]) / (trans[0, 0] + trans[1, 0] * odds[: active[t]])
        forward[at] = odds
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        later = x[at + 1] * backward[at + 1]
        backward[at] = (trans[1, 0] + trans[1, 1] * later) / (trans[0, 0] + trans[0, 1] * later)
    both = forward * backward
    return both / (1 + both)


def pair_counts(emission: np.ndarray, p: np.ndarray, sizes: np.ndarray, trans: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Expected 2 x 2 transition counts, from the marginals of neighbours; inner: tokens with a successor."""
    p0, p1 = p[inner], p[inner + 1]
    # the joint of two neighbours keeps their marginals and the odds ratio of the transition weights
    ratio = trans[1, 1] * trans[0, 0] / (trans[0, 1] * trans[1, 0])
    if abs(ratio - 1) < 1e-6:
        both = p0 * p1
    else:
        s = 1 + (p0 + p1) * (ratio - 1)
        both = (s - np.sqrt(np.maximum(s * s - 4 * ratio * (ratio - 1) * p0 * p1, 0))) / (2 * (ratio - 1))
    b, q0, q1 = both.sum(), p0.sum(), p1.sum()
    return np.array([[len(inner) - q0 - q1 + b, q1 - b], [q0 - b, b]])


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    logistic: np.ndarray

    def scorer(self):
        return Scorer(self)


class Scorer:
    """Emissions of forms, memoised, and the scores of texts."""

    def __init__(self, model: Model, limit: int = 300_000):
        self.model, self.limit, self.known = model, limit, {}

    def emission(self, form: str) -> float:
        got = self.known.get(form)
        if got is None:
            got = self.model.bias + float(sum(self.model.weights[i] for i in features(form)))
            if len(self.known) < self.limit:
                self.known[form] = got
        return got

    def tokens(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all tokens, and the number of tokens of each text."""
        known, emission, values, sizes = self.known, self.emission, [], []
        for text in texts:
            own = forms(text)
            values += [known[f] if f in known else emission(f) for f in own]
            sizes.append(len(own))
        sizes = np.array(sizes, np.int64)
        return marginals(np.array(values, float), sizes, self.model.trans), sizes

    def documents(self, texts) -> np.ndarray:
        p, sizes = self.tokens(texts)
        return logistic(summary(p, sizes), self.model.logistic)


def summary(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Inputs of the document model: 1, the largest marginal, the log of the expected toxic tokens."""
    out = np.zeros((len(sizes), 3))
    out[:, 0] = 1
    some = np.flatnonzero(sizes)
    if len(some):
        starts = (np.cumsum(sizes) - sizes)[some]
        out[some, 1] = np.maximum.reduceat(p, starts)
        out[some, 2] = np.log1p(np.add.reduceat(p, starts))
    return out


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def train(examples) -> Model:
    """The field and the document model, from (text, label) pairs. Without both labels every text scores the rate of label 1.

    Tokens become numbers of their forms text by text, so no text is held after its turn and the sample's words once each.
    """
    ids: dict[str, int] = {}
    own, labels = [], []
    for text, label in examples:
        own.append(np.array([ids.setdefault(f, len(ids)) for f in forms(text)], np.int32))
        labels.append(label)
    y = np.array(labels, np.int64)
    sizes = np.array([len(x) for x in own], np.int64)
    empty = ids.get("")
    feature = np.fromiter((i for f in ids for i in features(f)), np.int32)
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), [3 if f else 0 for f in ids])
    del ids
    weights, bias, trans = np.zeros(HASHED), -4.0, np.array([[1.0, 0.05], [0.5, 0.5]])
    kinds = int(owner[-1]) + 1 if len(owner) else 0
    kinds = max(kinds, 1 + max((int(x.max()) for x in own if len(x)), default=-1))
    if 0 < y.sum() < len(y):
        seen = [np.zeros(kinds), np.zeros(kinds)]
        for codes, label in zip(own, labels, strict=True):
            seen[int(label)][np.unique(codes)] += 1
        n = (len(y) - y.sum(), y.sum())
        toxic = (seen[1] >= SUPPORT) & (seen[1] / n[1] >= LIKELIER * (seen[0] + 0.5) / n[0])
        if empty is not None:
            toxic[empty] = False
        weights, bias, trans = train_field(own, sizes, y, toxic, feature, owner, kinds)
    emission = bias + np.bincount(owner, weights[feature], minlength=kinds)
    codes = np.concatenate(own) if own else np.zeros(0, np.int32)
    inputs = [summary(marginals(emission[codes[a:b]], part, trans), part) for a, b, part in stretches(sizes, np.cumsum(sizes))]
    inputs = np.concatenate(inputs) if inputs else summary(np.zeros(0), sizes)
    return Model(weights.astype(np.float32), bias, trans, train_logistic(inputs, y))


def train_field(own: list[np.ndarray], lengths: np.ndarray, y: np.ndarray, toxic: np.ndarray, feature: np.ndarray, owner: np.ndarray, kinds: int):
    codes = np.concatenate(own)
    target = toxic[codes] & np.repeat(y == 1, lengths)
    sizes = np.array([min(SEGMENT, n - at) for n in lengths.tolist() for at in range(0, n, SEGMENT)], np.int64)
    last = np.zeros(len(codes), bool)
    last[np.cumsum(sizes) - 1] = True
    inner = np.flatnonzero(~last)
    weights, bias, log_trans = np.zeros(HASHED), -4.0, np.log(np.array([[1.0, 0.05], [0.5, 0.5]]))
    square_w, square_b, square_t = np.full(HASHED, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    seen = np.bincount(2 * target[inner] + target[inner + 1], minlength=4).reshape(2, 2)
    ends = np.cumsum(sizes)
    for _ in range(EPOCHS):  # ascent of the conditional likelihood with a small penalty, each weight with its own step
        by_kind = bias + np.bincount(owner, weights[feature], minlength=kinds)
        trans = np.exp(log_trans)
        of_kind, gt, gb = np.zeros(kinds), seen - 0.05 * log_trans, 0.0
        for first, last_, own_sizes in stretches(sizes, ends):
            part = codes[first:last_]
            p = marginals(by_kind[part], own_sizes, trans)
            miss = target[first:last_] - p
            of_kind += np.bincount(part, miss, minlength=kinds)
            gt = gt - pair_counts(None, p, own_sizes, trans, np.flatnonzero(~last[first:last_]))
            gb += miss.sum()
        g = np.bincount(feature, of_kind[owner], minlength=HASHED) - 0.05 * weights
        square_w += g * g
        square_b += gb * gb
        square_t += gt * gt
        weights += 0.8 * g / np.sqrt(square_w)
        bias += 0.3 * gb / np.sqrt(square_b)
        log_trans += 0.2 * gt / np.sqrt(square_t)
    return weights, bias, np.exp(log_trans)


def stretches(sizes: np.ndarray, ends: np.ndarray):
    """(first token, end, sizes) of runs of whole sequences of about STRETCH tokens, so that few numbers a token are held at once."""
    at = 0
    while at < len(sizes):
        start = int(ends[at] - sizes[at])
        to = max(at + 1, int(np.searchsorted(ends, start + STRETCH, side="right")))
        yield start, int(ends[to - 1]), sizes[at:to]
        at = to


def train_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(3)
    for _ in range(50):  # Newton's method with a small penalty
        p = logistic(x, w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2) -> Model:
    """A model from labelled rows whose fold is not `held`; null ids, texts and labels are not learned from.

    A doc_id with several labels takes the greatest. Rows that repeat an id and
    text are learned from once, different texts of an id each.
    """
    import pyarrow as pa

    usable = labels.where(F.col("toxic").isin(0, 1) & (fold_column(F.col("doc_id"), mod) != held)).groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("label"))
    chosen = usable.orderBy(F.xxhash64("label_id"), "label_id").limit(SAMPLE_ROWS)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "label", "text")

    def cut(batches):
        for part in slices(batches):
            rows = []
            for k, text in enumerate(part.column(2).to_pylist()):
                words, name = text.split(), zlib.crc32(text.encode())
                rows += [(k, name, at, " ".join(words[at : at + SEGMENT])) for at in range(0, max(1, len(words)), SEGMENT)]
            row, *own = zip(*rows, strict=True) if rows else ((), (), (), ())
            row = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), *(pa.array(x, t) for x, t in zip(own, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "label", "name", "place", "segment"])

    by = ["doc_id", "name", "place"]
    segments = texts.mapInArrow(lean(cut), f"doc_id {id_type(docs)}, label int, name long, place long, segment string")
    chosen = segments.dropDuplicates([*by, "segment"]).orderBy(F.xxhash64(*by), *by, "segment").limit(SAMPLE_SEGMENTS)
    model = train(documents(chosen.toArrow().sort_by([(c, "ascending") for c in (*by, "segment")])))
    # a pipeline's later stages run in the same driver
    release_memory()
    return model


def documents(sample):
    """(text, label) of each document of the sorted segments, a text at a time; the sample goes with the last."""
    last, words, label = None, [], 0
    for part in sample.to_batches(max_chunksize=256):
        for doc, own, name, _, segment in zip(*(part.column(c).to_pylist() for c in ("doc_id", "label", "name", "place", "segment")), strict=True):
            if (doc, name) != last and words:
                yield " ".join(words), label
                words = []
            last, label = (doc, name), own
            words.append(segment)
    if words:
        yield " ".join(words), label


def score(docs: DataFrame, model: Model, mod: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted, n_spans for every row; empty and null texts score too.

    held_out is true for a null id. Repeated rows get a row each; other columns
    are ignored; an empty table gives no rows.
    """
    import pyarrow as pa

    def run(batches):
        scorer = model.scorer()
        for part in slices(batches):
            p, sizes = scorer.tokens(part.column(1).to_pylist())
            got = logistic(summary(p, sizes), model.logistic)
            spans = [len(runs(x)) for x in np.split(p, np.cumsum(sizes)[:-1])] if len(sizes) else []
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got), pa.array((got >= THRESHOLD).astype(np.int32)), pa.array(spans, pa.int32())], ["doc_id", "score", "predicted", "n_spans"])

    out = docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {id_type(docs)}, score double, predicted int, n_spans int")
    return out.select("doc_id", F.coalesce(fold_column(F.col("doc_id"), mod) == held, F.lit(True)).alias("held_out"), "score", "predicted", "n_spans")


def runs(p: np.ndarray, least: float = 0.5) -> list[tuple[int, int]]:
    """Runs [first, last] of tokens with a marginal of at least `least`."""
    on = np.flatnonzero(np.diff(np.concatenate([[0], (p >= least).astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(on[::2], on[1::2], strict=True)]


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, end, score) of each toxic span: character offsets, end exclusive, the mean marginal."""
    import re

    import pyarrow as pa

    def run(batches):
        scorer = model.scorer()
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            p, sizes = scorer.tokens(texts)
            rows = []
            for k, own in enumerate(np.split(p, np.cumsum(sizes)[:-1])):
                if found := runs(own):
                    at = [m.span() for m in re.finditer(r"\S+", texts[k])]
                    rows += [(k, at[a][0], at[b][1], float(own[a : b + 1].mean())) for a, b in found]
            row, start, end, value = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int32())), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(value, pa.float64())], ["doc_id", "start", "end", "score"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {id_type(docs)}, start long, end long, score double")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are not predicted toxic, with exactly their columns, in one pass.

    Null and empty texts score as texts without tokens do. Repeated rows stay or
    go together; an empty table gives no rows.
    """
    import pyarrow as pa

    at = docs.columns.index("text")

    def run(batches):
        scorer = model.scorer()
        for part in slices(batches):
            yield part.filter(pa.array(scorer.documents(part.column(at).to_pylist()) < THRESHOLD))

    return docs.mapInArrow(lean(run), docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
