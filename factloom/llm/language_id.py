"""Language identification by mixture inference.

Each language has a letter-trigram model over hashed trigrams of words. A text's
words come from a mixture of languages: expectation-maximisation estimates the
proportions from the words' likelihoods. The language set starts with the single
most likely language and grows by the language that would raise the likelihood
most steeply, as long as the likelihood less a penalty for each further language
rises; it may reach any size. The prediction is the selected language with the
largest proportion (of equal ones the first by name), the score its proportion
over all languages.

The models are fitted on a bounded sample: about `PER_LANGUAGE` rows of each
language, those whose hashed id is least. Inference is one pass over all rows;
the models, 256 kB a language, are broadcast once.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import fold_column, id_type, slices, table

PER_LANGUAGE = 3_000
BUCKETS = 1 << 16
ROUNDS = 8
#: Penalty for each language above the first, as a multiple of the log of the number of words.
PENALTY = 2.0
#: What parts words: all but letters and the marks that belong to a letter before them.
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
LOOSE_MARKS = regex.compile(r"(?<![\p{L}\p{M}])\p{M}+")
UNKNOWN = "und"


def letters(text: str | None) -> str:
    """The words of a text in lower case, each between single spaces; a space alone if there is no letter."""
    if not text:
        return " "
    text = text.lower()
    if not text.isascii():
        text = LOOSE_MARKS.sub(" ", text)
    return f" {NOT_LETTERS.sub(' ', text).strip()} "


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams centred at each letter of the texts, each word's first letter, words of each text.

    texts: results of `letters`.
    """
    joined = "".join(texts)
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    space = code == 32
    inner = np.flatnonzero(~space)
    if not len(inner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    mixed = code[inner - 1] * np.uint64(0x9E3779B97F4A7C15) ^ code[inner] * np.uint64(0xC2B2AE3D27D4EB4F) ^ code[inner + 1] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    bucket = ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)
    first = np.flatnonzero(space[inner - 1])
    text_of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return bucket, first, np.bincount(text_of[inner[first]], minlength=len(texts))


def likelihoods(bucket: np.ndarray, first: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """(words, languages): each word's likelihood relative to its best language."""
    if not len(first):
        return np.zeros((0, log_p.shape[1]))
    total = np.add.reduceat(log_p[bucket], first, axis=0)
    return np.exp(np.maximum(total - total.max(axis=1, keepdims=True), -50))


def mixture(like: np.ndarray, owner: np.ndarray, n: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each text, by EM over its allowed languages."""
    starts = np.cumsum(n) - n
    p = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        r = p[owner] * like
        r /= r.sum(axis=1, keepdims=True)
        p = np.add.reduceat(r, starts, axis=0) / n[:, None]
    return p, np.add.reduceat(np.log((p[owner] * like).sum(axis=1) + 1e-300), starts)


def select(like: np.ndarray, owner: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(texts, languages) proportions within each text's selected set of languages."""
    starts = np.cumsum(n) - n
    alone = np.add.reduceat(np.log(like), starts, axis=0)
    p = np.zeros(alone.shape)
    p[np.arange(len(n)), alone.argmax(axis=1)] = 1
    value = alone.max(axis=1)
    going = np.arange(len(n))
    while len(going):
        rows = np.isin(owner, going) if len(going) < len(n) else slice(None)
        own, sizes = like[rows], n[going]
        of = np.repeat(np.arange(len(going)), sizes)
        # the slope of the mean log-likelihood towards a language; at 1 or less none can raise it
        slope = np.add.reduceat(own / ((p[going][of] * own).sum(axis=1, keepdims=True) + 1e-300), np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        slope[p[going] > 0] = 0
        best = slope.argmax(axis=1)
        rising = slope[np.arange(len(going)), best] > 1 + 1e-9
        if not rising.any():
            break
        rows, going, best = rising[of], going[rising], best[rising]
        own, sizes = own[rows], sizes[rising]
        of = np.repeat(np.arange(len(going)), sizes)
        allowed = (p[going] > 0).astype(float)
        allowed[np.arange(len(going)), best] = 1
        grown, log_like = mixture(own, of, sizes, allowed)
        penalised = log_like - PENALTY * (allowed.sum(axis=1) - 1) * np.log(sizes + 1.0)
        better = penalised > value[going]
        p[going[better]], value[going[better]] = grown[better], penalised[better]
        going = going[better]
    return p


def infer(texts: list[str | None], log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For each text the predicted language (-1: none), its proportion, and the proportions in the selected set."""
    bucket, first, n = trigrams([letters(t) for t in texts])
    best, score, chosen = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros((len(texts), log_p.shape[1]))
    some = np.flatnonzero(n)
    if len(some) and log_p.shape[1]:
        like, n = likelihoods(bucket, first, log_p), n[some]
        owner = np.repeat(np.arange(len(some)), n)
        everything, _ = mixture(like, owner, n, np.ones((len(some), log_p.shape[1])))
        kept = select(like, owner, n)
        best[some] = kept.argmax(axis=1)
        score[some] = np.clip(everything[np.arange(len(some)), best[some]], 0, 1)
        chosen[some] = kept
    return best, score, chosen


def fit(docs: DataFrame, mod: int = 4, held: int = 2) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities of the hashed trigrams by language) from rows with a language, fold and text.

    Repeated rows count each. Without such rows, or letters, there is no language.
    """
    import pyarrow as pa

    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_column(F.col("doc_id"), mod) != held))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not counts:
        return [], np.zeros((BUCKETS, 0))
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, PER_LANGUAGE / n)) for k, n in counts.items()], "of string, share double")
    unit = F.xxhash64("doc_id", F.length("text")).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    sample = usable.join(F.broadcast(shares), F.col("lang") == F.col("of")).where(unit < F.col("share")).select("lang", "text")

    def run(batches):
        total = {}
        for part in slices(batches):
            got, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for lang in set(got):
                bucket, _, _ = trigrams([letters(t) for t, x in zip(texts, got, strict=True) if x == lang])
                total[lang] = total.get(lang, 0) + np.bincount(bucket, minlength=BUCKETS)
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bucket", "n"])

    found = sample.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = found.column("lang").to_pylist()
    langs = sorted(set(names))  # a language without a letter in its sample has no model
    table_ = np.zeros((BUCKETS, len(langs)), np.float32)
    place = {k: i for i, k in enumerate(langs)}
    table_[found.column("bucket").to_numpy(), np.array([place[x] for x in names], np.int64)] = found.column("n").to_numpy()
    return langs, np.log((table_ + 0.05) / (table_.sum(axis=0, dtype=np.float64) + 0.05 * BUCKETS)).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], log_p: np.ndarray, mod: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs for every row of (doc_id, text).

    `langs` lists the selected set, largest proportion first. Texts that are null
    or have no letter, and all texts where nothing was learned, are `und` with
    score 0. held_out is true for a null id. Repeated rows get a row each; other
    columns are ignored; an empty table gives no rows.
    """
    import pyarrow as pa

    model = docs.sparkSession.sparkContext.broadcast(log_p)

    def run(batches):
        for part in slices(batches):
            best, score, chosen = infer(part.column(1).to_pylist(), model.value)
            name = [langs[b] if b >= 0 else UNKNOWN for b in best]
            sets = [",".join(langs[i] for i in np.argsort(-c, kind="stable") if c[i] > 0) for c in chosen]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(name, pa.string()), pa.array(score), pa.array(sets, pa.string())], ["doc_id", "lang_pred", "score", "langs"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, lang_pred string, score double, langs string")
    return out.select("doc_id", F.coalesce(fold_column(F.col("doc_id"), mod) == held, F.lit(True)).alias("held_out"), "lang_pred", "score", "langs")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, *fit(docs))
