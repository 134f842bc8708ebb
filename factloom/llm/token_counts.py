"""Token counts with the whole-token shortcut.

The vocabulary strings that encode alone as exactly one token are proved once
(`whole_tokens`, by encoding each of them with the library) on the driver, and the
proved set, bounded by the vocabulary, is broadcast. A text is cut at
white space, which no pre-token crosses, and each distinct piece into its
pre-tokens; those in the proved set count one each, and only the rest go through
the merges of the library's model. A bounded memo keeps what pieces gave.

The cutting here handles texts made of characters whose normalisation, lower
case and class are the same in Python and in the library (`PLAIN`). Any other
text, and any text that holds a special token's string, is encoded whole by the
library itself, so results are the library's for every input. A worker keeps the memo
for its next task of the same use and drops it when a task of another kind begins.
"""

from __future__ import annotations

import re
from functools import cache as memo

from pyspark.sql import DataFrame, SparkSession

from factloom.llm.common import KEPT, id_type, lean, release_memory, slices, table

#: Memoised pieces a worker keeps between tasks of one use.
MEMO = 400_000
LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-įı-ſ"
NUMBERS = "0-9²³¹¼½¾"
#: Characters for which the fast path holds: ASCII, Latin letters, common punctuation.
PLAIN = re.compile("[\\t-\\r -~¡-¬®-įı-ſ‐-‧€]*")
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
PRE_TOKEN = re.compile(f"[{LETTERS}]+|[{NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^\\s{LETTERS}{NUMBERS}]+")


@memo
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ..."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


@memo
def whole_tokens(path: str) -> dict[str, int]:
    """Vocabulary strings proved to encode alone as one token: text -> id."""
    tok, letters, texts = library(path), byte_letters(), {}
    for entry, i in tok.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(letters[c] for c in entry.removesuffix("</w>")).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if entry.endswith("</w>") and text and PLAIN.fullmatch(text) and PRE_TOKEN.findall(text) == [text]:
            texts[text] = i
    known = list(texts)
    alone = tok.encode_batch(known, add_special_tokens=False)
    return {t: e.ids[0] for t, e in zip(known, alone, strict=True) if len(e.ids) == 1}


def plain(text: str) -> bool:
    return PLAIN.fullmatch(text) is not None and not any(s in text for s in SPECIAL)


class Encoder:
    """Values of texts, piece by piece: `value` turns a list of ids into what is kept."""

    def __init__(self, path: str, value, whole: dict[str, int] | None = None, limit: int = MEMO):
        self.tok, self.value, self.limit = library(path), value, limit
        self.model, self.whole, self.known = self.tok.model, whole_tokens(path) if whole is None else whole, {}
        self.letters = {b: c for c, b in byte_letters().items()}

    def ids(self, piece: str) -> list[int]:
        """Ids of a piece in lower case without white space."""
        out = []
        for t in PRE_TOKEN.findall(piece):
            alone = self.whole.get(t)
            if alone is not None:
                out.append(alone)
            else:
                out += [x.id for x in self.model.tokenize(t.encode().decode("latin-1").translate(self.letters))]
        return out

    def texts(self, texts: list[str | None]):
        """For each text the list of its pieces' values; of one value if the library encodes it whole."""
        cut = [t.lower().split() if t and plain(t) else None for t in texts]
        known = self.known
        fresh = list(set().union(*(c for c in cut if c)).difference(known))
        for piece in fresh:
            known[piece] = self.value(self.ids(piece))
        for text, c in zip(texts, cut, strict=True):
            if c is not None:
                yield [known[t] for t in c]
            else:
                yield [self.value(self.tok.encode(text, add_special_tokens=False).ids)] if text else []
        if len(known) > self.limit:
            for t in fresh:
                del known[t]


def encoder(path: str, use: str, value, proved) -> Encoder:
    """This worker's encoder for a use, made from the broadcast set of proved tokens; `lean` drops it."""
    if (path, use) not in KEPT:
        KEPT[path, use] = Encoder(path, value, proved.value)
    return KEPT[path, use]


def proved(spark: SparkSession, path: str):
    """The proved set of a vocabulary as a broadcast; the driver keeps the set, not the library it was proved with."""
    whole = spark.sparkContext.broadcast(whole_tokens(path))
    library.cache_clear()
    release_memory()
    return whole


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of (doc_id, text).

    A null or empty text has 0 bytes and 0 tokens. Repeated rows and null ids
    give a row each; other columns are ignored; an empty table gives no rows.
    """
    import pyarrow as pa

    whole = proved(docs.sparkSession, path)

    def run(batches):
        enc = encoder(path, "count", len, whole)
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            n = [sum(v) for v in enc.texts(texts)]
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    schema = f"doc_id {id_type(docs)}, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select("doc_id", "text").mapInArrow(lean(run, (path, "count")), schema)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
