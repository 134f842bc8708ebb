"""Best-fit packing of tokenised documents into fixed-length sequences.

Pass 1 tokenises the texts where they are read and keeps only a few numbers for
each piece; ids never move. Those small rows are checkpointed, counted and dealt
to groups of at least about `GROUP` pieces, one task a group. A group is packed
as it streams by, in order of arrival, by bounded-space online best-fit: at most
`OPEN_BINS` bins are open, held in a bitset keyed by free space, and the fullest
closes when one more is needed. So a task holds the open bins and one batch,
whatever the size of its group, and a group loses little more than the room in
its last open bins.
"""

from __future__ import annotations

import struct
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import id_type, lean, saved, slices, table
from factloom.llm.token_counts import encoder, proved

GROUP = 20_000
OPEN_BINS = 256
SEQUENCE = 4_096
END_ID = 1


def packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def pieces(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row of (doc_id, text).

    A null text counts as empty: one piece that holds the end id alone.
    """
    import pyarrow as pa

    whole = proved(docs.sparkSession, path)

    def run(batches):
        enc, end = encoder(path, "ids", packed_ids, whole), struct.pack("<I", end_id)
        for part in slices(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for k, values in enumerate(enc.texts(part.column(1).to_pylist())):
                ids = b"".join([*values, end])
                for p, at in enumerate(range(0, len(ids), 4 * size)):
                    cut = ids[at : at + 4 * size]
                    row.append(k)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    schema = f"doc_id {id_type(docs)}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(lean(run, (path, "ids")), schema)


class BestFit:
    """The open bins of a stream of lengths.

    Bit f of `free` is set while some open bin has f tokens free; `at[f]` lists
    those bins with the last opened at the end. The least set bit at or above a
    length is the best fit, found by shifting; the least set bit of all is the
    fullest bin, which closes first. A full bin closes by itself.
    """

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins = size, open_bins
        self.free, self.at, self.n_open, self.n_bins, self.closings = 0, {}, 0, 0, 0

    def take(self, room: int) -> int:
        """Remove and return a bin with exactly `room` free."""
        stack = self.at[room]
        bin_ = stack.pop()
        if not stack:
            self.free ^= 1 << room
        return bin_

    def place(self, lengths) -> tuple[list[int], list[int]]:
        """Bin and place of each length, in order of arrival; bins are numbered from 0."""
        bins, places = [], []
        for n in lengths:
            fits = self.free >> n
            if fits:
                room = n + (fits & -fits).bit_length() - 1
                bin_ = self.take(room)
            else:
                if self.n_open == self.open_bins:
                    self.take((self.free & -self.free).bit_length() - 1)
                    self.n_open -= 1
                    self.closings += 1
                bin_, room = self.n_bins, self.size
                self.n_bins += 1
                self.n_open += 1
            bins.append(bin_)
            places.append(self.size - room)
            left = room - n
            if left:
                self.at.setdefault(left, []).append(bin_)
                self.free |= 1 << left
            else:
                self.n_open -= 1
        return bins, places


def pack(rows: DataFrame, size: int = SEQUENCE, group: int = GROUP, open_bins: int = OPEN_BINS) -> DataFrame:
    """Add sequence_id and offset to rows with a `length` of at most `size`.

    Rows are materialised once, so a lost executor repeats the same packing.
    Lengths of 0 take no room but still get a place. Empty input, empty result.
    """
    import numpy as np
    import pyarrow as pa

    rows = saved(rows)
    tasks = max(1, -(-rows.count() // group))
    place = rows.schema.fieldNames().index("length")

    def run(batches):
        bins, first = BestFit(size, open_bins), TaskContext.get().partitionId() << 40
        for part in batches:
            at, offset = bins.place(part.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.array(at, np.int64) + first), pa.array(offset, pa.int64())], [*part.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long"
    return rows.coalesce(tasks).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """Every document of (doc_id, text) in sequences of at most 4096 tokens.

    Null and empty texts are one end id. Repeated rows are packed each. Only
    documents above 4096 tokens are cut. Other columns are ignored.
    """
    return pack(pieces(docs, path)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
