"""Operator 5: bounded-space online best-fit packing of tokenised documents."""

from __future__ import annotations

import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, MapType, StructField, StructType, VariantType

from .common import byte_slices, id_text
from .tokens import text_ids

#: Open sequences a packing task holds.
OPEN_BINS = 2048


class BestFit:
    """Online best-fit into sequences of ``size`` with at most ``open_bins`` open ones.

    Bit ``f`` of one integer is set while an open sequence has ``f`` free places, so the
    best fit for a length is the lowest set bit at or above it.  When a new sequence is
    needed and all places are taken, the fullest open one closes.
    """

    def __init__(self, size: int, open_bins: int = OPEN_BINS):
        if size < 1 or open_bins < 1:
            raise ValueError("size and open_bins must be positive")
        self.size, self.open_bins = size, open_bins
        self.bits = self.n_open = self.made = 0
        self.by_free: dict[int, list[int]] = defaultdict(list)

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        got = held.pop()
        if not held:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return got

    def add(self, length: int) -> tuple[int, int]:
        """Place a piece; its sequence's number and its offset there."""
        if not 0 < length <= self.size:
            raise ValueError(f"a piece of {length} does not fit a sequence of {self.size}")
        at_least = self.bits >> length
        if at_least:
            free = length + (at_least & -at_least).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.size, self.made
            self.made += 1
        if left := free - length:
            if self.n_open == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.n_open += 1
        return number, self.size - free


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """``(start, length)`` pieces of a document of ``n`` ids: only the first may be shorter."""
    if n <= size:
        return [(0, n)] if n else []
    first = n % size
    starts = ([0] if first else []) + list(range(first, n, size))
    return [(s, (first if first and s == 0 else size)) for s in starts]


def tokenised_pieces(df: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document as ids plus ``end_id``, cut to ``size``: one row per piece with the CRC-32 of its ids."""
    end = int(end_id).to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, 1):
                out: list[tuple] = []
                for doc, data in zip(part.column(0).to_pylist(), text_ids(part.column(1), tokenizer_path), strict=True):
                    last = len(data) // 4
                    for k, (start, length) in enumerate(cut(last + 1, size)):
                        crc = zlib.crc32(data[4 * start : 4 * (start + length)])
                        # the end id stands behind the text's own
                        out.append((doc, k, start, length, zlib.crc32(end, crc) if start + length > last else crc))
                columns = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, columns)], names=names)

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(pieces: DataFrame, size: int = 1024, open_bins: int = OPEN_BINS, length_col: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a length of 1 to ``size``.

    Only the narrow piece rows are exchanged (balanced by Spark to the advisory size, so
    the number of packing tasks follows the data and a hot document or source has no
    task of its own).  Each task packs what it gets with ``open_bins`` open sequences;
    numbers are the partition's number in the high bits.  A task's rows are sorted first, so a task
    run again after an executor was lost places every piece where it was.  Places with a null length are
    an error; an empty table gives no rows.
    """
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    at = pieces.columns.index(length_col)

    def run(batches):
        bins, base = BestFit(size, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.add(n) for n in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + p[0] for p in placed], pa.int64()), pa.array([p[1] for p in placed], pa.int64())],
                names=[*batch.schema.names, "sequence_id", "offset"],
            )

    order = [f.name for f in pieces.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    return pieces.hint("rebalance").sortWithinPartitions(*[f"`{c}`" for c in order]).mapInArrow(run, schema)


def pack_documents(
    df: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 2, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` tokens.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.
    Null texts are empty (a piece of the end id alone); null and repeated ids and rows
    are documents of their own; an empty table gives no rows; other columns are ignored.
    """
    return pack(tokenised_pieces(df, tokenizer_path, size, end_id, id_col, text_col), size, open_bins)
