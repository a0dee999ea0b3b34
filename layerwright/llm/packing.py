"""Best-fit packing of token sequences, with a bounded number of open bins.

``token_pieces`` turns documents into pieces of at most ``size`` tokens where they are read.
``pack`` gives each piece a place. Pieces are dealt evenly to as many tasks as hold ``BINS_A_TASK`` full bins
each, so the share of bins left open at the end does not grow with the number of input splits. A task takes
its pieces longest first and places them one by one: into the open bin whose free space fits best, found in a
bitset keyed by free space; else into a new bin, for which the fullest open one closes when ``open_bins`` are open.

Defined cases: a null text has no ids but the end id, so one piece of one token; rows are packed as they
come, repeated ids included; a document longer than ``size`` is cut into full pieces and a rest; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import grouped
from .shared import free_name, written
from .words_bpe import TEXT_AT_ONCE, tokenizer

#: Full bins that one packing task is to hold: wide enough to fit well, small enough for a task's memory.
BINS_A_TASK = 2048


def token_pieces(docs: DataFrame, path: str, size: int, end_id: int, id_col: str = "doc_id", text: str = "text", crc: bool = True, at_once: int = TEXT_AT_ONCE, short: bool = False) -> DataFrame:
    """A row for each piece: the id, ``piece``, ``start``, ``length``, ``ids`` (binary, four bytes an id), and with ``crc`` ``ids_crc32`` of them. ``at_once`` bytes of text are in work at a time.

    With ``short`` an id takes two bytes in ``ids``, and ids beyond 16 bits are an error.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids binary" + ", ids_crc32 bigint" * crc
    names = [id_col, "piece", "start", "length", "ids", "ids_crc32"][: 5 + crc]
    end, step = np.asarray([end_id], "<u4").tobytes(), 4 * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        for whole in batches:
            texts = whole.column(1).to_pylist()
            for some in grouped(texts, at_once):
                all_ids = encode(texts[some], at_once)
                stream = end.join([*all_ids, b""])  # the pieces of all documents, one after the other
                bytes_of = np.fromiter(map(len, all_ids), "int64", len(all_ids)) + 4
                pieces = -(-bytes_of // step)
                row = np.repeat(np.arange(len(all_ids)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.minimum(step, bytes_of[row] - piece * step)
                cuts = np.concatenate([[0], np.cumsum(length)])
                held, held_cuts = stream, cuts
                if short:
                    wide = np.frombuffer(stream, "<u4")
                    if wide.max(initial=0) > 0xFFFF:
                        raise ValueError("an id needs more than 16 bits")
                    held, held_cuts = wide.astype("<u2").tobytes(), cuts // 2
                columns = [
                    whole.column(0).slice(some.start, some.stop - some.start).take(pa.array(row)),
                    pa.array(piece, pa.int32()),
                    pa.array(piece * size, pa.int64()),
                    pa.array(length // 4, pa.int64()),
                    pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(held_cuts.astype("int32")), pa.py_buffer(held)]),
                ]
                if crc:
                    columns.append(pa.array([zlib.crc32(stream[a:b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col), F.col(text).cast("string").cast("binary")).mapInArrow(run, schema)


class OpenBins:
    """Bins with free space, at most ``most`` at once; a bit of ``mask`` says that some bin has that much free."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.mask, self.count = size, most, 0, 0
        self.by_free: dict[int, list[int]] = {}
        self.made = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.mask ^= 1 << free
        self.count -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset for a piece."""
        if fits := self.mask >> length:
            free = length + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            if self.count >= self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)  # the fullest closes
            at, free = self.made, self.size
            self.made += 1
        rest = free - length
        if rest:
            self.by_free.setdefault(rest, []).append(at)
            self.mask |= 1 << rest
            self.count += 1
        return at, self.size - free


def pack(pieces: DataFrame, size: int, open_bins: int = 2048, length: str = "length", tasks: int | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` (these names, underscored where taken) to each row.

    ``pieces`` should be read from storage: it is read
    twice, once to sum up its lengths. Rows of null or non-positive length, or longer than ``size``, are an error.
    """
    sequence = free_name(pieces, "sequence_id")
    offset = free_name(pieces, "offset")
    if tasks is None:
        total = pieces.agg(F.sum(F.col(length).cast("bigint"))).first()[0] or 0
        tasks = max(1, -(-total // (BINS_A_TASK * size)))
    schema = pieces.withColumn(sequence, F.lit(0).cast("bigint")).withColumn(offset, F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, first = OpenBins(size, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths = batch[length]
            if len(batch) and not lengths.between(1, size).all():
                raise ValueError(f"a piece must have 1 to {size} tokens")
            places = [bins.place(int(n)) for n in lengths]
            batch[sequence] = np.asarray([first + at for at, _ in places], "int64")
            batch[offset] = np.asarray([at for _, at in places], "int64")
            yield batch

    return pieces.repartition(tasks).sortWithinPartitions(F.col(length).desc()).mapInPandas(run, schema)


def pack_documents(docs: DataFrame, path: str, size: int = 4096, end_id: int = 1, open_bins: int = 2048, with_ids: bool = True) -> DataFrame:
    """Tokens, cuts and packs ``docs``; a row for each piece. The pieces are written to the shared folder first."""
    pieces = token_pieces(docs, path, size, end_id)
    return pack(written(pieces if with_ids else pieces.drop("ids"), "pieces"), size, open_bins)
