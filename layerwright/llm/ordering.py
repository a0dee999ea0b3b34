"""Training order: a keyed permutation gives every sequence a slot, and binary shards hold the slots in order.

Sequences are numbered densely and the number goes through a Feistel network over the smallest even number of bits that
holds all of them; a result beyond the last number goes through again until it is a number (cycle walking), so the slots
are a permutation. One shuffle takes each sequence to its shard, a range of slots that one task puts in order and
writes as a file of records of one length. A reader finds slot ``s`` in file ``s // shard_rows`` at byte
``s % shard_rows * stride``, so reading goes on from any slot without an index, and files before it are neither opened nor needed.

A record is: document id (8 bytes), piece (4), number of ids (2), ids (2 each, zeros to the end), a line feed; integers are little-endian.
Shards are written in the shared folder and by Spark's writer, so a lost task leaves no half file. Records travel in
compressed lots, one for each shard that a batch has records for, against the ids of some sequences that all tasks know (this bears on the
lots' size alone); a task holds one array of its shard's size and one lot. Only the id and the text of
a document are read. The table of sequences goes when the shards are written.

Defined cases: null document ids are written as -1 and null texts have the end id only; rows that repeat are sequences of their own; an
empty table makes one empty shard and no rows. Ids beyond 16 bits are an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerwright.sources.workspace import remove

from .packing import token_pieces
from .shared import free_name, shared_folder

ROUNDS = 4
HEAD = 14
#: Records that go to the writer as one value; bytes of records that a task gathers before it sends them.
LINES, GATHERED = 2048, 16 << 20
#: Bytes of ids that lots are compressed against.
COMMON = 512 << 10
#: How the table of sequences is stored: it lies on disk beside the shuffled lots and the shards.
STORED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6", "parquet.page.size": str(4 << 20), "parquet.enable.dictionary": "false"}
#: Bytes of text in work at a time.
TEXT_AT_ONCE = 2 << 20
#: Multipliers of the round function and their modulus.
FIRST, SECOND, PRIME = 1_103_515_245, 1_664_525_003, 2_147_483_647


def half_bits(n: int) -> int:
    """Bits of a half of the smallest balanced network whose domain holds ``n`` numbers."""
    return max(1, -(-max(1, n - 1).bit_length() // 2))


def round_keys(key: int) -> list[int]:
    return [(key * FIRST + (i + 1) * SECOND) % PRIME for i in range(ROUNDS)]


def permuted(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of numbers below ``n``: a permutation of them for each key."""
    half = half_bits(n)
    mask = (1 << half) - 1
    x = np.asarray(numbers, "int64").copy()
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half, x[todo] & mask
        for k in round_keys(key):
            f = (right % PRIME * FIRST + k) % PRIME
            f = ((f ^ (f >> 15)) * SECOND + k) % PRIME
            left, right = right, left ^ ((f ^ (f >> 13)) & mask)
        x[todo] = (left << half) | right
        todo = todo[x[todo] >= n]
    return x


def numbered(sequences: DataFrame, path: str, name: str = "number") -> tuple[DataFrame, int]:
    """``sequences`` written to ``path`` and read back with dense numbers, and how many there are.

    The writing task and the row's place in it are written too; the tasks' totals, a row each, make the numbers global.
    """
    spark = sequences.sparkSession
    place = free_name(sequences, "_place")
    placed = sequences.withColumn(place, F.monotonically_increasing_id())
    placed.write.options(**STORED).parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path)
    part, at = F.shiftright(place, 33), F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    totals = rows.groupBy(part.alias("of")).agg(F.count(place).alias("n")).toPandas().sort_values("of")
    begin = pd.DataFrame({"of": totals["of"].astype("int64"), "begin": (totals["n"].cumsum() - totals["n"]).astype("int64")})
    begin = spark.createDataFrame(begin, "_of bigint, _begin bigint")
    joined = rows.join(F.broadcast(begin), part == F.col("_of"))
    return joined.withColumn(name, F.col("_begin") + at).drop(place, "_of", "_begin"), int(totals["n"].sum())


def stride(length: int) -> int:
    return HEAD + 2 * length + 1


def layout(length: int) -> np.dtype:
    return np.dtype([("doc", "<i8"), ("piece", "<u4"), ("n", "<u2"), ("ids", "<u2", (length,)), ("end", "u1")])


def records(batch: pa.RecordBatch, length: int) -> np.ndarray:
    """The records of sequences given as document id, piece and ids of two bytes."""
    ids = batch.column(2)
    _, ends, data = ids.buffers()
    ends = np.frombuffer(ends, "<i4")[ids.offset : ids.offset + len(ids) + 1]
    size = np.diff(ends) // 2
    flat = np.frombuffer(data, "uint8")[ends[0] : ends[-1]].view("<u2") if len(ids) else np.zeros(0, "<u2")
    if size.max(initial=0) > length:
        raise ValueError("a sequence is too long")
    out = np.zeros(len(ids), layout(length))
    out["doc"], out["piece"], out["n"], out["end"] = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), size, 10
    out["ids"][np.arange(length) < size[:, None]] = flat
    return out


def gathered(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Records and numbers of some ``GATHERED`` bytes at a time: larger lots travel smaller."""
    made, numbers, size = [], [], 0
    for batch in batches:
        made.append(records(batch, length))
        numbers.append(batch.column(3).to_numpy())
        size += made[-1].nbytes
        if size >= GATHERED:
            yield np.concatenate(made), np.concatenate(numbers)
            made, numbers, size = [], [], 0
    if made:
        yield np.concatenate(made), np.concatenate(numbers)


def codec(common: bytes) -> tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]:
    """Compresses lots against ``common``, which both sides have, and restores them: with many shards a lot is too small to be compressed by itself."""
    import zstandard

    known = zstandard.ZstdCompressionDict(common, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if common else None
    return zstandard.ZstdCompressor(level=5, dict_data=known).compress, zstandard.ZstdDecompressor(dict_data=known).decompress


def materialise(docs: DataFrame, path: str, length: int = 128, key: int = 20260101, end_id: int = 1, shard_rows: int = 1 << 16, id_col: str = "doc_id", text: str = "text") -> tuple[str, int]:
    """Tokens ``docs``, cuts them into sequences of up to ``length`` ids, and writes the shards; their folder and the number of sequences.

    Document ids must be integers.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/order-{uuid.uuid4().hex}"
    pieces = token_pieces(docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-1)).alias("doc_id"), F.col(text).alias("text")), path, length, end_id, crc=False, at_once=TEXT_AT_ONCE, short=True)
    rows, n = numbered(pieces.select("doc_id", "piece", "ids"), f"{folder}/sequences")
    common = b"".join(bytes(r["ids"]) for r in rows.select("ids").limit(-(-COMMON // (2 * length))).collect())[:COMMON]

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, _ = codec(common)
        for made, number in gathered(batches, length):
            slot = permuted(number, n, key)
            order = np.argsort(slot)
            shard = slot[order] // shard_rows
            cuts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
            parts = [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard[cuts[:-1]], pa.int32()),
                    pa.array([(slot[p] % shard_rows).astype("<u4").tobytes() for p in parts], pa.binary()),
                    pa.array([pack(made[p].tobytes()) for p in parts], pa.binary()),
                ],
                names=["shard", "places", "lot"],
            )

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, unpack), made, last = codec(common), None, 0
        for batch in batches:
            for shard, places, lot in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if made is None:
                    made = np.zeros(min(shard_rows, n - shard * shard_rows), layout(length))
                place = np.frombuffer(places, "<u4")
                made[place] = np.frombuffer(unpack(lot), layout(length))
                last += len(place)
        if made is None:
            return
        if last != len(made):
            raise ValueError("a shard does not have all its records")
        for a in range(0, len(made), LINES):
            # The writer adds a line feed, which is the last record's end.
            yield pa.RecordBatch.from_arrays([pa.array([made[a : a + LINES].tobytes()[:-1]], pa.binary())], names=["value"])

    packed = rows.select("doc_id", "piece", "ids", "number").mapInArrow(lots, "shard int, places binary, lot binary")
    shards = packed.repartitionById(max(1, -(-n // shard_rows)), F.col("shard")).mapInArrow(in_order, "value binary")
    shards.select(F.col("value").cast("string").alias("value")).write.text(f"{folder}/shards")
    remove(spark, f"{folder}/sequences")
    return f"{folder}/shards", n


def names_from(shard: int) -> str:
    """A pattern for the names of files from a shard's on. Their numbers have five digits, or as many as they need."""
    digits, any_digit = f"{shard:05}", "[0-9]"
    same = [digits[:i] + f"[{int(d) + 1}-9]" + any_digit * (len(digits) - i - 1) for i, d in enumerate(digits) if d != "9"]
    longer = ["[1-9]" + any_digit * more for more in range(len(digits), 10)]
    return f"part-{{{','.join([digits, *same, *longer])}}}-*"


def read_shards(spark: SparkSession, folder: str, length: int = 128, shard_rows: int = 1 << 16, first: int = 0) -> DataFrame:
    """``slot``, ``shard``, ``place`` in the shard, ``doc_id``, ``piece``, ``length``, ``ids`` (binary, four bytes an id) of the records from slot
    ``first`` on, as the files hold them. Files of earlier slots are left out by name."""
    step = stride(length)
    number = F.regexp_extract("path", r"part-(\d+)-", 1).cast("bigint")
    reader = spark.read.format("binaryFile").option("pathGlobFilter", names_from(first // shard_rows))
    files = reader.load(folder).select(number.alias("shard"), "path", "length", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, raw = batch.column(0)[i].as_py(), np.frombuffer(batch.column(1)[i].as_buffer(), "uint8")
                if len(raw) % step:
                    raise ValueError("a shard does not hold whole records")
                for a in range(0, len(raw) // step, 4096):
                    some = raw[a * step : (a + 4096) * step].reshape(-1, step)
                    if (some[:, -1] != 10).any():
                        raise ValueError("a record does not end where it should")
                    head = lambda lo, hi, kind, some=some: np.ascontiguousarray(some[:, lo:hi]).view(kind)[:, 0]
                    size = head(12, 14, "<u2")
                    tokens = np.ascontiguousarray(some[:, HEAD:-1]).view("<u2").astype("<u4")
                    place = np.arange(a, a + len(some))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard * shard_rows + place, pa.int64()),
                            pa.array(np.full(len(some), shard), pa.int64()),
                            pa.array(place, pa.int64()),
                            pa.array(head(0, 8, "<i8"), pa.int64()),
                            pa.array(head(8, 12, "<u4"), pa.int64()),
                            pa.array(size, pa.int64()),
                            pa.array([t[:n].tobytes() for t, n in zip(tokens, size.tolist(), strict=True)], pa.binary()),
                        ],
                        names=["slot", "shard", "place", "doc_id", "piece", "length", "ids"],
                    )

    rows = files.select("shard", "content").mapInArrow(run, "slot bigint, shard bigint, place bigint, doc_id bigint, piece bigint, length bigint, ids binary")
    return rows.where(F.col("slot") >= first)
