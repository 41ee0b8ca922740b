"""Token ids in files coded by a range asymmetric numeral system.

A file's rows are segments. A segment holds the ids of consecutive documents in ascending doc_id
order under one static frequency table, which its blocks share. A block is coded and decoded by
itself: LANES interleaved states, so that one step codes a number in each lane. The directory
of a segment holds for each block the number of ids, the sizes of its parts, a checksum of the
coded words and one of the ids (both crc32), and checkpoints: the place of every document's first
id, so that a document is decoded from the block it starts in.

Layout of a segment, little-endian: magic `RANS`, u32 version, u32 symbols, u32 blocks, u32
documents, u64 ids; the symbols (u32) and their frequencies (u32, summing to 2^SCALE); per document
u64 end place and i64 doc_id; per block u32 ids, u32 words, u32 crc of the words, u32 crc of the
ids; then per block LANES states (u64) and the words (u32); at the end the crc32 of all before it.

The segments are the rows of a Parquet table that Spark writes, so that a task that is run again
replaces what it wrote. Documents are range-partitioned and sorted by id, and each task codes its
range as it reads it, holding one segment at a time.

Null text is empty and has the end id alone. A null doc_id comes first. Rows of one doc_id follow
each other by their text's hash. An empty table gives files without segments; other columns play no part.
"""

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystride.llm.common import partitions, quoted, releasing, text_or_empty
from keystride.llm.tokens import documents_ids, worker_encoder
from keystride.session import new_path

SCALE = 18
LANES = 4096
BLOCK_IDS = 1 << 19
SEGMENT_IDS = 1 << 21
LOW = np.uint64(1 << 31)
HEAD = "<4sIIIIQ"
NO_ID = -(1 << 63)  # stands for a null doc_id in a file
SEGMENTS = "part int, segment int, documents long, ids long, payload binary"


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2^scale, near the counts' shares."""
    total = 1 << scale
    freq = np.maximum(1, np.floor(counts * ((total - len(counts)) / counts.sum()))).astype(np.int64)
    over = int(freq.sum()) - total
    if over <= 0:
        freq[counts.argmax()] -= over
    while over > 0:  # ones raised from below: take from the largest
        k = int(freq.argmax())
        take = min(over, int(freq[k]) // 2)
        freq[k] -= take
        over -= take
    return freq


def encode_block(codes: np.ndarray, freq: np.ndarray, first: np.ndarray, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    """States and words of numbers of symbols (last number first, words in reading order)."""
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    f, c = freq[codes].astype(np.uint64), first[codes].astype(np.uint64)
    shift, limit = np.uint64(SCALE), np.uint64(63 - SCALE)
    for at in range((len(codes) - 1) // lanes * lanes, -1, -lanes):
        ff, cc = f[at:at + lanes], c[at:at + lanes]
        x = state[:len(ff)]
        spill = x >= ff << limit
        if spill.any():
            words.append((x[spill] & np.uint64(0xFFFFFFFF)).astype("<u4")[::-1])
            x = np.where(spill, x >> np.uint64(32), x)
        q = x // ff
        state[:len(ff)] = (q << shift) + (x - q * ff) + cc
    return state, np.concatenate(words)[::-1] if words else np.empty(0, "<u4")


def decode_block(n: int, state: np.ndarray, words: np.ndarray, freq: np.ndarray, first: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Numbers of the n symbols."""
    lanes, state, read = len(state), state.copy(), 0
    out = np.empty(n, np.int64)
    mask, shift = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    freq, first = freq.astype(np.uint64), first.astype(np.uint64)
    for at in range(0, n, lanes):
        x = state[:min(lanes, n - at)]
        low = x & mask
        code = slots[low]
        out[at:at + lanes] = code
        x = freq[code] * (x >> shift) + low - first[code]
        need = np.nonzero(x < LOW)[0]
        if len(need):
            x[need] = x[need] << np.uint64(32) | words[read:read + len(need)]
            read += len(need)
        state[:len(x)] = x
    if read != len(words) or (state != LOW).any():
        raise ValueError("damaged block")
    return out


def encode_segment(names: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    counts = np.bincount(ids)
    symbols = np.nonzero(counts)[0]
    number = np.zeros(len(counts), np.int32)
    number[symbols] = np.arange(len(symbols))
    codes = number[ids]
    freq = scaled(counts[symbols])
    first = np.cumsum(freq) - freq
    heads, bodies = [], []
    for at in range(0, len(ids), BLOCK_IDS):
        part = codes[at:at + BLOCK_IDS]
        state, words = encode_block(part, freq, first)
        raw = words.astype("<u4").tobytes()
        heads.append((len(part), len(words), zlib.crc32(raw), zlib.crc32(ids[at:at + BLOCK_IDS].astype("<u4").tobytes())))
        bodies += [state.astype("<u8").tobytes(), raw]
    data = b"".join([
        struct.pack(HEAD, b"RANS", 1, len(symbols), len(heads), len(names), len(ids)),
        symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes(), np.cumsum(lengths).astype("<u8").tobytes(),
        np.array([NO_ID if x is None else x for x in names], "<i8").tobytes(), np.array(heads, "<u4").tobytes(), *bodies,
    ])
    return data + struct.pack("<I", zlib.crc32(data))


class Segment:
    """A segment read back; raises ValueError where a checksum does not fit."""

    def __init__(self, data: bytes):
        magic, version, n_symbols, n_blocks, n_docs, self.n_ids = struct.unpack_from(HEAD, data)
        if magic != b"RANS" or version != 1 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a whole segment")
        at = struct.calcsize(HEAD)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.symbols, self.freq = take("<u4", n_symbols), take("<u4", n_symbols).astype(np.int64)
        self.ends, self.names = take("<u8", n_docs).astype(np.int64), take("<i8", n_docs)
        self.heads = take("<u4", 4 * n_blocks).reshape(-1, 4)
        self.first = np.cumsum(self.freq) - self.freq
        self.slots = np.repeat(np.arange(n_symbols), self.freq)
        self.blocks = [(take("<u8", LANES), take("<u4", int(h[1]))) for h in self.heads]

    def block(self, i: int) -> np.ndarray:
        """The ids of block i."""
        n, _, crc_words, crc_ids = (int(x) for x in self.heads[i])
        state, words = self.blocks[i]
        if zlib.crc32(words.tobytes()) != crc_words:
            raise ValueError("damaged words")
        ids = self.symbols[decode_block(n, state, words, self.freq, self.first, self.slots)]
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc_ids:
            raise ValueError("damaged ids")
        return ids

    def document(self, i: int) -> np.ndarray:
        """The ids of document i, from the blocks it lies in."""
        start, end = int(self.ends[i - 1]) if i else 0, int(self.ends[i])
        low, high = start // BLOCK_IDS, (end - 1) // BLOCK_IDS
        ids = np.concatenate([self.block(b) for b in range(low, high + 1)])
        return ids[start - low * BLOCK_IDS:end - low * BLOCK_IDS]

    def ids(self) -> np.ndarray:
        return np.concatenate([self.block(b) for b in range(len(self.blocks))])


def write(docs: DataFrame, path: str, tokenizer: str, parts: int | None = None, doc_id: str = "doc_id", text: str = "text") -> None:
    """Files of segments below `path`."""
    parts = parts or partitions(docs.sparkSession)
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    # The text's hash parts rows of one doc_id, or without one.
    order = F.col("doc_id").asc_nulls_first(), F.sha2("text", 256)
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, False, True)
        part, segment, names, held = TaskContext.get().partitionId(), 0, [], []

        def flush() -> pa.RecordBatch:
            nonlocal segment, names, held
            ids = np.concatenate(held)
            data = encode_segment(names, [len(x) for x in held], ids)
            row = [[part], [segment], [len(names)], [len(ids)], [data]]
            segment, names, held = segment + 1, [], []
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)],
                                              names=["part", "segment", "documents", "ids", "payload"])

        n = 0
        for batch in found:
            for name, ids in zip(batch["doc_id"].to_pylist(), documents_ids(encoder, batch["text"])):
                if n and n + len(ids) > SEGMENT_IDS:
                    yield flush()
                    n = 0
                names.append(name)
                held.append(ids)
                n += len(ids)
        if names:
            yield flush()

    ordered.mapInArrow(releasing(batches), SEGMENTS).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32."""
    found = spark.read.parquet(path)
    in_part = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    parts = found.groupBy("part").agg(F.sum("ids").alias("n"))
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("before"))
    starts = found.select("part", "segment", F.coalesce(F.sum("ids").over(in_part), F.lit(0)).alias("inside"))
    # A row for each part or segment, without the payload.
    starts = starts.join(parts, "part").select("part", "segment", (F.col("before") + F.col("inside")).alias("start"))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part, number, data in zip(*(batch[c].to_pylist() for c in ("part", "segment", "payload"))):
                segment = Segment(data)
                ids, ends = segment.ids(), segment.ends
                begins = np.concatenate([[0], ends[:-1]])
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                names = [None if x == NO_ID else x for x in segment.names.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ends), pa.int32()), pa.array([number] * len(ends), pa.int32()),
                     pa.array(names, pa.int64()), pa.array(begins, pa.int64()), pa.array(ends - begins, pa.int64()),
                     pa.array(crc, pa.int64())],
                    names=["part", "segment", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    decoded = found.select("part", "segment", "payload").mapInArrow(
        releasing(batches), "part int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return decoded.join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = new_path(docs.sparkSession, "rans")
    write(docs, path, tokenizer)
    return read(docs.sparkSession, path)
