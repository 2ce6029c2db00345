"""Token ids of a corpus in binary files: canonical length-limited Huffman codes from global counts, in independent blocks."""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import file_system, fresh_folder, small_batches, table, text_or_empty, written
from .tokens import crc32, encoder

#: Longest code; the decoding table has 2 to this power entries.
MAX_BITS = 18
#: Ids in a block, each of which has its bit offset in the file and can be decoded alone.
BLOCK = 512
#: Ids that a file gets before the next begins (the last document stays whole).
FILE_IDS = 4_000_000
#: Ids for each partition of the sorted documents.
PARTITION_IDS = 8_000_000
MAGIC = b"HUFFIDS1"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol's code by package-merge: the least total under the limit. Symbols without a count get 0."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols do not fit codes of {max_bits} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(max_bits):
        both = np.concatenate((weights, packages))
        order = np.argsort(both, kind="stable")
        levels.append(order < len(weights))
        merged = both[order][: len(both) // 2 * 2]
        packages = merged[0::2] + merged[1::2]
    take, bits = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        bits[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[used] = bits
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, symbol)."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    for bits in range(1, int(lengths.max(initial=0)) + 1):
        code <<= bits - last
        of = np.flatnonzero(lengths == bits)
        codes[of] = code + np.arange(len(of))
        code, last = code + len(of), bits
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For each value of the next `width` bits: symbol * 32 + bits of its code."""
    width = max(1, int(lengths.max(initial=0)))
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    entries = np.repeat(order.astype(np.uint64) * 32 + lengths[order], 1 << (width - lengths[order].astype(np.int64)))
    out = np.zeros(1 << width, np.uint64)
    out[: len(entries)] = entries
    return out.astype(np.uint32) if len(lengths) < 1 << 27 else out, width


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of ids, most significant bit first, and the bit offset of each block of BLOCK ids."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    starts = ends - bits
    word, into = starts >> 5, starts & 31
    shifted = codes[ids].astype(np.uint64) << (64 - into - bits).astype(np.uint64)
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros((int(ends[-1]) >> 5) + 2 if len(ids) else 0, np.uint32)
    if len(ids):
        out[word[heads]] = np.add.reduceat(shifted >> np.uint64(32), heads).astype(np.uint32)
        out[word[heads] + 1] |= np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), heads).astype(np.uint32)
    return out.astype(">u4").tobytes(), starts[::BLOCK].astype("<u8")


def unpack(bits: bytes, offsets: np.ndarray, n: int, lengths: np.ndarray) -> np.ndarray:
    """The n ids of some blocks: all are decoded side by side, each from its own bit offset."""
    entries, width = decoding_table(lengths)
    raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at, out = offsets.astype(np.int64), np.zeros((BLOCK, len(offsets)), np.uint32)
    down = np.uint32(32 - width)
    for k in range(BLOCK):
        live = len(offsets) - (k > (n - 1) % BLOCK)
        at = at[:live]
        entry = entries[(window[at >> 3] << (at & 7).astype(np.uint32)) >> down]
        out[k, :live] = entry >> 5
        at = at + (entry & 31)
    return out.T.reshape(-1)[:n]


def file_bytes(ids: np.ndarray, docs: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """docs: columns doc_id, 1 if it is null, number of ids. Parts: bits, block offsets, documents, code lengths; then their sizes."""
    bits, offsets = pack(ids, codes, lengths)
    parts = [bits, offsets.tobytes(), zlib.compress(docs.astype("<i8").tobytes(), 1), zlib.compress(lengths.tobytes(), 6)]
    foot = json.dumps({"ids": len(ids), "docs": len(docs), "block": BLOCK, "sizes": [len(p) for p in parts]}).encode()
    return b"".join([MAGIC, *parts, foot, struct.pack("<I", len(foot)), MAGIC])


def read_file(handle, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, docs) of a file, checked by its marks."""
    raw = handle.read(size)
    if raw[:8] != MAGIC or raw[-8:] != MAGIC:
        raise ValueError("not a file of Huffman-coded ids")
    (n,) = struct.unpack("<I", raw[-12:-8])
    foot = json.loads(raw[-12 - n : -12])
    ends = 8 + np.cumsum(foot["sizes"])
    bits, offsets, docs, lengths = (raw[b - s : b] for b, s in zip(ends.tolist(), foot["sizes"]))
    lengths = np.frombuffer(zlib.decompress(lengths), np.uint8)
    docs = np.frombuffer(zlib.decompress(docs), "<i8").reshape(-1, 3)
    return unpack(bits, np.frombuffer(offsets, "<u8"), foot["ids"], lengths), docs


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, crc, ids): ids compressed; and after each task's documents a row with the task's counts of ids only."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        import zstandard

        enc, z = encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        counts = np.zeros(max(enc.vocabulary, end_id + 1), np.int64)
        for keys, ids, ends in enc.encoded(batches, end_id):
            counts += np.bincount(ids, minlength=len(counts))
            sizes, ends = np.diff(ends, prepend=0), ends.tolist()
            rows = [z.compress(ids[a:b]) for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(rows, pa.binary()), pa.nulls(len(rows), pa.binary())], schema=schema)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([z.compress(counts.tobytes())], pa.binary())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "id long, n long, ids binary, counts binary")


def summed_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs, over all documents: tasks' counts are added by partition, then by id; at most `size` rows reach the driver."""

    def run(batches):
        import zstandard

        total, z = np.zeros(size, np.int64), zstandard.ZstdDecompressor()
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(z.decompress(raw), np.int64)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    counts = np.zeros(size, np.int64)
    for row in tokens.where("counts is not null").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row.id] = row.n
    return counts


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents' ids to files in folder in ascending order of id (nulls last), and returns the list of files.

    The list: part and seq (their order is that of the ids), path, docs, ids, start (ids in all files before). Each attempt of a
    task writes files of its own names and only those of the attempt that Spark counted are in the list. Null texts are empty;
    each document has at least the end id. Rows of one id are in the order of their ids' checksum. No documents: no files.
    """
    small_batches(docs.sparkSession)
    size = max(encoder(tokenizer).vocabulary, end_id + 1)
    itemsize = encoder(tokenizer).dtype
    tokens = written(tokenized(docs, tokenizer, end_id, id_col, text_col), "tokens")
    counts = summed_counts(tokens, size)
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    partitions = max(1, -(-int(counts.sum()) // PARTITION_IDS))

    def run(batches):
        import zstandard

        part, seq, z = TaskContext.get().partitionId(), 0, zstandard.ZstdDecompressor()
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        rows, ids, held = [], [], 0

        def flush():
            nonlocal rows, ids, held, seq
            every = np.frombuffer(b"".join(ids), itemsize)
            name = f"{base}/ids-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.huf"
            with fs.open_output_stream(name) as out:
                out.write(file_bytes(every, np.array(rows, np.int64).reshape(-1, 3), codes, lengths))
            done = pa.RecordBatch.from_arrays([pa.array([v]) for v in (part, seq, name, len(rows), len(every))], names=["part", "seq", "path", "docs", "ids"])
            rows, ids, held, seq = [], [], 0, seq + 1
            return done

        for batch in batches:
            for i, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                rows.append((i or 0, i is None, n))
                ids.append(z.decompress(raw))
                held += n
                if held >= FILE_IDS:
                    yield flush()
        if rows:
            yield flush()

    order = [F.col("id").asc_nulls_last(), F.crc32("ids")]
    ranged = tokens.where("ids is not null").select("id", "n", "ids").repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    files = written(ranged.mapInArrow(run, "part long, seq long, path string, docs long, ids long"), "files")
    parts = files.groupBy("part").agg(F.sum("ids").alias("all"))
    before = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    inside = F.sum("ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("ids")
    return files.withColumn("start", inside).join(before, "part").withColumn("start", F.col("start") + F.col("before")).drop("before")


def read_ids(files: DataFrame, partitions: int, folder: str) -> DataFrame:
    """The files of write_ids() read back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches):
        fs, _ = file_system(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(path) as handle:
                    ids, docs = read_file(handle, handle.size())
                ends = np.cumsum(docs[:, 2])
                for at in range(0, len(docs), 10_000):
                    e, n = ends[at : at + 10_000], docs[at : at + 10_000, 2]
                    crc = [crc32(ids[b - k : b]) for b, k in zip(e.tolist(), n.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(docs[at : at + 10_000, 0], pa.int64(), mask=docs[at : at + 10_000, 1] > 0), pa.array(start + e - n), pa.array(n), pa.array(crc, pa.int64())], names=names)

    return files.select("path", "start").repartition(partitions).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_huffman_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null ids come last, null texts are a single end id, repeated ids each have a row, other columns are ignored."""
    import public_tokenizers

    folder = fresh_folder(spark, "huffman")
    files = write_ids(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_ids(files, max(1, files.count()), folder)
