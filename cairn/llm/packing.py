"""Packing of documents into sequences of tokens: a sharded BM25 index fills each window with the seed document's neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_or_empty, written
from .huffman import summed_counts
from .tokens import crc32, encoder

WINDOW = 2048
#: Ids of the remainders that one shard of the index holds at most (but for one remainder), and of those in a partition.
SHARD_IDS, PARTITION_IDS = 500_000, 3_000_000
K1, B = 1.2, 0.75
_PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """A row for each full window of a document and for its remainder: id, start, length, crc, total, seq, sig, ids, counts.

    Full windows are sequences already (seq: their number within the task) and carry no ids. A remainder carries its ids and the
    least hash of its distinct ids, by which documents with much in common come near to each other. Each task's last row has the
    number of its documents that hold each id.
    """
    schema = pa.schema([("id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "crc", "total", "seq", "sig")), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        import zstandard

        enc, z, full = encoder(tokenizer), zstandard.ZstdCompressor(level=1), 0
        size = max(enc.vocabulary, end_id + 1)
        holding, mixed = np.zeros(size, np.int64), np.random.default_rng(7).permutation(size)
        for keys, every, ends in enc.encoded(batches, end_id):
            rows, ends = [], ends.tolist()
            for key, a, b in zip(keys, [0, *ends], ends):
                ids = every[a:b]
                holding[ids] += 1  # by one, however often the document holds an id
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    whole = len(piece) == window
                    rows.append((key, start, len(piece), crc32(piece) if whole else None, len(ids), full if whole else None, None if whole else int(mixed[piece].min()), None if whole else z.compress(piece), None))
                    full += whole
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        if holding.any():
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(schema)[:-1]), pa.array([z.compress(holding.tobytes())], pa.binary())], schema=schema)

    kept = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return kept.mapInArrow(run, "id long, start long, length long, crc long, total long, seq long, sig long, ids binary, counts binary").withColumn("task", F.spark_partition_id())


class Shard:
    """A BM25 inverted index over the remainders of one shard, from which windows are filled."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        self.ids, self.at, self.next = ids, np.zeros(len(ids), np.int64), 0
        self.left = np.array([len(x) for x in ids], np.int64)
        length = self.left.copy()
        pairs, tf = np.unique(np.repeat(np.arange(len(ids)), length) * len(idf) + np.concatenate(ids), return_counts=True)
        doc, self.terms = np.divmod(pairs, len(idf))
        self.begin = np.searchsorted(doc, np.arange(len(ids) + 1))
        impact = idf[self.terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean))
        order = np.argsort(self.terms, kind="stable")
        self.term, self.doc, self.impact = self.terms[order].astype(np.int32), doc[order].astype(np.int32), impact[order]
        self.terms, self.used, self.listed = self.terms.astype(np.int32), 0, len(ids)

    def neighbours(self, seed: int, room: int) -> list[int]:
        """Unused remainders that share a term with the seed, best BM25 score first: as many as fill room, or all there are."""
        if self.used * 4 > self.listed:  # the lists forget what is used
            keep = self.left[self.doc] > 0
            self.term, self.doc, self.impact = self.term[keep], self.doc[keep], self.impact[keep]
            self.listed, self.used = self.listed - self.used, 0
        asked = self.terms[self.begin[seed] : self.begin[seed + 1]]
        first, last = np.searchsorted(self.term, asked).tolist(), np.searchsorted(self.term, asked, "right").tolist()
        doc, impact = (np.concatenate([x[a:b] for a, b in zip(first, last)]) for x in (self.doc, self.impact))
        score = np.bincount(doc, impact, len(self.ids))
        score[seed] = 0
        found = np.flatnonzero((score > 0) & (self.left > 0))
        k, best = 16, found
        while k < len(found):
            best = found[np.argpartition(-score[found], k)[:k]]
            if self.left[best].sum() >= room:
                break
            k, best = 4 * k, found
        return best[np.lexsort((best, -score[best]))].tolist()

    def unused(self) -> int | None:
        while self.next < len(self.left) and not self.left[self.next]:
            self.next += 1
        return self.next if self.next < len(self.left) else None


def filled(shards, window: int = WINDOW):
    """Sequences as lists of (shard, remainder, offset in it, length): all are full but the last, which falls into powers of two."""
    now, room = [], window
    for shard in shards:
        waiting, rest = [], None
        while (first := shard.unused()) is not None:
            if not waiting:
                seed = first if rest is None else rest
                lack = room - int(shard.left[seed])
                rest, waiting = None, [seed, *(shard.neighbours(seed, lack) if lack > 0 else [])][::-1]
            k = waiting.pop()
            n = min(int(shard.left[k]), room)
            if not n:
                continue
            now.append((shard, k, int(shard.at[k]), n))
            shard.at[k] += n
            shard.left[k] -= n
            shard.used += not shard.left[k]
            room -= n
            if not room:
                yield now
                now, room, waiting = [], window, []
                rest = k if shard.left[k] else None  # a cut remainder seeds the next window
    while now:
        goal, part = 1 << (sum(x[3] for x in now).bit_length() - 1), []
        while goal:
            shard, k, at, n = now.pop(0)
            if n > goal:
                now.insert(0, (shard, k, at + goal, n - goal))
                n = goal
            part.append((shard, k, at, n))
            goal -= n
        yield part


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (see the module).

    Null texts are empty and still have the end id; rows with a null or repeated id are documents like others. Every id is in
    exactly one piece. Only the last sequences of a partition are shorter than the window, each as long as a power of two, so
    nothing is padded. Document frequencies and the mean length are those of all documents. No documents give no rows. Other columns are
    not read, whatever their names.
    """
    small_batches(docs.sparkSession)
    size = max(encoder(tokenizer).vocabulary, end_id + 1)
    dtype = encoder(tokenizer).dtype
    cuts = written(cut(docs, tokenizer, end_id, id_col, text_col, window), "cuts")
    rest = cuts.where("ids is not null")
    n_docs, n_ids, n_rest = cuts.where("counts is null").agg(F.count(F.when(F.col("start") == 0, 1)), F.sum(F.when(F.col("start") == 0, F.col("total"))), F.sum(F.when(F.col("crc").isNull(), F.col("length")))).first()
    holding = summed_counts(cuts, size)
    idf = np.log(1 + ((n_docs or 0) - holding + 0.5) / (holding + 0.5)).clip(0)
    mean = min(float(window), (n_ids or 1) / max(n_docs or 1, 1))

    def run(batches):
        import zstandard

        part, n, z = TaskContext.get().partitionId(), 0, zstandard.ZstdDecompressor()

        def shards():
            rows, ids, held = [], [], 0
            for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
                columns = [c.to_pylist() for c in batch.columns]
                for row, raw in zip(zip(*columns[:3]), columns[3]):
                    ids.append(np.frombuffer(z.decompress(raw), dtype))
                    rows.append(row)
                    held += len(ids[-1])
                    if held >= SHARD_IDS:
                        yield shard_of(rows, ids)
                        rows, ids, held = [], [], 0
            if rows:
                yield shard_of(rows, ids)

        def shard_of(rows, ids):
            shard = Shard(ids, idf, mean)
            shard.rows = rows
            return shard

        out = []
        for sequence in filled(shards(), window):
            offset = 0
            for shard, k, at, length in sequence:
                key, start, total = shard.rows[k]
                out.append((key, start + at, length, crc32(shard.ids[k][at : at + length]), total, (1 << 62) + (part << 36) + n, offset))
                offset += length
            n += 1
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=_PIECE)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=_PIECE)

    whole = cuts.where("crc is not null").select(F.col("id").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"), F.col("total").alias("doc_tokens"), (F.shiftleft(F.col("task").cast("long"), 36) + F.col("seq")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    partitions = max(1, -(-int(n_rest or 0) // PARTITION_IDS))
    order = ["sig", "id", F.crc32("ids")]
    ranged = rest.select("id", "start", "total", "ids", "sig").repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return whole.unionByName(ranged.mapInArrow(run, _PIECES))


def op10_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
