"""Binary token files: frequency-ranked ids in byte-aligned variable length.

Texts are encoded once and staged; token counts over the whole corpus rank the
ids, so frequent ids become small numbers. A block holds documents in ascending
id order: two control bits a number (its bytes less one) in one byte array, the
numbers' bytes in another, and the documents' ids and lengths. Blocks are rows
of a Parquet data set written by Spark in its range partitions' order, so a
lost task is simply run again; a second small table holds the ranking. Decoding
looks up four lengths per control byte in a table.

Defined results: a null or empty text has only the end id; documents of one id
are ordered by the checksum of their ids; null ids come first; very long texts
are blocks of their own; other columns are ignored; an empty table gives an
empty data set.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choicelens.llm.staging import shared_path, staged
from choicelens.llm.textcols import pieces, utf8
from choicelens.llm.tokens import encoder
from choicelens.llm.workers import released

# bytes of the four numbers of each control byte
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.uint8) + 1


def encode_numbers(v: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    v = v.astype(np.uint32)
    size = 1 + (v > 0xFF).astype(np.int64) + (v > 0xFFFF) + (v > 0xFFFFFF)
    bits = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    bits[:len(v)] = size - 1
    quad = bits.reshape(-1, 4)
    control = quad[:, 0] | quad[:, 1] << 2 | quad[:, 2] << 4 | quad[:, 3] << 6
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        has = size > k
        data[at[has] + k] = (v[has] >> np.uint32(8 * k)) & np.uint32(0xFF)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_numbers(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of a block."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    at = np.cumsum(size) - size
    raw = np.frombuffer(data, np.uint8)
    v = raw[at].astype(np.uint32)
    for k in range(1, 4):
        has = np.flatnonzero(size > k)
        if len(has):
            v[has] |= raw[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return v


def token_ids(docs: DataFrame, path: str, end_id: int, drops_space: bool, id_col: str = "doc_id",
              text_col: str = "text", wide: bool = False) -> DataFrame:
    """(doc_id, crc, ids): little-endian ids with the end id, 16 bits each, or 32 if ``wide``.

    An id that 16 bits can't hold is an error without ``wide``. Each task adds a
    row of its own with its ids' counts (``kinds``, ``counts``; null in documents).
    """
    kind = "<u4" if wide else "<u2"
    none = [pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary())]

    def run(batches):
        enc = encoder(path, drops_space)
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for i, j in pieces(off):
                ids, n = enc.encode_bytes(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                if not wide and max(int(ids.max(initial=0)), end_id) > 0xFFFF:
                    raise ValueError(f"{path}: an id needs more than 16 bits; set wide=True")
                n_ids = np.bincount(ids)
                if len(n_ids) > len(total):
                    total = np.concatenate([total, np.zeros(len(n_ids) - len(total), np.int64)])
                total[:len(n_ids)] += n_ids
                if end_id >= len(total):
                    total = np.concatenate([total, np.zeros(end_id + 1 - len(total), np.int64)])
                total[end_id] += j - i
                out, crc, at = [], [], 0
                for size in n.tolist():
                    own = np.append(ids[at:at + size], np.uint32(end_id))
                    crc.append(zlib.crc32(own.astype("<u4").tobytes()))
                    out.append(own.astype(kind).tobytes())
                    at += size
                empty = pa.nulls(j - i, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array(crc, pa.int64()), pa.array(out, pa.binary()), empty, empty], names)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [*none, pa.array([at], pa.list_(pa.int64())), pa.array([total[at]], pa.list_(pa.int64()))], names)
    names = ["doc_id", "crc", "ids", "kinds", "counts"]
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(released(run, ("encoders",)), "doc_id long, crc long, ids binary, kinds array<bigint>, counts array<bigint>"))


def ranking(ids: DataFrame) -> list[int]:
    """Token ids by falling count over all documents, ties to the smaller id (one entry an id of the vocabulary)."""
    rows = (ids.where("kinds IS NOT NULL").select(F.explode(F.arrays_zip("kinds", "counts")).alias("c"))
            .groupBy("c.kinds").agg(F.sum("c.counts").alias("n")))
    return [r["kinds"] for r in sorted(rows.collect(), key=lambda r: (-r["n"], r["kinds"]))]


_BLOCK = ("part int, block int, first long, n_tokens long, doc_ids array<bigint>, doc_tokens array<bigint>, "
          "control binary, data binary")


def write_token_files(docs: DataFrame, out: str, path: str, end_id: int = 1, drops_space: bool = True,
                      id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 1 << 16,
                      wide: bool = False) -> None:
    """Write the block data set ``out/blocks`` and the ranking ``out/ranking``."""
    spark, kind = docs.sparkSession, "<u4" if wide else "<u2"
    ids = staged(token_ids(docs, path, end_id, drops_space, id_col, text_col, wide), "token-ids")
    order = ranking(ids)
    ids = ids.where("kinds IS NULL").select("doc_id", "crc", "ids")
    spark.createDataFrame([(r, i) for r, i in enumerate(order)], "rank long, id long").coalesce(1).write.parquet(f"{out}/ranking")
    rank = np.zeros(max(order, default=0) + 1, np.uint32)
    rank[order] = np.arange(len(order))

    def run(batches):
        held, size, block, first, part = [], 0, 0, 0, 0

        def flush():
            docs_, n, raw = zip(*held)
            control, data = encode_numbers(rank[np.frombuffer(b"".join(raw), kind)])
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first]), pa.array([size]),
                 pa.array([list(docs_)], pa.list_(pa.int64())), pa.array([list(n)], pa.list_(pa.int64())),
                 pa.array([control], pa.binary()), pa.array([data], pa.binary())], [c.split()[0] for c in _BLOCK.split(", ")])
        width = np.dtype(kind).itemsize
        for batch in batches:
            for p, d, x in zip(*(batch.column(i).to_pylist() for i in range(3))):
                part, n = p, len(x) // width
                if held and size + n > block_tokens:
                    yield flush()
                    held, size, block, first = [], 0, block + 1, first + size
                held.append((d, n, x))
                size += n
        if held:
            yield flush()
    (ids.repartitionByRange("doc_id", "crc").sortWithinPartitions("doc_id", "crc")
     .select(F.spark_partition_id().alias("part"), "doc_id", "ids").mapInArrow(released(run), _BLOCK)
     .write.option("compression", "none").parquet(f"{out}/blocks"))


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary): ids as little-endian 32-bit, read back from the files."""
    blocks = spark.read.parquet(f"{out}/blocks")
    order = spark.read.parquet(f"{out}/ranking").orderBy("rank").select("id").collect()
    back = np.array([r["id"] for r in order], "<u4")
    # one row for each range partition written
    before, total = {}, 0
    for r in sorted(blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r["part"]):
        before[r["part"]] = total
        total += r["n"]

    def run(batches):
        for batch in batches:
            for b in batch.to_pylist():
                ids = back[decode_numbers(b["control"], b["data"], b["n_tokens"])]
                n = np.array(b["doc_tokens"], np.int64)
                at = np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b["doc_ids"], pa.int64()), pa.array(at + before[b["part"]] + b["first"]), pa.array(n),
                     pa.array([ids[i:i + k].tobytes() for i, k in zip(at.tolist(), n.tolist())], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"])
    return blocks.mapInArrow(released(run), "doc_id long, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the files into the shared folder and return what reading them gives."""
    out = shared_path(docs.sparkSession, "token-files")
    write_token_files(docs, out, path, **options)
    return read_token_files(docs.sparkSession, out)
