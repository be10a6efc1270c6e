"""Token ids in binary files, by bit-plane shuffling.

Documents in ascending order of id are encoded, an end id follows each, and runs of whole documents become chunks.
A chunk's ids are cut into blocks of a fixed number of ids; each block is transposed into byte planes (all low
bytes, then all next bytes) or bit planes (all lowest bits, and so on), each plane is compressed with zstandard,
and the chunk index keeps the planes' lengths, the documents' ids and lengths, the place of the chunk's first id, the
block size, the kind of planes and the end id: a set describes itself.

A token set is a folder of two Parquet tables: ``chunks`` (one row for each chunk, its planes as one binary value)
and ``index`` (one row for each chunk, without the planes). Chunks hold whole documents, so any of them can be read
alone. A document of more ids than a chunk has one to itself.

Rows are range-partitioned by id and a hash of the text, so rows that share an id are dealt over several tasks.

Defined results: a null text has the end id only; rows of one doc_id stay apart, in order of a hash of their texts, then
of the texts; a null doc_id comes first; an empty table makes a set without chunks. Other columns are not stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import pieces_of
from .common import fresh_path, sent_if_small

CHUNKS = "part int, chunk int, doc_ids array<bigint>, lengths array<bigint>, n_ids bigint, width int, block int, bits boolean, end_id int, planes array<int>, body binary"


@dataclass(frozen=True)
class Format:
    block: int = 16_384  # ids of a block
    chunk: int = 1 << 18  # ids of a chunk, about
    bits: bool = False  # bit planes instead of byte planes
    level: int = 3


def to_planes(ids: np.ndarray, form: Format) -> tuple[list[int], bytes]:
    """Lengths of the compressed planes, block by block, and the planes one after another."""
    press = zstandard.ZstdCompressor(level=form.level)
    sizes, out = [], []
    for at in range(0, len(ids), form.block):
        rows = ids[at : at + form.block].view(np.uint8).reshape(-1, ids.itemsize)
        if form.bits:
            planes = np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1)
        else:
            planes = rows.T
        for plane in planes:
            out.append(press.compress(np.ascontiguousarray(plane).tobytes()))
            sizes.append(len(out[-1]))
    return sizes, b"".join(out)


def from_planes(sizes: list[int], body: bytes, n: int, width: int, form: Format) -> np.ndarray:
    """The ids of a chunk; of the form its block and bits count."""
    plain, at, k, out = zstandard.ZstdDecompressor(), 0, 0, []
    per = 8 * width if form.bits else width
    for start in range(0, n, form.block):
        size, planes = min(form.block, n - start), []
        for _ in range(per):
            planes.append(np.frombuffer(plain.decompress(body[at : at + sizes[k]]), np.uint8))
            at, k = at + sizes[k], k + 1
        if form.bits:
            rows = np.packbits(np.unpackbits(np.stack(planes), axis=1, count=size).T, axis=1, bitorder="little")
        else:
            rows = np.stack(planes, axis=1)
        out.append(np.ascontiguousarray(rows).reshape(-1).view(f"<u{width}"))
    return np.concatenate(out) if out else np.zeros(0, f"<u{width}")


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int = 0, form: Format = Format(), parts: int | None = None) -> None:
    """Encodes (doc_id, text) rows and writes them as the token set ``path``."""
    spark = documents.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = ["doc_id", F.xxhash64("text")]
    ordered = documents.select("doc_id", "text").repartitionByRange(parts, *place).sortWithinPartitions(*place, "text")
    ordered = ordered.withColumn("part", F.spark_partition_id())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, chunk = pieces_of(tokenizer), 0
        end = np.array([end_id], dtype=pieces.width).tobytes()
        held, docs, lengths, size = [], [], [], 0

        def packed(part: int) -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype=pieces.width)
            sizes, body = to_planes(ids, form)
            rows = {"part": part, "chunk": chunk, "doc_ids": list(docs), "lengths": list(lengths), "n_ids": len(ids), "width": ids.itemsize, "block": form.block, "bits": form.bits, "end_id": end_id, "planes": sizes, "body": body}
            return pa.RecordBatch.from_pylist([rows], schema=SCHEMA)

        part = 0
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = pieces.encode(text.as_py() or "") + end
                n = len(ids) // int(pieces.width[2])
                if size and size + n > form.chunk:
                    yield packed(part)
                    held, docs, lengths, size, chunk = [], [], [], 0, chunk + 1
                held.append(ids)
                docs.append(doc.as_py())
                lengths.append(n)
                size += n
        if docs:
            yield packed(part)

    chunks = ordered.mapInArrow(encode, CHUNKS)
    chunks.write.option("compression", "none").parquet(f"{path}/chunks")
    stored = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").drop("body")
    by_part = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))
    stored.join(by_part, "part").withColumn("first_id", first).drop("_before").write.parquet(f"{path}/index")


SCHEMA = pa.schema([
    ("part", pa.int32()), ("chunk", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ("n_ids", pa.int64()), ("width", pa.int32()), ("block", pa.int32()), ("bits", pa.bool_()), ("end_id", pa.int32()), ("planes", pa.list_(pa.int32())), ("body", pa.binary()),
])


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of a token set's documents; start counts ids before the document."""
    index = sent_if_small(spark.read.parquet(f"{path}/index").select("part", "chunk", "first_id"))
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").join(index, ["part", "chunk"])
    kind = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                form = Format(block=row["block"], bits=row["bits"])
                ids = from_planes(row["planes"], row["body"], row["n_ids"], row["width"], form).astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                cols = [
                    pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["first_id"], pa.int64()), pa.array(row["lengths"], pa.int64()),
                    pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    offsets = np.concatenate([[0], ends]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return chunks.select("doc_ids", "lengths", "n_ids", "width", "block", "bits", "planes", "body", "first_id").mapInArrow(decode, kind)


def new_token_set(spark: SparkSession) -> str:
    return fresh_path(spark, "tokens")
