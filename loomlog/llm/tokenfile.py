"""Token ids of a whole corpus in order of doc_id, written as coded blocks and read back.

A dataset is a folder of Parquet files with a row for each block: `part` and `block` (its place), `first` and `skip` (the number, in its part, of
the document in which its first id lies, and how many ids of that came before), and `data`, a self-describing block
of loomlog.llm.codec. A second table `index` has for each document its place (`part`, `row`), its number of ids, and the
ids of all documents before it. Spark's writer commits both, so a lost executor leaves no half-written file, and any store that
Spark reads will do. export() makes one plain file of a dataset in a local folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.llm import codec
from loomlog.llm.common import sliced
from loomlog.llm.textbytes import column_bytes
from loomlog.llm.tokens import VOCABULARY, encoder

END = 0


def _coded(vocabulary: str, size: int):
    """Sorted rows (doc_id, text) of one partition as rows of blocks and rows of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, waiting, block, row, starts, at = [], 0, 0, 0, [], 0

        def rows(kind, n, **cols):
            given = {"kind": pa.array([kind] * n), "part": pa.array(np.full(n, part, np.int32)), **cols}
            full = [given.get(f.name, pa.nulls(n, f.type)) for f in schema]
            return pa.RecordBatch.from_arrays(full, schema=schema)

        def flush(last: bool) -> pa.RecordBatch | None:
            nonlocal held, waiting, block, starts
            ids = np.concatenate(held)
            cut = len(ids) if last else len(ids) // codec.BLOCK * codec.BLOCK
            coded = codec.encode(ids[:cut], size)
            held, waiting = [ids[cut:].copy()], len(ids) - cut
            if not coded:
                return None
            begin = (block + np.arange(len(coded))) * codec.BLOCK
            known = np.array([s for s, _ in starts], np.int64)
            which = np.searchsorted(known, begin, "right") - 1
            number = np.array([n for _, n in starts], np.int64)
            out = rows("block", len(coded), block=pa.array(block + np.arange(len(coded), dtype=np.int64)), first=pa.array(number[which]), skip=pa.array(begin - known[which]), data=pa.array(coded, pa.binary()))
            block += len(coded)
            starts = starts[int(np.searchsorted(known, block * codec.BLOCK, "right")) - 1 :]
            return out

        for batch in batches:
            for piece in sliced(batch):
                ids, begin = encoder(vocabulary).encode(*column_bytes(piece["text"]), END)
                docs = piece.num_rows
                yield rows("doc", docs, row=pa.array(np.arange(row, row + docs, dtype=np.int64)), doc_id=piece["doc_id"].cast(pa.int64()), n_tokens=pa.array(np.diff(begin)))
                starts += zip((at + begin[:-1]).tolist(), range(row, row + docs))
                held.append(ids)
                row, at, waiting = row + docs, at + len(ids), waiting + len(ids)
                if waiting >= codec.BLOCK and (out := flush(False)) is not None:
                    yield out
        if waiting and (out := flush(True)) is not None:
            yield out

    schema = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("skip", pa.int64()), ("data", pa.binary())])
    return run


SCHEMA = "kind string, part int, row long, doc_id long, n_tokens long, block long, first long, skip long, data binary"


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY) -> None:
    """Writes docs (doc_id, text) to path, in ascending order of doc_id and, among rows that repeat one, of text; null ids come first.

    A null or empty text has the end id alone. An empty table gives an empty dataset.
    """
    size = encoder(vocabulary).tokenizer.get_vocab_size()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the second key parts rows of a doc_id that repeats very often
    ordered = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(_coded(vocabulary, size), SCHEMA).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/coded")
    spark = docs.sparkSession
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/coded").where("kind = 'doc'")
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each task
    before = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    index = rows.join(before.select("part", "before"), "part").select("part", "row", "doc_id", "n_tokens", (F.col("before") + F.coalesce(own, F.lit(0))).alias("start"))
    index.write.mode("overwrite").parquet(f"{path}/index")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks joined by nothing: each block's ids with its place."""
    for batch in batches:
        for k in range(batch.num_rows):
            b = batch.slice(k, 1)
            (ids,) = codec.decode(b["data"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["part"], b["block"], b["first"], b["skip"], pa.array([ids.tobytes()], pa.binary())], ["part", "block", "first", "skip", "ids"])


def read_blocks(spark, path: str) -> DataFrame:
    """(part, block, first, skip, ids): the decoded ids of each block as little-endian unsigned 32-bit integers. Damaged blocks raise codec.Corrupt."""
    blocks = spark.read.schema(SCHEMA).parquet(f"{path}/coded").where("kind = 'block'")
    return blocks.select("part", "block", "first", "skip", "data").mapInArrow(_pieces, "part int, block long, first long, skip long, ids binary")


def _crc_combine(crc1: int, crc2: int, length2: int) -> int:
    """The crc32 of two byte strings one after the other, from theirs and the second's length (products of GF(2) polynomials)."""

    def times(a: int, b: int) -> int:
        out = 0
        for k in range(31, -1, -1):
            if a >> k & 1:
                out ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return out

    shift, power = 1 << 31, 1 << 23  # x**0 and x**8, bits reversed
    while length2:
        if length2 & 1:
            shift = times(shift, power)
        power = times(power, power)
        length2 >>= 1
    return times(crc1, shift) ^ crc2


def digests(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the dataset's files.

    Documents are split over the ids that blocks hold of them: each block gives, for each document in it, the number
    and the crc32 of its ids there; parts of one document are then put together in their order. Rows that repeat a
    doc_id are documents of their own, and so are rows without one.
    """
    index = spark.read.parquet(f"{path}/index")
    blocks = spark.read.schema(SCHEMA).parquet(f"{path}/coded").where("kind = 'block'").select("part", "block", "first", "skip", "data")
    # how a block divides: the lengths of the documents that lie in it
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    spread = index.withColumn("at", F.coalesce(own, F.lit(0))).withColumn("to", F.col("at") + F.col("n_tokens") - 1)
    size = F.lit(codec.BLOCK)
    spread = spread.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor(F.col("to") / size))))
    piece = F.struct("row", (F.least(F.col("to") + 1, (F.col("block") + 1) * size) - F.greatest(F.col("at"), F.col("block") * size)).alias("n"))
    layout = spread.groupBy("part", "block").agg(F.sort_array(F.collect_list(piece)).alias("docs"))  # BLOCK documents at most

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (ids,), docs = codec.decode([batch["data"][k].as_py()]), batch["docs"][k].values
                n, raw = docs.field("n").to_numpy(), memoryview(ids.tobytes())
                ends = 4 * np.cumsum(n)
                if ends[-1] != len(raw):
                    raise codec.Corrupt("the index doesn't fit the blocks")
                crcs = [zlib.crc32(raw[a:b]) for a, b in zip((ends - 4 * n).tolist(), ends.tolist(), strict=True)]
                same = lambda c, kind: pa.array(np.full(len(n), batch[c][k].as_py()), kind)
                yield pa.RecordBatch.from_arrays([same("part", pa.int32()), docs.field("row"), same("block", pa.int64()), docs.field("n"), pa.array(crcs, pa.int64())], ["part", "row", "block", "n", "crc"])

    pieces = blocks.join(layout, ["part", "block"]).select("part", "block", "docs", "data").mapInArrow(cut, "part int, row long, block long, n long, crc long")
    # most documents lie in one or two blocks; those of many have a row for each block
    grouped = pieces.groupBy("part", "row").agg(F.sort_array(F.collect_list(F.struct("block", "n", "crc"))).alias("pieces"), F.sum("n").alias("n"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pieces in batch["pieces"].to_pylist():
                crc = pieces[0]["crc"]
                for p in pieces[1:]:
                    crc = _crc_combine(crc, p["crc"], 4 * p["n"])
                out.append(crc)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "start", "n")), pa.array(out, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    found = index.select("part", "row", "doc_id", "start").join(grouped, ["part", "row"]).select("doc_id", "start", "n", "pieces")
    return found.mapInArrow(joined, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export(spark, path: str, file: str) -> None:
    """All blocks in order as one local file, each as its length (4 bytes, little-endian) and its bytes."""
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/coded").where("kind = 'block'").orderBy("part", "block").select("data")
    with Path(file).open("wb") as out:
        for r in rows.toLocalIterator():
            out.write(len(r["data"]).to_bytes(4, "little") + bytes(r["data"]))


def import_file(file: str) -> np.ndarray:
    """The ids of a file that export() wrote."""
    raw, at, blocks = Path(file).read_bytes(), 0, []
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "little")
        blocks.append(raw[at + 4 : at + 4 + n])
        at += 4 + n
    return np.concatenate(codec.decode(blocks)) if blocks else np.zeros(0, np.uint32)
