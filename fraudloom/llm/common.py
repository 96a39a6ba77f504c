"""Column rules and packing helpers that several operators of this subpackage share."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import scratch_path, settle

__all__ = ["DOCUMENT_COLUMNS", "held_out", "join_split", "read", "remainder", "settle", "slices", "text_bytes", "write_packs", "unpack"]

C = F.col
#: The columns of the documents table, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
PACK_SCHEMA = T.StructType([
    T.StructField("pack", T.LongType()), T.StructField("blob", T.BinaryType()),
    T.StructField("kind", T.StringType()), T.StructField("bucket", T.IntegerType()),
    T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType())])
_ARROW_PACK = pa.schema([("pack", pa.int64()), ("blob", pa.binary()), ("kind", pa.string()), ("bucket", pa.int32()),
                         ("keys", pa.binary()), ("counts", pa.binary())])


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def held_out(doc_id: str, modulus: int, rest: int) -> Column:
    """True for the held-out fold; rows without an id are in no fold."""
    return F.coalesce(remainder(doc_id, modulus) == rest, F.lit(False))


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """UTF-8 bytes of a text column, over all rows."""
    return df.agg(F.coalesce(F.sum(F.octet_length(col)), F.lit(0)).alias("b")).first()["b"]


def slices(batch: pa.RecordBatch, text: int, rows: int = 2000, size: int = 8 << 20):
    """Slices of a batch of at most ``rows`` rows and about ``size`` bytes in column ``text``; a longer text is a slice by itself."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and (held + n > size or i - start >= rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)


def _seal(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as w:
        for b in batches:
            w.write_batch(b)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.Table:
    """The rows of one pack."""
    return pa.ipc.open_stream(blob).read_all()


def write_packs(df: DataFrame, requests, name: str, buckets: int, *, text: str = "text", pack_bytes: int = 6 << 20,
                max_rows: int = 16_000):
    """Cut the scan into packs of rows and write them, with what each pack asks of the corpus, to the shared folder.

    A pack is a run of rows of one input task holding about ``pack_bytes`` of text (one longer text makes a pack
    of its own), kept as one compressed row in ``blob``. ``requests(table)`` yields (kind, bucket, keys, counts)
    for a pack; these are rows of the same table, with a null ``blob``. The table is bucketed by ``pack``, so the
    answers are shuffled to the packs and no text is ever shuffled. Returns the table and a function that forgets its
    name, to be called once nothing is read from it any more; the files stay in the scratch folder.
    """
    def cut(batches):
        part, seq, held, size, rows = TaskContext.get().partitionId(), 0, [], 0, 0

        def emit():
            nonlocal seq, held, size, rows
            pack = (part << 32) | seq
            out = [{"pack": pack, "blob": _seal(held)}]
            out += [{"pack": pack, "kind": k, "bucket": b, "keys": keys, "counts": c}
                    for k, b, keys, c in requests(pa.Table.from_batches(held))]
            seq, held, size, rows = seq + 1, [], 0, 0
            return pa.RecordBatch.from_pylist(out, schema=_ARROW_PACK)

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
            start = 0
            for i, n in enumerate(lengths):
                if rows and (size + n > pack_bytes or rows >= max_rows):
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield emit()
                    start = i
                size, rows = size + int(n), rows + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield emit()

    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = f"llm_{path.rsplit('-', 1)[1]}"
    (df.mapInArrow(cut, PACK_SCHEMA).write.format("parquet").option("path", path).bucketBy(buckets, "pack").saveAsTable(table))
    return spark.table(table), lambda: spark.sql(f"DROP TABLE IF EXISTS {table}")


def broadcast_if_small(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """Mark a narrow table for broadcast when it has at most ``max_rows`` rows; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


#: a key with more than 1/HOT_SHARE of all rows is joined by broadcast; fewer than HOT_SHARE keys can be
HOT_SHARE = 2000


def join_split(rows: DataFrame, table: DataFrame, key: str, name: str, count: str = "count") -> DataFrame:
    """Left join of ``rows`` on ``key`` with ``table``, one row a key (column ``name``) with the number of rows in ``count``.

    Keys that hold more than 1/HOT_SHARE of the counted rows are joined where the rows lie, so no key, whatever its share,
    is a task of its own. The columns of ``table`` other than ``count`` are added.
    """
    table = settle(table, "join-table")
    hot = C(count) * HOT_SHARE > (table.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0] or 0)
    busy, rest = table.filter(hot).drop(count), table.filter(~hot).drop(count)
    keys = F.broadcast(busy.select(C(name).alias("_busy")))
    inner = rows.join(F.broadcast(busy), C(key) == C(name))
    other = rows.join(keys, C(key) == C("_busy"), "left_anti").join(rest.hint("merge"), C(key) == C(name), "left")
    return inner.unionByName(other)
