"""What the operators of this package share: work tables in the shared folder, row packing, dense counts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is missing and everything runs in this process (tests) is it a local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quern-')}"
    return f"{base.rstrip('/')}/quern-{uuid.uuid4().hex}"


class Work:
    """Tables that an operator writes and reads again, so that no later step repeats the work of an earlier one."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, work_dir(spark)

    def save(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables that nothing will read any more; without names, all."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names or [""]:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            path.getFileSystem(conf).delete(path, True)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, doc_id and text, whatever else the table holds; null texts become empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n (null: as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(n))


_remembered: dict[str, dict] = {}


def remembered(name: str) -> dict:
    """What an operator keeps in a worker from task to task. Workers serve one operator after another: what others kept goes."""
    for other in [x for x in _remembered if x != name]:
        del _remembered[other]
    return _remembered.setdefault(name, {})


def give_back() -> None:
    """Freed memory goes back to the system, so that workers which wait don't keep the most that they ever took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(f, *groups: pa.Table) -> pa.Table:
    """f(*groups); what it needed on its way is given back before the next group."""
    out = f(*groups)
    give_back()
    return out


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20, keeps: str = "") -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of a piece are about `limit` bytes at most (one longer text makes a piece of its own).

    keeps: the name of what the operator keeps in its worker, if it keeps anything.
    """
    remembered(keeps)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        arr = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.diff(text_offsets(arr)))
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def text_offsets(arr: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    return np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after another, and where each starts (with the end of the last)."""
    at = text_offsets(arr)
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


PAGE = 4096


def pages_out(vector: np.ndarray, first_page: int = 0) -> Iterator[pa.RecordBatch]:
    """A vector of counts as rows (page, counts), pages of zeros left out; each page in the smallest integer type that holds it."""
    grid = vector.reshape(-1, PAGE)
    keep = np.flatnonzero(grid.any(axis=1))
    for lo in range(0, len(keep), 64):
        some = keep[lo : lo + 64]
        yield pa.record_batch([pa.array(some + first_page, pa.int32()), pa.array([shrunk(grid[k]) for k in some], pa.binary())], names=["page", "counts"])


def shrunk(counts: np.ndarray) -> bytes:
    top = int(counts.max(initial=0))
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max)
    return counts.astype(kind).tobytes()


def grown(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(raw) // PAGE]).astype(np.int64)


PAGES_SCHEMA = "page int, counts binary"


def sum_pages(df: DataFrame) -> DataFrame:
    """Sums rows (page, counts) by page. A task adds up as it reads and holds one vector per page of its own."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for page, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if page in sums:
                    sums[page] += grown(raw)
                else:
                    sums[page] = grown(raw)
        done = sorted(sums)
        for lo in range(0, len(done), 64):
            some = done[lo : lo + 64]
            yield pa.record_batch([pa.array(some, pa.int32()), pa.array([shrunk(sums[k]) for k in some], pa.binary())], names=["page", "counts"])

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "page").mapInArrow(add, PAGES_SCHEMA)


def vector_of(pages: DataFrame, size: int) -> np.ndarray:
    """The whole vector on the driver; `size` (a multiple of PAGE) is fixed by a parameter of the operator, not by the data."""
    out = np.zeros(size, np.int64).reshape(-1, PAGE)
    got = sum_pages(pages).toArrow()
    for page, raw in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
        out[page] = grown(raw)
    return out.reshape(-1)
