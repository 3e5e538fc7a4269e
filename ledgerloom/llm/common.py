"""What the operators of this subpackage share: tables, bounded Arrow batches, row keys."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import forget, saved

__all__ = ["bounded_batches", "by_bytes", "forget", "forgetful", "frequent", "give_back", "id_remainder", "level", "picked", "saved", "table"]

#: Bytes of one Arrow batch that Spark sends to a Python worker, about, and of texts that a function works on at a time.
ARROW_BYTES, TEXT_BYTES = 8 << 20, 1 << 20
#: Bytes of such a batch in the pipeline, whose stages share their workers and executors.
STAGE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def bounded_batches(spark: SparkSession, most: int = ARROW_BYTES) -> None:
    """Bound Arrow batches by bytes, as texts can be long: results are the same with any bound, and one that is lower already stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, None) or 1 << 40) > most:
        spark.conf.set(name, str(most))


def give_back() -> None:
    """Freed memory that this process's allocators keep goes back to the system: workers are reused, and what they keep counts for their executor while later stages run."""
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)  # glibc's; other C libraries have none


def forgetful(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *clear: Callable[[], None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function of a task; where it ends, also early or by an error, its caches are emptied by clear and its memory is given back, so that it doesn't count in the stages that come after in the same worker."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for f in clear:
                f()
            give_back()

    return task


def by_bytes(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose column holds at most so many bytes, or one row; at their end, freed memory is given back."""
    for b in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, end - at)
            at = end
    b = upto = None
    give_back()


def picked(h: Column, most: int, total: int) -> Column:
    """Whether a 64-bit hash is in a share of most in total, by 63 of its bits: the share doesn't reach 0, nor does the sample outgrow most, at any total."""
    bound = (1 << 63) * most // max(total, 1)
    return F.lit(True) if bound >> 63 else h.bitwiseAND((1 << 63) - 1) < F.lit(bound).cast("bigint")


def id_remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo modulus; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def frequent(rows: DataFrame, count: str, most: int) -> int:
    """The lowest level of count (16 to a doubling) from which on there are at most ``most`` rows."""
    least, n = 1 << 20, 0
    for r in sorted(rows.groupBy(level(count).alias("level")).count().where("level is not null").collect(), reverse=True):  # a thousand rows at most
        if (n := n + r["count"]) > most:
            break
        least = r.level
    return least


def level(count: str) -> Column:
    return F.floor(F.log2(F.when(F.col(count) > 0, F.col(count))) * 16).cast("int")
