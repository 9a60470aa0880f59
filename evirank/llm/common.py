"""Helpers that the operators share: scratch tables, column checks and byte-level text access."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import materialize, scratch_path, shared_dir

__all__ = [
    "ALNUM", "ASCII_SPACE", "LOWER", "batches", "bounded_sample", "broadcast_if_small", "bytes_of", "held_out", "materialize", "quoted", "rows_with", "runs", "scratch_path",
    "shared_dir", "table", "text_hash",
]

#: The whitespace class ``[\x20\x09-\x0D]``; ``bytes.split()`` splits at just these bytes.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: Lower-cases A-Z only.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Lower-cases A-Z and turns every byte outside ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` into a space.
#: UTF-8 bytes of non-ASCII characters are all at least 0x80, so the class works byte by byte.
ALNUM = bytes(
    LOWER[b] if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= LOWER[b] <= 0x7A else 0x20 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bytes_of(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without a decode."""
    return column.cast(pa.large_binary()).to_pylist()


def text_hash() -> Column:
    """text_hash: 64 bits of the column text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text leaves remainder 0; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds) == 0, F.lit(True))


def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The non-empty batches.  A worker serves task after task, so what Arrow holds unused goes back at the end."""
    for b in rows:
        if b.num_rows:
            yield b
    pa.default_memory_pool().release_unused()


def bounded_sample(rows: DataFrame, key: str, max_rows: int, max_bytes: int, text: str = "text", seed: int = 7) -> DataFrame:
    """Rows chosen by a hash of ``key`` so that about 95 % of the smaller bound is used: all rows if they fit.
    The choice follows neither order nor partitioning."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    share = min(max_rows / max(n, 1), max_bytes / max(size, 1))
    if share >= 1:
        return rows
    return rows.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(0.95 * share * (1 << 30)))


def runs(rows: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Batches of rows sorted by their first ``keys`` columns, cut where a key changes, each with whether a
    new key begins."""
    last: tuple | None = None
    for b in batches(rows):
        cuts = {0, b.num_rows}
        for i in range(keys):
            c = b.column(i)
            changed = pc.invert(pc.equal(c.slice(1), c.slice(0, b.num_rows - 1)))
            cuts.update((pc.indices_nonzero(changed).to_numpy() + 1).tolist())
        at = sorted(cuts)
        for i, j in zip(at[:-1], at[1:], strict=True):
            key = tuple(b.column(k)[i].as_py() for k in range(keys))
            yield key != last, b.slice(i, j - i)
            last = key


#: Keys of 8 bytes or two that go out as a broadcast; more meet their rows in a shuffle.
BROADCAST_KEYS = 1_000_000


def broadcast_if_small(keys: DataFrame) -> DataFrame:
    """``keys`` (a column or two of 8 bytes) marked for a broadcast if they are ``BROADCAST_KEYS`` at most."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def rows_with(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` (a long, not null) is among ``keys`` (one column of that name).  Few keys go to the
    rows, so that no other row is shuffled."""
    found = broadcast_if_small(keys.withColumnRenamed(key, "__key"))
    return rows.join(found, F.col(key) == F.col("__key"), "left_semi")


def quoted(name: str) -> str:
    """A column name as it stands in an expression."""
    return "`" + name.replace("`", "``") + "`"
