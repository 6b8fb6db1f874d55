"""Words, hashes and stage tables that the operators share."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlsplit

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.session import shared_dir

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_ROLL = 0x9E3779B97F4A7C15
_SHIFT = np.uint64(33)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``; only a local session may do without)."""
    return shared_dir(spark)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a stage to the shared folder and read it back: a lost executor costs a re-read."""
    path = f"{shared_folder(df.sparkSession)}/llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def binary(column: str) -> Column:
    """A text column as UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def lowered_words(data: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; ``bytes`` methods touch ASCII only."""
    return data.lower().split()


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    values = (values ^ (values >> _SHIFT)) * _MIX1
    values = (values ^ (values >> _SHIFT)) * _MIX2
    return values ^ (values >> _SHIFT)


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """One 64-bit hash per run of ``size`` words, by position; a shorter text is one run, an empty one has none."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = word_hashes(words)
    size_used = min(size, len(words))
    count = len(words) - size_used + 1
    rolled = np.full(count, np.uint64(size_used))
    for k in range(size_used):
        rolled = rolled * np.uint64(_ROLL) + hashes[k : k + count]
    return mixed(rolled)


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; the deterministic fold of a row (null: fold 0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def file_system(folder: str):
    """(pyarrow file system, path) of a shared folder named by URI or plain path."""
    from pyarrow import fs

    if urlsplit(folder).scheme:
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), os.path.abspath(folder)


def slices(batches, rows: int = 500):
    """Arrow batches in parts of ``rows`` rows, so that a worker holds few texts as Python objects at once (it keeps what it once took)."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """A stored table with a broadcast hint if it has at most ``most_rows`` rows; else as it is, for a plain join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


FILTER_BITS = 1 << 24  # 262,144 words of 64 bits: 4 MB, whatever the data


def likely(rows: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose ``columns`` may stand in ``wanted``: all that do, and few others.

    A bitmap of the wanted values' hashes, of fixed size, goes to every task, so that a following join moves little else.
    It decides nothing: with more values than bits it would only let more rows through.
    """
    at = F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))
    word, bit, mask = (fresh(rows, c) for c in ("filter_word", "filter_bit", "filter_mask"))
    placed = lambda df: df.withColumns({word: F.shiftright(at, 6), bit: at.bitwiseAND(F.lit(63)).cast("int")})
    words = placed(wanted.select(*columns)).groupBy(word).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias(mask))
    met = placed(rows).join(F.broadcast(words), word)
    return met.where(F.expr(f"({mask} & shiftleft(1L, {bit})) != 0")).select(*rows.columns)
