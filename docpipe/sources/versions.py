"""Tables that many deliveries add to: a compacted base in buckets, the deliveries since, and one current view of both.

A table's folder holds one folder per delivery (``epoch=N``), written by ``streaming.sink.replace_batch``. ``compact`` merges them
into a base below ``_base``: the rows of the greatest ``order`` of every key, in folders by hash of the key. It writes
only buckets that the new deliveries touch and then names the new version in a file of its own. A reader takes the
newest such file whole, so a version is seen entirely or not at all. The file records the data files of every delivery
it covers: a delivery that was replaced since no longer matches its record, and readers then go back to the
deliveries, which compaction never deletes. So a replay before, during or after a compaction loses no row.

Readers that know the keys they need read those buckets only.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.session import swept
from docpipe.streaming.sink import replace_batch

BUCKETS = 64
ROUND_BYTES, ROUNDS = 128 << 20, 8  # a compaction moves its rows in rounds of buckets, so that few are in shuffle files at once
BUCKET = "bucket"
_BASE, _VERSIONS = "_base", "_base/versions"


def bucket_of(key: list[str], buckets: int = BUCKETS) -> Column:
    """The bucket of a key; nulls count as values."""
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


@dataclass
class Version:
    """What one version of the base consists of."""

    number: int = 0
    buckets: int = 0
    deliveries: dict[str, str] = field(default_factory=dict)  # epoch: its data files, as a digest
    folders: dict[str, str] = field(default_factory=dict)  # bucket: folder below the base


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _children(spark: SparkSession, path: str) -> list[str]:
    files, at = _files(spark, path)
    return [s.getPath().getName() for s in files.listStatus(at(path))] if files.exists(at(path)) else []


def _digest(spark: SparkSession, folder: str) -> str:
    """A digest of a folder's data files; a rewritten file has another name."""
    files, at = _files(spark, folder)
    listed, names = files.listFiles(at(folder), True), []
    while listed.hasNext():
        status = listed.next()
        names.append(f"{status.getPath().getName()}:{status.getLen()}")
    return hashlib.sha256("\n".join(sorted(n for n in names if not n.startswith(("_", ".")))).encode()).hexdigest()


def _size(spark: SparkSession, folder: str) -> int:
    files, at = _files(spark, folder)
    return files.getContentSummary(at(folder)).getLength()


def deliveries(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removeprefix("epoch=")) for n in _children(spark, path) if n.startswith("epoch="))


def version(spark: SparkSession, path: str) -> Version:
    """The newest version of the base; an empty one before the first."""
    numbers = [int(n.removesuffix(".json")) for n in _children(spark, f"{path}/{_VERSIONS}") if n.endswith(".json")]
    if not numbers:
        return Version()
    text = spark.read.text(f"{path}/{_VERSIONS}/{max(numbers)}.json", wholetext=True).first()[0]
    return Version(**json.loads(text))


def _publish(spark: SparkSession, path: str, made: Version) -> None:
    """Name a version. The rename is one step, and fails if the number is taken, so of two writers one gives up."""
    files, at = _files(spark, path)
    draft, final = at(f"{path}/{_VERSIONS}/.{uuid.uuid4().hex}"), at(f"{path}/{_VERSIONS}/{made.number}.json")
    out = files.create(draft, True)
    out.write(bytearray(json.dumps(made.__dict__).encode()))
    out.close()
    if files.exists(final) or not files.rename(draft, final):
        raise RuntimeError(f"version {made.number} of {path} was written by another job")


def _read(spark: SparkSession, path: str, epochs: list[int], wanted: list[int] | None) -> DataFrame | None:
    if not epochs:
        return None
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/epoch={n}" for n in epochs])
    return rows if wanted is None or BUCKET not in rows.columns else rows.filter(F.col(BUCKET).isin(wanted))


def _base(spark: SparkSession, path: str, made: Version, wanted: list[int] | None) -> DataFrame | None:
    folders = [f for b, f in made.folders.items() if wanted is None or int(b) in wanted]
    if not folders:
        return None
    return spark.read.option("mergeSchema", False).parquet(*[f"{path}/{_BASE}/{f}" for f in folders])


def newest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows with the greatest ``order`` of their key; null keys compare as equal, several rows may share the greatest."""
    last = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.max(F.struct(*order)).alias("_order"))
    same = F.struct(*order).eqNullSafe(F.col("_order"))
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(last, same, "left_semi")


def _merged(
    base: DataFrame | None, tail: DataFrame | None, key: list[str], order: list[str], even: bool = False, later: bool = False
) -> DataFrame | None:
    """The newest rows of both. Base rows whose key the tail lacks are already the newest and are not grouped again.

    ``even``: all rows of the tail have one order. ``later``: and they come after all of the base.
    """
    if tail is None:
        return base
    if base is None:
        return tail if even else newest(tail, key, order)
    keys = tail.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()
    same = None
    for k in key:
        test = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = test if same is None else same & test
    columns = [c for c in base.columns if c != BUCKET or BUCKET in tail.columns]
    untouched = base.join(keys, same, "left_anti").select(*columns)
    if even and later:
        return untouched.unionByName(tail, allowMissingColumns=True)
    touched = base.join(keys, same, "left_semi").select(*columns)
    return untouched.unionByName(newest(touched.unionByName(tail, allowMissingColumns=True), key, order), allowMissingColumns=True)


def _covered(spark: SparkSession, path: str, made: Version, present: list[int]) -> bool:
    return all(int(n) in present and _digest(spark, f"{path}/epoch={n}") == d for n, d in made.deliveries.items())


def read_current(
    spark: SparkSession, path: str, key: list[str], order: list[str] | None = None, before: int | None = None,
    keys: DataFrame | None = None, buckets: int = BUCKETS,
) -> DataFrame | None:
    """The newest rows of every key, or None before the first delivery.

    ``order`` defaults to the delivery's number. ``before`` leaves out deliveries from that number on; then ``compact``
    must not have covered them (pass its ``upto``). ``keys`` holds the values of some key columns that are asked for:
    only their buckets are read (the table must be written by ``put`` and compacted by these columns), and only rows
    that have them go further, so what is read and moved follows ``keys`` and not the table.
    """
    order = order or ["epoch"]
    wanted = None if keys is None else [r[0] for r in keys.select(bucket_of(keys.columns, buckets)).distinct().collect()]
    present = [n for n in deliveries(spark, path) if before is None or n < before]
    made = version(spark, path)
    if not _covered(spark, path, made, present) or (wanted is not None and made.buckets not in (0, buckets)):
        made = Version()
    tail = _read(spark, path, [n for n in present if str(n) not in made.deliveries], wanted)
    base = _base(spark, path, made, wanted)
    if keys is not None:
        base, tail = (None if rows is None else rows.join(keys, keys.columns, "left_semi") for rows in (base, tail))
    return _merged(base, tail, key, order)


def put(rows: DataFrame, path: str, epoch: int, by: list[str], buckets: int = BUCKETS) -> None:
    """Write a delivery laid out by the bucket of the columns ``by``; the same delivery again replaces itself."""
    laid = rows.withColumn(BUCKET, bucket_of(by, buckets)).hint("rebalance", BUCKET)
    replace_batch(laid, path, epoch, BUCKET)


def compact(
    spark: SparkSession, path: str, key: list[str], order: list[str] | None = None, by: list[str] | None = None,
    buckets: int = BUCKETS, upto: int | None = None,
) -> Version:
    """Merge the deliveries that the base does not cover yet (up to number ``upto``) into a new version of it.

    Buckets go by the columns ``by`` (default: the key). One without new rows keeps its folder. Nothing is deleted:
    older versions serve readers that began with them.
    """
    order, by = order or ["epoch"], by or key
    present = [n for n in deliveries(spark, path) if upto is None or n <= upto]
    made = version(spark, path)
    if made.number and (made.buckets != buckets or not _covered(spark, path, made, deliveries(spark, path))):
        made = Version(made.number)  # begin anew from the deliveries
    fresh = [n for n in present if str(n) not in made.deliveries]
    if not fresh:
        return made
    # Recorded before they are read: a delivery replaced meanwhile will not match its record.
    seen = {str(n): _digest(spark, f"{path}/epoch={n}") for n in fresh}
    tail = _read(spark, path, fresh, None)
    tail = tail.drop(BUCKET) if BUCKET in tail.columns else tail
    hit = sorted(r[0] for r in tail.select(bucket_of(by, buckets)).distinct().collect())
    # Rows of one delivery have one order, if its number is all that counts.
    even = order == ["epoch"] and len(fresh) == 1
    later = all(int(n) < fresh[0] for n in made.deliveries)
    number = made.number + 1
    size = sum(_size(spark, f"{path}/epoch={n}") for n in fresh) + sum(_size(spark, f"{path}/{_BASE}/{made.folders[str(b)]}") for b in hit if str(b) in made.folders)
    # A key's rows are in one round only if the key names its bucket.
    rounds = max(1, min(ROUNDS, len(hit), -(-size // ROUND_BYTES))) if set(by) <= set(key) else 1
    base = _base(spark, path, made, hit)
    for k in range(rounds):
        old, new = base, tail
        if rounds > 1:
            part = hit[k::rounds]
            old, new = None if base is None else base.filter(F.col(BUCKET).isin(part)), tail.filter(bucket_of(by, buckets).isin(part))
        rows = _merged(old.drop(BUCKET) if old is not None and BUCKET in old.columns else old, new, key, order, even, later)
        rows = rows.withColumn(BUCKET, bucket_of(by, buckets)).withColumn("_in", F.col(BUCKET)).hint("rebalance", BUCKET)
        swept(spark)
        rows.write.mode("append" if k else "error").option("compression", "zstd").partitionBy("_in").parquet(f"{path}/{_BASE}/v{number}")
    folders = made.folders | {str(b): f"v{number}/_in={b}" for b in hit}
    after = Version(number, buckets, made.deliveries | seen, folders)
    _publish(spark, path, after)
    return after
