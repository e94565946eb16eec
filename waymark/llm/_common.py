"""What the corpus operators share: scratch tables, row keys, skew-safe lookups."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these white space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"

#: Names under which a row's place in its file travels with the row.
ROW = ("__row_file", "__row_index")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the context's checkpoint
    folder; only where neither is set and the master is local (tests) a temporary one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = Path(tempfile.mkdtemp(prefix="waymark-")).as_uri()
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Rows and bytes of texts in one Arrow batch: 10,000 rows of Spark's default would be some 100 MB in each worker.
TEXT_BATCH, TEXT_BYTES = 1_000, 8 << 20


def text_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches in rows and bytes, for operators that hand texts to
    Python. Results are lazy and read the setting when they run, so it stays; a smaller one is left alone."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_BATCH), ("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BYTES)):
        if not 0 < _bytes(spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))


def _bytes(setting: str) -> int:
    """A setting's number, which may end in a unit of bytes."""
    found = re.fullmatch(r"(-?\d+)([kmgt]?)b?", setting.lower())
    return int(found[1]) << 10 * " kmgt".index(found[2] or " ") if found else 0


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back, which cuts its lineage
    and survives lost executors. The table goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/waymark-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    sc = spark.sparkContext
    jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables of ``materialise`` and ``row_by_row`` that nothing will read again. Spark deletes
    shuffle files only after the driver's JVM found that nothing refers to them, so it is told to look."""
    sc = spark.sparkContext
    for df in tables:
        if kept := df.__dict__.pop("_on_disks", None):
            kept.unpersist()
            continue
        for path in {re.sub(r"/[^/]*$", "", f) for f in df.inputFiles()}:
            if re.search(r"/waymark-\w+-[0-9a-f]{32}$", path):
                jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
                jpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(jpath, True)
    gc.collect()
    sc._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores after it, so that no column of ``df`` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def _is_scan(df: DataFrame) -> bool:
    """Whether each row of ``df`` is a row of a file: a scan, perhaps filtered and projected."""
    node = df._jdf.queryExecution().analyzed()
    while node.children().size() == 1 and node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return "LogicalRelation" in node.getClass().getName()


def row_by_row(df: DataFrame, made: DataFrame, name: str) -> DataFrame:
    """``made``, computed once. Where ``df``, from which it is made without a shuffle, is a plain scan,
    each executor keeps its partitions on its own disk until the session's cache is cleared or the
    application ends; what is lost with an executor is made again from the same file ranges, in the
    same order. Anything else, rows in an order of chance among it, becomes a scratch table."""
    if not (_is_scan(df) and df._jdf.queryExecution().analyzed().deterministic()):
        return materialise(made, name)
    return on_disks(made)


def on_disks(made: DataFrame) -> DataFrame:
    """``made``, computed once and kept on the executors' disks. A lost partition is made again, so its
    rows, apart from their order, must not hang on chance."""
    # The mark keeps a later call from meeting rows that were kept of a table since rewritten.
    mark = free_name(made, "run")
    kept = made.withColumn(mark, F.lit(uuid.uuid4().int >> 65)).persist(StorageLevel.DISK_ONLY)
    out = kept.drop(mark)
    out.__dict__["_on_disks"] = kept  # for ``discard``
    return out


def with_row_key(df: DataFrame) -> DataFrame:
    """``df`` with the columns ROW, which name a row for good: a hash of its file's path and its
    place in the file. A frame that isn't a scan of files is written to scratch first; one that has
    the columns already stays as it is."""
    if set(ROW) <= set(df.columns):
        return df
    scan = df if _is_scan(df) else materialise(df, "rows")
    meta = scan.metadataColumn("_metadata")
    return scan.select("*", F.xxhash64(meta["file_path"]).alias(ROW[0]), meta["row_index"].alias(ROW[1]))


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, n_rows: int, hot: int = 256) -> DataFrame:
    """Left join of ``rows`` with ``table`` (unique by ``key``, cheap to make) that no hot key can
    skew. ``table[weight]`` counts the rows of a key. Keys with over ``n_rows / hot`` rows, of
    which there are fewer than ``hot``, are broadcast; the others are shuffled."""
    most = max(1, n_rows // hot)
    few = F.broadcast(table.where(F.col(weight) > most))
    rest = rows.join(few.select(key), key, "left_anti").join(table.where(F.col(weight) <= most), key, "left")
    return rows.join(few, key, "inner").unionByName(rest)


def hash_sample(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """About the first ``n`` rows by a hash of ``keys``. A coarse cut by hash comes first, so that
    no task hands on more than a few times its share of ``n`` rows; where equal keys make the cut
    miss, all rows are ordered."""
    hashed = df.withColumn("__order", F.xxhash64(*keys))
    total = df.count()
    if total > 4 * n:
        cut = hashed.where(F.pmod(F.col("__order"), F.lit(1 << 30)) < int((1 << 30) * 2 * n / total))
        if cut.count() >= n:
            hashed = cut
    return hashed.orderBy("__order", *keys).limit(n).drop("__order")


def text_of(column: str):
    """The column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
