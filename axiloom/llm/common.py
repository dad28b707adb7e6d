"""Shared helpers: text primitives as Column expressions, shared-folder tables, distributed ranks."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The white space that separates words, and its complement.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: The columns that with_row_key() adds.
ROW = ("_axiloom_file", "_axiloom_row")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dir: dict[str, str] = {}
#: Writes that run, and the setting they found.
_writers: list[int] = [0]
_before: list[str | None] = []
_lock = threading.Lock()
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and all run in one process,
    as in tests, it is one of our own."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="axiloom-")
    return _own_dir[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/axiloom/{name}-{uuid.uuid4().hex}"


@contextmanager
def _dropping_shuffles(spark: SparkSession):
    """While any write of this module runs, what a finished query has shuffled is dropped: it is of no use after it."""
    with _lock:
        if not _writers[0]:
            _before[:] = [spark.conf.get(_CLEAN, None)]
            spark.conf.set(_CLEAN, "true")
        _writers[0] += 1
    try:
        yield
    finally:
        with _lock:
            _writers[0] -= 1
            if not _writers[0]:
                spark.conf.unset(_CLEAN) if _before[0] is None else spark.conf.set(_CLEAN, _before[0])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends in files that outlive any executor."""
    path = fresh_path(df.sparkSession, name)
    with _dropping_shuffles(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def _is_scan(df: DataFrame) -> bool:
    """Whether each row of df is a row of a file: a table as it is read, some of its columns or rows."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().apply(0)
    return node.nodeName() == "LogicalRelation" and "_metadata" not in df.columns


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """df with columns ROW that tell its rows apart: the file and the place in it that a row is read from, or for what is
    not read from files, which is then written, a number. Every reading finds the same."""
    if _is_scan(df):
        try:
            keyed = df.select("*", F.xxhash64("_metadata.file_path").alias(ROW[0]), F.col("_metadata.row_index").alias(ROW[1]))
            keyed.schema  # noqa: B018: files of another format know no places
            return keyed
        except AnalysisException:
            pass
    return materialize(df.select("*", F.lit(0).cast("long").alias(ROW[0]), F.monotonically_increasing_id().alias(ROW[1])), name)


def release(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(), with this package sent to the executors once per application."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _shipped:
        top = Path(__file__).resolve().parents[1]
        if top.is_dir():  # from a zip file it already came with the application
            target = Path(tempfile.mkdtemp(prefix="axiloom-code-")) / f"{top.name}.zip"
            with zipfile.ZipFile(target, "w") as z:
                for f in sorted(top.rglob("*.py")):
                    z.write(f, f.relative_to(top.parent))
            sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)
    return df.mapInArrow(run, schema)


def lower_az(text: Column) -> Column:
    """A-Z to a-z and nothing else. For pure ASCII, lower() does just that and is many times faster than translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """The words of a text in order; none for null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, whatever the optimizer inlines."""
    return F.transform(F.array(value), body)[0]


def prefix_sums(df: DataFrame, group: list[str], order: list[str], amount: Column, out: str, buckets: int) -> DataFrame:
    """Add ``out``: the sum of amount over the rows that come before, in each group.

    Rows are dealt into hash buckets of a group, which come one after the other; a row's place is the total of the
    buckets before its own plus a running sum inside it. So no task ever holds a whole group, however large it is.
    The order is a fixed shuffle: by bucket, then by hash, then by ``order``.
    """
    key = F.xxhash64(F.lit(out), *order)
    dealt = df.withColumns({"_h": key, "_b": F.pmod(key, F.lit(buckets)).cast("int"), "_a": amount})
    total = dealt.groupBy(*group, "_b").agg(F.sum("_a").alias("_t"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select(*group, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, "_b").orderBy("_h", *order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_in", F.coalesce(F.sum("_a").over(inside), F.lit(0)))
    return placed.join(base, [*group, "_b"]).withColumn(out, F.col("_base") + F.col("_in")).drop("_h", "_b", "_a", "_base", "_in")


def running_sums(df: DataFrame, order: list[Column], amounts: dict[str, Column], name: str) -> DataFrame:
    """Add for each of ``amounts`` its sum over the rows that come before in ``order``, which no two rows share.

    Rows are dealt into ranges of the order and written, so that they stay there; each range sums its own rows, after
    the totals of the ranges before it: as many numbers as there are shuffle partitions, and no task has more rows than
    a range. The ranges differ from run to run, so amounts should be whole numbers, whose sums don't.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select("*", *[c.alias(f"_a_{k}") for k, c in amounts.items()])
    dealt = materialize(dealt.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), name)
    totals = dealt.groupBy("_range").agg(*[F.sum(f"_a_{k}").alias(k) for k in amounts])
    before, inside = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (Window.orderBy("_range"), Window.partitionBy("_range").orderBy(*order)))
    bases = totals.select("_range", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_b_{k}") for k in amounts])
    placed = dealt.select("*", *[F.coalesce(F.sum(f"_a_{k}").over(inside), F.lit(0)).alias(f"_i_{k}") for k in amounts])
    return placed.join(F.broadcast(bases), "_range").select(*df.columns, *[(F.col(f"_b_{k}") + F.col(f"_i_{k}")).alias(k) for k in amounts])
