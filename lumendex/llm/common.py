"""Shared plumbing of the training-data operators: scratch tables, Arrow text maps, row keys."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes worked on at once. Texts may be long, so a Python worker takes Arrow batches in short slices.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices of at most BATCH_ROWS, and of BATCH_BYTES where that is more than a
    row, without empty ones. So the caller's session needs no setting."""
    for b in batches:
        at, rows = 0, min(BATCH_ROWS, b.num_rows)
        while at < b.num_rows:
            part = b.slice(at, rows)
            if part.num_rows > 1 and part.nbytes > BATCH_BYTES:
                rows = part.num_rows // 2
                continue
            yield part
            at += part.num_rows
            rows = BATCH_ROWS


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Only on a local master, as in tests,
    may it be unset: scratch tables then go under the warehouse, and the session is left as it is."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return root.rstrip("/")


def materialize(df: DataFrame, tag: str, release: bool = False) -> DataFrame:
    """Write df to a scratch table in the shared folder and read it back: it cuts the lineage and
    survives lost executors. The folder goes when the application ends. With release, the driver is
    asked to collect garbage, on which Spark deletes the shuffle files that made the table."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    if release:
        for _ in range(2):  # the first collection only makes the shuffles unreachable
            spark._jvm.System.gc()
            time.sleep(0.2)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for name in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def packed(df: DataFrame, *columns: Column) -> DataFrame:
    """All columns of df as one struct, row, beside others: no name of df can then clash with a name of ours."""
    return df.select(F.struct(*[quoted(c) for c in df.columns]).alias("row"), *columns)


def unpacked(df: DataFrame, like: DataFrame, *columns: Column) -> DataFrame:
    return df.select(*[F.col("row").getField(c).alias(c) for c in like.columns], *columns)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(name: str, taken: Sequence[str]) -> str:
    """The name, with underscores after it while it is taken (Spark's names differ by more than case)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def map_texts(
    df: DataFrame,
    text_col: str,
    keep: Sequence[str],
    fields: T.StructType,
    make: Callable[[], Callable[[list[bytes | None]], dict[str, list]]],
) -> DataFrame:
    """Per-document Arrow map. ``make()`` runs once a task and returns a function from the UTF-8
    texts of a batch to the new columns; the columns in ``keep`` are carried over unchanged."""
    src = df.select(*[df[c] for c in keep], df[text_col].cast("binary").alias("__text"))
    schema = T.StructType([df.schema[c] for c in keep] + list(fields))
    arrow_fields = [pa.field(f.name, _arrow(f.dataType)) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for batch in pieces(batches):
            if fn is None:
                fn = make()
            out = fn(batch.column(batch.num_columns - 1).to_pylist())
            cols = [batch.column(i) for i in range(len(keep))]
            cols += [pa.array(out[f.name], f.type) for f in arrow_fields]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *(f.name for f in arrow_fields)])

    return src.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in kind])
    return {
        T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.FloatType: pa.float32(),
        T.StringType: pa.string(), T.BinaryType: pa.binary(), T.BooleanType: pa.bool_(),
    }[type(kind)]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
