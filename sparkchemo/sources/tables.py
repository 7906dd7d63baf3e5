"""Reading tables: Parquet, CSV with a given schema, and .npy files; writing datasets and models."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, is_dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv_table(spark: SparkSession, path: str, schema: str, skip: int = 0, sep: str = ",", header: bool = False) -> DataFrame:
    """A CSV file read with its schema given; the first ``skip`` lines of each file are left out. 'NA' is null.

    With ``skip`` a file is read in one piece, so each should fit in a task; without, large files are split.
    """
    reader = spark.read.schema(schema).option("sep", sep).option("header", header).option("nullValue", "NA")
    if not skip:
        return reader.csv(path)
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.slice(F.split("value", "\n"), skip + 1, 1 << 30)).alias("value")).where("trim(value) <> ''")
    fields = F.from_csv("value", F.lit(schema), {"sep": sep, "nullValue": "NA"})
    return lines.select(fields.alias("r")).select("r.*")


def npy_table(spark: SparkSession, path: str) -> DataFrame:
    """(path, shape, data): a row for each .npy file of a folder, of any shape, flattened by rows."""
    return unpack_npy(spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path))


def unpack_npy(files: DataFrame) -> DataFrame:
    """(path, shape, data) of ``files`` (path, content): the bytes of .npy arrays of any shape, flattened by rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [np.load(io.BytesIO(x), allow_pickle=False) for x in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([list(a.shape) for a in arrays], pa.list_(pa.int32())), pa.array([a.ravel().astype(float) for a in arrays], pa.list_(pa.float64()))], ["path", "shape", "data"])

    return files.select("path", "content").mapInArrow(task, "path string, shape array<int>, data array<double>")


def pack_npy(arrays: DataFrame, dtype: str = "float64") -> DataFrame:
    """(path, content): the bytes of a .npy file for each row of ``arrays`` (path, shape, data)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for shape, data in zip(batch.column("shape").to_pylist(), batch.column("data"), strict=True):
                buffer = io.BytesIO()
                np.save(buffer, data.values.to_numpy().astype(dtype).reshape(shape), allow_pickle=False)
                out.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.binary())], ["path", "content"])

    return arrays.select("path", "shape", F.col("data").cast("array<double>").alias("data")).mapInArrow(task, "path string, content binary")


def write_npy(arrays: DataFrame, path: str, dtype: str = "float64") -> None:
    """Arrays as a Parquet table of .npy bytes, which ``unpack_npy`` reads: one table instead of a file per row."""
    pack_npy(arrays, dtype).write.parquet(path)


def file_number(path: Column) -> Column:
    """The number n of a file called x_n.ext: the order of a dataset's files."""
    return F.regexp_extract(path, r"x_(\d+)\.[^/]*$", 1).cast("bigint")


def keep_classes(df: DataFrame, label: str, include: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """Rows whose label is one of ``include`` (all if None) and none of ``exclude``."""
    wanted = F.lit(True) if include is None else F.col(label).isin(list(include))
    return df.where(wanted & ~F.col(label).isin(list(exclude)))


def split_label(df: DataFrame, label: str | Sequence[str], named: dict[str, str] | None = None, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(features, labels) of a table, each with ``keys``; one label or several; ``named`` renames feature columns, as spectra's centres."""
    names, labels = named or {}, [label] if isinstance(label, str) else list(label)
    features = [c for c in df.columns if c not in labels and c not in keys]
    return df.select(*keys, *[F.col(c).alias(names.get(c, c)) for c in features]), df.select(*keys, *labels)


def write_dataset(df: DataFrame, path: str, split: str | None = None, mode: str = "errorifexists") -> None:
    """A Parquet dataset, partitioned by the ``split`` column (train, test) if there is one."""
    writer = df.write.mode(mode)
    (writer.partitionBy(split) if split else writer).parquet(path)


def batch_summary(df: DataFrame, label: str, size: int, key: str) -> DataFrame:
    """(batch, n, classes): rows in the order of ``key`` (a dense number from 0) cut into batches of ``size``."""
    return df.groupBy(F.floor(F.col(key) / size).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("classes"))


def save_model(model, spark: SparkSession, path: str) -> None:
    """A fitted model's numbers as one JSON line."""

    def plain(x):
        return x.tolist() if isinstance(x, np.ndarray | np.generic) else asdict(x) if is_dataclass(x) else str(x)

    text = json.dumps(asdict(model), default=plain)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])
