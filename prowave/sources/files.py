"""File formats around the tables: text edge lists, attribute files, binary edges, npy matrices, splits.

Parquet is the engine's own format; these readers and writers are for exchange.
Paths are read by Spark, so they can be in any store it knows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


def read_edge_text(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of lines ``src dst``; lines that begin with # and blank ones are skipped, others that aren't two numbers are errors."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).filter("v != '' and not startswith(v, '#')")
    good = F.col("v").rlike(r"^\d+\s+\d+$")
    parts = F.split(F.when(good, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("not an edge: "), F.col("v")))), r"\s+")
    return lines.select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"))


def header_count(spark: SparkSession, path: str) -> int | None:
    """The number after # on the first such line, or None."""
    row = spark.read.text(path).filter("startswith(value, '#')").select(F.regexp_replace("value", r"\D", "").alias("n")).filter("n != ''").first()
    return int(row["n"]) if row else None


def write_edge_text(edges: DataFrame, path: str) -> None:
    """``src dst`` lines, without a header (files are written in parallel)."""
    edges.select(F.concat_ws(" ", "src", "dst")).write.mode("overwrite").text(path)


def read_attributes(spark: SparkSession, path: str) -> dict[str, int]:
    """``n=…`` and ``m=…`` lines."""
    return {r["k"]: int(r["v"]) for r in spark.read.text(path).filter("value like '%=%'").select(F.split("value", "=")[0].alias("k"), F.split("value", "=")[1].alias("v")).limit(100).collect()}


def write_attributes(spark: SparkSession, path: str, n: int, m: int) -> None:
    spark.createDataFrame([(f"n={n}",), (f"m={m}",)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_edge_binary(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of pairs of little-endian unsigned 64-bit numbers, read as fixed-length records, so one file is many tasks."""
    rows = spark.sparkContext.binaryRecords(path, 16).map(lambda r: (bytearray(r),)).toDF("r binary")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = np.frombuffer(b"".join(pdf["r"]), "<u8").reshape(-1, 2).astype(np.int64)
            yield pd.DataFrame({"src": pairs[:, 0], "dst": pairs[:, 1]})

    return rows.mapInPandas(run, "src long, dst long")


def edge_bytes(edges: DataFrame) -> DataFrame:
    """(part, data): each partition's edges as such bytes, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = b"".join(pdf[["src", "dst"]].to_numpy(np.int64).astype("<u8").tobytes() for pdf in batches)
        yield pd.DataFrame({"data": [data]})

    return edges.select("src", "dst").sortWithinPartitions("src", "dst").mapInPandas(run, "data binary").withColumn("part", F.spark_partition_id())


def parse_npy(data: bytes) -> np.ndarray:
    """An array of a npy file of format 1.0 or 2.0; a short file is an error."""
    version = tuple(data[6:8])
    if data[:6] != b"\x93NUMPY" or version not in ((1, 0), (2, 0)):
        raise ValueError("not a npy file of format 1.0 or 2.0")
    return np.load(io.BytesIO(data), allow_pickle=False)


def read_npy(spark: SparkSession, path: str, feature_major: bool = True) -> DataFrame:
    """(feat, id, value) of a matrix file; rows are features unless told otherwise. A file is read by one task: split large ones by rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                a = np.atleast_2d(parse_npy(bytes(content)))
                for i, row in enumerate(a):
                    other = np.arange(len(row))
                    feat, node = (np.full(len(row), i), other) if feature_major else (other, np.full(len(row), i))
                    yield pd.DataFrame({"feat": feat.astype(np.int32), "id": node.astype(np.int64), "value": row.astype(np.float64)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "feat int, id long, value double")


def npy_rows(wide: DataFrame) -> DataFrame:
    """(first_id, data): each partition's (id, embedding) rows as a npy file of 32-bit floats, in order of ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches) or [pd.DataFrame({"id": [], "embedding": []})])
        if len(pdf):
            out = io.BytesIO()
            np.save(out, np.stack(pdf["embedding"].to_numpy()).astype(np.float32))
            yield pd.DataFrame({"first_id": [int(pdf["id"].iloc[0])], "data": [out.getvalue()]})

    return wide.select("id", F.col("embedding").cast("array<double>").alias("embedding")).sortWithinPartitions("id").mapInPandas(run, "first_id long, data binary")


def read_queries(spark: SparkSession, path: str | None, n: int) -> DataFrame:
    """(id) of a file of one id a line, or all of n nodes without a file."""
    if path is None:
        return spark.range(n).select("id")
    return spark.read.text(path).filter("trim(value) != ''").select(F.trim("value").cast("long").alias("id"))


def write_queries(ids: DataFrame, path: str) -> None:
    ids.select(F.col("id").cast("string")).write.mode("overwrite").text(path)


def write_blocks(wide_with_block: DataFrame, path: str) -> None:
    """Row blocks as partitions of one Parquet table, which reads back whole."""
    wide_with_block.write.mode("overwrite").partitionBy("block").parquet(path)


def save_if_missing(df: DataFrame, path: str) -> DataFrame:
    """The table at ``path``, written first if there is none."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def summary(n: int, m: int, features: int, classes: int, sets: DataFrame) -> DataFrame:
    """One row: a line that tells the sizes of a data set and of its splits."""
    c = sets.agg(*[F.sum((F.col("split") == s).cast("long")).alias(s) for s in ("train", "val", "test")])
    return c.select(F.format_string(f"n={n}, m={m}, F={features}, C={classes} | %d/%d/%d (%.2f%%/%.2f%%/%.2f%%)", "train", "val", "test", *[F.col(s) * 100.0 / n for s in ("train", "val", "test")]).alias("summary"))


def append_log(spark: SparkSession, path: str, line: str) -> None:
    """A line more in the run log, a folder of text files in the order of their names."""
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(path)


def read_log(spark: SparkSession, path: str) -> list[str]:
    return [r["value"] for r in spark.read.text(path).select("value", "_metadata.file_modification_time").orderBy("file_modification_time").collect()]


class Models:
    """Models of a run by name ("last", "best") and epoch, as text in one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, name: str, epoch: int, model) -> None:
        self.spark.createDataFrame([(epoch, model.dumps())], "epoch int, model string").coalesce(1).write.mode("overwrite").json(f"{self.path}/{name}")

    def load(self, name: str = "best") -> tuple[int, str]:
        """(epoch, text) for ``SkipMLP.loads``."""
        row = self.spark.read.schema("epoch int, model string").json(f"{self.path}/{name}").first()
        return row["epoch"], row["model"]


def _save(rows: DataFrame, path: str) -> None:
    """(name, data) rows as files: Hadoop's file system of ``path`` takes them one by one on the driver, each at most a partition's size."""
    spark = rows.sparkSession
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    for r in rows.toLocalIterator():
        out = fs.create(jvm.org.apache.hadoop.fs.Path(folder, r["name"]), True)
        out.write(bytearray(r["data"]))
        out.close()


def write_edge_binary(edges: DataFrame, path: str) -> None:
    """Pairs of little-endian unsigned 64-bit numbers, a file for each partition, in order of (src, dst) over all files; ``read_edge_binary`` reads the folder."""
    ordered = edges.select("src", "dst").repartitionByRange("src", "dst")
    _save(edge_bytes(ordered).filter(F.length("data") > 0).select(F.format_string("edges-%05d.bin", "part").alias("name"), "data"), path)


def write_npy(wide: DataFrame, path: str) -> None:
    """(id, embedding) rows as npy files of 32-bit floats, each a range of ids, in order of names."""
    rows = npy_rows(wide.repartitionByRange("id"))
    _save(rows.select(F.format_string("rows-%019d.npy", "first_id").alias("name"), "data"), path)


def write_adjacency_text(edges: DataFrame, n: int, path: str) -> None:
    """A ``# n`` line in a file that is read first, and ``src dst`` lines."""
    head = edges.sparkSession.createDataFrame([(f"# {n}",)], "value string")
    head.coalesce(1).unionAll(edges.select(F.concat_ws(" ", "src", "dst"))).write.mode("overwrite").text(path)
