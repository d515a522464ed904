"""Files in and out, through Spark's readers, so inputs may be in any store that Spark reads."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

READING = "minute int, timestamp string, temp_c double, humidity double, anomalous boolean, status_code string"
PASSAGE = "_id string, text string"
QUERY = "_id string, text string, gold array<string>, short_answers array<string>"


def sensor_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Readings of JSON datasets {metadata, readings, stats}; a missing status is OK."""
    whole = spark.read.schema(f"readings array<struct<{', '.join(':'.join(c.split(' ')) for c in READING.split(', '))}>>").option("multiLine", True).json(path)
    rows = whole.select(F.explode("readings").alias("r")).select("r.*")
    return rows.withColumn("status_code", F.coalesce("status_code", F.lit("OK")))


def passages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PASSAGE).json(path)


def rag_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERY).json(path)


def _first_of(df: DataFrame, names: tuple[str, ...]) -> Column:
    found = [F.col(n).cast("string") for n in names if n in df.columns]
    if not found:
        raise ValueError(f"none of the columns {', '.join(names)}")
    return F.trim(F.coalesce(*found))


def pairs(spark: SparkSession, path: str, question: tuple[str, ...] = ("question", "query"), answer: tuple[str, ...] = ("answer", "passage", "text")) -> DataFrame:
    """(question, answer) from Parquet whose columns have one of several names; blank rows go."""
    df = spark.read.parquet(path)
    out = df.select(_first_of(df, question).alias("question"), _first_of(df, answer).alias("answer"))
    return out.filter("question != '' and answer != ''")


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result files below a folder; files that aren't JSON are skipped."""
    df = spark.read.schema(f"{schema}, _bad string").option("recursiveFileLookup", True).option("columnNameOfCorruptRecord", "_bad").option("multiLine", True).json(path)
    return df.withColumn("_file", F.input_file_name()).filter("_bad is null").drop("_bad")


def _rows(parse):
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                matrix = parse(content)
                n, d = matrix.shape
                offsets = pa.array(np.arange(0, n * d + 1, d, dtype=np.int32)) if d else pa.array(np.zeros(n + 1, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * n), pa.array(np.arange(n)), pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix, np.float32).reshape(-1)))],
                    names=["path", "row", "vector"],
                )

    return run


def parse_npy(content: bytes) -> np.ndarray:
    """A two-dimensional little-endian float32 array of NumPy's file format."""
    import io

    out = np.load(io.BytesIO(content), allow_pickle=False)
    if out.dtype != np.dtype("<f4") or out.ndim not in (1, 2):
        raise ValueError("expected float32 vectors")
    return out.reshape(1, -1) if out.ndim == 1 else out


def parse_matrix(content: bytes) -> np.ndarray:
    """Big-endian rows, columns (32-bit), then float32 values."""
    n, d = struct.unpack(">ii", content[:8])
    return np.frombuffer(content, ">f4", n * d, 8).reshape(n, d)


def npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, vector) of NumPy files; each file is one task's work."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_rows(parse_npy), "path string, row bigint, vector array<float>")


def matrices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_rows(parse_matrix), "path string, row bigint, vector array<float>")


def save_snapshot(tables: dict[str, DataFrame], path: str, version: int) -> None:
    """All tables of a version, written aside first; the marker that names them comes last. A version without its marker doesn't exist.

    Tables are written to a folder of their own each time, so a failed or repeated save harms no version that is there."""
    (spark,) = {df.sparkSession for df in tables.values()}
    folder = f"{path}/parts/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    spark.createDataFrame([(name, f"{folder}/{name}") for name in tables], "name string, folder string").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_snapshot(spark: SparkSession, path: str, version: int, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Replaces the whole state: what isn't in the version isn't there. An error if the version was never completed."""
    marker = {r.name: r.folder for r in spark.read.parquet(f"{path}/version={version}/*.parquet").collect()}  # one row a table
    return {name: spark.read.parquet(marker[name]) for name in names or marker}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report table of at most ``most`` rows."""
    rows = df.limit(most).collect()
    line = lambda xs: "| " + " | ".join("" if x is None else str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


def tex(df: DataFrame, most: int = 1000) -> str:
    """A table of at most ``most`` rows in TeX, special characters escaped."""
    special = {c: "\\" + c for c in "&%$#_{}"} | {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
    line = lambda xs: " & ".join("" if x is None else "".join(special.get(c, c) for c in str(x)) for x in xs) + r" \\"
    rows = [line(r) for r in df.limit(most).collect()]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", line(df.columns), r"\hline", *rows, r"\end{tabular}"])


def upsert(state: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Insert, update and delete by key: rows of ``changes`` replace those of ``state``; a true ``_deleted`` removes.

    Of several changes of a key the last by the column ``order`` counts; without one, keys must be unique."""
    if order is not None:
        columns = [c for c in changes.columns if c not in (key, order)]
        changes = changes.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_c")).select(key, "_c.*")
    return state.join(changes.select(key), key, "left_anti").unionByName(changes.filter(~F.col("_deleted")).drop("_deleted"))
