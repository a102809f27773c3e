"""Readers and writers of tables: typed, tolerant, globbed and by directory name; append sinks with a frozen layout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What an evaluated candidate looks like; later batches are padded to it.
EVALUATED = T.StructType(
    [T.StructField("smiles", T.StringType(), False), T.StructField("generation", T.IntegerType()), T.StructField("is_valid", T.IntegerType())]
    + [T.StructField(n, T.DoubleType()) for n in "fitness niched_fitness mean_similarity density kv tc cp_sat beta mw cp alpha nu fom1 bp mp fp dc sc_score tox_score price price_penalty".split()]
    + [T.StructField("biodegradable", T.BooleanType())]
)


def clean(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column: the one place where missing values are settled."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if isinstance(k, (T.DoubleType, T.FloatType)) else F.col(c) for c, k in kinds.items()])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob has files, asked of Spark's own file system."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, columns: list[str] | None = None, sep: str = ",", header: bool = True) -> DataFrame:
    """A typed scan; bad fields become null, only the wanted columns are parsed."""
    df = clean(spark.read.schema(schema).option("header", header).option("sep", sep).option("mode", "PERMISSIVE").csv(path))
    return df.select(*columns) if columns else df


def read_csv_or_empty(spark: SparkSession, path: str, schema: T.StructType, required: list[str] = ()) -> DataFrame:
    """An empty table where the path is missing, empty or lacks a required column; corrupt files are passed over."""
    empty = spark.createDataFrame([], schema)
    if not exists(spark, path):
        return empty
    raw = spark.read.option("header", True).option("ignoreCorruptFiles", True).csv(path)
    if len(raw.columns) < 2 or any(c not in raw.columns for c in required):
        return empty
    cols = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return clean(raw.select(*cols))


def read_first(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """The first of the paths that has rows."""
    for path in paths:
        df = read_csv_or_empty(spark, path, schema)
        if not df.isEmpty():
            return df
    return spark.createDataFrame([], schema)


def read_runs(spark: SparkSession, glob: str, schema: T.StructType, pattern: str, names: dict[str, str]) -> DataFrame:
    """All files of a glob with parameters from the directory names; names maps each group to its type."""
    df = clean(spark.read.schema(schema).option("header", True).csv(glob))
    path = F.col("_metadata.file_path")
    params = [F.regexp_extract(path, pattern, k + 1).try_cast(kind).alias(n) for k, (n, kind) in enumerate(names.items())]
    return df.select("*", *params)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """By name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_gzip_lines(spark: SparkSession, path: str, partitions: int, sep: str = "\t", limit: int | None = None) -> DataFrame:
    """A gzip file can't be split: one task reads it; the lines are dealt out where there are fewer files than wanted parts."""
    lines = spark.read.text(path)
    lines = lines.limit(limit) if limit else lines
    lines = lines.repartition(partitions) if limit or lines.rdd.getNumPartitions() < partitions else lines
    return lines.select(F.split("value", sep).alias("fields"))


def read_sheet(spark: SparkSession, path: str, sheet: str, find: dict[str, list[str]]) -> DataFrame:
    """A small Excel sheet through the driver; columns are found by lower-cased parts of their names."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading .xlsx needs openpyxl") from e
    import pandas as pd

    frame = pd.read_excel(path, sheet_name=sheet)
    return spark.createDataFrame(frame.rename(columns=find_columns(list(frame.columns), find))[list(find)])


def find_columns(columns: list[str], find: dict[str, list[str]]) -> dict[str, str]:
    """For each wanted name the first column whose lower-cased name has one of the parts."""
    out = {}
    for name, parts in find.items():
        hit = next((c for p in parts for c in columns if p in str(c).lower()), None)
        if hit is None:
            raise KeyError(f"no column for {name}: {columns}")
        out[hit] = name
    return out


def padded(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order; missing ones are null, others are left out."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def append_generation(df: DataFrame, path: str, schema: T.StructType = EVALUATED) -> None:
    padded(df, schema).write.mode("append").partitionBy("generation").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(lines: DataFrame, path: str) -> None:
    lines.select(F.col(lines.columns[0]).cast("string").alias("value")).write.mode("overwrite").text(path)


def latex_rows(columns: list[str | Column]) -> Column:
    """One table row as LaTeX: cells by &, special characters escaped, a line end."""
    cell = lambda c: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("--")), r"([&%$#_{}])", r"\\$1")
    return F.concat(F.concat_ws(" & ", *[cell(F.col(c) if isinstance(c, str) else c) for c in columns]), F.lit(r" \\"))


def grid(spark: SparkSession, values: dict[str, list]) -> DataFrame:
    """All combinations of a few parameter values, the last name fastest, with the index of each."""
    sizes = [len(v) for v in values.values()]
    total = 1
    for s in sizes:
        total *= s
    out = spark.range(total).withColumnRenamed("id", "index")
    step = total
    for (name, options), size in zip(values.items(), sizes):
        step //= size
        spot = F.pmod(F.floor(F.col("index") / step), F.lit(size)).cast("int")
        out = out.withColumn(name, F.element_at(F.array(*[F.lit(o) for o in options]), spot + 1))
    return out
