"""Reading datasets and lookups, and writing tables and immutable samples."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.filters import nan_to_null
from ..functions.order import sample_n


def scan_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A dataset by its extension, csv or parquet; NaN becomes null."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending not in ("csv", "parquet"):
        raise ValueError(f"unknown kind of file: {path}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return nan_to_null(reader.csv(path, header=True) if ending == "csv" else reader.parquet(path))


def as_lookup(raw: DataFrame, types: dict[str, str], na_values: list[str]) -> DataFrame:
    """Text columns as a lookup: an empty field is a value, only ``na_values`` are null."""
    out = {}
    for c in raw.columns:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        text = F.when(~text.isin(na_values), text) if na_values else text
        out[c] = text.try_cast(types[c]) if c in types else text
    return raw.select(*[v.alias(c) for c, v in out.items()])


def read_lookup(spark: SparkSession, path: str, types: dict[str, str], na_values: list[str]) -> DataFrame:
    return as_lookup(spark.read.csv(path, header=True), types, na_values)


def read_sample(df: DataFrame, sample: int | None, seed: int, columns: list[str], keys: list[str], full: bool = False) -> DataFrame:
    """Pruned columns of ``sample`` rows; all rows only if ``full``."""
    if sample is None:
        if not full:
            raise ValueError("give a sample size, or full=True")
        return df.select(*columns)
    return sample_n(df.select(*dict.fromkeys([*columns, *keys])), sample, keys, seed).select(*columns)


def list_columns(df: DataFrame) -> DataFrame:
    """(position, name, dtype) of the columns; one name for all timestamps."""
    rows = [(i, n, "datetime" if t.startswith("timestamp") else t) for i, (n, t) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, dtype string")


def table_digest(df: DataFrame) -> DataFrame:
    """(rows, digest_sum, digest_xor): the same for the same rows in any order and files."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest_sum"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("digest_xor"))


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_version(df: DataFrame, folder: str, name: str, version: int | str) -> str:
    """Write an immutable version; one that exists is an error."""
    path = f"{folder}/{name}@{version}.parquet"
    df.write.mode("errorifexists").parquet(path)
    return path


def definition_hash(definition: dict) -> str:
    """SHA-256 of a definition, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(definition, sort_keys=True, default=str).encode()).hexdigest()


def commit_sample(df: DataFrame, folder: str, name: str, version: int | str, definition: dict) -> str:
    """Write an immutable sample and then its manifest: definition and hash, rows, digest,
    schema and where the rows are. Returns the manifest's path.

    The manifest is what makes a version exist. One that exists is refused; rows that a lost
    run left behind lie in a folder of their own, which no manifest names, and do no harm.
    """
    spark, path = df.sparkSession, f"{folder}/{name}@{version}"
    try:
        spark.read.parquet(f"{path}/manifest")
    except AnalysisException:
        pass
    else:
        raise ValueError(f"{name}@{version} exists")
    data = f"{path}/rows-{uuid.uuid4().hex[:12]}"
    df.write.mode("errorifexists").parquet(data)
    written = spark.read.parquet(data)
    facts = {"definition": json.dumps(definition, sort_keys=True, default=str), "definition_sha256": definition_hash(definition), "schema": written.schema.json(), "data": data}
    manifest = table_digest(written).select("*", *[F.lit(v).alias(k) for k, v in facts.items()])
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest")
    return f"{path}/manifest"


def committed_sample(spark: SparkSession, folder: str, name: str, version: int | str) -> tuple[DataFrame, Row]:
    """The rows of a committed sample and its manifest; an error for one without."""
    try:
        manifest = spark.read.parquet(f"{folder}/{name}@{version}/manifest").first()
    except AnalysisException:
        manifest = None
    if manifest is None:
        raise ValueError(f"{name}@{version} is not committed")
    return spark.read.schema(StructType.fromJson(json.loads(manifest["schema"]))).parquet(manifest["data"]), manifest
