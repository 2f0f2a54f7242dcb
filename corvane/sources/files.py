"""File sources and sinks: CSV, JSON, markdown trees and keyed tables. Schemas are never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Texts that stand for nothing in a CSV field.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_csv(spark: SparkSession, path: str, columns: list[str], missing: str = "null") -> DataFrame:
    """All columns as strings, quoted line breaks and doubled quotes understood.

    missing: 'null' turns the usual marks for nothing into null, 'empty' turns nulls into '', 'keep' does neither.
    """
    schema = StructType([StructField(c, StringType()) for c in columns])
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', quote='"', enforceSchema=False)
    if missing == "null":
        return df.select(*[F.when(F.col(c).isin(MISSING), None).otherwise(F.col(c)).alias(c) for c in columns])
    return df.na.fill("") if missing == "empty" else df


def read_markdown(spark: SparkSession, glob: str) -> DataFrame:
    """(doc_id int, path, text): one row per file whose folder is a number; order by doc_id where order matters."""
    df = spark.read.text(glob, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    key = F.regexp_extract("path", r"/(\d+)/[^/]*$", 1)
    return df.where(key != "").select(key.cast("int").alias("doc_id"), "path", F.col("value").alias("text"))


def read_json_records(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """One row per file that holds a JSON object of the schema; files that do not are left out."""
    df = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema).alias("x"))
    return df.where("x IS NOT NULL").select("path", "x.*")


def read_json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """The chunk table, partitioned by source: a search of one source reads only its folder."""
    chunks.write.mode("overwrite").partitionBy("source").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays and maps as JSON texts, with a header; blanks around values are kept."""
    flat = [F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def union_ragged(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns a frame lacks are null, in order of first appearance."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def current_version(spark: SparkSession, path: str) -> str | None:
    """The newest complete version of a keyed table (a folder with the mark of a finished write), or None."""
    fs, at = _fs(spark, path)
    if not fs.exists(at(path)):
        return None
    done = [str(f.getPath().getName()) for f in fs.listStatus(at(path)) if f.getPath().getName().startswith("v=") and fs.exists(at(f"{path}/{f.getPath().getName()}/_SUCCESS"))]
    return f"{path}/{max(done)}" if done else None


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a keyed table."""
    found = current_version(spark, path)
    if found is None:
        raise ValueError(f"no keyed table at {path}")
    return spark.read.parquet(found)


def keyed_overwrite(new: DataFrame, path: str, key: str, order: str) -> tuple[int, int]:
    """Upsert by key into a keyed table: the newest row per key is kept. Returns (rows given, rows held).

    Every call writes a new version beside the old ones (`v=` and a number), which counts once its write is complete;
    a failed run leaves the table as it was. Versions before the last two are removed.
    """
    spark = new.sparkSession
    fs, at = _fs(spark, path)
    given, old = new.count(), current_version(spark, path)
    rows = new.withColumn("_age", F.lit(0))
    if old is not None:
        rows = rows.unionByName(spark.read.parquet(old).withColumn("_age", F.lit(1)), allowMissingColumns=True)
    number = int(old.rsplit("=", 1)[1]) + 1 if old is not None else 1
    target = f"{path}/v={number:012d}"
    w = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), "_age")
    rows.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_age").write.mode("overwrite").parquet(target)
    for k in range(number - 2, 0, -1):
        if not fs.exists(at(f"{path}/v={k:012d}")):
            break
        fs.delete(at(f"{path}/v={k:012d}"), True)
    return given, spark.read.parquet(target).count()


def read_keyed_csv(spark: SparkSession, path: str, columns: list[str], key: str) -> DataFrame:
    """A CSV file as a keyed table: rows with a blank key are left out, a repeated key is an error."""
    df = read_csv(spark, path, columns, "empty").where(F.trim(key) != "")
    twice = [r[key] for r in df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").orderBy(key).limit(5).collect()]
    if twice:
        raise ValueError(f"repeated {key}: {', '.join(twice)}")
    return df


#: Fields of a benchmark of stages, and of one of keywords.
BENCHMARK = "query_id string, query string, intent string, expected_entities array<string>, expected_relevant_candidates array<string>, expected_relevant_jobs array<string>, expected_relevant_jd array<string>, expected_keywords array<string>, notes string"
KEYWORDS = "query string, intent string, expected_keywords array<string>"


def read_benchmark(spark: SparkSession, path: str, intents: list[str], keywords: int | None = None) -> DataFrame:
    """A benchmark file (a JSON list), checked: at least one query, none blank, known intents, `keywords` keywords each where given.

    With `keywords` the file has queries, intents and keywords only. A violation is a ValueError that names it.
    """
    df = read_json_list(spark, path, KEYWORDS if keywords is not None else BENCHMARK)
    bad = {
        "blank query": F.trim(F.coalesce("query", F.lit(""))) == "", "unknown intent": ~F.coalesce(F.col("intent").isin(intents), F.lit(False)),
        "wrong number of keywords": F.lit(False) if keywords is None else F.size(F.coalesce("expected_keywords", F.array().cast("array<string>"))) != keywords,
    }
    found = df.agg(F.count(F.lit(1)).alias("queries"), *[F.count_if(c).alias(n) for n, c in bad.items()]).first()
    wrong = [n for n in bad if found[n]] + ([] if found.queries else ["no queries"])
    if wrong:
        raise ValueError(f"{path}: {', '.join(wrong)}")
    return df


def write_vectors(vectors: DataFrame, path: str, key: str = "chunk_id", vector: str = "embedding", dim: int = 384) -> int:
    """A flat vector index: vectors of `dim` finite numbers, with their metadata (nulls as empty texts). Returns the rows written.

    Another length, a null or a number that is not finite is an error before anything is written; so is an empty table.
    """
    v = F.col(vector)
    sound = v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(float("inf"))))
    found = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(sound, F.lit(False)) | F.col(key).isNull()).alias("bad")).first()
    if not found.n or found.bad:
        raise ValueError(f"{found.bad} of {found.n} vectors are not sound" if found.n else "no vectors")
    texts = [f.name for f in vectors.schema if f.dataType.typeName() == "string"]
    vectors.na.fill("", texts).write.mode("overwrite").parquet(path)
    return found.n


def create_if_missing(spark: SparkSession, tables: dict[str, str], folder: str) -> list[str]:
    """Empty parquet tables (name -> schema) in a folder where they do not exist; returns the names of the new ones."""
    fs, at = _fs(spark, folder)
    new = [n for n in tables if not fs.exists(at(f"{folder}/{n}"))]
    for n in new:
        spark.createDataFrame([], tables[n]).write.parquet(f"{folder}/{n}")
    return new


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, or ValueError where a key repeats: the uniqueness a graph store declares."""
    if df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").limit(1).count():
        raise ValueError(f"repeated {', '.join(keys)}")
    return df


def write_traces(df: DataFrame, path: str) -> None:
    """One JSON object a line; structs and arrays stay nested."""
    df.write.mode("overwrite").json(path)
