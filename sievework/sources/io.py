"""Readers and writers: JSON lines, token folders, CSV, maps, manifests, kept intermediates."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievework.functions.answers import strip
from sievework.functions.tokens import Tokenizer, aligned, word_tokens
from sievework.runtime import _fs


def json_lines(spark: SparkSession, path: str, schema: str | StructType, strict: bool = False) -> DataFrame:
    """Records of a JSON-lines file with `_file` and `_pos` (byte order of the lines in it).

    Blank lines are skipped. A line that is no object gives nulls, or if `strict` an error that
    names file and line. `_pos` rises with the line number within a file.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), (F.col("_metadata.file_block_start") * F.lit(0) + F.monotonically_increasing_id()).alias("_pos"))
    lines = raw.where(strip(F.col("value")) != "")
    parsed = lines.withColumn("_r", F.from_json(strip(F.col("value")), schema))
    if strict:
        ok = F.try_parse_json(strip(F.col("value"))).isNotNull() & strip(F.col("value")).startswith("{")
        parsed = parsed.withColumn("_r", F.when(ok, F.col("_r")).otherwise(F.raise_error(F.concat(F.lit("no JSON object at "), F.col("_file"), F.lit(":"), F.col("_pos").cast("string")))))
    return parsed.select("_r.*", "_file", "_pos")


def token_folder(spark: SparkSession, root: str) -> DataFrame:
    """(problem_id, tokens, mask) of `root/tokens/<problem_id>/*.json`, one document a file."""
    raw = spark.read.option("wholetext", True).text(f"{root}/tokens/*/*.json").select("value", F.col("_metadata.file_path").alias("p"))
    r = F.from_json("value", "tokens array<bigint>, mask array<double>")
    return raw.select(F.regexp_extract("p", r"/tokens/([^/]+)/[^/]+$", 1).alias("problem_id"), r.alias("r")).select("problem_id", "r.tokens", "r.mask")


def evaluation_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file or, if the path is a folder with `tokens`, of that folder."""
    fs, p = _fs(spark, f"{path}/tokens")
    return token_folder(spark, path) if fs.exists(p) else json_lines(spark, path, schema)


def text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with header, every column a string, quoted line breaks allowed."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a file that holds one JSON object; values as strings."""
    return spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "map<string,string>")))


def tokenized(df: DataFrame, prompt: str, response: str, text: str, tokenizer: Tokenizer = word_tokens, end: int = 0) -> DataFrame:
    """Adds tokens and mask: prompt (mask 0) and response (mask 1) if both are there, else the text (mask 1), else an
    error; the end token is appended where missing."""
    p, r, t = tokenizer(F.col(prompt)), tokenizer(F.col(response)), tokenizer(F.col(text))
    two = F.col(prompt).isNotNull() & F.col(response).isNotNull()
    body = F.when(two, F.concat(p, r)).when(F.col(text).isNotNull(), t).otherwise(F.raise_error(F.lit("row has neither prompt and response nor text")))
    start = F.when(two, F.size(p)).otherwise(0)
    out = df.withColumn("tokens", body).withColumn("tokens", F.when(F.coalesce(F.try_element_at("tokens", F.lit(-1)) == end, F.lit(False)), F.col("tokens")).otherwise(F.concat("tokens", F.array(F.lit(end).cast("bigint")))))
    return out.withColumn("mask", F.transform("tokens", lambda _, i: F.when(i >= start, 1.0).otherwise(0.0)))


def kept(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The table at `path`, built and written first if it is missing or to be rebuilt."""
    fs, p = _fs(spark, f"{path}/_SUCCESS")
    if rebuild or not fs.exists(p):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object a row, nulls kept, text not escaped."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("append" if append else "overwrite").text(path)


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """The fields (default: all columns in sorted order) as CSV with header; nulls as empty text, nested values as JSON."""
    cols = []
    for c in fields or sorted(df.columns):
        kind = dict(df.dtypes).get(c)
        value = F.lit("") if kind is None else F.to_json(c) if kind.startswith(("array", "struct", "map")) else F.col(c).cast("string")
        cols.append(F.coalesce(value, F.lit("")).alias(c))
    df.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_tokens(df: DataFrame, path: str, by: str | None = None) -> None:
    """tokens/mask rows as parquet, checked for equal length, optionally parted by a column, beside an index."""
    checked = df.withColumn("mask", aligned(F.col("tokens"), F.col("mask"), F.col("problem_id")))
    w = checked.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(f"{path}/tokens")
    df.select("problem_id", F.size("tokens").cast("bigint").alias("num_tokens"), F.size(F.filter("mask", lambda x: x > 0)).cast("bigint").alias("num_loss_tokens")).write.mode("overwrite").parquet(f"{path}/index")


def manifest(df: DataFrame, key: str, **extra: str) -> DataFrame:
    """One row: number of rows, counts by key as a map, and the given texts."""
    n = df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.sum("n").alias("rows"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("counts")).select("rows", "counts", *[F.lit(v).alias(k) for k, v in extra.items()])


def report_lines(df: DataFrame, key: str) -> DataFrame:
    """(line): `key: n` in sorted order of the key."""
    n = df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy("k").select(F.format_string("%s: %d", "k", "n").alias("line"))


def provenance(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, bytes, sha256) of the files, in sorted order."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("path")


def fresh_folder(path: str, overwrite: bool) -> Path:
    """The empty folder; an error if it exists and may not be overwritten."""
    import shutil

    p = Path(path)
    if p.exists():
        if not overwrite:
            raise FileExistsError(path)
        shutil.rmtree(p)
    p.mkdir(parents=True)
    return p
