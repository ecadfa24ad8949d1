"""Record files, run reports and month partitions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import staged


def _as_json(text: str | None) -> str | None:
    """A YAML record as JSON; null if it can't be read or is no mapping. JSON is YAML too."""
    import yaml

    try:
        record = yaml.load(text or "", getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except yaml.YAMLError:
        return None
    return json.dumps(record, default=str) if isinstance(record, dict) else None


def read_records(spark: SparkSession, path: str, schema: str, required: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Record files, one JSON or YAML mapping each -> (good rows, bad(file, message)). What can't be parsed or lacks a key is bad. Only what
    isn't JSON goes through the YAML helper."""

    def run(text: pd.Series) -> pd.Series:
        return text.map(_as_json)

    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    plain = F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{")
    raw = raw.select("file", F.when(plain, F.col("value")).otherwise(F.pandas_udf(run, "string")(F.when(~plain, F.col("value")))).alias("value"))
    rows = raw.withColumn("r", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"r.{c}").isNull(), F.lit(c)) for c in required])), ", ")
    why = F.when(F.col("r._bad").isNotNull() | F.col("r").isNull(), "unreadable").when(missing != "", F.concat(F.lit("missing: "), missing))
    rows = staged(rows.select("file", "r", why.alias("message")), "records-read")  # each file is opened once for both
    return rows.where("message is null").select("file", "r.*").drop("_bad"), rows.where("message is not null").select("file", "message")


def write_by_month(rows: DataFrame, day: str, path: str) -> None:
    """Parquet in one folder for each month; a month's rows meet in few files."""
    rows.withColumn("month", F.date_format(day, "yyyy-MM")).repartition("month").write.mode("overwrite").partitionBy("month").parquet(path)


def read_since(spark: SparkSession, path: str, month: str) -> DataFrame:
    """Only the months from `month` on are listed and read."""
    return spark.read.parquet(path).where(F.col("month") >= month)


def latest_run(reports: DataFrame) -> DataFrame:
    """The report with the greatest run_id."""
    columns = [c for c in reports.columns if c != "run_id"]
    return reports.agg(F.max("run_id").alias("run_id"), F.max_by(F.struct(*columns), "run_id").alias("r")).select("run_id", "r.*")


def digests(files: DataFrame, most_chars: int | None = None) -> DataFrame:
    """files(profile_id, path, text) -> (profile_id, digest, chars): SHA-256 over path, NUL, text, NUL of each file in order of the
    paths; null texts count as empty. One row gathers a profile's texts. most_chars: a profile with more characters is refused before any
    text is gathered, its digest is null; `digests_in_levels` takes profiles of any size."""
    rows = files.select("profile_id", "path", F.coalesce("text", F.lit("")).alias("text"))
    chars = rows.groupBy("profile_id").agg(F.sum(F.length("text")).alias("chars"))
    kept = rows if most_chars is None else rows.join(chars.where(F.col("chars") <= most_chars).select("profile_id"), "profile_id")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda f: F.concat(f["path"], F.lit("\0"), f["text"], F.lit("\0"))), "")
    own = kept.groupBy("profile_id").agg(F.sha2(whole.cast("binary"), 256).alias("digest"))
    return chars.join(own, "profile_id", "left").select("profile_id", "digest", "chars")


def digests_in_levels(files: DataFrame) -> DataFrame:
    """files(profile_id, path, text) -> (profile_id, digest, chars) over all files, of any length and number; null texts
    count as empty.

    The rule: a file's hash is SHA-256 of path, NUL, text, NUL; files fall into 4,096 groups by the first 12 bits of their
    path's SHA-256; a group's hash is SHA-256 of its files' hashes in order of path and hash; the digest is SHA-256 of the
    groups' hashes in the order of the groups. So no row holds more than one text or a group's short hashes."""
    text = F.coalesce("text", F.lit(""))
    own = files.select(
        "profile_id", "path", F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 3).alias("part"),
        F.sha2(F.concat("path", F.lit("\0"), text, F.lit("\0")).cast("binary"), 256).alias("hash"), F.length(text).alias("n"),
    )
    level = lambda c, key: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key, c))), lambda x: x[c]), "").cast("binary"), 256)
    groups = own.groupBy("profile_id", "part").agg(level("hash", ["path"]).alias("hash"), F.sum("n").alias("n"))
    return groups.groupBy("profile_id").agg(level("hash", ["part"]).alias("digest"), F.sum("n").alias("chars"))
