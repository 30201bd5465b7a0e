"""Reading and writing request logs, bodies, tasks, evidence, manifests and data sets."""

from __future__ import annotations

import gzip
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cost import cost_usd, with_price
from ..operators.report import in_days

REQUEST_SCHEMA = """id LONG, ts TIMESTAMP, ts_epoch DOUBLE, day STRING, api STRING, path STRING, client STRING, model STRING, stream BOOLEAN,
status INT, err STRING, latency_ms INT, ttfb_ms INT, in_tok LONG, cw_tok LONG, cr_tok LONG, out_tok LONG, reasoning_tok LONG, usage_source STRING,
cost_usd DOUBLE, msg_count INT, sys_chars LONG, tool_spec_chars LONG, tool_count INT, tool_names ARRAY<STRING>, cat_chars MAP<STRING, LONG>,
hist_age_rank MAP<STRING, ARRAY<DOUBLE>>, body_sha STRING, features_sha STRING, est_in_tok LONG, engine_ms DOUBLE, interventions ARRAY<STRING>"""
TASK_SCHEMA = "id STRING, task STRING, grader STRING, expected_files ARRAY<STRING>, context ARRAY<STRUCT<path: STRING, stale: BOOLEAN, big: BOOLEAN>>"
# Folders that hold no source, and known source extensions.
SKIP_DIRS = [".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", "target"]
SOURCE_EXTENSIONS = ["py", "js", "jsx", "ts", "tsx", "mjs", "cjs", "go", "rs", "java", "rb", "php", "c", "h", "cpp", "cs", "swift", "kt", "sql", "json", "jsonl", "csv", "tsv", "yaml", "yml", "toml", "md", "html", "css", "sh", "vue", "svelte"]
MAX_FILE_BYTES, MAX_FILES = 4 << 20, 20_000


def read_requests(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    return in_days(spark.read.schema(REQUEST_SCHEMA).option("mergeSchema", "true").parquet(path), since, until)


def to_request_rows(raw: DataFrame) -> DataFrame:
    """raw rows (ts_epoch, model, usage numbers, ...) with day in UTC, token numbers of 0 for null, and cost where it is absent."""
    rows = raw.withColumn("day", F.date_format(F.timestamp_seconds("ts_epoch"), "yyyy-MM-dd"))
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("in_tok", "cw_tok", "cr_tok", "out_tok")})
    priced = with_price(rows)
    given = F.col("cost_usd") if "cost_usd" in raw.columns else F.lit(None).cast("double")
    return priced.withColumn("cost_usd", F.coalesce(given, cost_usd())).drop("price_in", "price_cached", "price_out")


def append_requests(rows: DataFrame, path: str, batch: int = 0) -> dict:
    """Writes one batch of rows under path/day=.../batch=..., and returns how many it wrote, and their first and last day.

    Only the partitions of this batch are replaced, so a batch that is written again, after a lost
    driver or a replay, changes nothing, and others can be written at the same time. The counts
    come out of the write itself.
    """
    seen = Observation()
    own = rows.withColumn("batch", F.lit(batch)).observe(seen, F.count("*").alias("rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    own.write.partitionBy("day", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return seen.get


def stream_requests(rows: DataFrame, path: str, checkpoint: str, counted=None):
    """Starts a query that appends a stream of rows batch by batch; counted gets each batch's number and counts."""

    def write(batch: DataFrame, number: int) -> None:
        counts = append_requests(batch, path, number)
        if counted is not None:
            counted(number, counts)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_schema(rows: DataFrame, schema: str = REQUEST_SCHEMA) -> DataFrame:
    """rows with every column of the schema; those of an older log are null."""
    empty = rows.sparkSession.createDataFrame([], schema)
    return empty.unionByName(rows.select(*[c for c in rows.columns if c in empty.columns]), allowMissingColumns=True)


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(dialect, body_sha, body, ok) of spooled bodies named <dialect>_<sha>.json or .json.gz; an unreadable one has ok false."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column(1).to_pylist():
                try:
                    text = (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode()
                    json.loads(text)
                    out.append(text)
                except (OSError, EOFError, zlib.error, ValueError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["path", "body"])

    files = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unpack, "path string, body string")
    name = r"([a-z]+)_([0-9a-f]{12})\.json(?:\.gz)?$"
    return files.select(F.regexp_extract("path", name, 1).alias("dialect"), F.regexp_extract("path", name, 2).alias("body_sha"), "body", F.col("body").isNotNull().alias("ok"))


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TASK_SCHEMA).json(path).where("id is not null")


def read_repo(spark: SparkSession, root: str, most: int = MAX_FILES) -> DataFrame:
    """(path, length, src) of source files by extension, outside of skipped folders, the first ones by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return source_files(files.select("path", "length", F.col("content").cast("string").alias("src")), most)


def source_files(files: DataFrame, most: int = MAX_FILES, skip: list[str] = SKIP_DIRS) -> DataFrame:
    ext = F.lower(F.substring_index("path", ".", -1))
    skipped = F.exists(F.split("path", "/"), lambda d: d.isin(skip))
    kept = files.where(ext.isin(SOURCE_EXTENSIONS) & ~skipped & (F.col("length") <= MAX_FILE_BYTES))
    if most is None:
        return kept
    first = kept.select("path").orderBy("path").limit(most)  # texts don't go through the one task that ends a limit
    return kept.join(first, "path", "left_semi")


def load_evidence(spark: SparkSession, path: str) -> DataFrame:
    """(label, precision, latency_ms, source) of a JSON file {baseline, adapters: [...]}; latency may be a number or a curve."""
    raw = spark.read.schema("baseline STRUCT<precision: DOUBLE>, adapters ARRAY<STRUCT<label: STRING, precision: DOUBLE, latency: STRING>>").option("multiLine", "true").json(path)
    a = raw.select(F.inline("adapters"))
    latency = F.coalesce(F.try_variant_get(F.try_parse_json("latency"), "$.p50", "double"), F.expr("try_cast(latency as double)"))
    adapters = a.select("label", "precision", latency.alias("latency_ms"), F.lit("adapter").alias("source"))
    base = raw.select(F.lit("heuristic").alias("label"), F.col("baseline.precision").alias("precision"), F.lit(0.0).alias("latency_ms"), F.lit("baseline").alias("source"))
    return base.unionByName(adapters).where("precision is not null and label is not null")


def manifest_rows(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions, warnings) of a manifest (versions array<struct<label, version>>, active): labels once, first kept; an unknown active is dropped."""
    rows = manifest.select(F.posexplode("versions").alias("pos", "v"), "active").select("pos", "v.*", "active").where("label is not null")
    w = Window.partitionBy("label").orderBy("pos")
    once = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    versions = once.withColumn("active", F.coalesce(F.col("label") == F.col("active"), F.lit(False))).drop("pos")
    unknown = manifest.select("active").where("active is not null").join(once.select(F.col("label").alias("active")), "active", "left_anti")
    return versions, unknown.select(F.concat(F.lit("unknown active version "), F.col("active")).alias("warning"))


def export_rows(decisions: DataFrame, labels: DataFrame, slots: list[str] | None = None, slim: bool = False) -> DataFrame:
    """One row for each request and slot with its human label; slim leaves candidates out."""
    rows = decisions if slots is None else decisions.where(F.col("slot").isin(slots))
    rows = rows.drop("candidates") if slim and "candidates" in rows.columns else rows
    return rows.join(labels.select("request_id", "slot", "verdict"), ["request_id", "slot"], "left").withColumn("label_source", F.when(F.col("verdict").isNotNull(), "human").otherwise("none"))


def write_export(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def export_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("slot", "label_source").agg(F.count("*").alias("n"))


def write_split(split: DataFrame, path: str) -> None:
    split.write.partitionBy("part").json(path)


def read_labels(store: DataFrame) -> DataFrame:
    """(request_id, slot, verdict) of a store row (request_id, verdicts map<slot, verdict>)."""
    return store.select("request_id", F.explode("verdicts").alias("slot", "verdict"))
