"""JSON sources and sinks: sequence cases, golden cases, reports, and a snapshot with its manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINDING = "event:string,kind:string,title:string,lang:string,start:timestamp,end:timestamp,due:timestamp,allDay:boolean,inferred:array<string>,confidence:double,place:string,people:array<string>"
SEQUENCE = f"""macTimezone string, contexts array<struct<id:string,name:string,timezone:string>>,
captures array<struct<id:string,capturedAt:timestamp,context:string,findings:array<struct<{FINDING}>>>>,
actions array<struct<after:string,action:string,event:string,title:string>>"""
META = """capturedAt timestamp, macTimezone string, context struct<name:string,timezone:string>,
windows array<struct<app:string,bundleID:string,title:string,frame:array<int>,stack:int>>, displaySize array<int>, scale double, origin string, scope string"""


def sequences(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each sequence case below the folder, named after its own folder."""
    read = spark.read.schema(SEQUENCE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "sequence.json").json(folder)
    return read.withColumn("case", F.element_at(F.split(F.input_file_name(), "/"), -2))


def golden_meta(spark: SparkSession, folder: str) -> DataFrame:
    read = spark.read.schema(META).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "meta.json").json(folder)
    return read.withColumn("case", F.element_at(F.split(F.input_file_name(), "/"), -2))


def sequence_findings(cases: DataFrame) -> DataFrame:
    """One row for each finding, with its capture."""
    captures = cases.select("case", F.explode("captures").alias("c"))
    return captures.select("case", F.col("c.id").alias("capture"), F.col("c.capturedAt").alias("captured_at"), F.col("c.context").alias("context"), F.posexplode("c.findings").alias("n", "f")).select(
        "case", "capture", "captured_at", "context", "n", "f.*"
    )


def sequence_problems(cases: DataFrame) -> DataFrame:
    """(case, problem): findings without a title and captures of unknown contexts."""
    found = sequence_findings(cases)
    untitled = found.where(F.trim(F.coalesce("title", F.lit(""))) == "").select("case", F.lit("missing title").alias("problem"))
    known = cases.select("case", F.explode("contexts").alias("x")).select("case", F.col("x.id").alias("context"))
    unknown = found.where(F.col("context").isNotNull()).join(known, ["case", "context"], "left_anti").select("case", F.lit("unknown context").alias("problem"))
    return untitled.unionByName(unknown).distinct()


def write_report(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).write.text(path)


def snapshot(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes the tables below ``path`` and returns the manifest: (name, rows, digest of the contents)."""
    parts = []
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
        stored = df.sparkSession.read.parquet(f"{path}/{name}")
        total = F.sum(F.xxhash64(*stored.columns).cast("decimal(38,0)"))
        parts.append(stored.agg(F.count("*").alias("rows"), F.sha2(F.coalesce(total.cast("string"), F.lit("")), 256).alias("digest")).select(F.lit(name).alias("name"), "rows", "digest"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    out.write.parquet(f"{path}/_manifest")
    return out


def replace_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """An upsert: rows of ``old`` whose key is not in ``new``, and all rows of ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
