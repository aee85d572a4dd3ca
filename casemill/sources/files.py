"""Sources and sinks of case tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import CASE_SCHEMA
from ..session import stash


def read_cases(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """JSON lines of CASE_SCHEMA. Blank lines are skipped; a malformed one raises, or is dropped if lenient."""
    return spark.read.schema(CASE_SCHEMA).json(path, mode="DROPMALFORMED" if lenient else "FAILFAST")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """CASE_SCHEMA records from one JSON array or from JSON lines, told apart by the first character."""
    first = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''").limit(1).collect()
    array = bool(first) and first[0]["line"].startswith("[")
    return spark.read.schema(CASE_SCHEMA).json(path, multiLine=array)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """value: the trimmed lines that aren't empty."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """class, keyword from maps of class to keywords, one map in the file or one a line."""
    kind = "map<string,array<string>>"
    lines = spark.read.text(path).select(F.from_json("value", kind).alias("m")).filter("m is not null")
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m")).filter("m is not null")
    found = lines if lines.limit(1).count() else whole
    return found.select(F.explode("m").alias("class", "keywords")).select("class", F.explode("keywords").alias("keyword")).distinct()


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def write_by(rows: DataFrame, column: str, path: str) -> None:
    """One folder for each value of a column."""
    rows.write.partitionBy(column).parquet(path)


def write_split(rows: DataFrame, keep: Column, kept: str, dropped: str) -> None:
    """Two filtered writes of rows that are made once; a null condition is a drop."""
    told = stash(rows.withColumn("__kept", F.coalesce(keep, F.lit(False))), "split")
    told.filter("__kept").drop("__kept").write.parquet(kept)
    told.filter("not __kept").drop("__kept").write.parquet(dropped)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_new(rows: DataFrame, key: str, path: str) -> int:
    """Append the rows whose key the table at path hasn't; gives how many there were. The
    table is made if there is none."""
    spark = rows.sparkSession
    new = rows
    if exists(spark, path):
        done = spark.read.parquet(path).select(F.col(key).alias("__done"))
        new = rows.join(done, F.col(key) == F.col("__done"), "left_anti")
    new = stash(new, "new-rows")
    new.write.mode("append").parquet(path)
    return new.count()


def write_centroids(centroids: DataFrame, summary: DataFrame, path: str) -> None:
    """The centroids as a table, and the classes' figures as JSON beside it."""
    centroids.write.parquet(f"{path}/centroids")
    summary.write.json(f"{path}/summary")


def write_embeddings(rows: DataFrame, path: str) -> None:
    """case_id, embedding (floats) and articles, ordered so that a range of ids is read from few files."""
    out = rows.select("case_id", F.col("v").cast("array<float>").alias("embedding"), "articles")
    out.repartitionByRange("case_id").sortWithinPartitions("case_id").write.parquet(path)


def report_lines(title: str, figures: DataFrame) -> DataFrame:
    """place, line of a plain text report of a table of figures, one line a row, in the order of its columns."""
    told = F.concat_ws(", ", *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in figures.columns))
    w = Window.orderBy(*figures.columns)  # a report's rows are few
    body = figures.select(F.row_number().over(w).alias("place"), told.alias("line"))
    return figures.sparkSession.createDataFrame([(0, title)], "place int, line string").unionByName(body)


def write_report(title: str, figures: DataFrame, path: str) -> None:
    """report_lines as one text file."""
    report_lines(title, figures).coalesce(1).sortWithinPartitions("place").select("line").write.text(path)
