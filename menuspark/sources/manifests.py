"""Onboarding manifests: a folder of JSON documents, read with a schema and checked across fields."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from menuspark.storage import hadoop_path

SCHEMA = """
    slug string, name string, city string, countryCode string, address string, websiteUrl string, latitude double, longitude double,
    menuSource struct<url string, sourceType string, fetchMode string, checkIntervalMinutes int, minimumExpectedItems int>,
    requiredDishes array<struct<name string, sectionName string, priceMinor long, priceKind string, priceMaxMinor long>>,
    forbiddenDishes array<string>
"""
TYPES = ("html", "json_ld", "pdf")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests with ``manifest_file`` and the names of the rules each breaks, in file order."""
    rows = spark.read.schema(SCHEMA).option("multiLine", True).json(path).withColumn("manifest_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    source = F.col("menuSource")
    rules = {
        "slug": F.coalesce(F.col("slug").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False)),
        "coordinates": F.coalesce(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180), F.lit(False)),
        "source_type": F.coalesce(source["sourceType"].isin(*TYPES), F.lit(False)),
        "interval": F.coalesce(source["checkIntervalMinutes"].between(5, 10080), F.lit(False)),
        "browser_needs_html": ~F.coalesce((source["fetchMode"] == "browser") & (source["sourceType"] == "pdf"), F.lit(False)),
        "minimum": F.coalesce(source["minimumExpectedItems"] >= F.size(F.coalesce("requiredDishes", F.array())), F.lit(False)),
    }
    broken = F.array_compact(F.array(*[F.when(~ok, name) for name, ok in rules.items()]))
    return rows.withColumn("broken_rules", broken).orderBy("manifest_file")


def expected_dishes(manifests: DataFrame) -> DataFrame:
    """(manifest_id, minimum_items, kind, name) of required and forbidden dishes, for the quality gate."""
    required = F.transform(F.coalesce("requiredDishes", F.array()), lambda d: F.struct(F.lit("required").alias("kind"), d["name"].alias("name")))
    forbidden = F.transform(F.coalesce("forbiddenDishes", F.array()), lambda d: F.struct(F.lit("forbidden").alias("kind"), d.alias("name")))
    return manifests.select(F.col("slug").alias("manifest_id"), F.col("menuSource.minimumExpectedItems").alias("minimum_items"), F.inline(F.concat(required, forbidden)))


def generated(items: DataFrame, key: str, spread: int = 5) -> DataFrame:
    """A manifest draft per key: the item count as minimum and evenly spaced names as required dishes."""
    from menuspark.operators.queues import evenly_spaced

    counts = items.groupBy(key).agg(F.count("*").cast("int").alias("minimum_items"))
    picks = evenly_spaced(items, ["position", "name"], spread, [key]).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "name"))), lambda s: s["name"]).alias("required"))
    return counts.join(picks, key)


def write_exclusive(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new file; false, and nothing written, if there is one of that name already."""
    fs, at = hadoop_path(spark, path)
    try:
        out = fs.create(at, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True
