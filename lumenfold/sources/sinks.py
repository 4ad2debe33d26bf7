"""Writes: CSV exports, mirror trees, name collisions, safe names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names that a file must not have.
RESERVED = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])$"
MAX_NAME = 120


def write_csv(df: DataFrame, path: str) -> None:
    """All fields quoted, quotes doubled, nested values as JSON, a header line."""
    nested = {f.name: F.to_json(f.name) for f in df.schema if f.dataType.typeName() in ("struct", "array", "map", "variant")}
    df.withColumns(nested).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def safe_name(name: Column) -> Column:
    """Whether a name may be given to a file."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    bad = (name == "") | name.rlike(r'[\\/<>:"|?*\x00-\x1f]') | name.isin(".", "..") | stem.rlike(RESERVED) | name.rlike(r"[. ]$") | (F.length(name) > MAX_NAME)
    return F.coalesce(~bad, F.lit(False))


def segment(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r'[\\/:*?"<>|]', ""))


def mirror_path(subject: Column, name: Column) -> Column:
    """The subject's folders, or ``_Unsorted``, then the name."""
    parts = F.filter(F.transform(F.split(F.coalesce(subject, F.lit("")), r"[/\\.]"), segment), lambda x: x != "")
    folder = F.when(F.size(parts) > 0, F.array_join(parts, "/")).otherwise("_Unsorted")
    return F.concat(folder, F.lit("/"), name)


def disambiguated(df: DataFrame, path: str, order: str) -> DataFrame:
    """Paths that are equal but for case get " (2)", " (3)" before the extension, in the order given.

    Numbers begin after the largest that a given path with the same stem and extension has, so no new path is one that is
    there. Null paths stay null."""
    ext, stem = F.regexp_extract(path, r"(\.[^./]+)$", 1), F.regexp_replace(path, r"\.[^./]+$", "")
    mark = r" \((\d{1,9})\)$"
    taken = df.select(F.lower(F.concat(F.regexp_replace(stem, mark, ""), ext)).alias("_path"), F.regexp_extract(stem, mark, 1).alias("k")).where("k <> ''")
    largest = taken.groupBy("_path").agg(F.max(F.col("k").cast("long")).alias("_taken"))
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(F.lower(path)).orderBy(order)))
    again = numbered.join(largest, F.lower(path) == F.col("_path"), "left")
    place = F.col("_n") - 1 + F.greatest(F.coalesce("_taken", F.lit(1)), F.lit(1))
    return again.withColumn(path, F.when(F.col("_n") > 1, F.concat(stem, F.lit(" ("), place.cast("string"), F.lit(")"), ext)).otherwise(F.col(path))).drop("_n", "_path", "_taken")


def swapped_version(versions: DataFrame, new: DataFrame) -> DataFrame:
    """A new current version of each document it names: numbers go on, the old current row is demoted. new: document_id and facts."""
    last = versions.groupBy("document_id").agg(F.max("version_number").alias("_last"))
    fresh = new.join(last, "document_id", "left").withColumn("version_number", F.coalesce("_last", F.lit(0)) + 1).withColumn("is_current", F.lit(True)).drop("_last")
    touched = new.select("document_id").distinct().withColumn("_new", F.lit(True))
    old = versions.join(touched, "document_id", "left").withColumn("is_current", F.col("is_current") & F.col("_new").isNull()).drop("_new")
    return old.unionByName(fresh, allowMissingColumns=True)
