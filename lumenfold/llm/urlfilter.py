"""URL verdicts: explicit rules first, else logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path), fixed values.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
FEATURES = 1 << 14


def host_and_path(url: str) -> tuple[Column, Column]:
    """Empty for a null url or one without ``://``."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def longest_rule(rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) that fits columns host and path; of several the longest, of equally long ones the first in the alphabet."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def featurizer(n: int = 3, features: int = FEATURES) -> Pipeline:
    return Pipeline(stages=[NGram(n=n, inputCol="chars", outputCol="grams"), HashingTF(numFeatures=features, binary=True, inputCol="grams", outputCol="features")])


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, max_labelled: int = 3000, url_col: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict and p_block to ``pages``. Columns of those names are replaced; all others stay, whatever they are called.

    labelled: a small URL table (url, block 0/1); without it, the urls that a rule judges are the labelled table. Whatever it is, a url (its host and path)
    with its label counts once, however often it is there, and no more than half of ``max_labelled`` urls of each class train, those with the smallest
    hashes. If there is one class only, that is the verdict without a rule, and ``allow`` if there are none."""
    added = ["host", "path", "rule", "verdict", "p_block"]
    own = [(f"_{i}", name) for i, name in enumerate(pages.columns) if name not in added]
    # The input's columns go by their places inside, so that no name of theirs can meet one of the model's.
    held = pages.toDF(*(f"_{i}" for i in range(len(pages.columns))))
    host, path = host_and_path(f"_{pages.columns.index(url_col)}")
    rule, verdict = longest_rule(rules)
    judged = held.select(*(i for i, _ in own), host.alias("host"), path.alias("path")).withColumns({"rule": rule, "says": verdict})
    chars = F.split(F.concat(F.lit("^"), "host", F.lit(" "), "path", F.lit("$")), "")
    if labelled is None:
        table = judged.where("rule is not null").select("host", "path", (F.col("says") == "block").cast("double").alias("label"))
    else:
        h, p = host_and_path("url")
        table = labelled.select(h.alias("host"), p.alias("path"), F.col("block").cast("double").alias("label"))
    distinct = table.distinct()
    smallest = lambda label: distinct.where(F.col("label") == label).orderBy(F.xxhash64("host", "path"), "host", "path").limit(max_labelled // 2)
    table = written(smallest(0.0).unionByName(smallest(1.0)).coalesce(1), "labelled").withColumn("chars", chars)
    classes = [r["label"] for r in table.select("label").distinct().collect()]
    if len(classes) < 2:
        p_block = F.lit(classes[0] if classes else 0.0)
        scored = judged.withColumn("p_block", p_block)
    else:
        features = featurizer().fit(table)
        model = LogisticRegression(regParam=0.002, maxIter=40, labelCol="label", featuresCol="features").fit(features.transform(table))
        scored = model.setPredictionCol("").setRawPredictionCol("").transform(features.transform(judged.withColumn("chars", chars)))
        from pyspark.ml.functions import vector_to_array

        scored = scored.withColumn("p_block", vector_to_array("probability")[1])
    verdict = F.coalesce("says", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    return scored.withColumn("verdict", verdict).select(*(F.col(i).alias(name) for i, name in own), *added)
