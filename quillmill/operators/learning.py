"""Label preparation and evaluation: priority dedup, leak-free splits, calibration, thresholds, and a text classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.text import bucket_of


def survivors(df: DataFrame, key: Column, priority: Column, tie: str) -> DataFrame:
    """Of rows with equal key the one of greatest priority, then smallest `tie`. A partial aggregate, so copies combine before the shuffle."""
    best = df.groupBy(key.alias("_key")).agg(F.max_by(F.col(tie), F.struct(priority, -F.col(tie))).alias(tie), F.count(F.lit(1)).alias("copies"))
    return best.select(tie, "copies")


def split_of(group: Column, train: int = 80, valid: int = 10) -> Column:
    """train, valid or test from the group's hash: a group never falls apart."""
    b = bucket_of(group, 100)
    return F.when(b < train, "train").when(b < train + valid, "valid").otherwise("test")


def reliability(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Half-open bins of probability; p = 1 is in none."""
    b = F.floor(F.col(p) * bins).cast("bigint")
    return df.where(F.col(p) < 1).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))


def text_classifier(docs: DataFrame, text: str, label: str, features: int = 1 << 14):
    """A fitted pipeline: words, hashed term frequencies, IDF, logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    stages = [RegexTokenizer(inputCol=text, outputCol="_words", pattern="[^a-z]+"), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_x", minDocFreq=2), LogisticRegression(featuresCol="_x", labelCol=label, maxIter=20, regParam=0.01)]
    return Pipeline(stages=stages).fit(docs)
