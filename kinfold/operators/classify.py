"""A binary classifier over pair features: labelled links against hard negatives of the candidate pool."""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.session import materialize

FEATURES = ["name_similarity", "name_jaccard", "name_overlap", "name_length_ratio", "name_contained", "number_match", "postal_match", "numbers_overlap", "street_overlap"]


def folded(features: DataFrame, folds: int = 5) -> DataFrame:
    """Adds ``fold``; folds are disjoint in S1 entities."""
    return features.withColumn("fold", F.pmod(F.xxhash64("s1_id"), F.lit(folds)))


def weighted(features: DataFrame) -> DataFrame:
    """``fold, is_match, pairs`` and the features: one row for all pairs of a fold that are equal in them, with their number.

    Neither a fit nor its measures tell such pairs apart, and they are the most of all pairs.
    """
    return folded(features).groupBy("fold", "is_match", *FEATURES).agg(F.count(F.lit(1)).alias("pairs"))


def fit_and_score(features: DataFrame, folds: int = 5, trees: int = 10, depth: int = 4) -> DataFrame:
    """The rows of fold 0 with ``score``, by boosted trees fitted on all pairs of the others.

    ``features`` has the feature columns and ``is_match`` of labelled entities, and either ``s1_id`` and ``cand_id``, or the
    columns of ``weighted``. Equal pairs are fitted as one row with their number as weight, and thresholds come from all
    rows. With no pairs, or those of one class only, there is nothing to fit and no row.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    if "pairs" not in features.columns:
        features = folded(features, folds).withColumn("pairs", F.lit(1).cast("long"))
    kept = [c for c in features.columns if c not in FEATURES and c != "fold"]
    numeric = [F.col(f).cast("double").alias(f) for f in FEATURES]
    table = features.select(*kept, "fold", F.col("is_match").cast("double").alias("label"), *numeric)
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="vector")
    train = materialize(table.filter("fold > 0").groupBy("label", *FEATURES).agg(F.sum("pairs").cast("double").alias("weight")), "train")
    n = train.groupBy("label").count().collect()  # two rows at most
    if len(n) < 2:
        return table.limit(0).select(*kept, F.lit(0.0).alias("score"))
    # Spark takes thresholds from a sample of the rows if there are more than bins squared.
    bins = max(32, ceil(sqrt(sum(r["count"] for r in n))))
    model = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, maxBins=bins, seed=42).fit(assembled.transform(train).select("vector", "label", "weight"))
    scored = model.transform(assembled.transform(table.filter("fold = 0")))
    return scored.select(*kept, vector_to_array("probability")[1].alias("score"))


def precision_recall(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """``threshold, pairs, hits, precision, recall`` of scored pairs, recall against the matches among them, in one pass.

    A row stands for its number of ``pairs``, where it has one.
    """
    w = F.col("pairs") if "pairs" in scored.columns else F.lit(1)
    count = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0).cast("long"))
    aggs = [count(F.col("is_match")).alias("m")]
    for i, t in enumerate(thresholds):
        aggs += [count(F.col("score") >= t).alias(f"p{i}"), count((F.col("score") >= t) & F.col("is_match")).alias(f"h{i}")]
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"p{i}").alias("pairs"), F.col(f"h{i}").alias("hits"), F.col("m").alias("m")) for i, t in enumerate(thresholds)])
    g = scored.agg(*aggs).select(F.inline(rows))
    return g.withColumns({"precision": F.col("hits") / F.nullif("pairs", F.lit(0)), "recall": F.col("hits") / F.nullif("m", F.lit(0))}).drop("m")
