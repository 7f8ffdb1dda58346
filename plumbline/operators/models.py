"""Column scorers: TF-IDF with naive Bayes or logistic regression, a stub, and a registry for others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF, NGram, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCORERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


#: Grams of characters, 3 to 5 of each word with a space at either side; of words, one and two.
CHARACTERS = "SELECT *, flatten(transform(words, w -> flatten(transform(sequence(3, 5), n -> transform(sequence(1, greatest(length(w) + 3 - n, 1)), i -> substr(concat(' ', w, ' '), i, n)))))) AS grams FROM __THIS__"
PAIRS = "SELECT *, concat(words, pairs) AS grams FROM __THIS__"


def fit(rows: DataFrame, *, kind: str = "nb", grams: str = "words", vocabulary: int = 50_000, weight: str | None = None) -> PipelineModel:
    """rows(text, label): words and word pairs, or characters, counted, weighted by inverse document frequency; rows without a label don't
    count."""
    rows = rows.where(F.col("label").isNotNull()).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[\p{L}\p{N}']+", gaps=False)
    pairs = NGram(n=2, inputCol="words", outputCol="pairs")
    both = SQLTransformer(statement=CHARACTERS if grams == "characters" else PAIRS)
    count = CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=vocabulary, minDF=2) if vocabulary <= 1 << 18 else HashingTF(inputCol="grams", outputCol="tf", numFeatures=vocabulary)
    idf = IDF(inputCol="tf", outputCol="features")
    model = NaiveBayes(smoothing=0.1, weightCol=weight) if kind == "nb" else LogisticRegression(maxIter=50, regParam=0.01, weightCol=weight)
    if weight is None:
        model.clear(model.weightCol)
    return Pipeline(stages=[words, pairs, both, count, idf, model]).fit(rows)


def score(rows: DataFrame, model: PipelineModel, key: str) -> DataFrame:
    """(key, score of label 1, predicted) of every row, joined by key and never by position; a null text has no words."""
    out = model.transform(rows.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return out.select(key, F.round(vector_to_array("probability")[1], 6).alias("score"), F.col("prediction").cast("int").alias("predicted"))


def chosen(train: DataFrame, dev: DataFrame, options: list[dict]) -> tuple[PipelineModel, dict]:
    """The model, of one for each of the options, with the best macro-F1 on dev, and its options; the first of equals. dev is scored by the
    confusion counts alone."""
    best = None
    for o in options:
        model = fit(train, **o)
        out = model.transform(dev.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))))
        cells = {(int(r[0]), int(r[1])): r[2] for r in out.groupBy("label", "prediction").count().collect()}
        labels = sorted({x for c in cells for x in c})
        f1 = [2 * cells.get((x, x), 0) / (sum(n for (t, _), n in cells.items() if t == x) + sum(n for (_, p), n in cells.items() if p == x)) for x in labels]
        value = sum(f1) / len(f1) if f1 else 0.0
        if best is None or value > best[0]:
            best = value, model, o
    return best[1], best[2]


def register(name: str, scorer: Callable[[DataFrame], DataFrame]) -> None:
    SCORERS[name] = scorer


def predict(rows: DataFrame, name: str) -> DataFrame:
    if name not in SCORERS:
        raise KeyError(f"no scorer {name}")
    return SCORERS[name](rows)


def class_weights(rows: DataFrame, label: str, most: float = 20.0) -> DataFrame:
    """Weight of the positive class for each type: negatives over positives, 20 at most. rows: type, label."""
    return rows.groupBy("type").agg(F.least(F.try_divide(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)), F.lit(most)).alias("weight"))
