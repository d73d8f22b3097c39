"""Text features as Spark ML stages.

The vocabulary and document frequencies come from ``operators.features``, so
the vectors hold the same weights as the TF-IDF table. Every stage is saved
and loaded with the pipeline.
"""

from __future__ import annotations

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from labelwright.functions.text import ngrams, tokenize
from labelwright.models.linear import doubles, score
from labelwright.operators.features import (
    MAX_FEATURES,
    MIN_DOCS,
    corpus_vocabulary,
    smoothed_idf,
)


class TermSplitter(
    Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """text -> array of terms, uni- or uni- and bigrams."""

    nMax = Param(Params._dummy(), "nMax", "longest n-gram", TypeConverters.toInt)

    def __init__(self, inputCol: str = "text", outputCol: str = "terms", nMax: int = 1):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, nMax=nMax)

    def _transform(self, df: DataFrame) -> DataFrame:
        tokens = F.coalesce(
            tokenize(F.col(self.getInputCol())), F.array().cast("array<string>")
        )
        held = df.withColumn(self.getOutputCol(), tokens)
        if self.getOrDefault(self.nMax) == 1:
            return held
        return held.withColumn(
            self.getOutputCol(),
            ngrams(F.col(self.getOutputCol()), self.getOrDefault(self.nMax)),
        )


class SublinearTfidf(
    Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Term counts -> (1 + ln count) * idf at unit length, as sparse (indices, values).

    Spark ML has no stage that takes logarithms of counts. The count vector is opened as
    the struct it is stored as, so the weights are column expressions.
    """

    idf = Param(Params._dummy(), "idf", "weight of each term", TypeConverters.toListFloat)

    def __init__(self, inputCol: str = "counts", outputCol: str = "features", idf: list[float] | None = None):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, idf=idf)

    def _transform(self, df: DataFrame) -> DataFrame:
        idf = doubles(self.getOrDefault(self.idf))
        counts = F.unwrap_udt(F.col(self.getInputCol()))
        raw = F.zip_with(
            counts["indices"], counts["values"], lambda at, n: (F.lit(1.0) + F.log(n)) * F.get(idf, at)
        )
        length = lambda values: F.sqrt(F.aggregate(values, F.lit(0.0), lambda t, x: t + x * x))
        # One element, so that the length is taken once per row and not once per term.
        unit = F.transform(
            F.array(F.struct(raw.alias("raw"), length(raw).alias("length"))),
            lambda row: F.transform(row["raw"], lambda x: x / row["length"]),
        )[0]
        return df.withColumn(
            self.getOutputCol(), F.struct(counts["indices"].alias("indices"), unit.alias("values"))
        )


class LinearClassifier(
    Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Sparse features -> index of the class with the largest score, the first of equal ones."""

    weights = Param(Params._dummy(), "weights", "class after class, its intercept last", TypeConverters.toListFloat)
    n_classes = Param(Params._dummy(), "n_classes", "number of classes", TypeConverters.toInt)

    def __init__(
        self, inputCol: str = "features", outputCol: str = "_predicted",
        weights: list[float] | None = None, n_classes: int = 0,
    ):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, weights=weights, n_classes=n_classes)

    def by_class(self) -> list[list[float]]:
        flat, n = self.getOrDefault(self.weights), self.getOrDefault(self.n_classes)
        width = len(flat) // n
        return [flat[k * width:(k + 1) * width] for k in range(n)]

    def _transform(self, df: DataFrame) -> DataFrame:
        features = F.col(self.getInputCol())
        scores = F.array(*[score(features, weights) for weights in self.by_class()])
        best = F.transform(F.array(scores), lambda s: F.array_position(s, F.array_max(s)))[0]
        return df.withColumn(self.getOutputCol(), (best - 1).cast("double"))


class TfidfVectorizer(Estimator):
    """Fit the vocabulary and idf; the model turns text into unit vectors."""

    def __init__(
        self,
        id_col: str,
        text_col: str = "text",
        n_max: int = 1,
        max_features: int = MAX_FEATURES,
        min_docs: int = MIN_DOCS,
        output_col: str = "features",
    ):
        super().__init__()
        self.id_col, self.text_col, self.n_max = id_col, text_col, n_max
        self.max_features, self.min_docs, self.output_col = max_features, min_docs, output_col

    def _fit(self, df: DataFrame) -> PipelineModel:
        words = corpus_vocabulary(
            df, self.id_col, self.text_col, self.n_max, self.max_features, self.min_docs
        )
        n_docs = df.agg(F.count(F.lit(1)).alias("n")).scalar()
        # At most max_features rows: the model itself.
        rows = words.select("term", smoothed_idf(F.col("df"), n_docs).alias("idf")).collect()
        if not rows:
            raise ValueError(f"no term occurs in {self.min_docs} documents")
        counter = CountVectorizerModel.from_vocabulary(
            [row.term for row in rows], inputCol="terms", outputCol="counts"
        )
        return PipelineModel(
            [
                TermSplitter(self.text_col, "terms", self.n_max),
                counter,
                SublinearTfidf("counts", self.output_col, [row.idf for row in rows]),
            ]
        )


SMALL_TABLE_ROWS = 1_000_000


def spread_small(df: DataFrame, id_col: str, n_rows: int) -> DataFrame:
    """Put a small table on all cores before its texts are vectorised.

    It may come in one file. A large table has enough splits and is not shuffled.
    """
    if n_rows > SMALL_TABLE_ROWS:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, id_col)


WORKING_COLUMNS = ("terms", "counts")
