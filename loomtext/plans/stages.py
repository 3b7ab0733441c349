"""UD2 / VEC6: text steps as `pyspark.ml` stages, to be put together and saved as a Pipeline."""
from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import labels as LB


class _Stage(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    def setParams(self, **given):
        return self._set(**given)


class Lemmas(_Stage):
    """Lower-case word tokens of a text column as an array; with `clean` after the cleaning of questions (TXT1, TXT3).
    A null text gives an empty array."""

    clean = Param(Params._dummy(), "clean", "clean the text first", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCol: str = "question", outputCol: str = "lemmas", clean: bool = True):
        super().__init__()
        self._setDefault(inputCol="question", outputCol="lemmas", clean=True)
        self.setParams(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        source = F.coalesce(F.col(self.getInputCol()), F.lit(""))
        return dataset.withColumn(self.getOutputCol(), T.lemmas(T.question_text(source) if self.getOrDefault("clean") else source))


class MeanWordVector(_Stage):
    """Mean of the default word vectors of an array of words, as a vector column for other stages; no word
    gives the zero vector."""

    dims = Param(Params._dummy(), "dims", "width of the vectors, 16 at most", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str = "lemmas", outputCol: str = "features", dims: int = 16):
        super().__init__()
        self._setDefault(inputCol="lemmas", outputCol="features", dims=16)
        self.setParams(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), array_to_vector(LB.mean_word_vector(F.col(self.getInputCol()), self.getOrDefault("dims"))))
