"""The fitted parts of the flow as stages of ``pyspark.ml`` pipelines, which can be saved and loaded.

A model is its parameters and one small table of what was fitted on the Normal rows.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowguard import constants as K
from windowguard.functions import scalars as S
from windowguard.operators import logs, normalize
from windowguard.session import stage

FITTED = "fitted"


class _TableWriter(MLWriter):
    def __init__(self, model: TableModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.fitted.write.parquet(f"{path}/{FITTED}")


class _TableReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> TableModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind(self.sparkSession.read.parquet(f"{path}/{FITTED}"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class TableModel(Model, MLWritable, MLReadable):
    """A model whose state is a table."""

    def __init__(self, fitted: DataFrame):
        super().__init__()
        self.fitted = fitted

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class _Scaling(Params):
    rules = Param(Params._dummy(), "rules", "feature:scope of every scaled column", TypeConverters.toListString)
    rates = Param(Params._dummy(), "rates", "columns limited to [0, 1]", TypeConverters.toListString)

    def by_feature(self) -> dict[str, str]:
        return dict(r.rsplit(":", 1) for r in self.getOrDefault(self.rules))


class NormalScalerModel(_Scaling, TableModel):
    """Scales by the ranges of the Normal rows and limits the rates."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return normalize.clip_rates(normalize.apply_minmax(dataset, self.fitted, self.by_feature()), self.getOrDefault(self.rates))


class NormalScaler(_Scaling, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Ranges of the Normal rows; ``rules`` as in ``normalize.fit_minmax``, each as ``feature:scope``."""

    @keyword_only
    def __init__(self, *, rules: list[str] | None = None, rates: list[str] | None = None):
        super().__init__()
        self._setDefault(rules=[], rates=list(K.RATE_COLUMNS))
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> NormalScalerModel:
        normal = dataset.where(S.is_normal(F.col("anomaly_type")))
        fitted = stage(normalize.fit_minmax(normal, self.by_feature()), "scaler")
        return self._copyValues(NormalScalerModel(fitted))


class _Templating(Params):
    windowMs = Param(Params._dummy(), "windowMs", "length of a window in ms", TypeConverters.toInt)
    similarity = Param(Params._dummy(), "similarity", "share of equal tokens that links two lines", TypeConverters.toFloat)


class LogTemplatesModel(_Templating, TableModel):
    """Log features per case, service and window, by the templates of the Normal lines."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        window = self.getOrDefault(self.windowMs)
        lines = stage(logs.condense(dataset, window), "log-lines")
        return logs.log_features(lines, self.fitted, window)


class LogTemplates(_Templating, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Templates of the parsed lines of cases whose name says Normal."""

    @keyword_only
    def __init__(self, *, windowMs: int | None = None, similarity: float | None = None):
        super().__init__()
        self._setDefault(windowMs=K.WINDOW_MS, similarity=K.TEMPLATE_SIMILARITY)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> LogTemplatesModel:
        normal = dataset.where(S.is_normal(F.col("case_id")))
        fitted = stage(logs.fit_templates(normal, self.getOrDefault(self.similarity)), "templates")
        return self._copyValues(LogTemplatesModel(fitted))
