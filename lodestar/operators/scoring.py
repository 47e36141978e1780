"""Scorers: anything that maps a case DataFrame to ``p1`` and ``prediction``.

``Scorecard`` is a fixed logistic model over raw (cleaned) features and
is pure Column arithmetic, so every model-dependent operator built on it
stays JVM-side and has an exact SQL twin. ``MLlibScorer`` wraps a fitted
``pyspark.ml`` pipeline model behind the same interface (M4-M6).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators import features as feat
from lodestar.spec import CaseSpec


@dataclass(frozen=True)
class Scorecard:
    """z = intercept + sum w*(x - center) + sum categorical weights; p1 = sigmoid(z)."""

    intercept: float
    numeric: tuple = ()  # (column, weight, center)
    categorical: tuple = ()  # (column, ((value, weight), ...))
    threshold: float = 0.0

    def terms(self) -> list[tuple[str, str | None, Column]]:
        """(feature name, source column, contribution) per linear term."""
        out = []
        for c, w, center in self.numeric:
            out.append((c, c, F.lit(float(w)) * (F.col(c) - F.lit(float(center)))))
        for c, values in self.categorical:
            for v, w in values:
                out.append((f"{c}_{v}", c, F.lit(float(w)) * (F.col(c) == F.lit(v)).cast("double")))
        return out

    def dummies(self) -> list[tuple[str, Column]]:
        """Encoded value of each term's feature (raw numeric or 0/1 dummy)."""
        out = []
        for c, _, _ in self.numeric:
            out.append((c, F.col(c).cast("double")))
        for c, values in self.categorical:
            for v, _ in values:
                out.append((f"{c}_{v}", (F.col(c) == F.lit(v)).cast("double")))
        return out

    def weights(self) -> list[tuple[str, float]]:
        return [(c, float(w)) for c, w, _ in self.numeric] + \
               [(f"{c}_{v}", float(w)) for c, values in self.categorical for v, w in values]

    def margin(self) -> Column:
        z = F.lit(float(self.intercept))
        for _, _, t in self.terms():
            z = z + t
        return z

    def score(self, df: DataFrame, prefix: str = "") -> DataFrame:
        """M4 + M5: adds ``{prefix}margin``, ``{prefix}p1``, ``{prefix}prediction``."""
        # the margin is a column first, so p1 and the class reference it
        # instead of re-evaluating the whole linear form
        z = F.col(f"{prefix}margin")
        return df.withColumn(f"{prefix}margin", self.margin()).withColumns({
            f"{prefix}p1": F.lit(1.0) / (F.lit(1.0) + F.exp(-z)),
            f"{prefix}prediction": (z > F.lit(float(self.threshold))).cast("int"),
        })


# Fixed scorecard of the order case table (used by the registered queries).
ORDER_SCORECARD = Scorecard(
    intercept=-5.2,
    numeric=(("line_count", 0.55, 0.0), ("sum_qty", 0.018, 0.0), ("avg_discount", -6.0, 0.0),
             ("total_price", 0.000002, 0.0), ("priority_num", 0.25, 1.0), ("acct_bal", 0.00002, 0.0)),
    categorical=(("segment", (("BUILDING", 0.5), ("MACHINERY", -0.4))),),
)


@dataclass
class MLlibScorer:
    """Raw-space adapter for a fitted MLlib classifier (M6).

    sanitise -> reconcile dependents -> frozen feature transform -> model.
    The encoded width must equal the model's input width.
    """

    model: object  # pyspark.ml Model with featuresCol/probabilityCol
    features: feat.FeatureModel
    spec: CaseSpec
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        n = getattr(self.model, "numFeatures", None)
        if n is not None and n != self.features.width:
            raise ValueError(f"encoded width {self.features.width} != model width {n}")

    def score(self, df: DataFrame, prefix: str = "") -> DataFrame:
        from pyspark.ml.functions import array_to_vector
        cleaned = feat.reconcile(feat.clean(df, self.spec), self.spec)
        enc = self.features.transform(cleaned, output="__features")
        enc = enc.withColumn("__features", array_to_vector("__features"))
        model = self.model.copy()
        model.setFeaturesCol("__features")
        for p in ("setPredictionCol", "setProbabilityCol", "setRawPredictionCol"):
            if not hasattr(model, p):
                raise AttributeError("classification needs a model with class probabilities")
        model.setPredictionCol("__pred").setProbabilityCol("__prob").setRawPredictionCol("__raw")
        out = model.transform(enc)
        # the input's own columns and the scores, not the encoder's
        return out.select(*[F.col(f"`{c}`") for c in df.columns], vector_to_array("__prob")[1].alias(f"{prefix}p1"),
                          F.col("__pred").cast("int").alias(f"{prefix}prediction"))


def score(scorer, df: DataFrame, prefix: str = "") -> DataFrame:
    return scorer.score(df, prefix=prefix)
