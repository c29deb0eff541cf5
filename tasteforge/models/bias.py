"""Bias baseline: mean plus a damped user term and a damped item term.

Koren, "Factor in the Neighbors" (2010): terms are found in turn,

    b_i = sum(r - mean - b_u) / (reg_i + n_i)
    b_u = sum(r - mean - b_i) / (reg_u + n_u)

The steps are those of ``bias_blocks``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tasteforge.models import bias_blocks
from tasteforge.models.base import Recommender, check_cold_start, clamp
from tasteforge.operators.prep import ITEM, USER
from tasteforge.operators.skew import ROWS_PER_SLICE, join_chain
from tasteforge.sources.shared import stage


def rating_cells(train: DataFrame) -> DataFrame:
    """One row per (user, item) with sum and count: copies go before any loop."""
    rated = train.filter(F.col(USER).isNotNull() & F.col(ITEM).isNotNull() & F.col("stars").isNotNull())
    return rated.groupBy(USER, ITEM).agg(F.sum("stars").alias("_sum"), F.count(F.lit(1)).alias("_n"))


class BiasModel(Recommender):
    """Options: reg_i, reg_u, n_epochs; ratings are clamped to ``scale``."""

    def __init__(
        self,
        reg_i: float = 10,
        reg_u: float = 15,
        n_epochs: int = 10,
        scale: tuple[float, float] = (1.0, 5.0),
        cold_start: str = "keep",
        cut_every: int = 3,
        rows_per_slice: int = ROWS_PER_SLICE,
    ) -> None:
        super().__init__(reg_i=reg_i, reg_u=reg_u, n_epochs=n_epochs)
        self.scale = scale
        self.cold_start = check_cold_start(cold_start)
        self.cut_every = cut_every
        self.rows_per_slice = rows_per_slice

    def fit(self, train: DataFrame, user_info: DataFrame | None = None, item_info: DataFrame | None = None) -> "BiasModel":
        return self.fit_cells(stage(rating_cells(train), "bias-cells"))

    def fit_cells(self, cells: DataFrame) -> "BiasModel":
        """Fit from a stored table of (user_id, business_id, _sum, _n)."""
        return self._fit_alike([self], cells)[0]

    @classmethod
    def fit_all(
        cls, models: Sequence["BiasModel"], train: DataFrame, user_info: DataFrame | None = None, item_info: DataFrame | None = None
    ) -> list["BiasModel"]:
        """Models of as many epochs share the passes over the ratings."""
        if cls.fit is not BiasModel.fit:
            return super().fit_all(models, train, user_info, item_info)
        cells = stage(rating_cells(train), "bias-cells")
        for epochs in dict.fromkeys(model.params["n_epochs"] for model in models):
            cls._fit_alike([model for model in models if model.params["n_epochs"] == epochs], cells)
        return list(models)

    @staticmethod
    def _fit_alike(models: Sequence["BiasModel"], cells: DataFrame) -> list["BiasModel"]:
        mean = cells.agg(F.sum("_sum") / F.sum("_n")).first()[0]
        regs = [(model.params["reg_i"], model.params["reg_u"]) for model in models]
        first = models[0]
        found = bias_blocks.fit(cells, mean or 0.0, regs, first.params["n_epochs"], first.cut_every, first.rows_per_slice)
        for model, (items, users) in zip(models, found):
            model.scalars = {"mean": mean}
            model.tables = {"items": items, "users": users}
        return list(models)

    def terms(self) -> tuple[DataFrame, DataFrame]:
        self.check_fitted()
        return self.tables["users"], self.tables["items"]

    def estimate(self, pairs: DataFrame, more: Sequence[tuple[DataFrame, Sequence[str], str]] = ()) -> DataFrame:
        """Pairs with both terms (NULL when unknown) and the unclamped estimate.

        ``more`` tables are joined in the same chain.  Pairs that bring both
        terms (``terms``) are joined with these tables only.
        """
        self.check_fitted()
        brought = {"b_u", "b_i"} <= set(pairs.columns)
        steps = [*([] if brought else [(self.tables["users"], [USER], "left"), (self.tables["items"], [ITEM], "left")]), *more]
        with_both = join_chain(pairs, steps, self.rows_per_slice, pin=True)
        value = F.lit(self.scalars["mean"]) + F.coalesce("b_u", F.lit(0.0)) + F.coalesce("b_i", F.lit(0.0))
        return with_both.withColumn("_estimate", value)

    def transform(self, pairs: DataFrame) -> DataFrame:
        scored = self.estimate(pairs)
        known = F.col("b_u").isNotNull() & F.col("b_i").isNotNull()
        value = clamp(F.col("_estimate"), self.scale)
        if self.cold_start == "nan":
            value = F.when(known, value).otherwise(F.lit(float("nan")))
        scored = scored.filter(known) if self.cold_start == "drop" else scored
        return scored.select(*pairs.columns, value.alias("prediction"))
