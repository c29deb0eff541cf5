"""The interface that every recommender shares."""

from __future__ import annotations

import inspect
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tasteforge.functions.text import hyper_text, params_dirname
from tasteforge.operators.prep import ITEM, USER
from tasteforge.operators.ranking import first_items, list_positions, rank_candidates
from tasteforge.operators.sampling import CANDIDATE
from tasteforge.sources.shared import stage

ABOUT = "about"
COLD_START = ("keep", "drop", "nan")
# Arguments that change how a model is worked out, not its numbers.
LAYOUT = ("rows_per_slice", "cut_every", "local_rows")


class Recommender:
    """Subclass with ``fit`` and ``transform``; the rest follows.

    A fitted model is a set of tables (``tables``) and numbers (``scalars``).
    Neither is ever held by the driver as a whole.
    """

    def __new__(cls, *args: object, **kwargs: object) -> "Recommender":
        self = super().__new__(cls)
        given = inspect.signature(cls.__init__).bind(self, *args, **kwargs)
        given.apply_defaults()
        # What the model was built with, for ``save``.
        self.arguments = {name: value for name, value in list(given.arguments.items())[1:]}
        return self

    def __init__(self, **params: object) -> None:
        self.params = dict(params)
        self.name = type(self).__name__
        self.tables: dict[str, DataFrame] = {}
        self.scalars: dict[str, float] = {}

    def fit(self, train: DataFrame, user_info: DataFrame | None = None, item_info: DataFrame | None = None) -> "Recommender":
        """Learn from (user_id, business_id, stars)."""
        raise NotImplementedError

    @classmethod
    def fit_all(
        cls, models: Sequence["Recommender"], train: DataFrame, user_info: DataFrame | None = None, item_info: DataFrame | None = None
    ) -> list["Recommender"]:
        """Fit several models on one training set; a subclass may let them share their passes."""
        return [model.fit(train, user_info, item_info) for model in models]

    def transform(self, pairs: DataFrame) -> DataFrame:
        """Add ``prediction`` to (user_id, business_id, ...).

        The pairs are read once more to find hot keys: store them if they are
        costly to work out.
        """
        raise NotImplementedError

    def terms(self) -> tuple[DataFrame, DataFrame] | None:
        """Tables of users and items whose columns are all that ``transform`` needs, for candidates that bring them (``test_candidates``)."""
        return None

    def recommend(
        self, candidates: DataFrame, top_n: int = 50, strict: bool = False, dedupe: bool = True, digits: int | None = None
    ) -> DataFrame:
        """Rank (user_id, candidate_id): the first ``top_n`` with rank and position, ties by item.

        ``digits`` rounds predictions first, so that sums taken in another
        order cannot turn a tie into an order.
        """
        carried = [c for table in self.terms() or () for c in table.columns if c not in (USER, ITEM)]
        pairs = candidates.withColumnRenamed(CANDIDATE, ITEM)
        if carried and set(carried) <= set(pairs.columns):
            scored = self.transform(pairs.select(USER, ITEM, *carried))
        else:
            # Stored, because a transform reads its pairs once more for each key.
            scored = self.transform(stage(pairs.select(USER, ITEM), "pairs"))
        if digits is not None:
            scored = scored.withColumn("prediction", F.round("prediction", digits))
        if dedupe:
            # Copies of a pair have one score, so they go after the cut, not in a shuffle of all candidates.
            scored = first_items(scored, top_n).distinct()
        return list_positions(rank_candidates(scored, top_n, strict, dedupe=False), top_n)

    def identity(self) -> dict[str, object]:
        """The parameters, and every further argument that changes the result and is not at its default."""
        known = inspect.signature(type(self).__init__).parameters
        more = {
            name: getattr(self, name)
            for name, argument in known.items()
            if name not in self.params and name not in LAYOUT and hasattr(self, name) and getattr(self, name) != argument.default
        }
        return {**self.params, **more}

    @property
    def hyper(self) -> str:
        """Parameters as the log writes them."""
        return hyper_text(self.identity())

    @property
    def dirname(self) -> str:
        """Parameters as a directory name."""
        return params_dirname(self.identity())

    def check_fitted(self) -> None:
        if not self.tables and not self.scalars:
            raise ValueError(f"{self.name}: run fit() first")

    def save(self, path: str) -> None:
        """Write the fitted tables, the numbers and the model's arguments as Parquet."""
        self.check_fitted()
        for name, table in self.tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")
        spark = SparkSession.active()
        described = (type(self).__name__, json.dumps(self.arguments), list(self.tables))
        about = spark.createDataFrame([described], "model string, arguments string, tables array<string>")
        about.write.mode("overwrite").parquet(f"{path}/{ABOUT}")
        rows = [(name, float(value)) for name, value in self.scalars.items()]
        scalars = spark.createDataFrame(rows, "name string, value double")
        scalars.write.mode("overwrite").parquet(f"{path}/scalars")

    def load(self, spark: SparkSession, path: str, tables: Mapping[str, None] | list[str]) -> "Recommender":
        """Read tables written by ``save`` into a model built with the same parameters."""
        self.tables = {name: spark.read.parquet(f"{path}/{name}") for name in tables}
        # One row per number of the model: a handful.
        self.scalars = {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/scalars").collect()}
        return self

    @classmethod
    def restore(cls, spark: SparkSession, path: str) -> "Recommender":
        """A saved model with its arguments; called on the model's class or on a class above it."""
        about = spark.read.parquet(f"{path}/{ABOUT}").first()
        below, known = [cls], {}
        while below:
            kind = below.pop()
            known[kind.__name__] = kind
            below += kind.__subclasses__()
        if about["model"] not in known:
            raise ValueError(f"{path} holds a {about['model']}, which is no {cls.__name__} known here")
        # JSON knows no tuples.
        arguments = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(about["arguments"]).items()}
        return known[about["model"]](**arguments).load(spark, path, about["tables"])


def clamp(value: Column, scale: tuple[float, float]) -> Column:
    """Keep a prediction on the rating scale."""
    return F.least(F.greatest(value, F.lit(float(scale[0]))), F.lit(float(scale[1])))


def dot(left: str, right: str) -> Column:
    """Inner product of two array columns; NULL when either is NULL."""
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda total, p: total + p)


def when_cold(known: Column, value: Column, fallback: Column, cold_start: str) -> Column:
    """``value`` for known pairs; for others the fallback, or NaN."""
    return F.when(known, value).otherwise(F.lit(float("nan")) if cold_start == "nan" else fallback)


def check_cold_start(cold_start: str) -> str:
    if cold_start not in COLD_START:
        raise ValueError(f"cold_start {cold_start} is not one of {COLD_START}")
    return cold_start
