"""What all fitted operators share: the guard against use before a fit, and profiles that fit once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame


class NotFittedError(ValueError):
    """A transform was asked for before a fit."""


class Guarded:
    @staticmethod
    def check_fitted(state) -> None:
        if state is None:
            raise NotFittedError("fit before transform")


class Profiles:
    """Named preprocessors. The first use of a name fits it; later uses take the same fit."""

    def __init__(self, make: dict[str, Callable[[], Estimator]]):
        self._make, self._fitted = make, {}

    def names(self) -> list[str]:
        return sorted(self._make)

    def is_fitted(self, name: str) -> bool:
        return name in self._fitted

    def model(self, name: str) -> Model:
        if name not in self._fitted:
            raise NotFittedError(f"profile {name} has not been fitted")
        return self._fitted[name]

    def apply(self, name: str, df: DataFrame) -> DataFrame:
        if name not in self._make:
            raise KeyError(name)
        if name not in self._fitted:
            self._fitted[name] = self._make[name]().fit(df)
        return self._fitted[name].transform(df)
