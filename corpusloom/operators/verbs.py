"""The same verbs for every model: ``fit(x, model)``, ``fit_transform(x, model)``, ``transform(x, model)``."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fit(x: DataFrame, model: object, *more: object, **parameters: object) -> object:
    """Learn from ``x`` and return the model; ``more`` is what its ``fit`` takes besides (labels, ids, counts)."""
    found = model.fit(x, *more, **parameters)
    return model if found is None else found


def transform(x: DataFrame, model: object, *more: object, **parameters: object) -> DataFrame:
    """``x`` as the fitted model sees it."""
    return model.transform(x, *more, **parameters)


def fit_transform(x: DataFrame, model: object, *more: object, **parameters: object) -> DataFrame:
    """Both in turn, by the model's own ``fit_transform`` if it has one."""
    if hasattr(model, "fit_transform"):
        return model.fit_transform(x, *more, **parameters)
    return transform(x, fit(x, model, *more, **parameters))
