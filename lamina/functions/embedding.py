"""Embedders by name. The stub is a pure column expression; real models register an Arrow function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.functions.vectors import EPSILON, l2_normalised

GOLDEN = 0.61803


def stub_embedding(text: Column, dim: int = 32) -> Column:
    """Deterministic unit vector from the first UTF-8 byte and the byte length."""
    first = F.coalesce(F.conv(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 1)), 16, 10).cast("double"), F.lit(0.0))
    size = F.octet_length(text).cast("double")
    slots = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.when(i % 2 == 0, F.sin(first * 0.07 + i * GOLDEN)).otherwise(F.cos(size * 0.13 + i * GOLDEN)),
    )
    return l2_normalised(slots)


def mean_pooled(tokens: Column, mask: Column) -> Column:
    """Unit vector along the mean of the token vectors whose mask isn't 0; zeros where there are none."""
    kept = F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda t: t["m"] != 0)
    zeros = F.transform(F.element_at(tokens, 1), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zeros, lambda acc, t: F.zip_with(acc, t["v"], lambda a, x: a + x.cast("double")))
    count = F.greatest(F.size(kept), F.lit(1))
    return l2_normalised(F.transform(total, lambda x: x / count))


def cls_pooled(tokens: Column) -> Column:
    """Unit vector along the first token's."""
    return l2_normalised(F.element_at(tokens, 1))


_REGISTRY: dict[tuple[str, int], Callable[[Column], Column]] = {}


def register(name: str, dim: int, embed: Callable[[Column], Column]) -> None:
    _REGISTRY[name, dim] = embed


def register_model(name: str, dim: int, load: Callable[[], Callable[[list[str]], list]], pooling: str | None = None, batch: int = 32) -> None:
    """A model loaded once per task; texts go through it `batch` at a time.

    Without pooling it gives a vector for each text; with "mean" or "cls" it gives, for each
    text, the vectors of its tokens, which become one unit vector as in `mean_pooled` and `cls_pooled`.
    """
    if pooling not in (None, "mean", "cls"):
        raise ValueError(f"unknown pooling {pooling!r}")

    def one(tokens) -> list[float]:
        x = np.asarray(tokens, float)
        v = x[0] if pooling == "cls" else x.mean(axis=0)
        return (v / max(float(np.sqrt(v @ v)), EPSILON)).tolist()

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            every = texts.fillna("").to_list()
            made = [v for at in range(0, len(every), batch) for v in model(every[at : at + batch])]
            yield pd.Series(made if pooling is None else [one(v) for v in made])

    register(name, dim, embed)


def embedder(name: str, dim: int) -> Callable[[Column], Column]:
    if name == "stub":
        return lambda text: stub_embedding(text, dim)
    if (name, dim) not in _REGISTRY:
        raise KeyError(f"no embedder {name} of dimension {dim}")
    return _REGISTRY[name, dim]
