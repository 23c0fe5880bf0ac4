"""Detectors over pictures as plug-ins: what each can do, which regions it wants, and how it looks at them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOUND = "page_id long, region_idx long, type string, confidence double, x int, y int, width int, height int, model string"


@dataclass(frozen=True)
class Model:
    """load makes the model once for each task; detect gets it and a frame of regions, and returns a frame of FOUND without model; wants tells which regions it is shown."""

    name: str
    capabilities: tuple[str, ...]
    detect: Callable[[object, pd.DataFrame], pd.DataFrame]
    load: Callable[[], object] = lambda: None
    wants: Callable[[DataFrame], Column] = lambda _: F.lit(True)
    dispose: Callable[[object], None] = lambda _: None


class Models:
    """Models by name; a later one of a name replaces the earlier."""

    def __init__(self) -> None:
        self.known: dict[str, Model] = {}

    def register(self, model: Model) -> "Models":
        if not model.name or not callable(model.detect):
            raise ValueError("a model needs a name and a detect function")
        self.known[model.name] = model
        return self

    def able(self, capability: str) -> list[str]:
        return [m.name for m in self.known.values() if capability in m.capabilities]

    def run(self, regions: DataFrame, capability: str | None = None) -> DataFrame:
        """What all models (of a capability) find in regions, in Arrow batches. A model that fails on a batch finds nothing in it, as one detector must not stop the others."""
        chosen = [m for m in self.known.values() if capability is None or capability in m.capabilities]
        if not chosen:
            return regions.sparkSession.createDataFrame([], FOUND)
        return reduce(DataFrame.unionByName, [self._one(regions, m) for m in chosen])

    @staticmethod
    def _one(regions: DataFrame, m: Model) -> DataFrame:
        columns = [c.split()[0] for c in FOUND.split(", ")]

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            loaded = m.load()
            try:
                for batch in batches:
                    try:
                        found = m.detect(loaded, batch)
                    except Exception:  # noqa: BLE001 - any plug-in error
                        continue
                    yield found.assign(model=m.name)[columns]
            finally:
                m.dispose(loaded)

        return regions.where(m.wants(regions)).mapInPandas(look, FOUND)
