"""Scalar quantization to one byte a component."""

from __future__ import annotations

from dataclasses import dataclass
from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.errors import DimensionMismatch, EmptyIndex, InvalidParameter

LEVELS = 255


@dataclass(frozen=True)
class ScalarQuantizer:
    """Codes are ``round-half-up((x - low) / scale)`` within 0 to 255."""

    low: tuple[float, ...]
    scale: tuple[float, ...]

    def __post_init__(self):
        if len(self.low) != len(self.scale):
            raise DimensionMismatch(len(self.low), len(self.scale))
        if not all(map(isfinite, self.low)) or not all(isfinite(s) and s > 0 for s in self.scale):
            raise InvalidParameter("bounds must be finite and scales positive")

    @classmethod
    def train(cls, vectors: DataFrame, vector_col: str = "vector") -> ScalarQuantizer:
        """Bounds of each component by one aggregation; a constant or unbounded one gets scale 1."""
        at = vectors.select(F.posexplode(F.col(vector_col).cast("array<double>")).alias("at", "x"))
        rows = at.groupBy("at").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("at").collect()
        if not rows:
            raise EmptyIndex("no vectors to train on")
        scales = [(r.high - r.low) / LEVELS for r in rows]
        return cls(tuple(r.low if isfinite(r.low) else 0.0 for r in rows), tuple(s if isfinite(s) and s > 0 else 1.0 for s in scales))

    @property
    def dim(self) -> int:
        return len(self.low)

    @property
    def code_len(self) -> int:
        return len(self.low)

    @property
    def param_bytes(self) -> int:
        return 2 * 4 * len(self.low)

    @property
    def max_abs_error(self) -> float:
        """Largest error of a decoded component that lay within the bounds."""
        return max(self.scale, default=0.0) / 2

    def _bounds(self) -> Column:
        return F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("scale")) for a, b in zip(self.low, self.scale, strict=True)])

    def encode(self, vector: Column) -> Column:
        """Codes as shorts; null if the length differs."""
        def one(x: Column, b: Column) -> Column:
            level = (x - b["low"]) / b["scale"]
            return F.floor(F.least(F.greatest(level, F.lit(0.0)), F.lit(float(LEVELS))) + 0.5).cast("short")

        return F.when(F.size(vector) == self.dim, F.zip_with(vector.cast("array<double>"), self._bounds(), one))

    def decode(self, codes: Column) -> Column:
        return F.when(F.size(codes) == self.dim, F.zip_with(codes, self._bounds(), lambda c, b: b["low"] + c * b["scale"]))
