"""Model features of candles: configured names expand to columns, in order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlemill.functions import geometry
from candlemill.functions.scaling import clip_atr, clip_macd, clip_zscore
from candlemill.operators import indicators as ind
from candlemill.operators import recurrence

WICKS = ["upper_wick_to_candle_ratio", "lower_wick_to_candle_ratio", "body_to_candle_ratio"]
# Names a feature goes by.
COLOR_NAMES = {"candle_color", "candle_color_code"}
BUNDLE_NAMES = {"indicator", "indicators", "technical_indicators", "technical indicators"}
SYNONYMS = {
    "stoch": "stochastic", "stochastic_oscillator": "stochastic", "stochastic oscillator": "stochastic",
    "stochastic rsi": "stochastic_rsi", "stoch_rsi": "stochastic_rsi", "stoch rsi": "stochastic_rsi", "stochrsi": "stochastic_rsi",
}


@dataclass
class Features:
    names: list[str]
    rsi_periods: list[int] = field(default_factory=lambda: [7, 14])
    stochastic_periods: list[int] = field(default_factory=lambda: [7, 14])
    stochastic_rsi_periods: list[int] = field(default_factory=lambda: [7, 14])
    period: int = 14
    macd: tuple[int, int] = (12, 26)
    zscore_window: int = 5

    def bundle(self) -> list[str]:
        return [
            *(f"rsi_{p}" for p in self.rsi_periods), *(f"stochastic_{p}" for p in self.stochastic_periods),
            *(f"stochastic_rsi_{p}" for p in self.stochastic_rsi_periods), "macd", "atr", "adx",
        ]

    def columns(self) -> list[str]:
        """Output columns in order, without repeats; an unknown name stands for itself."""
        out: list[str] = []
        for n in self.names:
            if n in COLOR_NAMES:
                out += [f"candle_color_{c}" for c in geometry.COLORS]
            elif n == "candle_type":
                out += [f"candle_type_{t}" for t in geometry.TYPES]
            elif n == "wick_ratios" or n in WICKS:
                out += WICKS
            elif n in BUNDLE_NAMES:
                out += self.bundle()
            else:
                out.append(SYNONYMS.get(n, n))
        return list(dict.fromkeys(out))

    def oscillator(self, column: str) -> tuple[str | None, int]:
        """Kind and period of an oscillator's column; no kind for other columns."""
        base, _, tail = column.rpartition("_")
        kind, period = (base, int(tail)) if tail.isdigit() else (column, self.period)
        return (kind if kind in ("rsi", "stochastic", "stochastic_rsi") else None), period

    def positions(self) -> dict[str, int]:
        return {c: i for i, c in enumerate(self.columns())}


def _windowed(name: str, f: Features) -> ind.Add | None:
    kind, p = f.oscillator(name)
    if kind is None:
        return None
    return ind.stochastic_rsi(p, p, normalize=True) if kind == "stochastic_rsi" else getattr(ind, kind)(p, normalize=True)


def encode_features(candles: DataFrame, f: Features, fill: bool = True) -> DataFrame:
    """Candle keys and feature columns; indicator nulls become 0 unless ``fill`` is off.

    Geometry is a projection, bounded indicators are windows over the series, MACD and ADX
    come last in one streamed pass: one exchange in all.
    """
    wanted = f.columns()
    zero = (lambda c: F.coalesce(c, F.lit(0.0))) if fill else (lambda c: c)
    out = geometry.with_geometry(candles)
    hot = geometry.one_hot()
    out = out.withColumns({c: hot[c] for c in wanted if c in hot})
    ready: dict[str, Column] = {}
    for c in wanted:
        if (add := _windowed(c, f)) is not None:
            out = add(out, f"_f_{c}")
            ready[c] = zero(F.col(f"_f_{c}"))
    if "log_volume_zscore" in wanted:
        out = ind.log_volume_zscore(f.zscore_window)(out, "_f_z")
        ready["log_volume_zscore"] = clip_zscore(F.col("_f_z")) if fill else F.when(F.col("_f_z").isNotNull(), clip_zscore(F.col("_f_z")))
    if "atr" in wanted:
        out = ind.atr(f.period)(out, "_f_atr")
        ready["atr"] = clip_atr(F.col("_f_atr"), F.col("close")) if fill else F.when(F.col("_f_atr").isNotNull(), clip_atr(F.col("_f_atr"), F.col("close")))
    scans = {}
    if "macd" in wanted:
        scans["_f_macd"] = recurrence.macd(*f.macd)
        ready["macd"] = clip_macd(F.col("_f_macd"), F.col("close")) if fill else F.when(F.col("_f_macd").isNotNull(), clip_macd(F.col("_f_macd"), F.col("close")))
    if "adx" in wanted:
        scans["_f_adx"] = recurrence.adx(f.period, normalize=True)
        ready["adx"] = zero(F.col("_f_adx"))
    if scans:
        out = recurrence.with_recurrences(out, scans)
    known = set(out.columns)
    keys = [c for c in candles.columns if c not in wanted]
    return out.select(*keys, *[ready[c].alias(c) if c in ready else F.col(c) if c in known else F.lit(None).cast("double").alias(c) for c in wanted])


def feature_vector(features: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    """The feature columns as one array, in order."""
    return features.withColumn(name, F.array(*[F.col(c).cast("double") for c in columns]))
