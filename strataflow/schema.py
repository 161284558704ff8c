"""Names of a series table's columns and the windows over it.

All builders share one (partition, order) pair, so that one exchange and one sort serve every per-series window.
Missing values are NULL, never NaN: ``normalised`` makes them so at ingest. Targets are never filled."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class SeriesSchema:
    well: str = "well_id"
    order: tuple[str, ...] = ("md", "row_seq")
    md: str = "md"
    x: str = "x"
    y: str = "y"
    z: str = "z"
    gr: str = "gr"
    target: str = "tvt"
    known: str = "tvt_input"

    @property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(self.well).orderBy(*self.order)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(self.well)

    def last(self, k: int) -> WindowSpec:
        """The row and the k - 1 before it."""
        return self.ordered.rowsBetween(-(k - 1), 0)

    @property
    def far(self) -> WindowSpec:
        """All rows of the series, in order."""
        return self.ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    @property
    def so_far(self) -> WindowSpec:
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def from_here(self) -> WindowSpec:
        return self.ordered.rowsBetween(0, Window.unboundedFollowing)


DEFAULT = SeriesSchema()


def normalised(df: DataFrame) -> DataFrame:
    """NaN as NULL in every float column."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({n: F.nanvl(F.col(n), F.lit(None).cast("double")) for n in names})


def numeric_columns(df: DataFrame, less: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in less]


def aligned(df: DataFrame, columns: list[str], default: float = 0.0) -> DataFrame:
    """The columns, in order; those that are absent hold the default."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(default).alias(c) for c in columns))


def feature_groups(df: DataFrame, s: SeriesSchema = DEFAULT) -> dict[str, list[str]]:
    """Columns of the sequence family by group, told by names."""
    # Groups with (prefixes, parts of names, whole names).
    groups = {
        "gr_rolling": (("gr_r",), (), ()), "gr_derivatives": (("gr_d",), ("gr_grad",), ()), "gr_lags": ((), ("gr_lag", "gr_lead"), ()), "gr_proxies": ((), ("proxy",), ()),
        "trajectory": ((), ("horiz", "x_d1", "y_d1", "z_d1", "z_d2", "z_curve", "z_rm", "z_dev", "md_step", "md_frac"), ()),
        "tvt_continuation": ((), ("pre_slope", "tvt_extrap"), ("last_known_tvt", "dist_from_last_known", "tvt_ffill", "in_nan_zone", "gr_vs_pre_nan", "z_vs_pre_nan")),
        "tvt_history": (("tvt_r", "tvt_lag"), (), ("tvt_d1", "tvt_d2")),
        "anchor_stats": ((), (), ("anchor_tvt_mean", "anchor_tvt_last", "anchor_tvt_range", "anchor_global_slope", "anchor_length", "nan_length", "tvt_known_frac", "nan_to_anchor_ratio", "gr_at_boundary", "gr_std_at_boundary")),
    }
    found = {g: [c for c in df.columns if c.startswith(p) or any(x in c for x in parts) or c in whole] for g, (p, parts, whole) in groups.items()}
    return {"baseline": [c for c in (s.gr, s.md, s.x, s.y, s.z) if c in df.columns], **found}


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)
