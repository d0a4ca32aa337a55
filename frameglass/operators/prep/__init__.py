"""Column operations with a fit and a transform."""

from .base import Needs, Operation, Stats, collect_stats
from .custom import CustomTransform, PandasTransform, SqlTransform
from .encoding import EncodeLabel, EncodeOneHot, EncodeOrdinal
from .impute import (
    DropColumns,
    DropNullRows,
    ImputeConstant,
    ImputeMean,
    ImputeMedian,
    ImputeMode,
)
from .outliers import OutlierIQR, OutlierZScore, PercentileClip
from .scaling import ScaleMinMax, ScaleRobust, ScaleStandard

__all__ = [
    "CustomTransform", "DropColumns", "DropNullRows", "EncodeLabel", "EncodeOneHot", "EncodeOrdinal",
    "ImputeConstant", "ImputeMean", "ImputeMedian", "ImputeMode", "Needs", "Operation", "OutlierIQR",
    "OutlierZScore", "PandasTransform", "PercentileClip", "ScaleMinMax", "ScaleRobust",
    "ScaleStandard", "SqlTransform", "Stats", "collect_stats",
]
