"""Print heights: pixel scale, millimetres, and the least height a declaration needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.functions.rounding import round_even
from tallymark.rules.packs import AREA_BANDS, DEFAULT_HEIGHT_MM, QUANTITY_BANDS, Band

DEFAULT_SCALE = 300.0 / 25.4


def positive(value: Column) -> Column:
    return F.when(value > 0, value.cast("double"))


def pixel_scale(
    ar_px_per_mm: Column,
    ar_mm_per_px: Column,
    circle_px: Column,
    circle_mm: Column,
    image_width_px: Column,
    package_width_mm: Column,
) -> Column:
    """Struct of px_per_mm, method and tier; the most precise calibration available wins.

    A measured reference circle comes in as data (its pixel and real diameter).
    """

    def choice(value: Column, method: str, tier: str) -> Column:
        return F.when(
            value.isNotNull(),
            F.struct(round_even(value, 4).alias("px_per_mm"), F.lit(method).alias("method"), F.lit(tier).alias("tier")),
        )

    ar = F.coalesce(positive(ar_px_per_mm), 1.0 / positive(ar_mm_per_px))
    circle = positive(circle_px) / positive(circle_mm)
    width = image_width_px.cast("double") / positive(package_width_mm)
    return F.coalesce(
        choice(ar, "ar_verified", "ar_verified"),
        choice(circle, "hough_circle_reference", "reference_object"),
        choice(width, "manual_package_width", "package_dimension"),
        choice(F.lit(DEFAULT_SCALE), "uncalibrated_default_dpi", "dpi_estimated"),
    )


def height_mm(height_px: Column, px_per_mm: Column) -> Column:
    return F.when(height_px <= 0, F.lit(0.0)).otherwise(round_even(height_px / positive(px_per_mm), 2))


def band_height(value: Column, bands: list[Band]) -> Column:
    """Height of the first band holding the value, both ends included; an open band takes the rest."""
    expr = F.lit(None).cast("double")
    for band in reversed(bands):
        inside = F.lit(True) if band.high is None else value.between(band.low, band.high)
        expr = F.when(inside, F.lit(float(band.min_height_mm))).otherwise(expr)
    return F.when(value.isNotNull(), expr)


def required_height(
    field: Column,
    quantity: Column,
    package_width_mm: Column,
    quantity_bands: list[Band] = QUANTITY_BANDS,
    area_bands: list[Band] = AREA_BANDS,
) -> Column:
    """Least height: by net quantity for that field, else by panel area, else the default."""
    by_quantity = (F.lower(field) == "net_quantity") & (quantity >= 0)
    area = positive(package_width_mm) * (positive(package_width_mm) * 1.5) / 100.0
    default = F.lit(DEFAULT_HEIGHT_MM)
    return F.when(by_quantity, F.coalesce(band_height(quantity, quantity_bands), default)).otherwise(
        F.coalesce(band_height(area, area_bands), default)
    )
