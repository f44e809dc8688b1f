"""Boxes on a page, in top-left pixel space."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lamplight.settings import DEFAULTS

# PDF points per inch, and the smallest crop side worth reading.
POINTS_PER_INCH = 72
MIN_CROP_SIDE = 4


def box(x_min: Column, y_min: Column, x_max: Column, y_max: Column) -> Column:
    return F.struct(
        x_min.cast("double").alias("x_min"),
        y_min.cast("double").alias("y_min"),
        x_max.cast("double").alias("x_max"),
        y_max.cast("double").alias("y_max"),
    )


def box_from_array(values: Column) -> Column:
    """A box from four numbers; null for anything else."""
    return F.when(
        F.size(values) == 4,
        box(*[F.get(values, F.lit(i)) for i in range(4)]),
    )


def box_to_array(b: Column) -> Column:
    return F.when(b.isNotNull(), F.array(b["x_min"], b["y_min"], b["x_max"], b["y_max"]))


def box_to_pixels(
    left: Column, top: Column, right: Column, bottom: Column, bottom_origin: Column, page_height: Column
) -> Column:
    """PDF points to pixels, flipping bottom-left boxes and ordering the corners.

    A bottom-left box on a page of unknown height is scaled but not flipped; a box
    with a missing side is all zeros.
    """
    flip = bottom_origin & page_height.isNotNull()
    y0 = F.when(flip, page_height - top).otherwise(top)
    y1 = F.when(flip, page_height - bottom).otherwise(bottom)
    scale = F.lit(DEFAULTS.render_dpi / POINTS_PER_INCH)
    x0, x1, y0, y1 = left * scale, right * scale, y0 * scale, y1 * scale
    known = x0.isNotNull() & x1.isNotNull() & y0.isNotNull() & y1.isNotNull()
    zero = F.lit(0.0)
    return box(
        *[
            F.when(known, side).otherwise(zero)
            for side in (F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))
        ]
    )


def area_ratio(b: Column, page_width: Column, page_height: Column) -> Column:
    page = page_width * page_height
    width = F.greatest(b["x_max"] - b["x_min"], F.lit(0.0))
    height = F.greatest(b["y_max"] - b["y_min"], F.lit(0.0))
    return F.when(page > 0, width * height / page).otherwise(0.0)


def crop_box(b: Column, page_width: Column, page_height: Column) -> Column:
    """Whole-pixel crop inside the page; halves round to even."""

    def side(value: Column, edge: Column) -> Column:
        return F.greatest(F.least(F.bround(value).cast("long"), edge.cast("long")), F.lit(0).cast("long"))

    return F.struct(
        side(b["x_min"], page_width).alias("x_min"),
        side(b["y_min"], page_height).alias("y_min"),
        side(b["x_max"], page_width).alias("x_max"),
        side(b["y_max"], page_height).alias("y_max"),
    )


def crop_is_readable(crop: Column) -> Column:
    return (crop["x_max"] - crop["x_min"] >= MIN_CROP_SIDE) & (
        crop["y_max"] - crop["y_min"] >= MIN_CROP_SIDE
    )


def worth_reading(ratio: Column, crop: Column, pixel_stddev: Column) -> Column:
    """Cheap tests first: big enough, at least 4x4 pixels, not one flat colour."""
    return F.coalesce(
        (ratio >= DEFAULTS.ocr_min_region_area_ratio)
        & crop_is_readable(crop)
        & (pixel_stddev >= DEFAULTS.ocr_min_pixel_stddev),
        F.lit(False),
    )
