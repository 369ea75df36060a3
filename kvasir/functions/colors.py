"""Colours as hexadecimal text, RGB arrays and CMYK arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rgb_to_hex(rgb: Column) -> Column:
    return F.concat(F.lit("#"), F.array_join(F.transform(rgb, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), ""))


def hex_to_rgb(text: Column) -> Column:
    digits = F.regexp_replace(text, "#", "")
    return F.array(*[F.conv(F.substring(digits, k, 2), 16, 10).cast("int") for k in (1, 3, 5)])


def add_hex(a: Column, b: Column) -> Column:
    """By channel, at most 255."""
    return rgb_to_hex(F.zip_with(hex_to_rgb(a), hex_to_rgb(b), lambda x, y: F.least(x + y, F.lit(255))))


def average_hex(text: Column) -> Column:
    """Aggregate: the mean of each channel, rounded."""
    rgb = hex_to_rgb(text)
    return rgb_to_hex(F.array(*[F.round(F.avg(F.element_at(rgb, k))) for k in (1, 2, 3)]))


def cmyk_to_hex(cmyk: Column) -> Column:
    k = F.element_at(cmyk, 4)
    return rgb_to_hex(F.array(*[F.round(255 * (1 - F.element_at(cmyk, i)) * (1 - k)) for i in (1, 2, 3)]))


def plotly(rgb: Column, alpha: float | None = None) -> Column:
    inner = F.array_join(rgb.cast("array<string>"), ", ")
    return F.concat(F.lit("rgb("), inner, F.lit(")")) if alpha is None else F.concat(F.lit("rgba("), inner, F.lit(f", {alpha})"))
