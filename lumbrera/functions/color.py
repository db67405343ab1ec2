"""Colour arithmetic on hex columns: contrast, colour-deficiency simulation, distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumbrera import config as cfg


def rgb_number(col: Column) -> Column:
    """'#CCCCCC' or 'CCCCCC' as one number; NULL for anything else."""
    return F.when(col.rlike("^#?[0-9A-Fa-f]{6}$"), F.conv(F.right(col, F.lit(6)), 16, 10).cast("int"))


def unpack(number: Column) -> Column:
    """Number of a colour to struct(r, g, b)."""
    return F.struct(
        F.shiftright(number, 16).alias("r"), F.shiftright(number, 8).bitwiseAND(255).alias("g"), number.bitwiseAND(255).alias("b"))


def parse_hex(col: Column) -> Column:
    """Hex colour to struct(r, g, b); NULL when it is not one."""
    number = rgb_number(col)
    return F.when(number.isNotNull(), unpack(number))


def number_hex(number: Column) -> Column:
    return F.format_string("#%06X", number)


def format_hex(rgb: Column) -> Column:
    return F.format_string("#%02X%02X%02X", rgb["r"], rgb["g"], rgb["b"])


def linear(channel: Column) -> Column:
    c = channel / F.lit(255.0)
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def _srgb(value: Column) -> Column:
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    return F.lit(255.0) * F.when(v <= 0.0031308, v * 12.92).otherwise(
        F.lit(1.055) * F.pow(v, F.lit(1.0 / 2.4)) - 0.055
    )


def luminance(rgb: Column) -> Column:
    return linear(rgb["r"]) * 0.2126 + linear(rgb["g"]) * 0.7152 + linear(rgb["b"]) * 0.0722


def contrast_ratio(a: Column, b: Column) -> Column:
    """Contrast of two rgb structs, 1 (equal) to 21 (black on white)."""
    la, lb = luminance(a), luminance(b)
    return (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05)


def simulate(rgb: Column, kind: str) -> Column:
    """The colour as seen with a deficiency, as struct of doubles."""
    r, g, b = linear(rgb["r"]), linear(rgb["g"]), linear(rgb["b"])
    rows = cfg.CVD_MATRICES[kind]
    return F.struct(*[
        _srgb(r * row[0] + g * row[1] + b * row[2]).alias(name) for row, name in zip(rows, ("r", "g", "b"))
    ])


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum((F.pow(a[c].cast("double") - b[c].cast("double"), F.lit(2.0)) for c in ("g", "b")),
                      F.pow(a["r"].cast("double") - b["r"].cast("double"), F.lit(2.0))))


def chroma(rgb: Column) -> Column:
    return F.greatest(rgb["r"], rgb["g"], rgb["b"]) - F.least(rgb["r"], rgb["g"], rgb["b"])


def is_large(size: Column, bold: Column) -> Column:
    """Large text for contrast purposes; unknown size is not large."""
    return F.coalesce((size >= cfg.LARGE_PT) | (bold & (size >= cfg.LARGE_BOLD_PT)), F.lit(False))


def font_label(font: Column) -> Column:
    """Font name without the subset prefix; NULL when nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(font, r"^[A-Z]{6}\+", "")), F.lit(""))


def is_decorative_font(font: Column) -> Column:
    """Decorative or handwriting face, judged by its normalised family name."""
    family = F.regexp_replace(F.regexp_replace(font, r"^[A-Z]{6}\+", ""), "[-,].*$", "")
    name = F.regexp_replace(F.lower(family), "[^a-z0-9]", "")
    decorative = name.rlike(f"^(?:{'|'.join(cfg.DECORATIVE_FONTS)})|{'|'.join(cfg.DECORATIVE_KEYWORDS)}")
    return F.coalesce(decorative & ~name.rlike(f"^(?:{'|'.join(cfg.NOT_DECORATIVE)})"), F.lit(False))
