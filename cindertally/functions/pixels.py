"""Pointwise pixel formulas on numeric columns in 0..255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strength of a corruption at severities 0 to 5.
LOW_LIGHT = [1.0, 0.7, 0.5, 0.35, 0.22, 0.13]
CONTRAST = [1.0, 0.75, 0.58, 0.42, 0.30, 0.20]
GREY_MIX = [0.0, 0.3, 0.5, 0.7, 0.85, 1.0]
#: Colours of a core's glow and of the light that it spills.
GLOW, SPILL = (255, 180, 90), (255, 140, 45)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def stored(x: Column) -> Column:
    """What an unsigned byte keeps of a value: clipped, then truncated; a millionth below a whole number counts as one."""
    return F.round(clip(x, 0, 255), 6).cast("int")


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * F.lit(0.299).cast("double") + g * F.lit(0.587).cast("double") + b * F.lit(0.114).cast("double")


def screen(under: Column, over: Column) -> Column:
    return 255.0 - (255.0 - under) * (255.0 - over) / 255.0


def alpha_over(under: Column, over: Column, alpha: Column) -> Column:
    return under * (1 - alpha) + over * alpha


def ramp(x: Column, start: Column | float, end: float, least: float) -> Column:
    """0 at start, 1 at end, clipped; the span is `least` at least."""
    start = start if isinstance(start, Column) else F.lit(float(start))
    return clip((x - start) / F.greatest(F.lit(end) - start, F.lit(least)), 0, 1)


def warm_alpha(r: Column, g: Column, b: Column, v0: float, core0: float, thr: float, w0: float) -> Column:
    """Opacity of bright warm pixels, or of white-hot ones; 0 below thr."""
    channels = (r, g, b)
    white = ramp(F.least(*channels), core0, 255.0, 1.0)
    warm = ramp((r - b) / 255.0, w0, 1.0, 1e-6)
    bright = ramp(F.greatest(*channels), v0, 255.0, 1.0)
    opacity = F.greatest(white, bright * warm)
    return F.when(opacity >= thr, opacity).otherwise(0.0)


def is_flame_coloured(r: Column, g: Column, b: Column) -> Column:
    return (r > 160) & (r > b + 55) & (r + g + b > 340)


def colour_corrected(x: Column, channel_mean: Column, overall_mean: Column, strength: float = 0.15) -> Column:
    """Draws a channel toward the background's cast."""
    return clip(x + (channel_mean - overall_mean) * F.lit(strength), 0, 255)


def core_bloom(out: Column, brightness: Column, alpha: Column, bloom: float = 0.9) -> Column:
    """Lifts white-hot cores by a share of the headroom."""
    share = ramp(brightness / 255.0, 0.6, 1.0, 1e-6) * alpha * F.lit(bloom)
    return alpha_over(out, F.lit(255.0), share)


def bloom_glow(out: Column, halo: Column, colour: float, glow: float = 0.35) -> Column:
    """Adds the light of blurred cores (halo in 0..1) in one channel of the glow's colour (GLOW)."""
    return out + halo * F.lit(colour / 255.0 * glow * 60.0)


def grey_blob(r: Column, g: Column, b: Column) -> Column:
    return stored((r + g + b) / 3.0 * 0.55)


def by_severity(severity: Column, table: list[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(x)) for x in table]), severity + 1)


def low_light(x: Column, severity: Column) -> Column:
    return F.when(severity == 0, x.cast("int")).otherwise(stored(x * by_severity(severity, LOW_LIGHT)))


def contrast(x: Column, mean: Column, severity: Column) -> Column:
    return F.when(severity == 0, x.cast("int")).otherwise(stored((x - mean) * by_severity(severity, CONTRAST) + mean))


def grey_mix(x: Column, grey: Column, severity: Column) -> Column:
    f = by_severity(severity, GREY_MIX)
    return F.when(severity == 0, x.cast("int")).otherwise(stored(x * (1 - f) + grey * f))


def visibility(blended: Column, under: Column, alpha: Column) -> Column:
    """What a pixel adds to a placement's visibility; averaged over the box."""
    return F.abs(blended - under) * alpha
