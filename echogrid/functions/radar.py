"""Radiometry, masks, ionosphere and axis arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from echogrid.functions.cplx import Pair, rotate, scale

C = 299792458.0
TAU = 2 * math.pi


def db(x: Column) -> Column:
    """Power to decibels; null for what is not positive."""
    return F.when(x > 0, 10 * F.log10(x))


def undb(x: Column) -> Column:
    return F.pow(F.lit(10.0), x / 10)


def flatten(z: Pair, offset: Column, spacing: float, wavelength: float) -> Pair:
    """An interferogram without the phase of a range offset (in samples)."""
    return rotate(z, -4 * math.pi * spacing / wavelength * offset)


def terrain_corrected(v: Column, rtc: Column, factor: float = 1.0, least: float = 0.0, low: float | None = None, high: float | None = None) -> Column:
    """v factor / rtc; null below the least factor and for zero input, then clipped."""
    out = F.when((rtc >= least) & (rtc > 0) & (v != 0), v * factor / rtc)
    if low is not None:
        out = F.when(out < low, low).otherwise(out)
    if high is not None:
        out = F.when(out > high, high).otherwise(out)
    return out


def area_ratio(a: Column, b: Column, least_db: float | None = None) -> Column:
    """a / b, null where b is 0 or the ratio is below the least one in decibels."""
    out = a / F.nullif(b, F.lit(0.0))
    return out if least_db is None else F.when(out >= 10 ** (least_db / 10), out)


def denoised_power(p: Column, noise: Column) -> Column:
    return F.greatest(p - noise, F.lit(0.0))


def denoised(z: Pair, noise: Column) -> Pair:
    """The amplitude is that of the power less noise (not below 0); the phase stays."""
    p = z[0] * z[0] + z[1] * z[1]
    return scale(z, F.when(p > 0, F.sqrt(F.greatest(p - noise, F.lit(0.0)) / p)).otherwise(0.0))


def mask_digits(m: Column, nodata: int = 255) -> dict[str, Column]:
    """secondary, reference and water validity of a digit-coded mask; null for nodata."""
    v = F.when(m != nodata, m)
    return {"secondary": v % 10 > 0, "reference": F.floor(v / 10) % 10 > 0, "water": F.floor(v / 100) % 10 > 0}


def water_binary(distance: Column) -> Column:
    """1 for water distances 1 to 200, 255 stays, else 0."""
    return F.when(distance == 255, 255).when(distance.between(1, 200), 1).otherwise(0)


def with_water(mask: Column, water: Column) -> Column:
    return mask + 100 * water


def with_bit24(mask: Column, flag: Column) -> Column:
    return mask.bitwiseAND(F.lit(0xFEFFFFFF)).bitwiseOR(F.shiftleft(flag, 24))


def iono_low_high(f0: float, fl: float, fh: float, low: Column, high: Column) -> tuple[Column, Column]:
    """Dispersive and non-dispersive phase of two sub-bands."""
    d = fh * fh - fl * fl
    return (low * fh - high * fl) * (fl * fh / f0) / d, (high * fh - low * fl) * f0 / d


def iono_main_diff(f0: float, fl: float, fh: float, main: Column, diff: Column) -> tuple[Column, Column]:
    """The same from the main phase and the difference of the two sub-bands."""
    k = fl * fh / f0
    part = diff * (-k / (fh - fl) / 2)
    return main * (k / (fl + fh)) + part, main / 2 + part


def iono_main_side(f0: float, f1: float, main: Column, side: Column) -> tuple[Column, Column]:
    """The same from a main and a side band."""
    k = f0 / f1 - f1 / f0
    return (side - main * (f1 / f0)) / k, (main * (f0 / f1) - side) / k


def iono_main_diff_side(f0: float, f1: float, main: Column, diff: Column) -> tuple[Column, Column]:
    """The same from the main phase and the difference main less side."""
    return iono_main_side(f0, f1, main, main - diff)


def phase_sigma(coherence: Column, looks: float) -> Column:
    return F.when(coherence > 0, F.sqrt(F.greatest(1 - coherence * coherence, F.lit(0.0))) / coherence / math.sqrt(2 * looks))


def sigma_low_high(f0: float, fl: float, fh: float, low: Column, high: Column) -> tuple[Column, Column]:
    """Sigmas of the dispersive and non-dispersive phase."""
    d = abs(fh * fh - fl * fl)
    k = fl * fh / f0 / d
    return k * F.sqrt(fh * fh * low * low + fl * fl * high * high), f0 / d * F.sqrt(fl * fl * low * low + fh * fh * high * high)


def sigma_main_diff(f0: float, fl: float, fh: float, main: Column, diff: Column) -> tuple[Column, Column]:
    a, b = fl * fh / f0 / (fh + fl), fl * fh / f0 / 2 / (fh - fl)
    spread = b * b * diff * diff
    return F.sqrt(a * a * main * main + spread), F.sqrt(main * main / 4 + spread)


def sigma_main_side(f0: float, f1: float, main: Column, side: Column) -> tuple[Column, Column]:
    d = abs(f1 * f1 - f0 * f0)
    return F.sqrt((f1 * f1 * main) ** 2 + (f0 * f1 * side) ** 2) / d, f0 / d * F.sqrt((f0 * main) ** 2 + (f1 * side) ** 2)


def wraps(x: Column) -> Column:
    """Whole turns, halves to even."""
    return F.rint(x / TAU)


def turns_low_high(f0: float, fl: float, fh: float, disp: Column, nondisp: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Common and differential whole turns by which two sub-bands miss the two phases."""
    diff = wraps(high - low - nondisp * ((fh - fl) / f0) + disp * (f0 * (fh - fl) / (fh * fl)))
    return F.rint((low + high - 2 * nondisp - 2 * disp) / (2 * TAU) - diff / 2), diff


def turns_main_diff(f0: float, fl: float, fh: float, disp: Column, nondisp: Column, main: Column, diff: Column) -> tuple[Column, Column]:
    return wraps(main - nondisp - disp), wraps(diff - nondisp * ((fh - fl) / f0) - disp * (f0 * (1 / fh - 1 / fl)))


def turns_main_diff_side(f0: float, f1: float, disp: Column, nondisp: Column, main: Column, diff: Column) -> tuple[Column, Column]:
    return wraps(main - nondisp - disp), wraps(diff + nondisp * ((f1 - f0) / f0) - disp * ((f1 - f0) / f1))


def turns_main_side(f0: float, f1: float, disp: Column, nondisp: Column, main: Column, side: Column) -> tuple[Column, Column]:
    diff = wraps(nondisp * (1 - f1 / f0) + disp * (1 - f0 / f1) + side - main)
    return F.rint((main + side - nondisp * (1 + f1 / f0) - disp * (1 + f0 / f1) - TAU * diff) / (2 * TAU)), diff


def wrapped(x: Column) -> Column:
    """An angle in [-pi, pi)."""
    return F.pmod(x + math.pi, F.lit(TAU)) - math.pi


def wrap_degrees(x: Column) -> Column:
    return F.pmod(x + 180.0, F.lit(360.0)) - 180.0


def line_of(t: Column, t0: float, prf: float) -> Column:
    return (t - t0) * prf


def sample_of(r: Column, r0: float, spacing: float) -> Column:
    return (r - r0) / spacing


def range_of(col: Column, r0: float, spacing: float) -> Column:
    return col * spacing + r0


def looked_start(r0: Column, spacing: Column, looks: Column) -> Column:
    """First range (or time) of a multilooked axis: the centre of its first block."""
    return r0 + spacing * (looks - 1) / 2


def snap_up(x: Column, step: float) -> Column:
    return F.ceil(x / step) * step


def snap_down(x: Column, step: float) -> Column:
    return F.floor(x / step) * step


def snap_near(x: Column, step: float) -> Column:
    return F.rint(x / step) * step


def truncated(x: Column, bits: int) -> Column:
    """x with so many bits of mantissa kept."""
    k = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x))) - bits)
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * F.floor(F.abs(x) / k) * k)


def tec_delay(tec: Column, frequency: float, incidence: Column) -> Column:
    """Range delay of total electron content in units of 1e16."""
    return 40.31 * tec * 1e16 / (frequency * frequency) / F.cos(incidence)


def incidence(radius_platform: Column, radius_ground: Column, slant: Column) -> Column:
    """Incidence angle by the law of cosines."""
    return F.acos((radius_platform**2 - radius_ground**2 - slant**2) / (2 * radius_ground * slant))


def look_angle(radius_platform: Column, radius_ground: Column, slant: Column) -> Column:
    return F.acos((radius_platform**2 + slant**2 - radius_ground**2) / (2 * radius_platform * slant))


def calibration(theta: Column, abscal: float = 1.0, convention: str = "beta0") -> dict[str, Column]:
    """Amplitude layers to beta0, sigma0 and gamma0 from images in the given convention."""
    s, k = F.sin(theta), math.sqrt(abscal)
    one = F.lit(1.0)
    by = {
        "beta0": (one, F.sqrt(1 / s), F.sqrt(1 / F.tan(theta))),
        "sigma0": (F.sqrt(s), one, F.sqrt(F.cos(theta))),
        "gamma0": (F.sqrt(F.tan(theta)), F.sqrt(1 / F.cos(theta)), one),
    }[convention]
    return dict(zip(("beta0", "sigma0", "gamma0"), (x * k for x in by), strict=True))


def trihedral_rcs(l1: Column, l2: Column, l3: Column, side: Column, wavelength: float, square: bool = False) -> Column:
    """Radar cross-section of a trihedral reflector from the components of its line of sight."""
    p = F.array_sort(F.array(F.abs(l1), F.abs(l2), F.abs(l3)))
    a, b, c = p[0], p[1], p[2]
    s = a + b + c
    triangular = F.when(a + b > c, s - 2 / s).otherwise(4 * a * b / s)
    squared = F.when(b >= c / 2, a * (4 - c / b)).otherwise(4 * a * b / c)
    return 4 * math.pi * F.pow(side, F.lit(4)) / wavelength**2 * F.pow(squared if square else triangular, F.lit(2))
