"""Keys on the circle of fifths, tempo, beat grids, the seeded generator. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of the twelve tonics
MAJOR = ["C", "D♭", "D", "E♭", "E", "F", "F♯", "G", "A♭", "A", "B♭", "B"]
MINOR = ["C", "C♯", "D", "E♭", "E", "F", "F♯", "G", "G♯", "A", "B♭", "B"]


def fifths(tonic: Column, minor: Column) -> Column:
    """0 for C major and A minor, clockwise."""
    return (F.when(minor, (tonic + 3) % 12).otherwise(tonic) * 7) % 12


def camelot(tonic: Column, minor: Column) -> Column:
    return (fifths(tonic, minor) + 7) % 12 + 1


def key_label(tonic: Column, minor: Column, notation: str = "camelot") -> Column:
    if notation == "camelot":
        return F.concat(camelot(tonic, minor).cast("string"), F.when(minor, "A").otherwise("B"))
    if notation == "open":
        return F.concat((fifths(tonic, minor) + 1).cast("string"), F.when(minor, "m").otherwise("d"))
    name = lambda xs: F.element_at(F.array(*map(F.lit, xs)), tonic.cast("int") + 1)
    return F.when(minor, F.concat(name(MINOR), F.lit(" minor"))).otherwise(F.concat(name(MAJOR), F.lit(" major")))


def key_at(pos: Column, minor: Column) -> Column:
    """The tonic at a place of the circle."""
    return F.when(minor, ((pos * 7) % 12 + 9) % 12).otherwise((pos * 7) % 12)


def neighbours(tonic: Column, minor: Column) -> Column:
    """Three keys that mix cleanly: one step either way, and the relative one."""
    p = fifths(tonic, minor)
    one = lambda t, m: F.struct(t.cast("int").alias("tonic"), m.alias("minor"))
    return F.array(one(key_at((p + 11) % 12, minor), minor), one(key_at((p + 1) % 12, minor), minor), one(key_at(p, ~minor), ~minor))


def key_fit(n1: Column, minor1: Column, n2: Column, minor2: Column) -> Column:
    """By Camelot numbers: 1 the same, 0.9 a step, 0.85 relative, 0.5 two up, 0 else; null if one is unknown."""
    d = F.pmod(n2 - n1, F.lit(12))
    step = F.least(d, 12 - d)
    known = n1.isNotNull() & n2.isNotNull() & minor1.isNotNull() & minor2.isNotNull()
    alike = F.when(step == 0, 1.0).when(step == 1, 0.9).when(d == 2, 0.5).otherwise(0.0)
    return F.when(known, F.when(minor1 == minor2, alike).otherwise(F.when(step == 0, 0.85).otherwise(0.0)))


def tempo_fit(bpm: Column, target: Column, tolerance: float, half_double: bool = False) -> Column:
    """1 on target, 0 at the tolerance, below it beyond; -1 for an unknown tempo, null without target."""
    off = lambda b: F.abs(b - target) / target
    least = F.least(off(bpm), off(bpm * 2), off(bpm / 2)) if half_double else off(bpm)
    return F.when(target.isNotNull(), F.when(bpm.isNull(), -1.0).otherwise(1 - least / tolerance))


def tag_fit(have: Column, want: list[str]) -> Column:
    if not want:
        return F.lit(0.0)
    n = F.size(F.array_intersect(have, F.array(*map(F.lit, want))))
    return F.when(F.size(have) > 0, F.least(F.lit(1.0), n / min(2, len(want)))).otherwise(0.0)


def octave_fold(b: Column, lo: float) -> Column:
    """Halved or doubled into [lo, 2 lo); null unless positive. Exact: powers of two only, corrected at the edges."""
    v = b * F.pow(F.lit(2.0), -F.floor(F.log2(b / lo)))
    v = F.when(v >= 2 * lo, v / 2).when(v < lo, v * 2).otherwise(v)
    return F.when(b > 0, v)


def flipped(v: Column, flip: Column) -> Column:
    return F.when(flip, F.when(v >= 120, v / 2).otherwise(v * 2)).otherwise(v)


def tempo_text(b: Column) -> Column:
    """"128", or "127.5" where it isn't whole within 0.05."""
    near = F.floor(b + 0.5)
    return F.when(F.abs(b - near) < 0.05, near.cast("long").cast("string")).otherwise(F.format_string("%.1f", F.floor(b * 10 + 0.5) / 10))


def grid_at(t: Column, bpm: Column) -> tuple[Column, Column]:
    """First beat at or after 0 and the bar phase of a grid whose bar starts at t."""
    p = 60 / bpm
    first = F.pmod(t, p)
    return first, F.pmod(F.floor((t - first) / p + 0.5), F.lit(4)).cast("int")


def beats_between(first: Column, bpm: Column, t0: Column, t1: Column) -> Column:
    """How many beats lie in [t0, t1)."""
    p = 60 / bpm
    return (F.ceil((t1 - first) / p) - F.ceil((t0 - first) / p)).cast("long")


def snapped(t: Column, first: Column, bpm: Column) -> Column:
    p = 60 / bpm
    return F.greatest(F.lit(0.0), first + F.floor((t - first) / p + 0.5) * p)


_M32 = 4294967296


def _mul32(a: Column, b: Column) -> Column:
    """Product modulo 2^32 of unsigned 32-bit numbers, the first split so that nothing overflows."""
    hi, lo = F.shiftrightunsigned(a, 16), a.bitwiseAND(65535)
    return F.pmod(F.pmod(hi * b, F.lit(_M32)) * 65536 + lo * b, F.lit(_M32))


def prng(seed: Column, n: Column) -> Column:
    """The n-th number (from 1) in [0, 1) of the 32-bit generator with the seed."""
    a = F.pmod(seed + n * F.lit(0x6D2B79F5), F.lit(_M32))
    t = _mul32(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1).cast("long")))
    t = t.bitwiseXOR(F.pmod(t + _mul32(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61).cast("long"))), F.lit(_M32)))
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / F.lit(float(_M32))
