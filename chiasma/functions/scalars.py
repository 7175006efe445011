"""Scalar expressions over genotypes, positions and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import HmmParams


def n_a(genotypes: Column) -> Column:
    return F.regexp_count(genotypes, F.lit("A"))


def n_b(genotypes: Column) -> Column:
    return F.regexp_count(genotypes, F.lit("B"))


def allele_balance(a: Column, b: Column) -> Column:
    """Share of A among informative genotypes; null without any."""
    return F.try_divide(a.cast("double"), (a + b).cast("double"))


def whole(x: Column) -> Column:
    """Number in text (or a float) as bigint, towards zero; null if it is none."""
    return x.try_cast("double").try_cast("bigint")


def midpoint(a: Column, b: Column) -> Column:
    """Floor of the mean; the shift floors negative sums too."""
    return F.shiftright(a + b, 1)


def state_label(state: Column) -> Column:
    return F.when(state == 0, "A").otherwise("B")


def sample_id(map_: Column, index0: Column) -> Column:
    return F.format_string("%s_ind%03d", map_, index0 + 1)


def switch_probability(distance: Column, p: HmmParams = HmmParams()) -> Column:
    d = F.greatest(distance, F.lit(1)).cast("double")
    return F.least(F.greatest(F.lit(p.per_bp) * d, F.lit(p.min_switch)), F.lit(p.max_switch))


def emission(state: int, observed: Column, p: HmmParams = HmmParams()) -> Column:
    """Log probability of an observed genotype in state 0 (A) or 1 (B)."""
    own, other = ("A", "B") if state == 0 else ("B", "A")
    return F.ln(F.when(observed == own, p.match).when(observed == other, p.mismatch).otherwise(p.missing))


def chrom_name(name: Column) -> Column:
    """Trimmed, with any casing of a leading ``chr`` as ``chr``; digits alone stay; null stays."""
    t = F.trim(name)
    return F.when(F.lower(t).startswith("chr"), F.concat(F.lit("chr"), F.substring(t, 4, 1 << 30))).otherwise(t)


def chrom_name_strict(name: Column) -> Column:
    """``Chr`` becomes ``chr``, digits alone get ``chr`` in front, all else stays."""
    return F.when(name.startswith("Chr"), F.concat(F.lit("chr"), F.substring(name, 4, 1 << 30))).when(name.rlike("^[0-9]+$"), F.concat(F.lit("chr"), name)).otherwise(name)


def kb_label(x: Column) -> Column:
    """Kilobases: whole numbers plainly, others with six significant digits."""
    science = F.format_string("%.5e", x)
    power = F.regexp_extract(science, "e([+-][0-9]+)$", 1).cast("int")
    trimmed = lambda s: F.regexp_replace(s, r"\.?0+$", "")
    short = F.concat(trimmed(F.regexp_extract(science, "^([^e]+)e", 1)), F.regexp_extract(science, "(e.*)$", 1))
    for k in range(-4, 6):
        plain = F.format_string(f"%.{5 - k}f", x)
        short = F.when(power == k, trimmed(plain) if k < 5 else plain).otherwise(short)
    return F.concat(F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(short), F.lit(" kb"))
