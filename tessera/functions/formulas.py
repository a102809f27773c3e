"""Property formulae and penalties as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_positive(*c: Column) -> Column:
    out = F.lit(True)
    for x in c:
        out = out & (x > 0)
    return F.coalesce(out, F.lit(False))


def mass_heat_capacity(molar: Column, weight: Column) -> Column:
    """J/(kg K) from J/(mol K) and g/mol."""
    return F.try_divide(molar * 1000.0, weight)


def diffusivity(conductivity: Column, density: Column, cp: Column) -> Column:
    """m2/s from W/(m K), g/cm3 and J/(kg K)."""
    return F.try_divide(conductivity, density * 1000.0 * cp)


def merit(beta: Column, cp: Column, density: Column, nu: Column, k: Column) -> Column:
    """k ((beta cp rho) / (nu k)) ^ 0.2813 in SI units; null unless all are positive."""
    return F.when(all_positive(beta, cp, density, nu, k), k * F.pow(beta * cp * density / (nu * k), F.lit(0.2813)))


def beta_from_two(d_low: Column, d_high: Column, dt: float) -> Column:
    """Thermal expansion from densities at two temperatures."""
    return F.try_divide(d_low - d_high, d_low * dt)


def cosine_penalty(price: Column, soft: float, hard: float) -> Column:
    """1 up to soft, 0 from hard on, half a cosine between; a missing price isn't punished, nor is any if soft >= hard."""
    if soft >= hard:
        return F.lit(1.0)
    t = (price - soft) / (hard - soft)
    return F.when(price.isNull() | F.isnan(price), 1.0).when(price <= soft, 1.0).when(price >= hard, 0.0).otherwise((1 + F.cos(F.lit(3.141592653589793) * t)) / 2)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(500.0)), F.lit(-500.0))))


def soft_gate(terms: list[tuple[Column, str, float, float]], biodegradable: Column | None = None) -> Column:
    """The product of sigmoids of (limit - x) / width for 'max' and (x - limit) / width for 'min' over the limits that x breaks.

    A missing x breaks none; what isn't biodegradable, where that is asked for, keeps a tenth.
    """
    out = F.lit(1.0)
    for c, sense, limit, width in terms:
        gap = (limit - c) if sense == "max" else (c - limit)
        out = out * F.when(gap < 0, sigmoid(gap / width)).otherwise(1.0)
    return out if biodegradable is None else out * F.when(F.coalesce(biodegradable, F.lit(False)), 1.0).otherwise(0.1)


def fitness(value: Column, maximise: bool, valid: Column) -> Column:
    """The signed target times the 0/1 validity; a missing target stays missing."""
    return (value if maximise else -value) * valid


def viscosity_index(nu40: Column, nu100: Column) -> Column:
    """log10 of the log-log slope between two viscosities; null where a logarithm is not defined."""
    inner = lambda nu: F.when(nu + 0.7 > 1, F.log10(F.log10(nu + 0.7)))
    slope = inner(nu40) - inner(nu100)
    return F.when(slope > 0, F.log10(slope))


def density_at(d: Column, beta: Column, dt: float) -> Column:
    return d / (1 + beta * dt)


def celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def size_weight(n: Column, low: float, high: float, grow: bool) -> Column:
    """1 falling to 0.1 (or rising) over the allowed sizes."""
    t = F.greatest(F.least((n - low) / (high - low), F.lit(1.0)), F.lit(0.0))
    return F.greatest(t if grow else 1 - t, F.lit(0.1))


def mahalanobis2(values: list[Column], mean: list[float], inverse: list[list[float]]) -> Column:
    """The squared distance, as one expression over a fixed few columns."""
    d = [v - m for v, m in zip(values, mean)]
    out = F.lit(0.0)
    for i, row in enumerate(inverse):
        for j, w in enumerate(row):
            out = out + d[i] * d[j] * w
    return out


def quadratic_fit(n: Column, sx: list[Column], sxy: list[Column]) -> tuple[Column, Column, Column]:
    """(a, b, c) of y = a + b x + c x^2 from the sums of x^k (k = 1..4) and of x^k y (k = 0..2), by Cramer's rule."""
    s0, (s1, s2, s3, s4), (t0, t1, t2) = n.cast("double"), sx, sxy
    det = lambda a, b, c, d, e, f, g, h, i: a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    base = det(s0, s1, s2, s1, s2, s3, s2, s3, s4)
    return (
        F.try_divide(det(t0, s1, s2, t1, s2, s3, t2, s3, s4), base),
        F.try_divide(det(s0, t0, s2, s1, t1, s3, s2, t2, s4), base),
        F.try_divide(det(s0, s1, t0, s1, s2, t1, s2, s3, t2), base),
    )


def merit_average(at_40: Column, at_100: Column) -> Column:
    """The mean of the merits at both temperatures, or the one at 40 C."""
    return F.when(at_40.isNotNull() & at_100.isNotNull(), (at_40 + at_100) / 2).otherwise(at_40)


def merit_100(k: Column, molar_cp: Column, weight: Column, nu: Column, density: Column, beta_100: Column | None, beta_40: Column) -> Column:
    """The merit at 100 C, with the expansion at 40 C where none at 100 C is known (units as stored: cSt, g/cm3, J/(mol K))."""
    beta = beta_40 if beta_100 is None else beta_100
    return merit(beta, mass_heat_capacity(molar_cp, weight), density * 1000.0, nu * 1e-6, k)
