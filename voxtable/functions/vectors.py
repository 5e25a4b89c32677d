"""Array functions for embeddings and posteriors; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def bind(value: Column, body) -> Column:
    """body(v), v being worked out once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalise(v: Column, least: float = 1e-8) -> Column:
    """v / max(|v|, least); the zero vector stays zero."""
    return bind(F.greatest(norm(v), F.lit(least)), lambda n: F.transform(v, lambda x: x.cast("double") / n))


def shares(v: Column, least: float = 0.0) -> Column:
    """v divided by its sum."""
    return bind(F.greatest(total(v), F.lit(least)), lambda s: F.transform(v, lambda x: x / s))


def softmax(scores: Column, temperature: float = 1.0) -> Column:
    """softmax(scores / temperature), the temperature being at least 1e-8."""
    tau = max(temperature, 1e-8)
    scaled = F.transform(scores, lambda x: x.cast("double") / F.lit(tau))
    return bind(scaled, lambda z: shares(bind(F.array_max(z), lambda m: F.transform(z, lambda x: F.exp(x - m)))))


def scale_softmax(scores: Column, tau: float) -> Column:
    """softmax(scores * tau)."""
    return softmax(F.transform(scores, lambda x: x.cast("double") * F.lit(tau)))


def sharpen(p: Column, power: float) -> Column:
    """Powers, renormalised."""
    return shares(F.transform(p, lambda x: F.pow(x, F.lit(power))))


def calibrate(p: Column, temperature: float = 2.5, weight: float = 1.0, mix: float = 0.08) -> Column:
    """Clip and normalise, temper, weigh, then mix with the uniform distribution, in that order."""
    clipped = shares(F.transform(p, lambda x: F.greatest(x, F.lit(1e-12))))
    powered = sharpen(sharpen(clipped, 1.0 / temperature), weight)
    return F.transform(powered, lambda x: (1 - mix) * x + F.lit(mix) / F.size(p))


def log_emission(p: Column) -> Column:
    return F.transform(p, lambda x: F.ln(F.least(F.lit(1.0), F.greatest(x, F.lit(1e-12)))))


def argmax(v: Column) -> Column:
    """Index from 0 of the greatest element, the lowest of equal ones."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def margin(v: Column) -> Column:
    """Greatest minus second greatest; the greatest alone has itself as margin."""
    return bind(F.sort_array(v, asc=False), lambda s: s[0] - F.coalesce(F.get(s, F.lit(1)), F.lit(0.0)))


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda x: x * F.ln(F.greatest(x, F.lit(1e-12)))))


def entropy_normalised(p: Column) -> Column:
    """Entropy over ln K; 0 where K is 1."""
    return F.when(F.size(p) > 1, entropy(p) / F.ln(F.size(p).cast("double"))).otherwise(F.lit(0.0))


def stretch_flat(v: Column, mean_std: Column, below: float = 0.05) -> Column:
    """tanh(3 z) of the z-scores within v where rows vary little on the whole, else v."""

    def stretched(m: Column) -> Column:
        sd = F.sqrt(total(F.transform(v, lambda x: (x - m) * (x - m))) / F.size(v))
        return bind(sd, lambda s: F.transform(v, lambda x: F.tanh(3.0 * (x - m) / (s + 1e-8))))

    return F.when(mean_std < below, bind(total(v) / F.size(v), stretched)).otherwise(v)


def fit_length(v: Column, size: int) -> Column:
    """Cut or filled with zeros to ``size``."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), size)), 1, size)
