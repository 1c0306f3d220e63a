"""Distribution functions as Column expressions, so tests and p-values need no Python workers.

Normal cdf: West (2005), "Better approximations to cumulative normal functions".
Normal quantile: Wichura (1988), algorithm AS 241. Chi-square and Student tails:
the finite series for whole degrees of freedom (Abramowitz & Stegun 26.4, 26.7).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.columns import dbl, let, polynomial

# West's rational approximation, highest power first.
WEST_NUM = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
WEST_DEN = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
# AS 241 coefficients, highest power first (centre, middle, far tail).
CENTRE_NUM = (
    2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4,
    1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0,
)
CENTRE_DEN = (
    5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4,
    5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0,
)
MIDDLE_NUM = (
    7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0,
    3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0,
)
MIDDLE_DEN = (
    1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
    6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0,
)
TAIL_NUM = (
    2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
    2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0,
)
TAIL_DEN = (
    2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
    1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0,
)


def normal_cdf(z: Column) -> Column:
    def value(z: Column) -> Column:
        x = F.abs(z)
        e = F.exp(-x * x / dbl(2.0))
        near = e * polynomial(x, WEST_NUM) / polynomial(x, WEST_DEN)
        b = x + dbl(0.65)
        for k in (4.0, 3.0, 2.0, 1.0):
            b = x + dbl(k) / b
        far = e / b / dbl(2.506628274631)
        tail = F.when(x > dbl(37.0), dbl(0.0)).when(x < dbl(7.07106781186547), near).otherwise(far)
        return F.when(z > dbl(0.0), dbl(1.0) - tail).otherwise(tail)

    return let(z, value)


def normal_ppf(p: Column) -> Column:
    """Standard normal quantile; null outside (0, 1)."""

    def outer(r: Column) -> Column:
        rm, rt = r - dbl(1.6), r - dbl(5.0)
        return F.when(r <= dbl(5.0), polynomial(rm, MIDDLE_NUM) / polynomial(rm, MIDDLE_DEN)).otherwise(
            polynomial(rt, TAIL_NUM) / polynomial(rt, TAIL_DEN)
        )

    def value(p: Column) -> Column:
        q = p - dbl(0.5)
        rc = dbl(0.180625) - q * q
        centre = q * polynomial(rc, CENTRE_NUM) / polynomial(rc, CENTRE_DEN)
        side = let(F.sqrt(-F.log(F.when(q <= dbl(0.0), p).otherwise(dbl(1.0) - p))), outer)
        return F.when(F.abs(q) <= dbl(0.425), centre).when(q < dbl(0.0), -side).otherwise(side)

    return F.when((p > dbl(0.0)) & (p < dbl(1.0)), let(p, value))


def chi2_tail_even(x: Column, dof: int) -> Column:
    """P(chi2_dof > x) for an even number of degrees of freedom (closed form)."""
    if dof % 2:
        raise ValueError("closed form needs even degrees of freedom")
    half = x / dbl(2.0)
    series = dbl(1.0 / math.factorial(dof // 2 - 1))
    for j in range(dof // 2 - 2, -1, -1):
        series = series * half + dbl(1.0 / math.factorial(j))
    return F.exp(-half) * series


def student_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| > |t|) for whole degrees of freedom, by the finite cosine series."""
    theta = F.atan(F.abs(t) / F.sqrt(dof.cast("double")))
    c2 = F.pow(F.cos(theta), F.lit(2.0))
    odd = dof % 2 == 1
    # terms after the first: each multiplies the previous one by c2 * (k / (k + 1))
    first = F.when(odd, F.lit(2)).otherwise(F.lit(1))
    count = F.floor((dof - F.when(odd, F.lit(3)).otherwise(F.lit(2))) / 2).cast("int")
    steps = F.when(count >= 1, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    start = F.struct(dbl(1.0).alias("term"), dbl(1.0).alias("total"))

    def grow(acc, i):
        k = (first + i * 2).cast("double")
        term = acc["term"] * c2 * k / (k + dbl(1.0))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(steps, start, grow)["total"]
    odd_value = F.when(dof == 1, theta).otherwise(theta + F.sin(theta) * F.cos(theta) * total) * dbl(2.0 / math.pi)
    inside = F.when(odd, odd_value).otherwise(F.sin(theta) * total)
    return F.when(dof >= 1, F.greatest(dbl(1.0) - inside, dbl(0.0)))
