"""Scalar mathematics as Column expressions (stays in whole-stage code generation)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational approximation of the upper normal tail, highest power first.
CDF_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
CDF_FAR = 7.07106781186547
# Wichura's algorithm AS 241 for the normal quantile (centre, tail, far tail), highest power first.
PPF_CENTRE = ((2.5090809287301226727e+3, 3.3430575583588128105e+4, 6.7265770927008700853e+4, 4.5921953931549871457e+4, 1.3731693765509461125e+4, 1.9715909503065514427e+3, 1.3314166789178437745e+2, 3.3871328727963666080e+0),
              (5.2264952788528545610e+3, 2.8729085735721942674e+4, 3.9307895800092710610e+4, 2.1213794301586595867e+4, 5.3941960214247511077e+3, 6.8718700749205790830e+2, 4.2313330701600911252e+1, 1.0))
PPF_TAIL = ((7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e+0, 3.64784832476320460504e+0, 5.76949722146069140550e+0, 4.63033784615654529590e+0, 1.42343711074968357734e+0),
            (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e+0, 2.05319162663775882187e+0, 1.0))
PPF_FAR = ((2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e+0, 5.46378491116411436990e+0, 6.65790464350110377720e+0),
           (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0))
# Lanczos' approximation of the gamma function with g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def half_up(x: Column, digits: int = 6) -> Column:
    """Rounded after a nudge of 1e-9, so that sums in another order give the same figure."""
    return F.round(x + F.lit(1e-9), digits)


def norm_cdf(x: Column) -> Column:
    """Normal distribution function, to double precision; relative accuracy holds in the lower tail."""
    z = F.abs(x)
    e = F.exp(F.lit(-0.5) * z * z)
    fraction = reduce(lambda acc, k: z + F.lit(float(k)) / acc, (4, 3, 2, 1), z + F.lit(0.65))
    tail = F.when(z < CDF_FAR, e * _polynomial(z, CDF_TOP) / _polynomial(z, CDF_BOTTOM)).otherwise(e / fraction / F.lit(math.sqrt(2 * math.pi)))
    return F.when(x > 0, F.lit(1.0) - tail).otherwise(tail)


def norm_ppf(p: Column, eps: float = 1e-6) -> Column:
    """Normal quantile with p clipped to [eps, 1 - eps], to double precision."""
    p = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), p))
    q = p - F.lit(0.5)
    r = F.lit(0.180625) - q * q
    t = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    centre = q * _polynomial(r, PPF_CENTRE[0]) / _polynomial(r, PPF_CENTRE[1])
    near, far = t - F.lit(1.6), t - F.lit(5.0)
    tail = F.when(t <= 5, _polynomial(near, PPF_TAIL[0]) / _polynomial(near, PPF_TAIL[1])).otherwise(_polynomial(far, PPF_FAR[0]) / _polynomial(far, PPF_FAR[1]))
    return F.when(F.abs(q) <= 0.425, centre).when(q < 0, -tail).otherwise(tail)


def norm_cdf_sql(x: str) -> str:
    """The distribution function in SQL by another way: its power series, by Horner's rule."""
    series = f"list_reduce([1e0] || list_transform(range(0, 120), lambda i: 2e0 * (119 - i) + 3), lambda a, n: 1 + a * ({x}) * ({x}) / n)"
    return f"(case when {x} > 8 then 1e0 when {x} < -8 then 0e0 else 0.5e0 + ({x}) * exp(-({x}) * ({x}) / 2e0) / {math.sqrt(2 * math.pi)!r} * {series} end)"


def log_gamma(x: Column) -> Column:
    """log of the gamma function for x > 0, in closed form whatever its size."""
    y = x.cast("double")
    t = y + F.lit(6.5)
    series = reduce(lambda acc, i: acc + F.lit(LANCZOS[i]) / (y + F.lit(float(i - 1))), range(1, len(LANCZOS)), F.lit(LANCZOS[0]))
    return F.lit(0.5 * math.log(2 * math.pi)) + (y - F.lit(0.5)) * F.log(t) - t + F.log(series)


def logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def inv_logit(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def normal_density(x: Column, mu: float, sd: float) -> Column:
    z = (x - F.lit(mu)) / F.lit(sd)
    return F.exp(F.lit(-0.5) * z * z) / F.lit(sd * math.sqrt(2 * math.pi))


def shifted_lognormal(x: Column, mu: float, sd: float, shift: float) -> Column:
    """Log-normal density of x - shift; 0 at and left of the shift."""
    d = F.when(x > shift, x - F.lit(shift))
    z = (F.log(d) - F.lit(mu)) / F.lit(sd)
    return F.coalesce(F.exp(F.lit(-0.5) * z * z) / (d * F.lit(sd * math.sqrt(2 * math.pi))), F.lit(0.0))


def logistic_step(t: Column, t0: float, gamma: float, low: float, high: float) -> Column:
    return F.lit(low) + F.lit(high - low) / (F.lit(1.0) + F.exp(F.lit(-gamma) * (t - F.lit(t0))))


def round_to_grid(x: Column, step: float, origin: float = 0.0) -> Column:
    """Grid point origin + k * step with k = (x - origin) / step + 0.5 truncated toward zero."""
    return F.lit(origin) + ((x - F.lit(origin)) / F.lit(step) + F.lit(0.5)).cast("int") * F.lit(step)


def log_choose(n: Column, k: Column) -> Column:
    """log of the binomial coefficient, of real arguments too."""
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def log_beta(a: Column, b: Column) -> Column:
    """log B(a, b) for positive a and b."""
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def beta_binomial_log(k: Column, n: Column, alpha: Column, beta: Column) -> Column:
    """Log probability of k successes in n under a beta-binomial with positive parameters; k may be real."""
    return log_choose(n, k) + log_beta(k + alpha, n - k + beta) - log_beta(alpha, beta)


def binary_entropy(p: Column) -> Column:
    """-p log p - (1-p) log(1-p); 0 at 0 and 1."""
    return F.when((p > 0) & (p < 1), -(p * F.log(p) + (F.lit(1.0) - p) * F.log(F.lit(1.0) - p))).otherwise(F.lit(0.0))


def replace_zeros(probabilities: Column, least: float) -> Column:
    """Array of probabilities with zeros raised to `least` and renormalised."""
    raised = F.transform(probabilities, lambda p: F.when(p <= 0, F.lit(least)).otherwise(p))
    total = F.aggregate(raised, F.lit(0.0), lambda a, p: a + p)
    return F.transform(raised, lambda p: p / total)


def stick_forward(x: list[Column]) -> list[Column]:
    """Stick-breaking: n shares of 1 to n - 1 free numbers (log odds of each piece of what is left)."""
    out, left, n = [], F.lit(1.0), len(x)
    for i, share in enumerate(x[:-1]):
        out.append(logit(share / left) + F.lit(math.log(n - 1 - i)))
        left = left - share
    return out


def stick_backward(y: list[Column]) -> list[Column]:
    out, left, n = [], F.lit(1.0), len(y) + 1
    for i, v in enumerate(y):
        z = inv_logit(v - F.lit(math.log(n - 1 - i)))
        out.append(left * z)
        left = left * (F.lit(1.0) - z)
    return [*out, left]


def interval_forward(x: Column, a: float, b: float) -> Column:
    return F.log(x - F.lit(a)) - F.log(F.lit(b) - x)


def interval_backward(y: Column, a: float, b: float) -> Column:
    return F.lit(a) + F.lit(b - a) * inv_logit(y)


def _t_tail(t: float, df: int) -> float:
    """Upper tail of Student's t by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b))
    def fraction(x, a, b):
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 300):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + k * d)
                c = 1 + k / c
                h *= c * d
        return h
    inside = front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b
    return inside / 2


def t_table(confidence: float = 0.95, most: int = 200) -> list[float]:
    """Two-sided quantiles of Student's t for 1..most degrees of freedom."""
    out = []
    for df in range(1, most + 1):
        low, high = 0.0, 1e4
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if _t_tail(mid, df) > (1 - confidence) / 2 else (low, mid)
        out.append(mid)
    return out


def t_quantile(df: Column, confidence: float = 0.95) -> Column:
    """Two-sided quantile of Student's t: from a table, and beyond it by the expansion around the normal one."""
    from statistics import NormalDist

    table, z = t_table(confidence), NormalDist().inv_cdf(0.5 + confidence / 2)
    far = F.lit(z) + F.lit((z**3 + z) / 4) / df + F.lit((5 * z**5 + 16 * z**3 + 3 * z) / 96) / (df * df) + F.lit((3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384) / (df * df * df)
    return F.when(df <= len(table), F.get(F.array(*[F.lit(v) for v in table]), df.cast("int") - 1)).otherwise(far)


def correlation_interval(r: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Interval of a correlation by Fisher's transform with the quantile of Student's t of n - 1 degrees; null for n <= 3."""
    half = F.when(n > 3, t_quantile(n - 1, confidence) / F.sqrt(n - 3))
    return F.tanh(F.atanh(r) - half), F.tanh(F.atanh(r) + half)


def whole_step(a: float, b: float, n: int) -> int:
    """The step, a whole number of 1 at least, that parts [a, b] into about n pieces."""
    return max(1, round((b - a) / max(n, 1)))


def axis_end(x: float) -> float:
    """The next of 1, 2, 5 times a power of ten that is not below x (0 for x <= 0)."""
    if x <= 0:
        return 0.0
    base = 10.0 ** math.floor(math.log10(x))
    return next(m * base for m in (1, 2, 5, 10) if m * base >= x * (1 - 1e-12))


def lognormal_curve(t: Column, mu: float, sd: float, scale: float, offset: float = 0.0) -> Column:
    """scale * log-normal density of t, and an offset; the offset alone for t <= 0."""
    return shifted_lognormal(t, mu, sd, 0.0) * F.lit(scale) + F.lit(offset)
