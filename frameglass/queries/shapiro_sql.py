"""The Shapiro-Wilk test as reference SQL, for samples of twelve values or more."""

from __future__ import annotations

from collections.abc import Sequence

# Published coefficients, lowest power first. The quantile of the normal distribution by algorithm AS 241 (centre and
# tail, numerator and denominator), the test's polynomials by algorithm AS R94, and a rational form of erfc.
_CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4,
     6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4,
     2.8729085735721942674e4, 5.2264952788528545610e3),
)
_OUTER = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0,
     2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1,
     1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
_LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_LOG_SD = (-0.4803, -0.082676, 0.0030302)
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _poly(coefficients: Sequence[float], x: str) -> str:
    text = f"{coefficients[-1]!r}::DOUBLE"
    for c in reversed(coefficients[:-1]):
        text = f"({c!r}::DOUBLE + {x} * {text})"
    return text


def shapiro_sql(sample: str, keys: Sequence[str], rest: str = "") -> str:
    """Per group of `keys`: tested, w, p_value and is_normal of the values x of `sample`; `rest` are further aggregates."""
    k = ", ".join(keys)
    centre, outer = (f"{_poly(a, 'r')} / {_poly(b, 'r')}" for a, b in (_CENTRE, _OUTER))
    over = f"OVER (PARTITION BY {k})"
    return f"""
        SELECT {k}, {rest} n AS tested, round(w, 6) AS w,
               round(0.5 * CASE WHEN z >= 0 THEN tail ELSE 2 - tail END, 6) AS p_value, 0.5 * CASE WHEN z >= 0 THEN tail ELSE 2 - tail END > 0.05 AS is_normal
        FROM (SELECT *, t * exp(-z * z / 2 + {_poly(_ERFC, 't')}) AS tail FROM (SELECT *, 1 / (1 + 0.5 * abs(z) / sqrt(2)) AS t FROM (
        SELECT *, (ln(1 - w) - {_poly(_MEAN, 'ln(n)')}) / exp({_poly(_LOG_SD, 'ln(n)')}) AS z FROM (
        SELECT {k}, {rest} n, least(pow(sum(CASE i WHEN 1 THEN -a1 WHEN n THEN a1 WHEN 2 THEN -a2 WHEN n - 1 THEN a2 ELSE g / sqrt(phi) END * x), 2)
               / sum((x - m) * (x - m)), 1) AS w
        FROM (SELECT *, (total - 2 * g1 * g1 - 2 * g2 * g2) / (1 - 2 * a1 * a1 - 2 * a2 * a2) AS phi FROM (
        SELECT *, g1 / sqrt(total) + {_poly(_LAST, 'u')} AS a1, g2 / sqrt(total) + {_poly(_SECOND, 'u')} AS a2 FROM (
        SELECT *, 1 / sqrt(n) AS u, sum(g * g) {over} AS total, max(g) {over} AS g1, max(CASE WHEN i = n - 1 THEN g END) {over} AS g2 FROM (
        SELECT *, CASE WHEN abs(p - 0.5) <= 0.425 THEN (p - 0.5) * {centre.replace("r *", "(0.180625 - (p - 0.5) * (p - 0.5)) *")}
               ELSE sign(p - 0.5) * {outer.replace("r *", "(sqrt(-ln(least(p, 1 - p))) - 1.6) *")} END AS g FROM (
        SELECT *, (i - 0.375) / (n + 0.25) AS p FROM (
        SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY x) AS i, count(*) {over} AS n, avg(x) {over} AS m FROM ({sample}) s0) s1) s2) s3) s4) s5) s6
        GROUP BY {k}, {rest} n) s7) s8) s9) s10"""
