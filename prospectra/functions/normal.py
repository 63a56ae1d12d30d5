"""Normal distribution as SQL expressions that Spark compiles: density, cumulative distribution, quantiles."""

from __future__ import annotations

# Hart's rational approximation as published by West (2005).
_HART_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_HART_LOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
# Wichura's algorithm AS241, numerators and denominators from the highest power down.
_CENTRE = ((2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080), (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0))
_MIDDLE = ((7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734), (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940, 2.05319162663775882187, 1.0))
_TAIL = ((2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580, 5.46378491116411436990, 6.65790464350110377720), (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0))


def _number(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _horner(coefficients: tuple, x: str) -> str:
    out = _number(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {_number(c)})"
    return out


def cdf(x: str) -> str:
    """Probability that a normal number is at most x; absolute error below 1e-14."""
    a = f"abs({x})"
    near = f"exp(-({x}) * ({x}) / 2) * {_horner(_HART_TOP, a)} / {_horner(_HART_LOW, a)}"
    far = f"exp(-({x}) * ({x}) / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + {_number(0.65)}))))) / {_number(2.506628274631)}"
    tail = f"CASE WHEN {a} > 37 THEN {_number(0.0)} WHEN {a} < {_number(7.07106781186547)} THEN {near} ELSE {far} END"
    return f"CASE WHEN ({x}) > 0 THEN 1 - ({tail}) ELSE ({tail}) END"


def pdf(x: str) -> str:
    return f"(exp(-({x}) * ({x}) / 2) * {_number(0.3989422804014327)})"


def quantile(p: str) -> str:
    """Inverse of cdf for 0 < p < 1."""
    q = f"(({p}) - {_number(0.5)})"
    inner = f"({_number(0.180625)} - {q} * {q})"
    r = f"sqrt(-ln(least(({p}), 1 - ({p}))))"
    ratio = lambda pair, x: f"{_horner(pair[0], x)} / {_horner(pair[1], x)}"
    outer = f"CASE WHEN {r} <= 5 THEN {ratio(_MIDDLE, f'({r} - {_number(1.6)})')} ELSE {ratio(_TAIL, f'({r} - 5)')} END"
    return f"CASE WHEN abs({q}) <= {_number(0.425)} THEN {q} * {ratio(_CENTRE, inner)} WHEN {q} < 0 THEN -({outer}) ELSE {outer} END"
