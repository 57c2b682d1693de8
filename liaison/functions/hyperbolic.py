"""Column functions on arrays of doubles: vectors in the Poincare ball."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms that enter atanh stay between these.
LEAST, MOST = 1e-10, 1 - 1e-5


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)


def let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once, however often `body` or a function of elements names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def norm(u: Column) -> Column:
    return let(u, lambda u: F.sqrt(dot(u, u)))


def scaled(u: Column, k: Column) -> Column:
    return let(k, lambda k: F.transform(u, lambda x: x * k))


def added(u: Column, v: Column) -> Column:
    return F.zip_with(u, v, lambda x, y: x + y)


def _atanh(x: Column) -> Column:
    return F.atanh(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), x)))


def mobius_add(u: Column, v: Column, c: float = 1.0) -> Column:
    return let(u, lambda u: let(v, lambda v: _mobius_add(u, v, c)))


def _mobius_add(u: Column, v: Column, c: float) -> Column:
    uv, uu, vv = dot(u, v), dot(u, u), dot(v, v)
    base = F.greatest(1 + 2 * c * uv + c * c * uu * vv, F.lit(1e-15))
    return added(scaled(u, (1 + 2 * c * uv + c * vv) / base), scaled(v, (1 - c * uu) / base))


def distance_from(uu: Column, vv: Column, uv: Column, c: float = 1.0) -> Column:
    """The Poincare distance from squared norms and the inner product: |-u (+) v|^2 in closed form, then 2/sqrt(c) atanh."""
    gap = F.greatest(uu + vv - 2 * uv, F.lit(0.0))
    base = F.greatest(1 - 2 * c * uv + c * c * uu * vv, F.lit(1e-15))
    return 2 / c**0.5 * _atanh(F.sqrt(c * gap / base))


def distance(u: Column, v: Column, c: float = 1.0) -> Column:
    return distance_from(dot(u, u), dot(v, v), dot(u, v), c)


def expmap0(u: Column, c: float = 1.0) -> Column:
    n = F.greatest(norm(u) * c**0.5, F.lit(1e-15))
    return scaled(u, F.tanh(F.least(n, F.lit(15.0))) / n)


def logmap0(u: Column, c: float = 1.0) -> Column:
    n = F.greatest(norm(u) * c**0.5, F.lit(1e-15))
    return scaled(u, _atanh(n) / n)


def conformal(u: Column, c: float = 1.0) -> Column:
    """lambda(u) = 2 / (1 - c |u|^2)."""
    return 2 / F.greatest(1 - c * dot(u, u), F.lit(1e-15))


def expmap(p: Column, u: Column, c: float = 1.0) -> Column:
    n = F.greatest(norm(u), F.lit(1e-15))
    return mobius_add(p, scaled(u, F.tanh(F.least(c**0.5 * conformal(p, c) * n / 2, F.lit(15.0))) / (n * c**0.5)), c)


def logmap(p: Column, q: Column, c: float = 1.0) -> Column:
    """The tangent vector at p whose exponential is q: 2 / (sqrt(c) lambda(p)) atanh(sqrt(c) |-p + q|) in its direction."""
    gap = mobius_add(scaled(p, F.lit(-1.0)), q, c)
    n = F.greatest(norm(gap), F.lit(1e-15))
    return scaled(gap, 2 / (c**0.5 * conformal(p, c)) * _atanh(n * c**0.5) / n)


def inner(p: Column, u: Column, v: Column, c: float = 1.0) -> Column:
    """The inner product of tangent vectors at p."""
    return F.pow(conformal(p, c), 2) * dot(u, v)


def gyration(a: Column, b: Column, u: Column, c: float = 1.0) -> Column:
    """-(a + b) + (a + (b + u)) in closed form: the turn by which Moebius addition fails to associate; it keeps lengths."""
    ab, au, bu, aa, bb = dot(a, b), dot(a, u), dot(b, u), dot(a, a), dot(b, b)
    base = F.greatest(1 + 2 * c * ab + c * c * aa * bb, F.lit(1e-15))
    for_a = 2 * (c * bu + 2 * c * c * ab * bu - c * c * au * bb) / base
    for_b = -2 * (c * au + c * c * bu * aa) / base
    return added(u, added(scaled(a, for_a), scaled(b, for_b)))


def transported(v: Column, x: Column, y: Column, c: float = 1.0) -> Column:
    """The tangent vector v at x carried to y: turned by the gyration of y and -x, and scaled by lambda(x) / lambda(y)."""
    return scaled(gyration(y, scaled(x, F.lit(-1.0)), v, c), conformal(x, c) / conformal(y, c))


def projected(u: Column, c: float = 1.0, eps: float = 1e-3) -> Column:
    most = (1 - eps) / c**0.5
    n = F.greatest(norm(u), F.lit(1e-15))
    return F.when(n > most, scaled(u, most / n)).otherwise(u)


def riemannian_gradient(p: Column, g: Column, c: float = 1.0) -> Column:
    return scaled(g, 1 / F.pow(conformal(p, c), 2))


def fermi_dirac(d: Column, r: float = 2.0, t: float = 1.0) -> Column:
    return 1 / (F.exp((d - r) / t) + 1)


def aperture(u: Column, k: float = 0.1) -> Column:
    """Half aperture of the entailment cone at u."""
    n = F.greatest(norm(u), F.lit(LEAST))
    return F.asin(F.least(F.lit(1.0), k * (1 - n * n) / n))


def lorentz_product(u: Column, v: Column) -> Column:
    return dot(u, v) - 2 * F.element_at(u, 1) * F.element_at(v, 1)


def lorentz_distance(u: Column, v: Column) -> Column:
    return F.acosh(F.greatest(F.lit(1.0), -lorentz_product(u, v)))


def lorentz_to_poincare(u: Column) -> Column:
    return scaled(F.slice(u, 2, F.size(u) - 1), 1 / (F.element_at(u, 1) + 1))


def lorentz_from_poincare(u: Column) -> Column:
    """The point of the hyperboloid, time first."""
    uu = dot(u, u)
    return F.concat(F.array((1 + uu) / (1 - uu)), scaled(u, 2 / (1 - uu)))


def lorentz_logmap(p: Column, q: Column) -> Column:
    """The tangent vector at p of the hyperboloid whose exponential is q: of length the distance, in the direction of q + <p, q> p.
    Equal points give zero."""

    def made(cosh: Column) -> Column:
        rest = F.sqrt(cosh * cosh - 1)
        return F.zip_with(q, p, lambda y, x: F.when(rest > LEAST, F.acosh(cosh) / rest).otherwise(1.0) * (y - cosh * x))

    return let(F.greatest(F.lit(1.0), -lorentz_product(p, q)), made)


def lorentz_expmap(p: Column, u: Column) -> Column:
    """cosh(n) p + sinh(n) / n u, n the length of the tangent vector u at p."""
    n = let(F.sqrt(F.greatest(lorentz_product(u, u), F.lit(0.0))), lambda n: F.array(F.cosh(n), F.when(n > LEAST, F.sinh(n) / n).otherwise(1.0)))
    return let(n, lambda n: F.zip_with(p, u, lambda x, y: F.element_at(n, 1) * x + F.element_at(n, 2) * y))


def lorentz_transported(v: Column, p: Column, q: Column) -> Column:
    """The tangent vector v at p carried to q along the geodesic: v + <q, v> / (1 - <p, q>) (p + q)."""
    return let(lorentz_product(q, v) / (1 - lorentz_product(p, q)), lambda k: F.zip_with(v, added(p, q), lambda x, y: x + k * y))
