"""Vector geometry as Column expressions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-5


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def squared_distance(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)


def squared_norm(u: Column) -> Column:
    return F.aggregate(u, F.lit(0.0), lambda s, x: s + x * x)


def norm(u: Column) -> Column:
    return F.sqrt(squared_norm(u))


def scale(u: Column, by: Column) -> Column:
    return F.transform(u, lambda x: x * by)


def poincare_distance(u: Column, v: Column, variant: str = "model") -> Column:
    """Distance in the Poincaré ball.

    variant "model": epsilon in the denominator and under acosh, squared norms held below 1 - epsilon, so
    the distance of a point to itself is a little above 0; "clamped": the argument of acosh is held at
    1 + epsilon or above; "exact": no epsilon.
    """
    d = squared_distance(u, v)
    if variant == "exact":
        return F.acosh(F.greatest(1 + 2 * d / ((1 - squared_norm(u)) * (1 - squared_norm(v))), F.lit(1.0)))
    held = lambda x: F.greatest(F.least(squared_norm(x), F.lit(1 - EPS)), F.lit(0.0))
    x = 1 + 2 * d / ((1 - held(u)) * (1 - held(v)) + EPS)
    return F.acosh(x + EPS) if variant == "model" else F.acosh(F.greatest(x, F.lit(1 + EPS)))


def target_radius(depth: Column, max_depth: Column, schedule: str = "linear") -> Column:
    """0.1 at the root to 0.95 at the deepest level, linearly or by log1p; 0.1 for a tree of one level."""
    share = depth / max_depth if schedule == "linear" else F.log1p(depth.cast("double")) / F.log1p(max_depth.cast("double"))
    return F.when(max_depth <= 0, F.lit(0.1)).otherwise(F.lit(0.1) + F.lit(0.85) * share)


def project_to_ball(u: Column, most: float = 0.999) -> Column:
    n = norm(u)
    return F.when(n >= most, scale(u, most / (n + 1e-8))).otherwise(u)


def tanh_map(z: Column) -> Column:
    """R^d into the ball: tanh(|z| / 2) z / |z|."""
    n = F.greatest(norm(z), F.lit(1e-8))
    return scale(z, F.tanh(n / 2) / n)


def inverse_tanh_map(u: Column) -> Column:
    n = F.greatest(norm(u), F.lit(1e-8))
    return scale(u, 2 * F.atanh(F.least(n, F.lit(0.999))) / n)


def radial_nudge(u: Column, target: Column, share: float) -> Column:
    """Moves the norm towards the target by a share of the way; the direction stays."""
    n = F.greatest(norm(u), F.lit(1e-8))
    return scale(u, (n * (1 - share) + target * share) / n)


def tanh_radial_nudge(z: Column, target: Column, share: float) -> Column:
    """radial_nudge of the ball's image of z, taken back to R^d; the radius stays within 1e-6 of 0 and 1."""
    n = F.greatest(norm(z), F.lit(1e-8))
    r = F.least(F.greatest(F.tanh(n / 2) * (1 - share) + target * share, F.lit(1e-6)), F.lit(1 - 1e-6))
    return scale(z, 2 * F.atanh(r) / n)


def riemannian_gradient(p: Column, g: Column) -> Column:
    return scale(g, (1 - squared_norm(p)) * (1 - squared_norm(p)) / 4)


def riemannian_step(p: Column, g: Column, rate: float, most: float = 0.999) -> Column:
    """One step of Riemannian gradient descent in the ball: against the scaled gradient, then back into the ball."""
    return project_to_ball(F.zip_with(p, riemannian_gradient(p, g), lambda a, b: a - rate * b), most)


def lorentz_dot(u: Column, v: Column) -> Column:
    return dot(u, v) - 2 * F.get(u, 0) * F.get(v, 0)


def lorentz_distance(u: Column, v: Column) -> Column:
    return F.acosh(F.greatest(-lorentz_dot(u, v), F.lit(1.0)))


def lorentz_to_poincare(x: Column) -> Column:
    return F.transform(F.slice(x, 2, F.size(x) - 1), lambda c: c / (F.get(x, 0) + 1))


def poincare_to_lorentz(p: Column) -> Column:
    s = squared_norm(p)
    return F.concat(F.array((1 + s) / (1 - s)), F.transform(p, lambda c: 2 * c / (1 - s)))


def lorentz_lift(x: Column) -> Column:
    """A vector of space coordinates put on the hyperboloid."""
    return F.concat(F.array(F.sqrt(1 + squared_norm(x))), x)


def lorentz_exp_map(p: Column, d: Column) -> Column:
    n = F.sqrt(F.greatest(lorentz_dot(d, d), F.lit(1e-20)))
    return F.zip_with(p, d, lambda a, b: F.cosh(n) * a + F.sinh(n) / n * b)


def lorentz_log_map(x: Column, y: Column) -> Column:
    xy = F.least(lorentz_dot(x, y), F.lit(-1.0) - 1e-15)
    return F.zip_with(x, y, lambda a, b: F.acosh(-xy) / F.sqrt(xy * xy - 1) * (b + xy * a))


def lorentz_transport(x: Column, y: Column, v: Column) -> Column:
    """Parallel transport of the tangent v from x to y."""
    k = lorentz_dot(y, v) / (1 - lorentz_dot(x, y))
    return F.zip_with(v, F.zip_with(x, y, lambda a, b: a + b), lambda c, s: c + k * s)


def lorentz_gradient(p: Column, g: Column) -> Column:
    """The gradient with its time part turned, then made tangent at p."""
    h = F.concat(F.array(-F.get(g, 0)), F.slice(g, 2, F.size(g) - 1))
    return F.zip_with(h, p, lambda a, b: a + lorentz_dot(p, h) * b)


def _held_cosine(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(-1 + EPS)), F.lit(1 - EPS))


def _inner_radius(k: float) -> float:
    return 2 * k / (1 + (1 + 4 * k * k) ** 0.5)


def _aperture(s: Column, k: float) -> Column:
    return F.asin(_held_cosine(_inner_radius(k) * (1 - s) / F.sqrt(s)))


def cone_aperture(u: Column, k: float = 0.1) -> Column:
    """Half aperture of the entailment cone at u in the ball; k sets the inner radius."""
    return _aperture(squared_norm(u), k)


def cone_angle(u: Column, v: Column) -> Column:
    """Angle at u between the ray away from the origin and the way to v."""
    nu, nv, uv = squared_norm(u), squared_norm(v), dot(u, v)
    top = uv * (1 + nu) - nu * (1 + nv)
    bottom = F.sqrt(nu) * F.sqrt(squared_distance(u, v)) * F.sqrt(F.greatest(1 + nu * nv - 2 * uv, F.lit(1e-15)))
    return F.acos(_held_cosine(top / bottom))


def lorentz_cone_aperture(x: Column, k: float = 0.1) -> Column:
    """Half aperture at a point of the hyperboloid: that of its image in the ball."""
    return _aperture(squared_norm(lorentz_to_poincare(x)), k)


def lorentz_cone_angle(x: Column, y: Column) -> Column:
    """cone_angle on the hyperboloid."""
    x0, y0, xy = F.get(x, F.lit(0)), F.get(y, F.lit(0)), lorentz_dot(x, y)
    return F.acos(_held_cosine((y0 + x0 * xy) / (F.sqrt(x0 * x0 - 1) * F.sqrt(F.greatest(xy * xy - 1, F.lit(EPS))))))


def euclidean_cone_aperture(u: Column, k: float = 0.1) -> Column:
    """Half aperture in flat space; nearly a right angle within the inner radius."""
    return F.asin(_held_cosine(_inner_radius(k) / norm(u)))


def euclidean_cone_angle(u: Column, v: Column) -> Column:
    """cone_angle in flat space, by the law of cosines with the plain distance."""
    d = F.sqrt(squared_distance(u, v))
    return F.acos(_held_cosine((squared_norm(v) - squared_norm(u) - d * d) / (2 * norm(u) * d)))


def cone_energy(general: Column, special: Column, k: float = 0.1) -> Column:
    return F.greatest(cone_angle(general, special) - cone_aperture(general, k), F.lit(0.0))


def depth_margin(depth_diff: Column, deepest: Column, low: float = 0.05, high: float = 1.0) -> Column:
    return F.lit(low) + (high - low) * depth_diff / deepest


def hinge(positive: Column, negative: Column, margin: Column) -> Column:
    return F.greatest(positive - negative + margin, F.lit(0.0))


def distance_softmax(positive: Column, negatives: Column) -> Column:
    """Cross entropy of the positive among itself and an array of negatives, with scores of minus the distance."""
    low = F.least(positive, F.coalesce(F.array_min(negatives), positive))
    total = F.aggregate(negatives, F.exp(low - positive), lambda s, d: s + F.exp(low - d))
    return positive - low + F.ln(total)


def quality_score(corr: Column, hierarchy_pct: Column, purity: Column, ratio: Column) -> Column:
    return corr + hierarchy_pct / 100 + purity + (ratio - 1)
