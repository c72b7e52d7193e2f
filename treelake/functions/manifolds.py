"""Distances, entailment cones and their gradients in closed form, on NumPy rows, for four ways to hold a vector."""

from __future__ import annotations

from .vectors import EPS

TINY = 1e-15


def _rows(x):
    return x[:, None]


def _sum(x):
    return x.sum(1)


class Poincare:
    """Points of the open ball."""

    def __init__(self, k: float = 0.1, most: float = 0.999):
        self.k, self.most = k, most

    @property
    def inner_radius(self) -> float:
        """Below this radius of its image in the ball a point has no cone."""
        return 2 * self.k / (1 + (1 + 4 * self.k * self.k) ** 0.5)

    def width(self, dim: int) -> int:
        """Numbers that a vector of `dim` dimensions takes."""
        return dim

    def of_ball(self, u):
        """Vectors from points of the ball."""
        return u

    def to_ball(self, x):
        return x

    def distance(self, u, v):
        """Distances of rows, and their gradients by u and by v."""
        import numpy as np

        a, b = np.clip(_sum(u * u), 0, 1 - EPS), np.clip(_sum(v * v), 0, 1 - EPS)
        diff = u - v
        s = _sum(diff * diff)
        bottom = (1 - a) * (1 - b) + EPS
        x = 1 + 2 * s / bottom + EPS
        slope = _rows(2 / (bottom * np.sqrt(x * x - 1)))
        # x depends on u by the difference and, where the norm isn't held, by the bottom
        pull = lambda own, other: _rows(2 * s * (1 - other) / bottom * (own < 1 - EPS))
        return np.arccosh(x), slope * (2 * diff + pull(a, b) * u), slope * (pull(b, a) * v - 2 * diff)

    def riemannian(self, p, g):
        """The gradient under the metric at p."""
        return g * _rows((1 - _sum(p * p)) ** 2 / 4)

    def move(self, p, step):
        """p moved along a tangent, and back into the ball if it leaves it."""
        import numpy as np

        q = p + step
        n = np.sqrt(_sum(q * q))
        return np.where(_rows(n >= self.most), q * _rows(self.most / (n + 1e-8)), q)

    def settle(self, p):
        """p as a step leaves it, put where vectors may lie."""
        return self.move(p, 0)

    def aperture(self, u):
        """Half apertures of the cones at u, and their gradients; where none is open the widest angle, without a slope."""
        import numpy as np

        s = np.maximum(_sum(u * u), TINY)
        y = self.inner_radius * (1 - s) / np.sqrt(s)
        held = np.clip(y, -1 + EPS, 1 - EPS)
        slope = np.where(held == y, -self.inner_radius * (1 + s) / s**1.5 / np.sqrt(1 - held * held), 0)
        return np.arcsin(held), _rows(slope) * u

    def angle(self, u, v):
        """Angles at u between the ray away from the origin and the way to v, and their gradients by u and by v."""
        import numpy as np

        a, b, c = (np.maximum(x, TINY) for x in (_sum(u * u), _sum(v * v), _sum((u - v) ** 2)))
        uv = _sum(u * v)
        w = np.maximum(1 + a * b - 2 * uv, TINY)
        bottom = np.sqrt(a * c * w)
        cosine = (uv * (1 + a) - a * (1 + b)) / bottom
        # by a = |u|^2, b = |v|^2 and uv; c = a + b - 2 uv
        by_a = (uv - 1 - b) / bottom - cosine / 2 * (1 / a + 1 / c + b / w)
        by_b = -a / bottom - cosine / 2 * (1 / c + a / w)
        by_uv = (1 + a) / bottom + cosine * (1 / c + 1 / w)
        return _angle(cosine, _rows(2 * by_a) * u + _rows(by_uv) * v, _rows(2 * by_b) * v + _rows(by_uv) * u)


def _angle(cosine, by_u, by_v):
    """The angle of a cosine with gradients by_u and by_v; without slope where the cosine is held."""
    import numpy as np

    held = np.clip(cosine, -1 + EPS, 1 - EPS)
    slope = _rows(np.where(held == cosine, -1 / np.sqrt(1 - held * held), 0))
    return np.arccos(held), slope * by_u, slope * by_v


class Tanh(Poincare):
    """Points of R^d whose image tanh(|z| / 2) z / |z| is the point of the ball: no step can leave the ball."""

    def of_ball(self, u):
        import numpy as np

        n = np.maximum(np.sqrt(_sum(u * u)), 1e-8)
        return u * _rows(2 * np.arctanh(np.minimum(n, 0.999)) / n)

    def to_ball(self, z):
        import numpy as np

        n = np.maximum(np.sqrt(_sum(z * z)), 1e-8)
        return z * _rows(np.tanh(n / 2) / n)

    def _back(self, z, g):
        """A gradient by the image, taken back to z: along the ray by the slope of the radius, across it by radius over |z|."""
        import numpy as np

        n = np.maximum(np.sqrt(_sum(z * z)), 1e-8)
        t = np.tanh(n / 2)
        ray = z / _rows(n)
        along = ray * _rows(_sum(ray * g))
        return along * _rows((1 - t * t) / 2) + (g - along) * _rows(t / n)

    def distance(self, u, v):
        d, gu, gv = super().distance(self.to_ball(u), self.to_ball(v))
        return d, self._back(u, gu), self._back(v, gv)

    def riemannian(self, p, g):
        return g

    def move(self, p, step):
        return p + step

    def aperture(self, u):
        a, g = super().aperture(self.to_ball(u))
        return a, self._back(u, g)

    def angle(self, u, v):
        a, gu, gv = super().angle(self.to_ball(u), self.to_ball(v))
        return a, self._back(u, gu), self._back(v, gv)


class Lorentz(Poincare):
    """Points of the hyperboloid: a time coordinate first, sqrt(1 + the squares of the others)."""

    def __init__(self, k: float = 0.1, longest: float = 1.0, most: float = 1e6):
        super().__init__(k, most)
        self.longest = longest

    def width(self, dim: int) -> int:
        return dim + 1

    def of_ball(self, u):
        import numpy as np

        s = _rows(_sum(u * u))
        return np.concatenate([1 + s, 2 * u], 1) / (1 - s)

    def to_ball(self, x):
        return x[:, 1:] / (1 + x[:, :1])

    @staticmethod
    def dot(u, v):
        return _sum(u * v) - 2 * u[:, 0] * v[:, 0]

    @staticmethod
    def _turned(v):
        import numpy as np

        return np.concatenate([-v[:, :1], v[:, 1:]], 1)

    def distance(self, u, v):
        import numpy as np

        x = np.maximum(-self.dot(u, v), 1)
        slope = _rows(-1 / np.sqrt(np.maximum(x * x - 1, EPS)))
        return np.arccosh(x), slope * self._turned(v), slope * self._turned(u)

    def riemannian(self, p, g):
        h = self._turned(g)
        return h + _rows(self.dot(p, h)) * p

    def settle(self, p):
        """The time coordinate anew from the others, whose norm is held at `most`, and outside the inner radius."""
        import numpy as np

        x = p[:, 1:]
        n = np.sqrt(_sum(x * x))
        x = x * _rows(np.minimum(1, self.most / np.maximum(n, TINY)))
        return np.concatenate([np.sqrt(1 + _rows(_sum(x * x))), x], 1)

    def outside(self, p):
        """p, pushed along its ray to the inner radius if its image in the ball lies within it."""
        import numpy as np

        ball = self.to_ball(p)
        n = np.sqrt(_sum(ball * ball))
        least = self.inner_radius + EPS
        return np.where(_rows(n < least), self.of_ball(ball * _rows(least / np.maximum(n, TINY))), p)

    def move(self, p, step):
        """The exponential map, no further than `longest` at once."""
        import numpy as np

        n = np.sqrt(np.maximum(self.dot(step, step), 0))
        t = _rows(np.minimum(n, self.longest))
        return self.settle(np.cosh(t) * p + np.sinh(t) * step / _rows(np.maximum(n, 1e-12)))

    def aperture(self, u):
        import numpy as np

        s = np.maximum(_sum(u[:, 1:] ** 2) / (1 + u[:, 0]) ** 2, TINY)
        y = self.inner_radius * (1 - s) / np.sqrt(s)
        held = np.clip(y, -1 + EPS, 1 - EPS)
        slope = np.where(held == y, -self.inner_radius * (1 + s) / (2 * s**1.5) / np.sqrt(1 - held * held), 0)
        by_s = np.concatenate([_rows(-2 * s / (1 + u[:, 0])), 2 * u[:, 1:] / _rows(1 + u[:, 0]) ** 2], 1)
        return np.arcsin(held), _rows(slope) * by_s

    def angle(self, u, v):
        import numpy as np

        u0, v0, xy = u[:, 0], v[:, 0], self.dot(u, v)
        a, b = np.maximum(u0 * u0 - 1, TINY), np.maximum(xy * xy - 1, EPS)
        bottom = np.sqrt(a * b)
        cosine = (v0 + u0 * xy) / bottom
        by_xy = u0 / bottom - cosine * xy / b * (xy * xy - 1 > EPS)
        by_u, by_v = _rows(by_xy) * self._turned(v), _rows(by_xy) * self._turned(u)
        by_u[:, 0] += xy / bottom - cosine * u0 / a
        by_v[:, 0] += 1 / bottom
        return _angle(cosine, by_u, by_v)


class Euclidean(Poincare):
    """Points of flat space; the distance is squared, as the energy of a link."""

    def __init__(self, k: float = 0.1, most: float | None = None):
        super().__init__(k, most)

    def to_ball(self, x):
        return x

    def distance(self, u, v):
        diff = u - v
        return _sum(diff * diff), 2 * diff, -2 * diff

    def riemannian(self, p, g):
        return g

    def move(self, p, step):
        import numpy as np

        q = p + step
        return q if self.most is None else q * _rows(np.minimum(1, self.most / np.maximum(np.sqrt(_sum(q * q)), TINY)))

    def aperture(self, u):
        import numpy as np

        s = np.maximum(_sum(u * u), TINY)
        y = self.inner_radius / np.sqrt(s)
        held = np.clip(y, -1 + EPS, 1 - EPS)
        slope = np.where(held == y, -self.inner_radius / s**1.5 / np.sqrt(1 - held * held), 0)
        return np.arcsin(held), _rows(slope) * u

    def angle(self, u, v):
        import numpy as np

        a, b, c = _sum(u * u), _sum(v * v), np.maximum(_sum((u - v) ** 2), TINY)
        bottom = 2 * np.sqrt(np.maximum(a, TINY) * c)
        cosine = (b - a - c) / bottom
        by_a, by_b, by_c = -1 / bottom - cosine / (2 * np.maximum(a, TINY)), 1 / bottom, -1 / bottom - cosine / (2 * c)
        diff = 2 * (u - v)
        return _angle(cosine, _rows(2 * by_a) * u + _rows(by_c) * diff, _rows(2 * by_b) * v - _rows(by_c) * diff)


MANIFOLDS = {"poincare": Poincare, "tanh": Tanh, "lorentz": Lorentz, "euclidean": Euclidean}


def cone_energy(manifold: Poincare, general, special):
    """How far `special` lies outside the cone at `general`, and the gradients by both; 0 inside."""
    angle, gu, gv = manifold.angle(general, special)
    aperture, ga = manifold.aperture(general)
    out = _rows(angle > aperture)
    return (angle - aperture) * out[:, 0], (gu - ga) * out, gv * out


def ranking(manifold: Poincare, anc, desc, neg, margin, weight):
    """Weighted hinge losses of (ancestor, descendant, negatives), and the gradients by each of the three.

    anc, desc: (n, width); neg: (n, k, width); margin, weight: (n,). A link's loss is the mean over its negatives of
    max(0, distance to the descendant - distance of the ancestor to the negative + margin).
    """
    import numpy as np

    n, k, dim = neg.shape
    near, ga, gd = manifold.distance(anc, desc)
    far, gna, gn = manifold.distance(np.repeat(anc, k, 0), neg.reshape(n * k, dim))
    gap = _rows(near) - far.reshape(n, k) + _rows(margin)
    on = (gap > 0) * _rows(weight / k)
    each = on[:, :, None]
    return weight * np.maximum(gap, 0).mean(1), ga * _rows(on.sum(1)) - (gna.reshape(n, k, dim) * each).sum(1), gd * _rows(on.sum(1)), -gn.reshape(n, k, dim) * each


def softmax(manifold: Poincare, anc, desc, neg, margin, weight):
    """Weighted cross entropy of the descendant among itself and the negatives, with scores of minus the distance from
    the ancestor; shapes and gradients as in `ranking`. The margin takes no part."""
    import numpy as np

    n, k, dim = neg.shape
    d, ga, gb = manifold.distance(np.repeat(anc, k + 1, 0), np.concatenate([desc[:, None], neg], 1).reshape(n * (k + 1), dim))
    d = d.reshape(n, k + 1)
    low = d.min(1, keepdims=True)
    e = np.exp(low - d)
    p = e / e.sum(1, keepdims=True)
    by = -p * _rows(weight)
    by[:, 0] += weight
    ga, gb = ga.reshape(n, k + 1, dim) * by[:, :, None], gb.reshape(n, k + 1, dim) * by[:, :, None]
    return weight * (d[:, 0] - low[:, 0] + np.log(e.sum(1))), ga.sum(1), gb[:, 0], gb[:, 1:]


def cones(manifold: Poincare, anc, desc, neg, margin, weight):
    """Weighted two-sided hinge of cone energies: that of (ancestor, descendant), and what a negative's cone around the
    descendant lacks of the margin, over 1 + k; shapes and gradients as in `ranking`."""
    import numpy as np

    n, k, dim = neg.shape
    own, ga, gd = cone_energy(manifold, anc, desc)
    other, gn, gs = cone_energy(manifold, neg.reshape(n * k, dim), np.repeat(desc, k, 0))
    lack = _rows(margin) - other.reshape(n, k)
    by = (lack > 0) * _rows(-weight / (1 + k))
    share = _rows(weight / (1 + k))
    gs = (gs.reshape(n, k, dim) * by[:, :, None]).sum(1)
    return weight * (own + np.maximum(lack, 0).sum(1)) / (1 + k), ga * share, gd * share + gs, gn.reshape(n, k, dim) * by[:, :, None]


LOSSES = {"ranking": ranking, "softmax": softmax, "cones": cones}
