"""Scores of landmarks and matches as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions import vec

GATED = -1e9


@dataclass(frozen=True)
class Weights:
    """Coarse score: l1 residual, l2 cosine, l3 staticness, l4 view, l5 geometry."""

    l1: float = 1.0
    l2: float = 1.2
    l3: float = 0.6
    l4: float = 0.3
    l5: float = 0.5
    parallel: float | None = None  # None: half of l1
    perpendicular: float | None = None  # None: l1
    support: float = 0.0
    eps: float = 1e-6


def clip01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def staticness(n_obs: Column, spread: Column, reprojection: Column, view: Column) -> Column:
    return clip01(0.45 * F.tanh(n_obs / F.lit(6.0)) + 0.25 * F.exp(-spread) + 0.2 * F.exp(-F.greatest(F.lit(0.0), reprojection)) + 0.1 * clip01(view))


def view_diversity(mean_angle: Column, max_angle: Column, n_views: Column) -> Column:
    """From the angles of all pairs of views in degrees; 0.35 with fewer than two views."""
    return F.when(n_views <= 1, F.lit(0.35)).otherwise(clip01(0.65 * mean_angle / 25 + 0.35 * max_angle / 45))


def view_compatibility(view: Column, mean_direction: Column, low: Column, high: Column, stored: Column | None = None) -> Column:
    """Best cosine to the stored directions if there are any, else the cosine to the mean with a signed overflow beyond the envelope."""
    c = vec.dot(view, mean_direction)
    envelope = F.when(c < low, c - low).when(c > high, high - c).otherwise(c)
    known = envelope if stored is None else F.when(F.size(stored) > 0, vec.best_dot(view, stored)).otherwise(envelope)
    return F.when(view.isNull() | (vec.norm(view) <= vec.EPS), 0.0).otherwise(known)


def geometry_gate(error: Column, in_front: Column, has_prior: Column, edge: float = 60.0) -> Column:
    """0 without a pose prior; -1 behind the camera or beyond `edge` pixels; else 1 - error / edge."""
    return F.when(~has_prior, 0.0).when(~in_front | (error > edge), -1.0).otherwise(1 - error / edge)


def auxiliary(static: Column, view: Column, geometry: Column, w: Weights = Weights()) -> Column:
    return w.l3 * static + w.l4 * view + w.l5 * geometry


def residual(offset2: Column, coefficients: Column | None = None) -> Column:
    """Squared distance to the landmark's subspace: |d|^2 less the squared coefficients in an orthonormal basis."""
    if coefficients is None:
        return offset2
    return F.greatest(F.lit(0.0), offset2 - vec.dot(coefficients, coefficients))


def sigma_or_fallback(sigma2: Column, spread: Column, dim: int, eps: float = 1e-6) -> Column:
    other = spread * spread / dim
    return F.when(sigma2 > eps, sigma2).when(other > eps, other).otherwise(1.0)


def parallel_term(coefficients: Column, eigenvalues: Column, eps: float = 1e-6) -> Column:
    return F.coalesce(F.aggregate(F.zip_with(vec.doubles(coefficients), vec.doubles(eigenvalues), lambda c, e: c * c / (e + eps)), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))


def coarse_residual(res: Column, cosine: Column, aux: Column, geometry: Column, w: Weights = Weights()) -> Column:
    return F.when(geometry < -0.5, GATED).otherwise(-w.l1 * res + w.l2 * cosine + aux)


def coarse_ppca(parallel: Column, perpendicular: Column, cosine: Column, aux: Column, geometry: Column, n_obs: Column, w: Weights = Weights()) -> Column:
    wp = 0.5 * w.l1 if w.parallel is None else w.parallel
    wo = w.l1 if w.perpendicular is None else w.perpendicular
    return F.when(geometry < -0.5, GATED).otherwise(-wp * parallel - wo * perpendicular + w.l2 * cosine + aux + w.support * F.log1p(F.greatest(n_obs, F.lit(0))))


def fine(similarity: Column, aux: Column, n_obs: Column, weight: float = 1.0, support: float = 0.0, coarse: Column | None = None, coarse_weight: float = 0.0) -> Column:
    out = weight * similarity + aux + support * F.log1p(F.greatest(n_obs, F.lit(0)))
    return out if coarse is None else out + coarse_weight * coarse


def compact(cosine: Column, parallel: Column, perpendicular: Column, static: Column, support: Column, view: Column, fine_sim: Column) -> Column:
    """The compact matcher's score; its weights are fixed values."""
    return cosine - 0.25 * parallel - 0.5 * perpendicular + 0.15 * static + 0.05 * F.log1p(support) + 0.15 * view + 0.35 * fine_sim


def in_envelope(c: Column, low: Column, high: Column) -> Column:
    """1 inside the view envelope, less the overflow on either side."""
    inside = F.when((c >= low) & (c <= high), 1.0).otherwise(0.0)
    return inside - (F.greatest(F.lit(0.0), low - c) + F.greatest(F.lit(0.0), c - high))
