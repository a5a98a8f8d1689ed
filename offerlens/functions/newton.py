"""Small numeric steps of a logistic fit, on the sufficient statistics of a group."""

import math

import numpy as np

# Stopping rule of the fit, ridge added to the mean Hessian, and the normal quantile
# of a 95 % interval.
MAX_STEPS = 35
TOLERANCE = 1e-8
RIDGE = 1e-10
Z_95 = 1.959963984540054

# Eigenvalue of the correlation-scaled design below which columns depend on each other.
_SINGULAR = 1e-10

# What may remain of the start's information before a group counts as separated. Where an outcome
# is separated each step divides the information of some direction by about e, without end, so
# every such group gets here. A proper fit would need fitted chances below one in a million along
# a whole direction. The bound is far above rounding, so the order of the rows cannot decide.
SEPARATED = 1e-6


def _scaled(information: np.ndarray, scale: np.ndarray) -> float:
    """Smallest eigenvalue after scaling."""
    return float(np.linalg.eigvalsh(information * np.outer(scale, scale))[0])


def start_scale(information: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Scale and smallest eigenvalue of the design at the start; None if its columns are dependent."""
    diagonal = np.diag(information)
    if not np.all(diagonal > 0):
        return None
    scale = 1 / np.sqrt(diagonal)
    least = _scaled(information, scale)
    return None if least < _SINGULAR else (scale, least)


def is_separated(information: np.ndarray, scale: np.ndarray, least: float) -> bool:
    """True when some direction has lost nearly all the information that it had at the start."""
    return not np.all(np.isfinite(information)) or _scaled(information, scale) < SEPARATED * least


def step(
    beta: np.ndarray, gradient: np.ndarray, information: np.ndarray, n: float
) -> tuple[np.ndarray, bool]:
    """One Newton step on the mean log-likelihood, and whether it was within the tolerance."""
    curvature = information / n - RIDGE * np.eye(len(beta))
    change = np.linalg.solve(curvature, gradient / n)
    return beta + change, bool(np.max(np.abs(change)) <= TOLERANCE)


def inference(
    beta: np.ndarray, information: np.ndarray, at: int, n: float, wins: float, log_lik: float
) -> dict:
    """Coefficient, Wald p-value, odds ratio with interval, and pseudo R-squared."""
    variance = np.linalg.inv(information)[at, at]
    coef, error = float(beta[at]), math.sqrt(variance)
    share = wins / n
    null_log_lik = wins * math.log(share) + (n - wins) * math.log(1 - share)
    with np.errstate(over="ignore"):
        ratio, low, high = np.exp([coef, coef - Z_95 * error, coef + Z_95 * error])
    return {
        "was_picked_coef": coef,
        "was_picked_pvalue": math.erfc(abs(coef / error) / math.sqrt(2)),
        "odds_ratio": float(ratio),
        "odds_ratio_ci_low": float(low),
        "odds_ratio_ci_high": float(high),
        "pseudo_r2": 1 - log_lik / null_log_lik,
    }
