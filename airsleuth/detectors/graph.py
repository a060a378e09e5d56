"""Which signals hang together: a graph from the sparse inverse covariance, and averages over neighbours."""

from __future__ import annotations

import numpy as np

#: Penalty of the inverse covariance's entries; larger ones leave fewer edges.
PENALTY = 0.1


def sparse_inverse(covariance: np.ndarray, penalty: float = PENALTY, rounds: int = 100, tolerance: float = 1e-5) -> np.ndarray:
    """The inverse covariance with an L1 penalty (graphical lasso, by columns)."""
    n = len(covariance)
    estimate = covariance + penalty * np.eye(n)
    betas = np.zeros((n, n - 1))
    for _ in range(rounds):
        before = estimate.copy()
        for j in range(n):
            others = np.arange(n) != j
            inner, target, beta = estimate[np.ix_(others, others)], covariance[others, j], betas[j]
            for _ in range(rounds):
                last = beta.copy()
                for i in range(n - 1):
                    rest = target[i] - inner[i] @ beta + inner[i, i] * beta[i]
                    beta[i] = np.sign(rest) * max(abs(rest) - penalty, 0.0) / inner[i, i]
                if np.abs(beta - last).max(initial=0) < tolerance:
                    break
            estimate[others, j] = estimate[j, others] = inner @ beta
        if np.abs(estimate - before).max() < tolerance:
            break
    inverse = np.zeros((n, n))
    for j in range(n):
        others = np.arange(n) != j
        inverse[j, j] = 1 / (estimate[j, j] - estimate[others, j] @ betas[j])
        inverse[others, j] = -betas[j] * inverse[j, j]
    return (inverse + inverse.T) / 2


def adjacency(covariance: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Weights of each signal's neighbours, which sum to 1; a signal is its own only neighbour if it has no other.

    Edges are the sizes of partial correlations that the penalty leaves.
    """
    inverse = sparse_inverse(covariance, penalty)
    scale = np.sqrt(np.outer(np.diag(inverse), np.diag(inverse)))
    edges = np.abs(inverse / scale)
    edges[edges < 1e-6] = 0
    np.fill_diagonal(edges, 0)
    edges[edges.sum(axis=1) == 0, edges.sum(axis=1) == 0] = 1
    return edges / edges.sum(axis=1, keepdims=True)
