"""Gated recurrent layers in numpy: forward, backpropagation through time, and an Adam step.

Gates are in the order update z, reset r, candidate n; ``h' = (1 - z) n + z h``. Inputs come in as gate
pre-activations (time, batch, 3 hidden), so a caller with few distinct inputs multiplies each of them once.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def glorot(rng: np.random.Generator, *shape: int) -> np.ndarray:
    return (rng.standard_normal(shape) * (2.0 / (shape[0] + shape[-1])) ** 0.5).astype(np.float32)


def gru_step(gates: np.ndarray, h: np.ndarray, u: np.ndarray) -> np.ndarray:
    """One step without what the backward pass needs; ``gates`` may be overwritten."""
    k = h.shape[1]
    hu = h @ u
    zr = gates[:, : 2 * k]
    zr += hu[:, : 2 * k]
    np.multiply(zr, 0.5, out=zr)
    np.tanh(zr, out=zr)  # sigmoid(x) = (1 + tanh(x / 2)) / 2
    zr += 1
    zr *= 0.5
    n = hu[:, 2 * k :]
    n *= zr[:, k:]
    n += gates[:, 2 * k :]
    np.tanh(n, out=n)
    return n + zr[:, :k] * (h - n)


def gru_forward(gates: np.ndarray, mask: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (time, batch, hidden) and what ``gru_backward`` needs. A masked step keeps the state."""
    steps, batch, k3 = gates.shape
    k = k3 // 3
    h = np.zeros((batch, k), np.float32)
    out, kept = np.empty((steps, batch, k), np.float32), []
    for t in range(steps):
        hu = h @ u
        zr = sigmoid(gates[t, :, : 2 * k] + hu[:, : 2 * k])
        z, r = zr[:, :k], zr[:, k:]
        n = np.tanh(gates[t, :, 2 * k :] + r * hu[:, 2 * k :])
        m = mask[t][:, None]
        new = np.where(m, n + z * (h - n), h)
        kept.append((h, z, r, n, hu[:, 2 * k :], m))
        out[t] = h = new
    return out, kept


def gru_backward(dout: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate pre-activations and of ``u``, given those of all hidden states."""
    steps, batch, k = dout.shape
    dgates, du = np.zeros((steps, batch, 3 * k), np.float32), np.zeros_like(u)
    carry = np.zeros((batch, k), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, n, hn, m = kept[t]
        d = dout[t] + carry
        live = d * m
        dn = live * (1 - z) * (1 - n * n)
        dz = live * (h - n) * z * (1 - z)
        dr = dn * hn * r * (1 - r)
        dgates[t] = np.concatenate([dz, dr, dn], 1)
        dhu = np.concatenate([dz, dr, dn * r], 1)
        du += h.T @ dhu
        carry = dhu @ u.T + live * z + d * ~m
    return dgates, du


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = sum(float((g * g).sum()) for g in grads.values()) ** 0.5
        clip = min(1.0, 5.0 / (norm + 1e-9))
        scale = self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, g in grads.items():
            g = g * clip
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-7)
