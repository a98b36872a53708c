"""A tensor step on matrices in memory: what the operator on tables is tested against."""

import numpy as np


def t_svt(t: np.ndarray, tau: float) -> np.ndarray:
    """Soft threshold of the singular values of each slice of the transform along the last axis."""
    z = np.fft.fft(t, axis=2)
    for i in range(z.shape[2]):
        u, s, vh = np.linalg.svd(z[:, :, i], full_matrices=False)
        z[:, :, i] = (u * np.maximum(s - tau, 0)) @ vh
    return np.fft.ifft(z, axis=2).real
