"""Components within a task: labels of numbered members, merged by arrays of links."""

from __future__ import annotations

import numpy as np


class Forest:
    """Components of members 0 to size - 1, each named by its first."""

    def __init__(self, size: int):
        self.label = np.arange(size)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            low, high = self.label[a], self.label[b]
            apart = low != high
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            low, high = np.minimum(low, high)[apart], np.maximum(low, high)[apart]
            np.minimum.at(self.label, high, low)
            while True:  # every member names the top of its component
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """One link from the first of each component to each other member."""
        rest = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.label[rest], rest
