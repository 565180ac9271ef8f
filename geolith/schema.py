"""Column conventions shared by the operators.

Points have coordinates x, y, z (double), a key of their own, and a tile id once they are tiled. Boxes are
six numbers (xmin, xmax, ymin, ymax, zmin, zmax). A mass is a triple e (empty), o (occupied), u (unknown)
that sums to one.
"""

from __future__ import annotations

from dataclasses import dataclass

AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Box:
    """Axis-aligned box, lower bounds and upper bounds by axis."""

    low: tuple[float, ...]
    high: tuple[float, ...]

    @property
    def axes(self) -> tuple[str, ...]:
        return AXES[: len(self.low)]

    @classmethod
    def parse(cls, text: str) -> Box:
        """'0000x10000:0000x10000' or '0 10000 0 10000': lower and upper bound of each axis."""
        numbers = [float(v) for v in text.replace(":", " ").replace("x", " ").split()]
        if not numbers or len(numbers) % 2:
            raise ValueError(f"not a box: {text!r}")
        return cls(tuple(numbers[::2]), tuple(numbers[1::2]))
