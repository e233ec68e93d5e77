"""A small unit algebra: a factor and exponents of length, mass, time and temperature.

Units live beside a snapshot's columns; conversions become literal factors, so Catalyst sees
plain doubles.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from fractions import Fraction

# SI factors, and exponents of m, kg, s, K.
_L, _M, _T, _K, _0 = (1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (0, 0, 0, 0)
KNOWN = {
    "m": (1.0, _L), "cm": (1e-2, _L), "km": (1e3, _L), "au": (1.495978707e11, _L), "pc": (3.0856775814913673e16, _L), "kpc": (3.0856775814913673e19, _L), "Mpc": (3.0856775814913673e22, _L),
    "kg": (1.0, _M), "g": (1e-3, _M), "Msol": (1.98840987e30, _M),
    "s": (1.0, _T), "yr": (3.15576e7, _T), "Myr": (3.15576e13, _T), "Gyr": (3.15576e16, _T), "day": (86400.0, _T),
    "K": (1.0, _K), "rad": (1.0, _0), "1": (1.0, _0),
    "G": (6.6743e-11, (3, -1, -2, 0)),
}


@dataclass(frozen=True)
class Unit:
    factor: float
    dims: tuple[Fraction, ...]
    text: str = ""

    @classmethod
    def parse(cls, text: str | Unit) -> Unit:
        """``"km s^-1"``, ``"Msol kpc**-3"``, ``"30 kpc"`` or ``"kpc / Gyr"``."""
        if isinstance(text, Unit):
            return text
        factor, dims, sign = 1.0, [Fraction(0)] * 4, 1
        for word in re.sub(r"([*/])(?!\*)(?<!\*\*)", r" \1 ", text.replace("**", "^")).split():
            if word == "/":
                sign = -1
                continue
            if word == "*":
                continue
            try:
                factor *= float(word) ** sign
            except ValueError:
                m = re.fullmatch(r"([A-Za-z]+)(?:\^(-?[\d./]+))?", word)
                if not m or m[1] not in KNOWN:
                    raise ValueError(f"unknown unit {word!r} in {text!r}") from None
                power = sign * Fraction(m[2] or 1)
                f, d = KNOWN[m[1]]
                factor *= f ** float(power)
                dims = [a + power * b for a, b in zip(dims, d, strict=True)]
            sign = 1
        return cls(factor, tuple(map(Fraction, dims)), text)

    def __mul__(self, other: Unit) -> Unit:
        return Unit(self.factor * other.factor, tuple(a + b for a, b in zip(self.dims, other.dims, strict=True)), f"{self.text} {other.text}".strip())

    def __truediv__(self, other: Unit) -> Unit:
        return self * other**-1

    def __pow__(self, power: int | float | Fraction) -> Unit:
        p = Fraction(power).limit_denominator(64)
        return Unit(self.factor ** float(p), tuple(a * p for a in self.dims), f"({self.text})^{p}")

    def ratio(self, other: str | Unit) -> float:
        """How many ``other`` one of these is."""
        other = Unit.parse(other)
        if self.dims != other.dims:
            raise ValueError(f"{self.text or self.dims} is not convertible to {other.text or other.dims}")
        return self.factor / other.factor

    def latex(self) -> str:
        return r"\mathrm{" + re.sub(r"\^(-?\d+)", r"^{\1}", self.text) + "}"


def in_units(value: float | int | str | Unit, target: str | Unit | None) -> float:
    """A number in ``target``. A bare number is taken to be in it already; text and units are converted."""
    if isinstance(value, (int, float)):
        return float(value)
    if target is None:
        raise ValueError(f"{value!r} has a unit, and the field has none")
    return Unit.parse(value).ratio(target)


def gravity_constant(length: str, mass: str, velocity: str) -> float:
    """G in velocity^2 length / mass."""
    return Unit.parse("G").ratio(Unit.parse(velocity) ** 2 * Unit.parse(length) / Unit.parse(mass))


def is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and not (isinstance(value, float) and math.isnan(value))
