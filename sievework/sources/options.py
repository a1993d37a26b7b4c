"""Parsers of options given as text."""

from __future__ import annotations


def flag(text: str) -> bool:
    """true for 1, true, t, yes, y, on in any case; false for the opposites; else ValueError."""
    low = text.strip().lower()
    if low in ("1", "true", "t", "yes", "y", "on"):
        return True
    if low in ("0", "false", "f", "no", "n", "off"):
        return False
    raise ValueError(f"no boolean: {text!r}")


def names(text: str) -> list[str]:
    return [x for part in text.split(",") if (x := part.strip())]


def scales(text: str) -> list[tuple[str, float]]:
    """`name=value,name=value`; ValueError names the part that can't be read."""
    out = []
    for part in names(text):
        k, eq, v = part.partition("=")
        try:
            out.append((k.strip(), float(v)))
        except ValueError:
            eq = ""
        if not eq or not k.strip():
            raise ValueError(f"no name=value: {part!r}")
    return out


def numbers(text: str) -> list[float]:
    return [float(x) for x in names(text)]


def folder_of(value: float) -> str:
    """A folder name of a number: 0.0500 becomes lambda_0p05."""
    return "lambda_" + f"{value:.6f}".rstrip("0").rstrip(".").replace(".", "p").replace("-", "m")
