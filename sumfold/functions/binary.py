"""Binary digits of whole numbers, least significant first."""

from __future__ import annotations


def log2_exact(n: int) -> int | None:
    """The exponent if ``n`` is a power of two, else None."""
    return n.bit_length() - 1 if n > 0 and n & (n - 1) == 0 else None


def digits(n: int, width: int | None = None) -> list[int]:
    """Binary digits of ``n``; with ``width``, filled with zeroes up to it."""
    if n < 0 or width is not None and n >> width:
        raise ValueError(f"{n} has no {width} binary digits")
    return [n >> i & 1 for i in range(max(1, n.bit_length()) if width is None else width)]
