"""Claims of two converging streams over a commit linearization, on the driver: a handful of intervals.

The set form of the same thing is :func:`factloom.operators.intervals.coalesce` and ``frontier_gap``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

AUTHORITATIVE, PROVISIONAL = "authoritative", "provisional"


@dataclass
class Frontier:
    """Positions ``0 … total - 1``; the low side claims upwards for good, the high side downwards on trial."""

    total: int
    spans: dict[str, list[tuple[int, int]]] = field(default_factory=lambda: {AUTHORITATIVE: [], PROVISIONAL: []})

    def add(self, tag: str, lo: int, hi: int) -> None:
        """Take in an interval, merged with those of its tag that it overlaps or touches."""
        out: list[tuple[int, int]] = []
        for a, b in sorted([*self.spans[tag], (lo, hi)]):
            if out and a <= out[-1][1] + 1:
                out[-1] = (out[-1][0], max(out[-1][1], b))
            else:
                out.append((a, b))
        self.spans[tag] = out

    def _at(self, pos: int) -> tuple[int, int] | None:
        return next((s for spans in self.spans.values() for s in spans if s[0] <= pos <= s[1]), None)

    @property
    def gap(self) -> tuple[int, int]:
        """The first and last unclaimed position between both sides; empty if the first is larger."""
        low, high = self._at(0), self._at(self.total - 1)
        return (low[1] + 1 if low else 0), (high[0] - 1 if high else self.total - 1)

    def claim(self, tag: str) -> int | None:
        lo, hi = self.gap
        if lo > hi:
            return None
        pos = lo if tag == AUTHORITATIVE else hi
        self.add(tag, pos, pos)
        return pos


def ratio(text: str | None) -> tuple[int, int]:
    """``F:R`` as positive numbers; anything else is one to one."""
    parts = (text or "").split(":")
    if len(parts) == 2 and all(p.strip().isdigit() and int(p) > 0 for p in parts):
        return int(parts[0]), int(parts[1])
    return 1, 1
