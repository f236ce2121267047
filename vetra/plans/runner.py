"""Ordered steps with resume: each hands over through stored tables, so a run can begin at any of them."""

from __future__ import annotations

from collections.abc import Callable


def run_steps(steps: dict[str, Callable[[], int | None]], start: str | None = None) -> list[str]:
    """Run ``steps`` in order from ``start``; stop at the first that returns other than 0 or None."""
    names = list(steps)
    if start is not None and start not in steps:
        raise ValueError(f"no step {start}; steps: {', '.join(names)}")
    done = []
    for name in names[names.index(start) if start else 0 :]:
        if code := steps[name]():
            raise RuntimeError(f"{name} returned {code}")
        done.append(name)
    return done
