"""All registered queries and their SQL."""

from __future__ import annotations

from quillon.plans import bodies, contracts, detection, privacy, runs, sinks, streams, texts

_MODULES = (detection, privacy, texts, contracts, runs, sinks, streams, bodies)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
