"""Step verdicts: the six labels, their order of precedence, and which pipelines may speak which.

``verdict`` logs a line and returns whether the step's handler runs: ``applies`` and not banned.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

LOG = logging.getLogger("quern.verdicts")
LABELS = ("BANNED", "OVERRIDE", "ENFORCE", "LIMIT", "APPLIES", "N/A")


@dataclass(frozen=True)
class Verdict:
    label: str
    runs: bool
    message: str

    def __bool__(self) -> bool:
        return self.runs


def verdict(applies: bool, message: str, *, banned: bool = False, override: bool = False, enforce: bool = False, limit: bool = False, allowed: tuple[str, ...] = LABELS) -> Verdict:
    """The first label, in the order of ``LABELS``, whose flag is set; ``allowed`` are the caller's badges."""
    flags = dict(zip(LABELS, (banned, override, enforce, limit, bool(applies), True), strict=True))
    label = next(name for name, on in flags.items() if on)
    if label not in allowed:
        raise ValueError(f"{label} is no badge of this path")
    if label == "N/A" and not any(c.isdigit() for c in message):
        raise ValueError("an N/A must carry a number measured on this run")
    LOG.info("%-8s -- %s", label, message)
    return Verdict(label, bool(applies) and not banned, message)


#: Badges by path; BANNED, APPLIES and N/A belong to all.
CONTINUOUS = ("BANNED", "OVERRIDE", "LIMIT", "APPLIES", "N/A")
CATEGORICAL = ("BANNED", "ENFORCE", "APPLIES", "N/A")
BANDIT = ("BANNED", "OVERRIDE", "APPLIES", "N/A")

TARGET_MISSING_LIMIT = 0.05


def firewall_fires(rate: float) -> bool:
    """Whether the share of missing targets is over the limit (exactly at it does not fire)."""
    return rate > TARGET_MISSING_LIMIT
