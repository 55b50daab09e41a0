"""The control plane: which way to go, by configuration, capability, sizes and timed probes. Nothing here reads rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from quire.plans.ladder import run_ladder

# fixed values: the defaults for batches, the page count from which a probe pays, and the seconds it may take
DEFAULT_BATCH = {"accelerator": 32, "cpu": 8}
PROBE_PAGES = 20
PROBE_SECONDS = 60
CANDIDATES = (1, 2, 4, 8, 16, 32, 64)
PROVIDERS = ("CUDA", "DirectML", "CPU")  # best first
GRAY_MODES = ("none", "plain", "classic", "model")
UNATTENDED_FROM = 5  # files above which unattended work is offered


@dataclass
class Probe:
    batch: int
    patches: int
    seconds: float

    @property
    def per_patch(self) -> float:
        return self.seconds / max(self.patches, 1)


def probe_batches(run: Callable[[int], None], patches: int, candidates: Iterable[int] = CANDIDATES, most: float = PROBE_SECONDS, clock: Callable[[], float] = time.monotonic) -> list[Probe]:
    """Time run(batch) for every candidate that the patches fill, after one run that warms up; no new candidate after most seconds."""
    fitting = [c for c in candidates if c <= patches]
    out: list[Probe] = []
    if not fitting:
        return out
    run(fitting[0])
    began = clock()
    for batch in fitting:
        if clock() - began > most:
            break
        at = clock()
        run(batch)
        out.append(Probe(batch, batch, clock() - at))
    return out


def best_batch(probes: list[Probe], device: str = "cpu") -> int:
    """The batch with the least time a patch, the first of equals; the default without probes."""
    return min(probes, key=lambda p: p.per_patch).batch if probes else DEFAULT_BATCH["cpu" if device == "cpu" else "accelerator"]


def should_probe(pages: int) -> bool:
    return pages > PROBE_PAGES


def provider(available: Iterable[str]) -> str:
    there = set(available)
    return next((p for p in PROVIDERS if p in there), "CPU")


def gray_mode(wanted: str | None, capable: bool) -> str:
    """The way to make pages gray: none unless asked for; the model's only where its files are there, else the classic one."""
    mode = wanted if wanted in GRAY_MODES else "none"
    return "classic" if mode == "model" and not capable else mode


def capable(needed: Iterable[str], there: Iterable[str]) -> tuple[bool, list[str]]:
    """Whether all files that a feature needs are there, and which aren't."""
    missing = sorted(set(needed) - set(there))
    return not missing, missing


def unattended(files: int, answer: Callable[[], str] | None) -> bool:
    """Offered for more than UNATTENDED_FROM files; no answer (end of input) means yes."""
    if files <= UNATTENDED_FROM:
        return False
    try:
        return (answer() if answer else "").strip().lower() in ("", "y", "yes")
    except EOFError:
        return True


@dataclass
class Outcome:
    kind: str  # small at first, small after lossless, lossy, still large
    size: int
    rows: list = field(default_factory=list)


class Ladder:
    """A whole file's way: nothing if it is small, the lossless step, then steps with loss until it is small."""

    def __init__(self, lossless: Callable[[DataFrame], DataFrame], steps: list, measure: Callable[[DataFrame], int], limit: int, floor: int = 10_486):
        self.lossless, self.steps, self.measure, self.limit, self.floor = lossless, steps, measure, limit, floor

    def run(self, start: DataFrame) -> tuple[DataFrame, Outcome]:
        """The accepted snapshot and what came of it. Snapshots that aren't kept are dropped from the cache."""
        size = self.measure(start)
        if size <= self.limit:
            return start, Outcome("small at first", size, [(0, "start", size, True)])
        clean = self.lossless(start).persist()
        less = self.measure(clean)
        if not self.floor < less < size:
            clean.unpersist()
            clean, less = start, size
        if less <= self.limit:
            return clean, Outcome("small after lossless", less, [(0, "start", size, True), (0, "lossless", less, less < size)])
        now, rows = run_ladder(clean, self.steps, self.measure, self.limit, self.floor)
        last = next(r[2] for r in reversed(rows) if r[3])
        return now, Outcome("lossy" if last <= self.limit else "still large", last, [(0, "start", size, True), *rows])
