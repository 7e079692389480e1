"""Run a workload file against expected answers and time it, batch by batch."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from tallyweave.streaming.protocol import Engine, read_batches

MOST_FAILURES = 100


@dataclass
class Report:
    """Milliseconds over all batches, and the answers that differ: (query, expected, answer)."""

    ms: float = 0.0
    batch_ms: list[float] = field(default_factory=list)
    failures: list[tuple[str, str, str]] = field(default_factory=list)

    @property
    def valid(self) -> bool:
        """A time counts only if every answer was right."""
        return not self.failures


def run_workload(engine: Engine, work: list[str], expected: list[str]) -> Report:
    """Answer the batches of ``work`` one after the other; a batch starts when the one before is answered."""
    report, k = Report(), 0
    for batch in read_batches(work):
        began = time.perf_counter()
        answers = engine.answer_batch(batch)
        report.batch_ms.append(1000 * (time.perf_counter() - began))
        for query, answer in zip(batch, answers, strict=True):
            if answer != expected[k]:
                report.failures.append((query, expected[k], answer))
            k += 1
        if len(report.failures) >= MOST_FAILURES:
            break
    report.ms = sum(report.batch_ms)
    return report
