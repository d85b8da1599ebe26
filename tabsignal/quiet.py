"""Less noise: muted output, and progress lines on demand."""

from __future__ import annotations

import contextlib
import io
import logging
import sys
import warnings
from collections.abc import Iterable, Iterator


@contextlib.contextmanager
def force_silence() -> Iterator[None]:
    """Standard output, standard error, warnings and logging are muted inside; errors still rise."""
    before = logging.root.manager.disable
    with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()), warnings.catch_warnings():
        warnings.simplefilter("ignore")
        logging.disable(logging.CRITICAL)
        try:
            yield
        finally:
            logging.disable(before)


def suppress_library_logs(*names: str, level: int = logging.ERROR) -> None:
    """Raise the level of loggers by name (py4j and pyspark if none are given)."""
    for name in names or ("py4j", "pyspark"):
        logging.getLogger(name).setLevel(level)


def maybe_progress(items: Iterable, show: bool, what: str = "step") -> Iterator:
    """The items; with ``show`` a line to standard error before each."""
    for i, item in enumerate(items):
        if show:
            print(f"{what} {i + 1}", file=sys.stderr)
        yield item


def readiness_text(report: dict) -> str:
    """A readiness report as lines of text."""
    lines = ["ready" if report.get("ready") else "not ready"]
    lines += [f"- {k}: {', '.join(map(str, v)) if isinstance(v, list) else v}" for k, v in report.items() if k != "ready" and v not in ([], None)]
    return "\n".join(lines)
