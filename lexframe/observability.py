"""Timings of stages and log lines as JSON."""

from __future__ import annotations

import json
import logging
import sys
import time
from collections.abc import Iterator
from contextlib import contextmanager

_OWN = set(logging.makeLogRecord({}).__dict__) | {"message", "asctime"}


class Timings(dict):
    """Stage -> milliseconds, one decimal; stages entered more than once add up. Spark is lazy: a stage's time is that of the
    work done inside it, so measure around an action."""

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self[name] = round(self.get(name, 0.0) + 1000 * (time.perf_counter() - began), 1)


class JsonLines(logging.Formatter):
    """Time, level, logger, message and whatever was passed as ``extra``."""

    def format(self, record: logging.LogRecord) -> str:
        line = {"ts": self.formatTime(record, "%Y-%m-%dT%H:%M:%S%z"), "level": record.levelname.lower(), "logger": record.name, "event": record.getMessage()}
        line |= {k: v for k, v in record.__dict__.items() if k not in _OWN}
        if record.exc_info:
            line["exception"] = self.formatException(record.exc_info)
        return json.dumps(line, ensure_ascii=False, default=str)


def log_json(level: str = "INFO") -> None:
    """Sends the log to standard error, a JSON object a line."""
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(JsonLines())
    root = logging.getLogger("lexframe")
    root.handlers, root.propagate = [handler], False
    root.setLevel(level.upper())
