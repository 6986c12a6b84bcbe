"""Log lines as JSON objects: level, ts, msg, and any further fields of a record."""

from __future__ import annotations

import json
import logging
import sys
from datetime import UTC, datetime

_OWN = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime", "taskName"}


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        ts = datetime.fromtimestamp(record.created, UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
        more = {k: v for k, v in vars(record).items() if k not in _OWN}
        return json.dumps({"level": record.levelname.lower(), "ts": ts, "msg": record.getMessage(), **more}, default=str)


def logger(name: str = "quiver") -> logging.Logger:
    """The library's logger; without handlers of its own it is quiet unless the application configures logging."""
    return logging.getLogger(name)


def to_stderr(level: int = logging.INFO) -> logging.Handler:
    """Send the library's log to standard error as JSON lines."""
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(JsonLines())
    logger().addHandler(handler)
    logger().setLevel(level)
    return handler
