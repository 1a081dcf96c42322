"""A log of operations that can hold nothing but counts and codes."""

from __future__ import annotations

import json
import logging
import re
from logging.handlers import RotatingFileHandler

# The events and fields a line may hold, and how large and many files are.
EVENTS = ("scan", "activation", "query", "failure")
FIELDS = ("operation", "state", "reason", "code", "seconds", "contents", "completed", "partial", "failed", "skipped", "facts", "cached", "generation")
MOST_BYTES, MOST_FILES, LONGEST = 256 * 1024, 3, 64


def clean(value: object) -> object:
    """Numbers as they are; texts reduced to codes of letters, digits, dots, hyphens and underscores."""
    if isinstance(value, bool | int | float) or value is None:
        return value
    return re.sub(r"[^A-Za-z0-9_.-]", "_", str(value))[:LONGEST]


def line(event: str, **fields: object) -> str:
    """One line; unknown events are refused and unknown fields left out."""
    if event not in EVENTS:
        raise ValueError("unknown event")
    return json.dumps({"event": event, **{k: clean(v) for k, v in fields.items() if k in FIELDS}})


def open_log(path: str) -> logging.Logger:
    """A logger that rotates its files."""
    log = logging.Logger("spanline.operations")
    handler = RotatingFileHandler(path, maxBytes=MOST_BYTES, backupCount=MOST_FILES, encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
    log.addHandler(handler)
    return log
