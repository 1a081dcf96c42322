"""The one error type of the engine; it carries a fixed code, never data."""

from __future__ import annotations


class EngineError(Exception):
    """Raised for refused operations; ``code`` is stable, ``args`` hold only it."""

    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code
