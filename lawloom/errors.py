"""Failures, each with a stable code as the first word of its message."""

from __future__ import annotations


class CorpusError(Exception):
    """Tampering or an unavailable input or output (exit code 3)."""


class InputError(CorpusError):
    """A source or an option that is refused (exit code 2)."""


class DiagnosticsError(InputError):
    """A corpus with diagnostics; ``diagnostics`` holds (code, subject, detail) rows."""

    def __init__(self, message: str, diagnostics: list | None = None):
        super().__init__(message)
        self.diagnostics = diagnostics or []
