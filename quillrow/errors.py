"""Exceptions, and the record of a row that failed."""

from __future__ import annotations

from dataclasses import dataclass


class EnrichmentError(Exception):
    """Base of all errors raised here; may name the row and the field."""

    def __init__(self, message: str, row_index: int | None = None, field: str | None = None):
        super().__init__(message)
        self.message, self.row_index, self.field = message, row_index, field


class FieldValidationError(EnrichmentError):
    """A field definition, or the file it comes from, is wrong."""


class ConfigurationError(EnrichmentError):
    """A setting has an impossible value."""


class PipelineError(EnrichmentError):
    """Steps don't form a runnable graph, or are used wrongly."""


class StepError(EnrichmentError):
    """A step failed."""

    def __init__(self, message: str, step_name: str | None = None, row_index: int | None = None, field: str | None = None):
        super().__init__(message, row_index, field)
        self.step_name = step_name


@dataclass(frozen=True)
class RowError:
    """One failed (row, step); ``error_type`` is the exception's class name."""

    row_index: int
    step_name: str
    error: str
    error_type: str
