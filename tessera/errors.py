"""Errors by class, so that callers can tell a bad request from a failed one."""

from __future__ import annotations


class EngineError(Exception):
    """Any error of this package."""


class InvalidInput(EngineError):
    pass


class InvalidPath(InvalidInput):
    pass


class NotFound(EngineError):
    pass


class AlreadyExists(EngineError):
    pass


class Conflict(EngineError):
    """Someone else changed what a write was based on."""


class PermissionDenied(EngineError):
    pass


class QuotaExceeded(EngineError):
    pass


class Storage(EngineError):
    pass
