"""Errors with exit codes, and the envelope in which commands answer."""

from __future__ import annotations

SCHEMA = "1"


class CommandError(Exception):
    exit_code = 1

    def __init__(self, message: str, subcode: str | None = None) -> None:
        super().__init__(message)
        self.subcode = subcode


class UsageError(CommandError):
    exit_code = 1


class DataError(CommandError):
    exit_code = 2


class DependencyError(CommandError):
    exit_code = 3


class NetworkError(CommandError):
    exit_code = 4


class LibraryError(CommandError):
    exit_code = 5


def subcode_for_status(status: int) -> str:
    return {429: "RATE_LIMITED", 504: "UPSTREAM_TIMEOUT"}.get(status, "UPSTREAM_ERROR" if status >= 500 else "HTTP_ERROR")


def envelope(command: str, data: dict | None = None, warnings: list[str] | None = None, error: CommandError | None = None) -> dict:
    code = error.exit_code if error else 0
    described = None
    if error:
        described = {"code": type(error).__name__, "message": str(error)} | ({"subcode": error.subcode} if error.subcode else {})
    return {"schema": SCHEMA, "ok": error is None, "command": command, "exit_code": code, "data": data or {}, "warnings": warnings or [], "error": described}
