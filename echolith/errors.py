"""Typed errors; in a batch they are rows of (code, message), so one bad input does not fail a job."""

from __future__ import annotations

OK, DECODE, UNSUPPORTED, INVALID, IO, INTERNAL = range(6)
CODES = {"ok": OK, "decode": DECODE, "unsupported": UNSUPPORTED, "invalid": INVALID, "io": IO, "internal": INTERNAL}
_PREFIX = {"decode": "decode error", "unsupported": "unsupported format", "invalid": "invalid input", "io": "io error", "internal": "internal error"}


class SignalError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{_PREFIX[code]}: {message}")
        self.code, self.message = code, message

    @property
    def status(self) -> int:
        return CODES[self.code]

    @classmethod
    def from_status(cls, status: int, message: str | None = None) -> SignalError | None:
        """The error of a status number; None for OK, and an internal one for numbers that stand for nothing."""
        if status == OK:
            return None
        code = next((c for c, n in CODES.items() if n == status), "internal")
        return cls(code, message or "unexpected failure")
