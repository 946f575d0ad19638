"""Coded errors.  The codes are an external contract and equal in every implementation (fixed values)."""

from __future__ import annotations


class Coded(Exception):
    """An error with a stable code and named arguments."""

    def __init__(self, code: str, **args: object):
        self.code, self.args_ = code, args
        super().__init__(f"{code}: " + ", ".join(f"{k}={one_line(v)}" for k, v in args.items()))


def one_line(value: object, most: int = 200) -> str:
    """An argument bounded to one line of ``most`` characters."""
    text = " ".join(str(value).split())
    return text if len(text) <= most else text[: most - 1] + "…"


def first_code(error: BaseException) -> str:
    """The first code along the chain of causes; a failure without one is a failed job."""
    seen: set[int] = set()
    at: BaseException | None = error
    while at is not None and id(at) not in seen:
        if isinstance(at, Coded):
            return at.code
        for code in ("transform.expression-failed", "connector.write-failed", "capture.event-table-not-selected", "transform.script-failed"):
            if f"{code}: " in str(at):  # raised inside a task, the code travels in the message
                return code
        seen.add(id(at))
        at = at.__cause__ or at.__context__
    return "engine.job-failed"
