"""Errors that a statement can end in."""


class EngineError(Exception):
    """A statement was refused or failed; the message says why."""


class ParseError(EngineError):
    pass


class ConflictError(EngineError):
    """Another writer committed first, or a version isn't newer than the live one."""


def quoted(name: str) -> str:
    return '"' + name.replace("\\", "\\\\").replace('"', '\\"') + '"'
