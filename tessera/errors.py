"""Errors with a class, and a place in the statement where there is one."""

from __future__ import annotations

#: The classes of errors.
CODES = ("Internal", "Syntax", "Binder", "Catalog", "Type", "Execution", "Io", "Corruption", "NotImplemented")


class EngineError(Exception):
    def __init__(self, code: str, message: str, at: int | None = None):
        assert code in CODES
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.at = code, message, at

    def pointed(self, sql: str) -> str:
        """The message, with the line of the statement and a caret below the place."""
        if self.at is None:
            return str(self)
        begin = sql.rfind("\n", 0, self.at) + 1
        end = sql.find("\n", self.at)
        line = sql[begin : len(sql) if end < 0 else end]
        return f"{self}\nLINE {sql.count(chr(10), 0, begin) + 1}: {line}\n{' ' * (len(f'LINE {sql.count(chr(10), 0, begin) + 1}: ') + self.at - begin)}^"


def from_spark(error: Exception) -> EngineError:
    """The engine's view of an error that Spark raised while it analysed or ran a query."""
    text = str(error)
    condition = getattr(error, "getCondition", lambda: None)() or ""
    first = text.strip().split("\n")[0][:500]
    if condition.startswith(("UNSUPPORTED_SUBQUERY", "UNSUPPORTED_FEATURE", "NOT_SUPPORTED")) or "UNSUPPORTED_SUBQUERY" in text:
        return EngineError("NotImplemented", first)
    if type(error).__name__ in ("AnalysisException", "ParseException"):
        return EngineError("Binder", first)
    if condition.startswith("CAST_") or "CAST_INVALID_INPUT" in text or "CAST_OVERFLOW" in text:
        return EngineError("Type", first)
    return EngineError("Execution", first)
