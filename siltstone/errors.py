"""Errors with stable codes."""

CODES = frozenset(
    "config conflict corruption internal invalid_credentials invalid_request io limit_exceeded not_found not_leader "
    "protocol query_timeout schema_violation storage transaction_timeout unauthenticated unique_violation unsupported".split()
)


class EngineError(Exception):
    """``code`` is one of ``CODES``."""

    def __init__(self, code: str, message: str):
        assert code in CODES, code
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message


def invalid(message: str) -> EngineError:
    return EngineError("invalid_request", message)
