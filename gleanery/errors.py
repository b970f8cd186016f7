"""Errors of the engine. It never falls back silently."""


class EngineError(Exception):
    code = "INTERNAL_ERROR"

    def __init__(self, message: str, hint: str = ""):
        super().__init__(message)
        self.hint = hint


class InvalidArgument(EngineError):
    code = "INVALID_PARAMS"


class PathBlocked(EngineError):
    code = "PATH_BLOCKED"


class PolicyBlocked(EngineError):
    code = "POLICY_BLOCKED"


class SchemaUnsupported(EngineError):
    code = "INDEX_SCHEMA_UNSUPPORTED"


class ContractViolation(EngineError):
    code = "CONTRACT_VIOLATION"
