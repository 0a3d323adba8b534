"""Errors raised on the driver. Bad rows never raise: they carry a reject reason instead."""


class EngineError(Exception):
    """Base of every error raised here."""


class ConfigError(EngineError, ValueError):
    """A policy, rule or setting that cannot be used."""


class UsageError(EngineError, RuntimeError):
    """A call that makes no sense as made."""


class CelError(ConfigError):
    """A predicate that does not parse or cannot be compiled."""


class PolicyViolation(EngineError):
    """At least one call was blocked where none may be."""


class EvaluationFailed(EngineError):
    """At least one call's rules could not be evaluated under enforce."""


class ApprovalDenied(EngineError):
    """At least one call that needs approval was not released."""
