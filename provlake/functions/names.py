"""Names of agents, groups, endorsement kinds and tools: checks on the driver and as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from provlake.errors import ConfigError

DEFAULT_NAMESPACE = "default"
DEFAULT_AGENT = "default"
_NAME = re.compile(r"[A-Za-z0-9_.-]+")
_PART = re.compile(r"[A-Za-z0-9_-]+")


def check_name(value: str, what: str = "agent id") -> str:
    """The name itself, if all its characters are letters, digits, '_', '.' or '-'."""
    if not isinstance(value, str) or not _NAME.fullmatch(value):
        raise ConfigError(f"{what} {value!r} must consist of letters, digits, '_', '.' and '-'")
    return value


def check_group(value: str) -> str:
    return check_name(value, "group")


def check_kind(value: str) -> str:
    return check_name(value, "endorsement kind")


def check_part(value: str, what: str = "namespace or tool") -> str:
    if not isinstance(value, str) or not _PART.fullmatch(value):
        raise ConfigError(f"{what} {value!r} must consist of letters, digits, '_' and '-'")
    return value


def split_tool(value: str) -> tuple[str, str] | None:
    """(namespace, tool) of a name with exactly one dot and both parts valid; else None."""
    parts = value.split(".")
    return (parts[0], parts[1]) if len(parts) == 2 and all(_PART.fullmatch(p) for p in parts) else None


def qualify(tool: Column) -> Column:
    """A bare tool name is one of the default namespace."""
    return F.when(F.instr(tool, ".") == 0, F.concat(F.lit(DEFAULT_NAMESPACE + "."), tool)).otherwise(tool)


def tool_is_valid(tool: Column) -> Column:
    return F.coalesce(qualify(tool).rlike(r"\A[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\z"), F.lit(False))


def name_is_valid(name: Column) -> Column:
    return F.coalesce(name.rlike(r"\A[A-Za-z0-9_.-]+\z"), F.lit(False))


def explicit_agent_is_valid(name: Column) -> Column:
    """For a caller that states its id: the reserved default is not its own to use."""
    return name_is_valid(name) & (name != DEFAULT_AGENT)
