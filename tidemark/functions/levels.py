"""Severity levels of log lines, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities from low to high, and other spellings of them.
SEVERITY = {"debug": 0, "info": 1, "notice": 2, "warning": 3, "error": 4, "critical": 5, "fatal": 6}
ALIASES = {"warn": "warning", "err": "error", "crit": "critical"}
#: What statistics count; spellings are told apart there.
COUNTED = ("DEBUG", "INFO", "NOTICE", "WARNING", "WARN", "ERROR", "CRITICAL", "FATAL")


def canonical(level: str) -> str:
    return ALIASES.get(level.lower(), level.lower())


def severity(level: str) -> int:
    return SEVERITY.get(canonical(level), -1)


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def extract(line: Column) -> Column:
    """The first level named in the line, in lower case and one spelling; null if none."""
    found = F.lower(F.regexp_extract(line, r"(?i)\b(debug|info|notice|warning|warn|error|err|critical|crit|fatal)\b", 1))
    return F.when(found != "", F.coalesce(F.try_element_at(_map(ALIASES), found), found))


def severity_of(level: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(SEVERITY), level), F.lit(-1))


def counted(line: Column) -> Column:
    """The level as statistics count it: upper case, spelling kept; null if none."""
    found = F.upper(F.regexp_extract(line, rf"(?i)\b({'|'.join(COUNTED)})\b", 1))
    return F.when(found != "", found)
