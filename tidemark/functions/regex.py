"""Python regular expressions as Java ones."""

from __future__ import annotations

import re


def to_java(pattern: str, ignore_case: bool = False, fixed: bool = False) -> str:
    """Classes are Unicode-aware as in Python, named groups and references use Java's spelling; ``fixed`` quotes the text."""
    if fixed:
        return ("(?i)" if ignore_case else "") + "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    re.compile(pattern)  # a malformed pattern fails on the driver, with Python's message
    body = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', 'U95')}>", pattern))
    return ("(?Ui)" if ignore_case else "(?U)") + body


def literal(replacement: str) -> str:
    """A replacement text without group references."""
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def template(replacement: str) -> str:
    r"""A replacement with Python's references (\1, \g<name>) in Java's spelling."""
    return re.sub(r"\\(\d+)|\\g<(\w+)>", lambda m: f"${m[1]}" if m[1] else ("$" + m[2] if m[2].isdigit() else "${" + m[2] + "}"), replacement.replace("$", "\\$"))
