"""Regex fragments shared by the column builders.

Spark evaluates regexes with java.util.regex.  The reference's rules use
Python's ``re`` on ``str``, whose ``\\s`` and ``\\b`` are Unicode-aware; ``(?U)``
gives Java the same classes, and Python's whitespace also covers U+001C..U+001F.
"""

from __future__ import annotations

# Python str whitespace (str.isspace / re \s), as a Java character class.
PY_WS_CLASS = r"[\s\x{1c}-\x{1f}]"
PY_WS_RUN = r"(?U)" + PY_WS_CLASS + "+"
PY_WS_EDGES = r"(?U)^" + PY_WS_CLASS + "+|" + PY_WS_CLASS + "+$"

_META = set("\\.^$|?*+()[]{}")


def escape(term: str) -> str:
    """Escape regex metacharacters; valid for both Java regex and RE2."""
    return "".join("\\" + ch if ch in _META else ch for ch in term)
