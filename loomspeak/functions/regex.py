"""Patterns with one meaning on the JVM whatever the script: word, blank and boundary classes spelled out."""

from __future__ import annotations

import re

WORD = r"\p{L}\p{N}_"
BLANK = r"\s\x1c-\x1f"
EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
_TOKEN = re.compile(r"\\.|\[\^?\]?|\]|.", re.S)


def java(pattern: str, ignore_case: bool = False) -> str:
    r"""The Java form of a pattern in which \w, \s and \b are meant for all scripts."""
    out, inside = [], False
    for token in _TOKEN.findall(pattern):
        if token.startswith("[") and not inside:
            inside = True
            out.append(token)
        elif token == "]" and inside:
            inside = False
            out.append(token)
        elif token == "[" and inside:
            out.append(r"\[")
        elif token == r"\w":
            out.append(WORD if inside else f"[{WORD}]")
        elif token == r"\W":
            out.append(f"[^{WORD}]")
        elif token == r"\s":
            out.append(BLANK if inside else f"[{BLANK}]")
        elif token == r"\b":
            out.append(EDGE)
        else:
            out.append(token)
    return ("(?Udi)" if ignore_case else "(?Ud)") + "".join(out)


def any_of(patterns: tuple[str, ...] | list[str]) -> str:
    """Whole-word alternation."""
    return r"\b(?:" + "|".join(patterns) + r")\b"
