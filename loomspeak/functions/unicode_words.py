"""Words and terms of multilingual text; pure Python, used inside Arrow batches."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

#: Apostrophes and hyphens that writers use for ' and - inside words.
APOSTROPHES = "‘’‛ʼʹ′＇´`"
HYPHENS = "‐‑﹣－"


@functools.cache
def _classes() -> tuple[str, str, str]:
    """Character classes (bodies for []) of Latin letters, of all word characters, and of invisible characters."""
    import regex

    latin, word, invisible = [], [], []
    is_latin = regex.compile(r"[\p{Script=Latin}&&\p{L}]", regex.V1)
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000:
            continue
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind == "Cf" or code == 0x34F or 0xFE00 <= code <= 0xFE0F:
            invisible.append(code)
        elif kind[0] in "LMN":
            word.append(code)
            if kind[0] == "L" and (code < 0x2C80 or 0xA720 <= code < 0x10800) and is_latin.match(ch):
                latin.append(code)

    def body(codes: list[int]) -> str:
        out, start, last = [], codes[0], codes[0]
        for c in [*codes[1:], None]:
            if c is not None and c == last + 1:
                last = c
                continue
            out.append(f"\\U{start:08x}-\\U{last:08x}" if last > start else f"\\U{start:08x}")
            start = last = c
        return "".join(out)

    return body(latin), body(word), body(invisible)


@functools.cache
def _tools() -> tuple[re.Pattern, re.Pattern, re.Pattern, dict[int, str]]:
    latin, word, invisible = _classes()
    same = {ord(c): "'" for c in APOSTROPHES} | {ord(c): "-" for c in HYPHENS}
    return (
        re.compile(f"[{latin}]+(?:['-][{latin}]+)*"),
        re.compile(f"[{word}]+(?:['-][{word}]+)*"),
        re.compile(f"[{invisible}]"),
        same,
    )


_ASCII_TERM = re.compile("[a-z]+(?:['-][a-z]+)*")
_ASCII_WORD = re.compile("[a-z0-9]+(?:['-][a-z0-9]+)*")


#: Frequent marks that part words, and the frequent apostrophe: without them most texts are ASCII.
_FREQUENT = tuple((c, " ") for c in "“”…—–«»\u00a0\u2009\u202f") + (("’", "'"),)


def plain(text: str) -> str:
    """Lower case, composed, without invisible characters, one kind of apostrophe and hyphen; frequent marks are blanks."""
    if not text.isascii():
        for mark, by in _FREQUENT:
            text = text.replace(mark, by)
    if text.isascii():
        return text.replace("`", "'").lower()
    _, _, invisible, same = _tools()
    text = unicodedata.normalize("NFC", invisible.sub("", text)).lower()
    return unicodedata.normalize("NFC", text.translate(same))


def latin_terms(text: str) -> list[str]:
    """Longest runs of Latin letters with single inner apostrophes or hyphens."""
    text = plain(text)
    return _ASCII_TERM.findall(text) if text.isascii() else _tools()[0].findall(text)


def words(text: str) -> list[str]:
    """Runs of letters, marks and digits of any script with inner apostrophes or hyphens."""
    text = plain(text)
    return _ASCII_WORD.findall(text) if text.isascii() else _tools()[1].findall(text)
