"""The words of a text, whatever its case, accents, markup, layout, encoding or disguise."""

from __future__ import annotations

import html
import re
import unicodedata

#: Letters of other scripts that look like Latin ones (fixed values; lower case, after decomposition).
LOOKALIKES = str.maketrans(
    {
        "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
        "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ı": "i", "ɑ": "a", "ɡ": "g",
    }
)

_INLINE = re.compile(r"</?(?:a|abbr|b|big|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strike|strong|sub|sup|tt|u|wbr)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<(?:!--.*?--|/?[a-zA-Z][^<>]*)>", re.S)
_FOREIGN = re.compile(r"[^\x00-\x7f]{2,}")
_HIDDEN = re.compile(r"[­͏؜᠎​-‏‪-‮⁠-⁤⁪-⁯︀-️﻿]")
_WORD = re.compile(r"[^\W_]+")
_FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})[^\n]*\n.*?(?:^[ \t]*\1[ \t]*$|\Z)", re.S | re.M)
_PRE = re.compile(r"<pre\b.*?(?:</pre\s*>|\Z)", re.S | re.I)


def _byte(c: str) -> bytes:
    try:
        return c.encode("cp1252")
    except UnicodeEncodeError:
        return c.encode("latin-1")


def _redecode(m: re.Match) -> str:
    """UTF-8 that was read as a single-byte encoding, read again; anything else stays."""
    try:
        return b"".join(map(_byte, m[0])).decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return m[0]


def without_code(text: str) -> str:
    """A text without its fenced and preformatted blocks."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return _PRE.sub(" ", _FENCE.sub("\n", text))


def plain(text: str) -> str:
    """Readable characters of a text: entities and wrong decodings resolved, markup and hidden characters gone."""
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    for _ in range(2):
        if "&" in text:
            text = html.unescape(text)
    if not text.isascii():
        text = _FOREIGN.sub(_redecode, text.replace("Ã ", "Ã\xa0"))
        text = _HIDDEN.sub("", text)
    return text


def folded(text: str) -> str:
    """Lower case without accents and look-alike letters."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    return "".join(c for c in text if not unicodedata.combining(c)).translate(LOOKALIKES)


def words(text: str) -> list[str]:
    """The words of a text, letters and digits only."""
    return _WORD.findall(folded(plain(text)))
