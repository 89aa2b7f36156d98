"""Words of marked-up text."""

from __future__ import annotations

import html
import re

_INVISIBLE = re.compile("[\u00ad\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.DOTALL)
_INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|span|a|code|sub|sup|mark|small|font)(?:\s[^<>]*)?>", re.IGNORECASE)
_HYPHEN = re.compile(r"(?<=[^\W_])[-\u2010\u2011][ \t]*(?:\r\n|\r|\n)[ \t>|*]*(?=[^\W_])")
_SPECIAL = re.compile("[<&\u00ad\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]|[-\u2010\u2011][ \t]*[\r\n]")
WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """``text`` without markup, character entities, invisible characters and hyphens at line ends."""
    if not _SPECIAL.search(text):
        return text
    if "&" in text:
        text = html.unescape(text)
    text = _INVISIBLE.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    return _HYPHEN.sub("", text)


def plain_words(text: str) -> list[str]:
    return WORD.findall(plain(text).lower())
