"""Words of letters and digits of whole texts, as bytes, a piece of the text at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 18
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_OTHER = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def word_pieces(text: str | None) -> Iterator[list[bytes]]:
    """Lists of the text's words in order, A-Z lower-cased; null has none.

    A piece ends where no word goes on, so the words don't depend on the pieces, and what is held beside
    the text is a piece's words (and one word, if it is longer than a piece).
    """
    raw = (text or "").encode()
    at = 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):
            cut = _OTHER.search(raw, end)
            end = cut.start() if cut else len(raw)
        yield _WORD.findall(raw[at:end].lower())
        at = end
