"""Words of whole texts, in slices of bounded size."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Bytes of a slice, about: it ends at the next white space, so that no word is cut.
SLICE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The text's words `[^\\x20\\x09-\\x0D]+`, in order, a list a slice; an empty text has none."""
    at = 0
    while len(text) - at > SLICE:
        space = _SPACE.search(text, at + SLICE)
        if space is None:
            break
        yield text[at : space.start()].split()
        at = space.end()
    yield text[at:].split()
