"""Words of a text as bytes: runs of ASCII letters, digits and whatever lies beyond ASCII, A-Z in lower case."""

from __future__ import annotations

from collections.abc import Iterator

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Bytes of a text that become word objects at once.
PIECE = 1 << 22


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """All words of UTF-8 ``text``, in lists that cover about ``size`` bytes each; no word is cut."""
    spaced = text.translate(_TABLE)
    at = 0
    while at < len(spaced):
        end = spaced.find(b" ", at + size) if at + size < len(spaced) else -1
        end = len(spaced) if end < 0 else end
        yield spaced[at:end].split()
        at = end


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()
