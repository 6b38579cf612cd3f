"""Words of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased (bytes, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

_KEPT = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
#: A-Z become a-z, what is kept stays, all else becomes a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEPT else 0x20 for b in range(0x100))


def word_blocks(data: bytes | None, block: int = 1 << 16) -> Iterator[list[bytes]]:
    """The words of a whole UTF-8 text in order, in lists of about ``block`` bytes each; none for null."""
    clean = (data or b"").translate(_TABLE)
    at = 0
    while at < len(clean):
        cut = clean.find(b" ", at + block)
        cut = len(clean) if cut < 0 else cut
        if words := clean[at:cut].split():
            yield words
        at = cut
