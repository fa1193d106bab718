"""Words, lines and counts of texts, as bytes.

A word is a run of bytes other than the six ASCII white-space characters
(``[^\\x20\\x09-\\x0D]+``), which is how ``bytes.split()`` splits.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
CONTINUATION = bytes(range(0x80, 0xC0))
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
LETTERS_ONLY = bytes.maketrans(
    bytes(x for x in range(128) if not chr(x).isalpha()),
    b" " * sum(not chr(x).isalpha() for x in range(128)),
)


def code_points(text: bytes) -> int:
    """The number of code points of well-formed UTF-8."""
    return len(text) - (len(text) - len(text.translate(None, CONTINUATION)) if not text.isascii() else 0)


def word_chars(text: bytes) -> int:
    return code_points(text.translate(None, SPACES))


def symbols(text: bytes) -> int:
    return len(text) - len(text.translate(None, SYMBOLS))


def duplicate_lines(text: bytes) -> int:
    r"""Lines (between ``\n``) with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    lines = [x for x in lines if x.strip()]
    return len(lines) - len(set(lines))


def windows(words: list[bytes], n: int):
    """All runs of ``n`` consecutive words, as tuples."""
    return zip(*(islice(words, i, None) for i in range(n)), strict=False)


def repeated_words(words: list[bytes], n: int = 5) -> int:
    """Words inside a run of ``n`` words that the text holds twice or more, the first one included."""
    if len(words) <= n:
        return 0
    runs = list(windows(words, n))
    if len(set(runs)) == len(runs):
        return 0
    often = {x for x, k in Counter(runs).items() if k > 1}
    total = upto = 0
    for i, run in enumerate(runs):
        if run in often:
            total += i + n - max(i, upto)
            upto = i + n
    return total


OBFUSCATED = re.compile(rb"[A-Za-z]+(?:[0-9@$*!._-]+[A-Za-z]+)+")
