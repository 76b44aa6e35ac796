"""Words of texts in any script.

Letters, digits and their marks make words, without case; punctuation and white space part
them. Each character of a script that is written without spaces is a word of its own, and so
is each symbol beyond ASCII; invisible format characters are left out. ASCII texts have the
words that ``WORD_BYTES`` gives. Composed and decomposed letters are not made equal.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np

from tallyframe.llm.common import WORD_BYTES

PART, IN_WORD, ALONE, UNSEEN = range(4)
#: Fixed ranges of the scripts without spaces: Thai, Lao, Tibetan, Myanmar, Khmer, Tai, Balinese, Javanese, kana,
#: Bopomofo, Han, Yi, Tangut, Nushu and Khitan.
WITHOUT_SPACES = (
    (0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F),
    (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
    (0x4E00, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x16FE0, 0x18DFF),
    (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFD),
)
CHARACTERS_AT_ONCE = 1 << 18


def kind_of(point: int) -> int:
    character = chr(point)
    if point < 128:
        return IN_WORD if character.isalnum() else PART
    category = unicodedata.category(character)
    if category[0] in "PZ" or category in ("Cc", "Sk") or point == 0x200B:
        return PART
    if category in ("Cf", "Cs") or 0xFE00 <= point <= 0xFE0F or 0xE0100 <= point <= 0xE01EF:
        return UNSEEN
    return ALONE if category[0] == "S" else IN_WORD


@functools.cache
def kinds() -> np.ndarray:
    """The kind of every character, made once in each process that meets a text beyond ASCII."""
    made = np.full(sys.maxunicode + 1, IN_WORD, np.uint8)
    # nothing is assigned between these planes' characters and the tags and selectors of the fourteenth
    for first, end in ((0, 0x20000), (0xE0000, 0xE0200)):
        made[first:end] = [kind_of(point) for point in range(first, end)]
    for first, last in WITHOUT_SPACES:
        some = made[first : last + 1]
        some[some == IN_WORD] = ALONE
    return made


def parted_words(text: bytes | None) -> Iterator[bytes]:
    """The text as UTF-8 words with spaces between them, in parts that begin and end between words."""
    if not text:
        return
    if text.isascii():
        yield text.translate(WORD_BYTES)
        return
    characters = text.decode("utf-8", "replace")
    rest = np.zeros(0, np.uint32)
    for at in range(0, len(characters), CHARACTERS_AT_ONCE):
        folded = characters[at : at + CHARACTERS_AT_ONCE].casefold()
        points = np.frombuffer(folded.encode("utf-32-le"), np.uint32)
        kind = kinds()[points]
        points = np.where(kind == PART, np.uint32(32), points)[kind != UNSEEN]
        alone = kind[kind != UNSEEN] == ALONE
        if alone.any():
            # a space on both sides: three places each, of which the middle one is the character
            sizes = np.where(alone, 3, 1)
            made = np.full(sizes.sum(), 32, np.uint32)
            made[np.cumsum(sizes) - np.where(alone, 2, 1)] = points
            points = made
        points = np.concatenate([rest, points])
        spaces = np.flatnonzero(points == 32)
        cut = int(spaces[-1]) + 1 if len(spaces) else 0
        if at + CHARACTERS_AT_ONCE >= len(characters):
            cut = len(points)
        rest = points[cut:]
        if cut:
            yield points[:cut].tobytes().decode("utf-32-le").encode()
