"""Splitting of texts into byte-level BPE pretokens, whole Arrow batches at a time.

The split is the one of ``public_tokenizers.PATTERN``: contractions, runs of
letters, digits or other signs with at most one leading blank, and runs of
white space.  It is worked out with numpy from character classes, then Arrow
dictionary-encodes the pieces, so that Python handles distinct words only.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

LETTER, NUMBER, SPACE, SIGN = 1, 2, 3, 4

# The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Character class of every code point, made once in a process."""
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        out = np.array([kinds.get(unicodedata.category(chr(c))[0], SIGN) for c in range(sys.maxunicode + 1)], np.uint8)
        out[WHITE_SPACE] = SPACE
        _classes = out
    return _classes


def starts(points: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Flags of the code points at which a pretoken starts.

    ``points``: the code points of one or more texts in a row; ``doc_start``:
    flags of each text's first one.
    """
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[points]
    before = np.empty_like(kind)
    before[0], before[1:] = 0, kind[:-1]
    before[doc_start] = 0
    last = np.empty(n, bool)  # the last code point of its text
    last[-1], last[:-1] = True, doc_start[1:]
    after = np.empty_like(kind)
    after[-1], after[:-1] = 0, kind[1:]
    after[last] = 0
    blank_before = np.zeros(n, bool)
    blank_before[1:] = points[:-1] == 0x20
    blank_before &= before == SPACE
    white = kind == SPACE
    # In a run of white space followed by something else, its last one stands apart.
    out = np.where(white, (before != SPACE) | ((after != SPACE) & (after != 0)), (before != kind) & ~blank_before)
    marks = np.flatnonzero((points == 0x27) & out & (after == LETTER))
    if len(marks):
        padded = np.concatenate([points, [0, 0, 0]])
        ends = np.concatenate([doc_start, [True, True, True]])
        one, two = padded[marks + 1], padded[marks + 2]
        two = np.where(ends[marks + 2], 0, two)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        out[marks[short] + 1] = False
        out[marks[long] + 1] = False
        for at in (marks[short] + 2, marks[long] + 3):
            out[at[at < n]] = True
    return out


def pieces(texts: list[bytes], cuts: Callable[[np.ndarray, bytes, np.ndarray], np.ndarray] | None = None) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The texts' pretokens as a dictionary array of bytes, and each text's number of them.

    ``cuts`` may cut them further: from the joined bytes, as an array and as
    they are, and the places at which pieces begin, it makes those places anew.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = b"".join(texts)
    if not raw:
        return pa.array([], pa.binary()).dictionary_encode(), np.zeros(len(texts), np.int64)
    # surrogatepass: ill-formed text is split somehow rather than refused
    points = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
    octets = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero((octets & 0xC0) != 0x80)
    doc_at = np.concatenate([[0], np.cumsum(sizes)])
    first = np.zeros(len(points), bool)
    full = doc_at[:-1][sizes > 0]
    first[np.searchsorted(at, full)] = True
    begin = at[starts(points, first)]
    if cuts:
        begin = cuts(octets, raw, begin)
    offsets = np.append(begin, len(raw)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    bounds = np.searchsorted(begin, doc_at)
    return words.dictionary_encode(), np.diff(bounds)


def slices(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    """Groups of rows whose first fields (bytes) add up to about ``size`` bytes."""
    group, held = [], 0
    for row in rows:
        group.append(row)
        held += len(row[0]) + 64
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group
