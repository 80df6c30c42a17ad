"""Words of texts as numbered buckets, whole batches at a time, for the classifiers."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

_KIND = np.full(256, 3, np.uint8)  # signs
_KIND[list(b" \t\n\r\v\f\x00")] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[[*range(48, 58)]] = 2


def _bucket(word: bytes, buckets: int) -> int:
    """Bucket of a token: words by their lower case, those in capitals, numbers and runs of signs apart."""
    if len(word) > 1 and word.isascii() and word.isalpha() and word.isupper():
        return zlib.crc32(b"\x01" + word[:1]) % 8
    text = word.decode("utf-8", "replace")
    if len(text) > 1 and text.isupper():
        return zlib.crc32(b"\x01" + word[:1]) % 8
    return 8 + zlib.crc32(text.lower().encode("utf-8", "replace")) % (buckets - 8)


def tokens(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (below ``buckets``) of all words, numbers and runs of signs in a row; each text's number of them."""
    raw = b"\n".join(texts) + b"\n"
    kind = _KIND[np.frombuffer(raw, np.uint8)]
    change = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    offsets = np.append(change, len(raw)).astype(np.int32)
    runs = pa.Array.from_buffers(pa.binary(), len(change), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    keep = kind[change] != 0
    coded = runs.filter(pa.array(keep)).dictionary_encode()
    table = np.array([_bucket(w, buckets) for w in coded.dictionary.to_pylist()], np.int32)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    bounds = np.concatenate([[0], np.searchsorted(change[keep], ends)])
    return table[np.asarray(coded.indices)] if len(table) else np.zeros(0, np.int32), np.diff(bounds)
