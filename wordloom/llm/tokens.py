"""Encoding of texts with a byte-level BPE file of the ``tokenizers`` library.

A pretoken's ids do not depend on its neighbours, so each distinct pretoken of
a slice is encoded once and the texts are put together with numpy.
"""

from __future__ import annotations

import os

import numpy as np

from wordloom.llm.pretokens import pieces

#: Distinct pretokens that a worker remembers between slices; later ones are encoded anew.
MEMO = 300_000

_encoders: dict[str, TextEncoder] = {}


class TextEncoder:
    """Encodes lists of texts; one object for each file and worker process."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.tokenizer = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.room = memo
        self.memo: dict[bytes, bytes] = {}
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]

    @staticmethod
    def of(path: str) -> TextEncoder:
        if path not in _encoders:
            _encoders[path] = TextEncoder(path)
        return _encoders[path]

    def _encode_words(self, words: list[bytes], block: int = 200) -> dict[bytes, bytes]:
        """Ids of each word as little-endian 32-bit integers.

        Words are joined by line ends, which are pretokens of their own there;
        white space cannot be told from those and is encoded by itself.
        """
        out: dict[bytes, bytes] = {}
        plain = []
        for w in words:
            text = w.decode("utf-8", "replace")
            (out.__setitem__(w, np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()) if text.isspace() else plain.append((w, text)))
        blocks = [plain[i : i + block] for i in range(0, len(plain), block)]
        for at in range(0, len(blocks), 64):
            group = blocks[at : at + 64]
            encoded = self.tokenizer.encode_batch_fast(["\n".join(t for _, t in b) for b in group], add_special_tokens=False)
            for b, e in zip(group, encoded, strict=True):
                ids = np.array(e.ids, "<u4")
                cuts = np.flatnonzero(ids == self.newline)
                if len(cuts) == len(b) - 1:
                    low, high, raw = [0, *(4 * (cuts + 1)).tolist()], [*(4 * cuts).tolist(), 4 * len(ids)], ids.tobytes()
                    out.update((w, raw[i:j]) for (w, _), i, j in zip(b, low, high, strict=True))
                else:  # a vocabulary in which line ends join with other signs
                    for w, text in b:
                        out[w] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def encode(self, texts: list[bytes], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each text's number of ids. ``end_id`` closes every text if given.

        Texts that spell an added token of the file are left to the library, which finds it there.
        """
        spelt = [k for k, t in enumerate(texts) if any(a in t for a in self.added)]
        if spelt:
            own = {k: np.array(self.library.encode(texts[k].decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4") for k in spelt}
            ids, counts = self._encode([b"" if k in own else t for k, t in enumerate(texts)])
            rest = np.split(ids, np.cumsum(counts)[:-1])
            parts = [own.get(k, x) for k, x in enumerate(rest)]
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        else:
            ids, counts = self._encode(texts)
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(counts), end_id)
            counts = counts + 1
        return ids.astype("<u4", copy=False), counts

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words, per_text = pieces(texts)
        distinct = words.dictionary.to_pylist()
        missing = [w for w in distinct if w not in self.memo]
        new = self._encode_words(missing)
        if len(self.memo) < self.room:
            self.memo.update(new)
        coded = [new[w] if w in new else self.memo[w] for w in distinct]
        sizes = np.array([len(c) // 4 for c in coded], np.int64)
        flat = np.frombuffer(b"".join(coded), "<u4")
        index = np.asarray(words.indices)
        n = sizes[index] if len(index) else np.zeros(0, np.int64)
        ends = np.cumsum(n)
        begin = (np.cumsum(sizes) - sizes)[index] if len(index) else n
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(begin - (ends - n), n) + np.arange(total)] if total else np.zeros(0, "<u4")
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        return ids, np.diff(bounds)
