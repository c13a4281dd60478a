"""Token ids of whole texts with the tokenizers library and a public vocabulary file."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from ._arrow import LOWER, NOT_SPACE, padded, word_hashes, words


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: The byte-level pre-tokeniser's characters: printable bytes stand for themselves, the others follow from 256 on.
_OWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _OWN)}

#: Kinds of bytes: white space, letters, digits, other printable ASCII, and bytes that only the library looks at.
_SPACE, _LETTER, _DIGIT, _OTHER, _HARD = range(5)
_KIND = np.full(256, _HARD, np.uint8)
_KIND[0x21:0x7F] = _OTHER
_KIND[~NOT_SPACE] = _SPACE
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x30:0x3A] = _DIGIT

#: Slots of the cache, and entries after which it is emptied.
_SLOT_BITS, _MOST = 21, 700_000


class TextEncoder:
    """Ids of many texts at once, as Tokenizer.encode(text, add_special_tokens=False) gives them.

    The vocabulary's pre-tokeniser never joins text across white space and its normaliser works within what
    stands between, so pieces between ASCII white space are encoded by themselves. Pieces of printable ASCII and Latin-1
    letters as precomposed characters are cut further, as the pre-tokeniser does: runs of letters, single digits, runs of
    other signs, in lower case. Pieces with other characters, an apostrophe (contractions) or a possible special token
    go to the library whole. Each distinct word goes to the library once while it stays in a direct-mapped cache, by a 64-bit
    hash of its bytes; all else is done on arrays.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << _SLOT_BITS, np.uint64)
        self.at = np.zeros(1 << _SLOT_BITS, np.int32)
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.start, self.size, self.n = np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.int32), 0

    def _whole(self, piece: bytes) -> list[int]:
        return self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids

    def _add(self, ids: list[int], sizes: list[int]) -> int:
        """Keep the ids of some words, one after another; the number of the first."""
        n, k = len(ids), len(sizes)
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + k > len(self.start):
            self.start, self.size = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.size, np.zeros_like(self.size)])
        first = self.n
        self.flat[self.used : self.used + n] = ids
        self.size[first : first + k] = sizes
        self.start[first : first + k] = self.used + np.cumsum(sizes) - sizes
        self.used += n
        self.n += k
        return first

    def encode(self, data: np.ndarray, off: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another (each with end_id behind), and where each begins (texts + 1)."""
        if self.n > _MOST:
            self.clear()
        n = len(data)
        kind = _KIND[data]
        after = np.flatnonzero(data[:-1] == 0xC3) + 1 if n else np.empty(0, np.int64)
        times = (data[after] == 0x97) | (data[after] == 0xB7)  # the two Latin-1 signs among the letters
        kind[after] = kind[after - 1] = np.where(times, _OTHER, _LETTER)
        s, e, first = words(data, off, NOT_SPACE)
        hard = (kind == _HARD) | (data == 0x27)
        if n > 1:
            hard[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        total = np.concatenate([[0], np.cumsum(hard)])
        whole = total[e] > total[s]
        # cuts: where a piece begins; within simple ones where the kind changes, and around digits
        cut = np.zeros(n + 1, bool)
        if n > 1:
            cut[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        cut[:n] &= kind != _SPACE
        for a, z in zip(s[whole].tolist(), e[whole].tolist(), strict=True):
            cut[a:z] = False
        cut[s] = True
        ws = np.flatnonzero(cut)
        piece = np.searchsorted(s, ws, "right") - 1
        we = np.minimum(np.append(ws[1:], n), e[piece]) if len(ws) else ws
        buf = padded(LOWER[data])
        odd = whole[piece] if len(ws) else np.empty(0, bool)
        h = word_hashes(buf, ws, we)
        if odd.any():  # as they are, and apart from simple words with the same bytes
            h[odd] = word_hashes(padded(data), ws[odd], we[odd], seed=1)
        h |= np.uint64(1)
        slot = (h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        index = self.at[slot].astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != h)
        if len(miss):
            new, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
            own = miss[where]
            raw, low = data.tobytes(), buf[:n].tobytes()
            ids, sizes, model = [], [], self.tokenizer.model.tokenize
            for a, z, o in zip(ws[own].tolist(), we[own].tolist(), odd[own].tolist(), strict=True):
                if o:
                    one = self._whole(raw[a:z])
                else:
                    word = low[a:z]
                    text = word.decode() if word.isascii() else word.decode().lower().encode().decode("latin-1").translate(_BYTE_LEVEL)
                    one = [t.id for t in model(text)]
                ids += one
                sizes.append(len(one))
            found = self._add(ids, sizes) + np.arange(len(new))
            index[miss] = found[back]
            at = (new >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
            self.keys[at], self.at[at] = new, found
        size = self.size[index].astype(np.int64)
        text = np.searchsorted(first, piece, "right") - 1
        extra = 0 if end_id is None else 1
        per = np.bincount(text, size, len(off) - 1).astype(np.int64) + extra
        begins = np.concatenate([[0], np.cumsum(per)])
        out = np.empty(int(begins[-1]), np.uint32)
        if extra:
            out[begins[1:] - 1] = end_id
        # place of each word's first id: the ids before it, and the end ids of the texts before
        place = np.cumsum(size) - size + text * extra
        count = int(size.sum())
        run = np.arange(count) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(place, size) + run] = self.flat[np.repeat(self.start[index], size) + run]
        return out, begins


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)
