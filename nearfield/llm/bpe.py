"""Byte-level BPE ids for whole batches.

Pre-tokens are found for a whole batch by array operations and each distinct one
is given to the ``tokenizers`` library once; ids are the library's own.  Texts
with characters from U+0240 on, or with an added token's own string, go to the
library whole.
"""

from __future__ import annotations

import unicodedata
from itertools import chain

import numpy as np

from nearfield.llm.textops import U64, ragged, span_hashes

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
_LIMIT = 0x240  # code points below are classified here; all of them take one or two bytes


def _classes() -> np.ndarray:
    kinds = np.full(_LIMIT, _OTHER, np.uint8)
    for c in range(_LIMIT):
        major = unicodedata.category(chr(c))[0]
        if c in (0x20, 0x85, 0xA0) or 0x09 <= c <= 0x0D:
            kinds[c] = _SPACE
        elif major == "L":
            kinds[c] = _LETTER
        elif major == "N":
            kinds[c] = _NUMBER
    return kinds


_KIND = _classes()


def pretokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of pre-tokens of texts whose characters are all below U+0240."""
    n = len(buf)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e
    code = buf.astype(np.uint16)
    lead = np.flatnonzero(buf >= 0xC0)
    code[lead] = ((code[lead] & 0x1F) << 6) | (code[lead + 1] & 0x3F)
    kind = _KIND[code]
    kind[lead + 1] = kind[lead]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    change = np.ones(n, bool)
    change[1:] = (kind[1:] != kind[:-1]) | edge[1:n]
    runs = np.flatnonzero(change)
    ends = np.append(runs[1:], n)
    what = kind[runs]
    final = edge[ends]
    # the last character of a run of white space stands alone, or goes to the next run if it is a blank
    white = (what == _SPACE) & ~final
    tail = ends[white] - 1
    tail -= (buf[tail] & 0xC0) == 0x80
    joins = buf[tail] == 0x20
    cut = np.zeros(n, bool)
    cut[runs] = True
    cut[ends[white & ~final]] = True
    cut[ends[white][joins]] = False
    cut[tail] = True
    # 's 't 'm 'd 're 've 'll after an apostrophe that begins a pre-token
    apostrophe = np.flatnonzero((buf == 0x27) & cut)
    apostrophe = apostrophe[apostrophe + 1 < n]
    apostrophe = apostrophe[~edge[apostrophe + 1]]
    if len(apostrophe):
        a = buf[apostrophe + 1]
        one = (a == 0x73) | (a == 0x74) | (a == 0x6D) | (a == 0x64)
        has = apostrophe + 2 < n
        has[has] &= ~edge[apostrophe[has] + 2]
        b = np.zeros_like(a)
        b[has] = buf[apostrophe[has] + 2]
        two = ((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C))
        for at, length in ((apostrophe[one], 2), (apostrophe[two], 3)):
            cut[at + 1] = False
            after = at + length
            cut[after[after < n]] = True
            if length == 3:
                cut[at + 2] = False
        # a blank or an edge may already stand behind; those cuts remain as they are
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n)


class CachedBPE:
    """Encodes batches; remembers the ids of up to ``most`` distinct pre-tokens."""

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.model, self.most = Tokenizer.from_file(path), most
        self.added = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, U64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        if len(self.keys) > self.most:
            self._forget()
        sizes, parts = [], [self.flat]
        for i in range(0, len(texts), 5000):
            found = [e.ids for e in self.model.encode_batch_fast(texts[i : i + 5000], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            parts.append(np.fromiter(chain.from_iterable(found), np.uint32, int(sizes[-1].sum())))
        size = np.concatenate(sizes)
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate(parts)
        allk = np.concatenate([self.keys, keys])
        order = np.argsort(allk, kind="stable")
        self.keys = allk[order]
        self.at = np.concatenate([self.at, at])[order]
        self.size = np.concatenate([self.size, size])[order]

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids before each text (``len + 1``)."""
        strange = np.zeros(len(off) - 1, bool)
        odd = np.flatnonzero(buf >= 0xC9)
        if len(odd):
            strange[np.searchsorted(off, odd, side="right") - 1] = True
        raw = buf.tobytes()
        for word in self.added:
            at = raw.find(word)
            while at >= 0:
                strange[np.searchsorted(off, at, side="right") - 1] = True
                at = raw.find(word, at + 1)
        if not strange.any():
            return self._plain(buf, off, raw)
        parts, counts = [], []
        edges = np.flatnonzero(np.diff(np.concatenate([[True], strange, [True]]))) if len(strange) else []
        marks = [0, *[int(x) for x in edges], len(strange)]
        for a, b in zip(marks[:-1], marks[1:], strict=True):
            if a == b:
                continue
            if strange[a]:
                for i in range(a, b):
                    ids = self.model.encode(raw[off[i] : off[i + 1]].decode(), add_special_tokens=False).ids
                    parts.append(np.asarray(ids, np.uint32))
                    counts.append([len(ids)])
            else:
                ids, before = self._plain(buf[off[a] : off[b]], off[a : b + 1] - off[a], raw[off[a] : off[b]])
                parts.append(ids)
                counts.append(np.diff(before))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)

    def _plain(self, buf: np.ndarray, off: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = pretokens(buf, off)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        keys, first, which = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > 2 * self.most:
            self._forget()
        new = self._missing(keys)
        if len(new):
            before = len(self.keys)
            self._learn(keys[new], [raw[starts[i] : ends[i]].decode() for i in first[new]])
            if len(self.keys) < before:  # forgot what was there: learn the rest again
                new = self._missing(keys)
                self._learn(keys[new], [raw[starts[i] : ends[i]].decode() for i in first[new]])
        at = np.searchsorted(self.keys, keys)
        size = self.size[at][which]
        ids = self.flat[ragged(self.at[at][which], size)]
        before = np.concatenate([[0], np.cumsum(size)])
        return ids, before[np.searchsorted(starts, off)]

    def _missing(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        return np.flatnonzero(~known)
