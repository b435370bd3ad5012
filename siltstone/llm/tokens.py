"""Texts to token ids by the public tokenizers library, with a bounded memo of words.

Words are cut at ASCII white space, where the tokenizer always ends a token.
Trailing punctuation is split off, and plain lower-case letter words go
straight to the library's model (its normalizer and pre-tokenizer leave such
words whole); everything else goes through the library's full encode().
"""

from __future__ import annotations

import itertools
import re

import numpy as np

from .common import LOWER, NOT_ALNUM, SPACES, chunks, distinct, hashes, runs, text_bytes

#: Words whose ids a worker keeps (some 25 bytes each); beyond it those go that were not met since the last turn.
MEMO = 400_000
#: Bytes of text that are encoded at once; scratch memory is some 25 times that.
PART = 1 << 20
_PLAIN = re.compile(rb"[a-z]+")
_LATIN = re.compile("[a-zß-öø-ÿ]+")
_TAIL = b".,;:!?"
_IS_TAIL = np.isin(np.arange(256), np.frombuffer(_TAIL, np.uint8))
_IS_ALNUM = ~NOT_ALNUM & (np.arange(256) < 128)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes whole texts to little-endian ids of `dtype`; byte-identical to Tokenizer.encode."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.dtype = np.dtype("<u2" if self.full.get_vocab_size() <= 1 << 16 else "<u4")
        kinds = str([x.__getstate__() for x in (self.full.normalizer, self.full.pre_tokenizer) if x])
        #: The short cuts hold for this shape of tokenizer only.
        self.short = "Lowercase" in kinds and "ByteLevel" in kinds and "p{L}]+|" in kinds and getattr(self.model, "end_of_word_suffix", None) == "</w>"
        from tokenizers.pre_tokenizers import ByteLevel

        bytelevel = ByteLevel(add_prefix_space=False, use_regex=False)
        self.to_chars = {}
        if self.short:
            for ch in map(chr, range(0xDF, 0x100)):
                self.to_chars[ord(ch)] = bytelevel.pre_tokenize_str(ch)[0][0]

        width = self.dtype.itemsize
        self.packed = [i.to_bytes(width, "little") for i in range(self.full.get_vocab_size())]
        self.known = _Known(self.dtype)

    def word(self, raw: bytes) -> bytes:
        """The ids of bytes without ASCII white space."""
        core = raw.rstrip(_TAIL)
        if core and core != raw:
            last = chr(core[-1]) if core[-1] < 128 else core.decode("utf-8", "replace")[-1]
            if last.isalpha() or last in "0123456789":
                return self._encode(core) + self._encode(raw[len(core) :])
        return self._encode(raw)

    def _encode(self, raw: bytes) -> bytes:
        packed = self.packed
        if self.short:
            if _PLAIN.fullmatch(raw):
                return b"".join([packed[t.id] for t in self.model.tokenize(raw.decode())])
            text = raw.decode("utf-8", "replace")
            if _LATIN.fullmatch(low := text.lower()) and len(low) == len(text):
                return b"".join([packed[t.id] for t in self.model.tokenize(low.translate(self.to_chars))])
        else:
            text = raw.decode("utf-8", "replace")
        return b"".join([packed[i] for i in self.full.encode(text, add_special_tokens=False).ids])

    def text(self, raw: bytes) -> bytes:
        """The ids of a whole UTF-8 text."""
        return b"".join(map(self.word, raw.split())) if self.short else self._encode(raw)

    def batch(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow string column, one text after another, and where each text's begin (one more entry than texts); null is empty.

        Words are lower-cased and parted from trailing punctuation by numpy;
        equal ones of a batch are looked up once, by hash, in sorted arrays.
        """
        data, offs = text_bytes(column)
        ids, counts = [np.empty(0, self.dtype)], [np.zeros(1, np.int64)]
        for i, j in chunks(offs, PART):
            part, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            if not self.short or b"<|" in (raw := part.tobytes()):  # special tokens are told by case
                got = [self.text(part[a:b].tobytes()) for a, b in itertools.pairwise(at.tolist())]
                ids.append(np.frombuffer(b"".join(got), self.dtype))
                counts.append(np.array([len(x) for x in got], np.int64) // self.dtype.itemsize)
                continue
            part = LOWER[part]
            raw = part.tobytes()
            starts, ends, first = _part_tails(part, *runs(part, at, SPACES))
            h = hashes(part, starts, ends)
            one, back = distinct(h)
            place, size = self.known.find(h[one], lambda k, o=one, s=starts, e=ends, r=raw: self.word(r[s[o[k]] : e[o[k]]]))
            n = size[back]
            after = np.cumsum(n, dtype=np.int64)
            shift = (place[back] - (after - n)).astype(np.int32)  # both below 2**31: ids of a part, and of all words kept
            ids.append(self.known.ids[np.arange(len(n) and after[-1], dtype=np.int32) + np.repeat(shift, n)])
            counts.append(np.diff(np.concatenate([[0], after])[first]))
        return np.concatenate(ids), np.cumsum(np.concatenate(counts))


def _part_tails(data, starts, ends, first):
    """Words with up to three trailing signs of _TAIL, after an ASCII letter or digit, as words of their own."""
    core = ends.copy()
    for _ in range(3):
        core -= (core - starts > 1) & _IS_TAIL[data[core - 1]]
    cut = (core < ends) & _IS_ALNUM[data[core - 1]] if len(core) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(cut)])
    at = np.arange(len(starts)) + before[:-1]
    s, e = np.empty(len(starts) + before[-1], np.int64), np.empty(len(starts) + before[-1], np.int64)
    s[at], e[at] = starts, np.where(cut, core, ends)
    s[at[cut] + 1], e[at[cut] + 1] = core[cut], ends[cut]
    return s, e, first + before[first]


class _Known:
    """Ids of words by hash, in sorted arrays: 17 bytes a word and its ids."""

    def __init__(self, dtype):
        self.hash, self.used = np.empty(0, np.uint64), np.empty(0, bool)
        self.place, self.size, self.ids = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, dtype)

    def find(self, h: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of each hash; encode(k) gives the ids of the k-th where it is new."""
        if len(self.hash) > MEMO:
            keep = np.flatnonzero(self.used) if self.used.sum() < MEMO // 2 else np.empty(0, np.int64)
            n = self.size[keep]
            after = np.cumsum(n, dtype=np.int32)
            self.ids = self.ids[np.arange(len(n) and after[-1]) + np.repeat(self.place[keep] - (after - n), n)]
            self.hash, self.size, self.place, self.used = self.hash[keep], n, after - n, np.zeros(len(keep), bool)
        at = np.searchsorted(self.hash, h)
        new = np.flatnonzero((at == len(self.hash)) | (self.hash[np.minimum(at, len(self.hash) - 1)] != h)) if len(self.hash) else np.arange(len(h))
        if len(new):
            fresh, k = np.unique(h[new], return_index=True)
            got = [encode(x) for x in new[k].tolist()]
            n = np.fromiter(map(len, got), np.int32, len(got)) // self.ids.dtype.itemsize
            to = np.searchsorted(self.hash, fresh)
            self.hash = np.insert(self.hash, to, fresh)
            self.place = np.insert(self.place, to, len(self.ids) + np.cumsum(n, dtype=np.int32) - n)
            self.size, self.used = np.insert(self.size, to, n), np.insert(self.used, to, False)
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(got), self.ids.dtype)])
            at = np.searchsorted(self.hash, h)
        self.used[at] = True
        return self.place[at], self.size[at]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
