"""Byte-pair vocabularies inside tasks: cutting texts into chunks that encode independently.

A chunk is a run of white space with the run of other characters after it, cut further between a
letter or digit and an ASCII sign. No token crosses such a place under the byte-level pattern, so a
text's ids are its chunks' ids one after the other, and each distinct chunk is encoded once.
"""

from __future__ import annotations

from functools import lru_cache
from struct import Struct

import numpy as np
import pyarrow as pa
import regex

from facetlens.llm.common import binary_array, flat

#: Fixed value: the pattern that splits text before merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct chunks that a worker remembers in each of two generations.
CACHE_CHUNKS = 300_000

#: White space of the byte-level pattern beyond ASCII.
WIDE_SPACE = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_WIDE = [chr(c).encode() for c in WIDE_SPACE]

#: The class of each byte, as a table for bytes.translate.
_SPACE, _ALNUM, _SIGN, _LEAD = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = _SPACE
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = _ALNUM
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _SIGN
_CLASS[[b[0] for b in _WIDE]] = _LEAD
_CLASS = _CLASS.tobytes()


@lru_cache(maxsize=None)
def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=None)
def specials(path: str) -> dict[bytes, int]:
    return {t.content.encode(): i for i, t in load(path).get_added_tokens_decoder().items() if t.special}


@lru_cache(maxsize=None)
def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    from tokenizers.pre_tokenizers import ByteLevel

    letters = sorted(ByteLevel.alphabet())
    plain = {c: ord(c) for c in letters if ord(c) < 256}
    rest = iter([b for b in range(256) if b not in plain.values()])
    return plain | {c: next(rest) for c in letters if ord(c) >= 256}


@lru_cache(maxsize=None)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id."""
    back = byte_letters()
    out = [b""] * load(path).get_vocab_size()
    for text, i in load(path).get_vocab().items():
        out[i] = bytes(back[c] for c in text) if text.encode() not in specials(path) else text.encode()
    return out


def chunks(texts: pa.Array, special: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Code of every chunk in text order, the distinct chunks, where each text's chunks begin, byte offsets."""
    raw, off = flat(texts)
    n, whole = len(raw), raw.tobytes()
    kind = np.frombuffer(whole.translate(_CLASS), np.uint8)
    space = (kind & _SPACE).astype(bool)
    lead = np.flatnonzero(kind & _LEAD)
    if len(lead):
        head = [raw[np.minimum(lead + j, n - 1)] for j in range(3)]
        for b in _WIDE:
            hit = lead[np.logical_and.reduce([head[j] == b[j] for j in range(len(b))])]
            for j in range(len(b)):
                space[hit + j] = True
    cut = np.zeros(n + 1, bool)
    if n:
        cut[1:n] = (space[1:] & ~space[:-1]) | ((kind[:-1] & _ALNUM) << 1 & kind[1:]).astype(bool)
    if special and n:
        for s in special:
            at = whole.find(s)
            while at >= 0:
                owner = int(np.searchsorted(off, at, "right")) - 1
                if at + len(s) <= off[owner + 1]:
                    # Signs or a space before it belong to a prefix that ends inside it.
                    cut[at + 1:at + len(s)] = False
                    cut[at + len(s)] = True
                at = whole.find(s, at + len(s))
    cut[off] = True
    cut[n] = False
    starts = np.flatnonzero(cut)
    bounds = np.append(starts, n)
    found = binary_array(raw, bounds).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist(), np.searchsorted(starts, off), off


class Recent:
    """A memory of at most two generations of ``size`` entries; what is used again stays."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def fetch(self, keys: list, learn) -> list:
        """The values of distinct ``keys``; ``learn`` gives those of the keys that neither generation has."""
        if len(self.new) > self.size:
            self.new, self.old = {}, self.new
        out = list(map(self.new.get, keys))
        gone = [i for i, v in enumerate(out) if v is None]
        if gone:
            for i, v in zip(gone, map(self.old.get, [keys[i] for i in gone])):
                out[i] = v
            lost = [i for i in gone if out[i] is None]
            for i, v in zip(lost, learn([keys[i] for i in lost])):
                out[i] = v
            self.new.update((keys[i], out[i]) for i in gone)
        return out


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, each distinct chunk encoded once."""

    def __init__(self, path: str):
        self.path, self.tokenizer = path, load(path)
        self.special = list(specials(path))
        self.split, self.merge = regex.compile(PATTERN).findall, self.tokenizer.model.tokenize
        self.holds_special = regex.compile(b"|".join(map(regex.escape, self.special)) or b"(?!)").search
        # Letters alone or digits alone are one piece, if no special string can lie in them.
        self.whole = not any(s.lstrip(b" ").isalnum() or s.isspace() for s in self.special)
        # The model spells bytes as printable characters.
        self.spelling = {i: c for c, i in byte_letters().items()}
        self.known = Recent(CACHE_CHUNKS)

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """Latin chunks go to the library's merges piece by piece, others through its whole encoding."""
        split, merge, spelling, special, space = self.split, self.merge, self.spelling, self.holds_special, self.spelling[32]
        out, alone = [], []
        for c in new:
            if self.whole and c.isascii():
                body = c[1:] if c[0] == 32 else c
                if body.isalpha() or body.isdigit():
                    t = body.decode()
                    out.append(_packed([k.id for k in merge(t if body is c else space + t)]))
                    continue
            t = c.decode()
            if not t.isascii() and max(t) > "\u024f" or special(c):
                alone.append(len(out))
                out.append(t)
                continue
            out.append(_packed([k.id for p in split(t) for k in merge(p.encode().decode("latin-1").translate(spelling))]))
        if alone:
            for i, e in zip(alone, self.tokenizer.encode_batch([out[i] for i in alone], add_special_tokens=False)):
                out[i] = _packed(e.ids)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit) in text order, and where each text's ids begin."""
        codes, values, off, _ = chunks(texts, self.special)
        packed = pa.array(self.known.fetch(values, self._learn), pa.large_binary())
        every = packed.take(pa.array(codes))
        ends = np.frombuffer(every.buffers()[1], np.int64, len(every) + 1) >> 2
        data = every.buffers()[2]
        return np.frombuffer(data, "<u4", int(ends[-1])) if ends[-1] else np.zeros(0, "<u4"), ends[off]


def _packed(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()


_PACK = [Struct(f"<{n}I").pack for n in range(64)]


@lru_cache(maxsize=None)
def encoder(path: str) -> Encoder:
    """One for each worker process, so that later tasks find what earlier ones encoded."""
    return Encoder(path)
