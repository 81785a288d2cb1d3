"""Exact token counts of every prefix of a text, by dynamic programming over its bytes.

The last token of a prefix's encoding is the one token that ends there and stays apart from the last
token of the prefix before it; so one left-to-right pass over a piece gives the count of each of its
prefixes, and truncation and budget questions are read off the table without encoding again.

Null and empty texts count no token. Repeated rows are counted each; other columns are not read.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from facetlens.llm.bpe import CACHE_CHUNKS, PATTERN, Recent, chunks, specials, token_bytes
from facetlens.llm.common import ids_and_text, text_slices

class PrefixTable:
    """Counts of every byte prefix of pieces, many pieces at once."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab, data = model["vocab"], token_bytes(path)
        skip = set(specials(path))
        size = len(data)
        self.left, self.right = np.arange(size), np.arange(size)
        pairs, whole = [], []
        for rule in model["merges"]:
            a, b = rule.split(" ") if isinstance(rule, str) else rule
            i, j, c = vocab[a], vocab[b], vocab[a + b]
            self.left[c], self.right[c] = i, j
            pairs.append(i * size + j)
            whole.append(c)
        order = np.argsort(pairs)
        self.pairs, self.whole, self.size = np.array(pairs, np.int64)[order], np.array(whole, np.int64)[order], size
        self.base = self.left == np.arange(size)
        # A trie of the tokens; only inner nodes own a row of children.
        rows, token = [[-1] * 256], [-1]
        row_of, ids = {b"": 0}, {b"": 0}
        for i in sorted(range(size), key=lambda i: len(data[i])):
            text = data[i]
            if not text or text in skip:
                continue
            for n in range(1, len(text) + 1):
                head = text[:n]
                if head not in ids:
                    ids[head] = len(token)
                    token.append(-1)
                    up = text[: n - 1]
                    if up not in row_of:
                        row_of[up] = len(rows)
                        rows.append([-1] * 256)
                    rows[row_of[up]][text[n - 1]] = ids[head]
            token[ids[text]] = i
        self.child = np.array(rows, np.int32)
        self.token = np.array(token, np.int32)
        self.row = np.full(len(token), -1, np.int32)
        for head, r in row_of.items():
            self.row[ids[head]] = r
        self.slot_key, self.slot_ok = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b next to each other stay two tokens."""
        key = a.astype(np.int64) * self.size + b
        slot = (key * 0x9E3779B1 >> 7) & ((1 << 20) - 1)
        hit = self.slot_key[slot] == key
        ok = self.slot_ok[slot]
        if not hit.all():
            miss = np.flatnonzero(~hit)
            ok[miss] = self._apart(a[miss].astype(np.int64), b[miss].astype(np.int64))
            self.slot_key[slot[miss]], self.slot_ok[slot[miss]] = key[miss], ok[miss]
            # Two keys may share a slot: what was written last stays, both columns from the same row.
            last = self.slot_key[slot[miss]] == key[miss]
            self.slot_ok[slot[miss][last]] = ok[miss][last]
        return ok

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undoes the later of the two merges at the border, step by step; a merge across it that
        would have come first rules the pair out."""
        out = np.ones(len(a), bool)
        live, limit = np.arange(len(a)), np.full(len(a), 1 << 40, np.int64)
        while len(live):
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            bad = (self.pairs[at] == key) & (self.whole[at] < limit)
            out[live[bad]] = False
            go = ~bad & ~(self.base[a] & self.base[b])
            live, a, b = live[go], a[go], b[go]
            first = ~self.base[a] & ((a > b) | self.base[b])
            limit = np.where(first, a, b + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def counts(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of prefixes of 1, 2, ... bytes of each piece, one after the other, and the offsets."""
        size = np.array([len(p) for p in pieces], np.int64)
        off = np.concatenate([[0], np.cumsum(size)])
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        count, last = np.zeros(off[-1], np.int32), np.full(off[-1], -1, np.int32)
        order = np.argsort(-size, kind="stable")
        begin, size = off[:-1][order], size[order]
        for s in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -s, "left"))  # pieces longer than s
            at = begin[:live] + s
            stop = begin[:live] + size[:live]
            before = at - 1
            node = np.zeros(live, np.int32)
            while len(at):
                row = self.row[node]
                node = np.where(row >= 0, self.child[row, raw[at]], -1)
                keep = node >= 0
                at, stop, before, node = at[keep], stop[keep], before[keep], node[keep]
                t = self.token[node]
                ends = np.flatnonzero(t >= 0)
                if len(ends):
                    ok = np.ones(len(ends), bool) if s == 0 else self.apart(last[before[ends]], t[ends])
                    ends = ends[ok]
                    last[at[ends]] = t[ends]
                    count[at[ends]] = 1 if s == 0 else count[before[ends]] + 1
                at = at + 1
                keep = at < stop
                at, stop, before, node = at[keep], stop[keep], before[keep], node[keep]
        return count, off


class PrefixCounter:
    """Remembers the prefix counts of distinct chunks; one for each worker process."""

    def __init__(self, path: str):
        self.table, self.special = PrefixTable(path), list(specials(path))
        self.split = regex.compile(PATTERN).findall
        self.known = Recent(CACHE_CHUNKS)

    def _learn(self, new: list[bytes]) -> list[np.ndarray]:
        if not new:
            return []
        pieces: dict[bytes, int] = {}
        parts = []
        for c in new:
            own = [p.encode() for p in self.split(c.decode())]
            for a, b in zip(own, own[1:]):
                # The white space before a word is one piece when the prefix ends there.
                if a.isspace() or a.decode().isspace():
                    pieces.setdefault(a + b.decode()[0].encode(), len(pieces))
            for p in own:
                pieces.setdefault(p, len(pieces))
            parts.append(own)
        for p in (b"'", b"r", b"v", b"l"):
            pieces.setdefault(p, len(pieces))
        count, off = self.table.counts(list(pieces))
        of = {p: count[off[i]:off[i + 1]] for p, i in pieces.items()}
        learned = []
        for c, own in zip(new, parts):
            if len(own) == 1 and own[0][:1] != b"'":
                out = of[own[0]]
            else:
                out, base = np.zeros(len(c), np.int32), 0
                at = 0
                for i, p in enumerate(own):
                    out[at:at + len(p)] = of[p] + base
                    if p in (b"'re", b"'ve", b"'ll"):
                        out[at + 1] = base + 2  # cut there, the sign and the letter are two pieces
                    if i and own[i - 1].decode().isspace():
                        head = p.decode()[0].encode()
                        if head.decode().isspace():
                            out[at + len(head) - 1] = of[own[i - 1] + head][-1] + base - of[own[i - 1]][-1]
                    at, base = at + len(p), base + int(of[p][-1])
                if c[-1:].isspace() or c.decode()[-1:].isspace():
                    out[-1] = base
            for s in self.special:
                if c.endswith(s):
                    out = out.copy()
                    out[-1] = (out[-len(s) - 1] if len(c) > len(s) else 0) + 1
            learned.append(out)
        return learned

    def look_up(self, texts: pa.Array):
        """Chunk codes, prefix counts of each distinct chunk, chunk offsets of the texts, byte offsets."""
        codes, values, off, byte_off = chunks(texts, self.special)
        return codes, values, self.known.fetch(values, self._learn), off, byte_off


@lru_cache(maxsize=None)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _inner(chunk: bytes) -> np.ndarray:
    """Byte lengths of the chunk's prefixes that end between characters."""
    b = np.frombuffer(chunk + b" ", np.uint8)[1:]
    return np.flatnonzero((b & 0xC0) != 0x80) + 1


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """n_bytes, n_tokens and over_limit of every text, and fit_bytes: the bytes of the longest prefix
    that has at most ``limit`` tokens."""

    def run(batches):
        table = counter(path)
        for batch in text_slices(batches):
            codes, values, known, off, byte_off = table.look_up(batch.column(1))
            total = np.array([k[-1] for k in known], np.int64) if known else np.zeros(0, np.int64)
            size = np.array([len(v) for v in values], np.int64)
            done = np.concatenate([[0], np.cumsum(total[codes])])
            n = done[off[1:]] - done[off[:-1]]
            n_bytes = np.diff(byte_off)
            fit = n_bytes.copy()
            at = np.concatenate([[0], np.cumsum(size[codes])])
            for d in np.flatnonzero(n > limit):
                lo, hi = off[d], off[d + 1]
                j = lo + int(np.searchsorted(done[lo:hi] - done[lo], limit, "left")) - 1
                own = _inner(values[codes[j]]) if j >= lo else np.zeros(0, np.int64)
                own = own[known[codes[j]][own - 1] + done[j] - done[lo] <= limit] if len(own) else own
                fit[d] = (at[j] - at[lo] + (own[-1] if len(own) else 0)) if j >= lo else 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n), pa.array(n > limit), pa.array(fit)], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_bytes"])

    return ids_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long")


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """prefix_tokens: the token count of the prefix of 1, 2, ... characters of every text."""

    def run(batches):
        table = counter(path)
        for batch in text_slices(batches):
            codes, values, known, off, _ = table.look_up(batch.column(1))
            inner = [k[_inner(v) - 1] for k, v in zip(known, values)]
            out = []
            for lo, hi in zip(off[:-1], off[1:]):
                own, base = [], 0
                for c in codes[lo:hi]:
                    own.append(inner[c] + base)
                    base += int(known[c][-1])
                out.append(np.concatenate(own) if own else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "prefix_tokens"])

    return ids_and_text(docs).mapInArrow(run, "doc_id long, prefix_tokens array<int>")
