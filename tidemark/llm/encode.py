"""Whole texts to token ids with a vocabulary file of the tokenizers library.

A byte-level BPE never merges across the start of a run of white space, nor between an ASCII letter and
ASCII punctuation (the apostrophe aside). A piece of text is cut there, each distinct part is encoded
once by the library, and the ids are laid out again in place; texts with white space beyond ASCII, or with
the text of a special token, go to the library whole.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

from .common import mix, run_hashes

_U = np.uint64
_ODD = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|[\x1c-\x1f]|<\|")
_LEADS = [b"\xc2", b"\xe1", b"\xe2", b"\xe3", b"<|", *(bytes([x]) for x in range(0x1C, 0x20))]
_SPACE, _LETTER, _PUNCT = (np.zeros(256, bool) for _ in range(3))
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCT[[x for x in range(33, 127) if not chr(x).isalnum() and chr(x) != "'"]] = True
_CODES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
#: Distinct parts, and ids of theirs, that a worker keeps encoded; it starts anew beyond.
KEEP, KEEP_IDS = 400_000, 4_000_000


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lengths[i] - 1, one run after another."""
    ends = np.cumsum(lengths)
    out = np.arange(ends[-1] if len(ends) else 0)
    return out + np.repeat(starts - (ends - lengths), lengths)


class Encoder:
    """``encode(data, offs)``: ids of all texts of a piece, and where each text's ids begin."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, _U), np.zeros(0, np.int64)
        self.new_keys, self.new_slot = self.keys, self.slot
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1, np.int64)

    def library(self, strings: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tok.encode_batch_fast(strings, add_special_tokens=False)]

    @functools.cached_property
    def n_bytes(self) -> np.ndarray:
        """Bytes of text behind each id of a byte-level vocabulary."""
        vocab = self.tok.get_vocab(with_added_tokens=True)
        out = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            out[i] = len(token)
        return out

    @staticmethod
    def _find(keys: np.ndarray, slot: np.ndarray, want: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.full(len(want), -1)
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[at] == want, slot[at], -1)

    def _slots(self, want: np.ndarray, text) -> np.ndarray:
        """Places of the distinct, sorted ``want`` in the store; text(i) is the i-th's string."""
        found = self._find(self.keys, self.slot, want)
        if len(self.new_keys):
            found = np.where(found < 0, self._find(self.new_keys, self.new_slot, want), found)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            got = self.library([text(i) for i in miss])
            n = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter((x for y in got for x in y), np.uint32, int(n.sum()))
            end = int(self.at[-1])
            while end + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[end : end + len(flat)] = flat
            found[miss] = np.arange(len(self.at) - 1, len(self.at) - 1 + len(miss))
            self.at = np.concatenate([self.at, end + np.cumsum(n)])
            self.new_keys, self.new_slot = self._merge(self.new_keys, self.new_slot, want[miss], found[miss])
            if len(self.new_keys) > 20_000 + len(self.keys) // 8:
                self.keys, self.slot = self._merge(self.keys, self.slot, self.new_keys, self.new_slot)
                self.new_keys, self.new_slot = np.zeros(0, _U), np.zeros(0, np.int64)
        return found

    @staticmethod
    def _merge(keys, slot, more_keys, more_slot):
        keys, slot = np.concatenate([keys, more_keys]), np.concatenate([slot, more_slot])
        order = np.argsort(keys, kind="stable")
        return keys[order], slot[order]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.at) > KEEP or len(self.ids) > 2 * KEEP_IDS:
            self.clear()
        raw = data.tobytes()
        odd = np.zeros(len(offs) - 1, bool)
        if any(raw.find(x) >= 0 for x in _LEADS):
            hits = np.fromiter((m.start() for m in _ODD.finditer(raw)), np.int64)
            odd[np.searchsorted(offs, hits, "right") - 1] = True
        if len(data):
            cut = np.zeros(len(data), bool)
            space = _SPACE[data]
            cut[1:] = (space[1:] & ~space[:-1]) | (_LETTER[data[:-1]] & _PUNCT[data[1:]])
            cut[offs[:-1][offs[:-1] < len(data)]] = True
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], len(data))
            h = run_hashes(data, starts, ends, _CODES)
            keep = ~odd[np.searchsorted(offs, starts, "right") - 1] if odd.any() else slice(None)
            starts, ends, h = starts[keep], ends[keep], h[keep]
        else:
            starts = ends = np.zeros(0, np.int64)
            h = np.zeros(0, _U)
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        slots = self._slots(distinct, lambda i: raw[starts[first[i]] : ends[first[i]]].decode())[which]
        begin, n = self.at[slots], self.at[slots + 1] - self.at[slots]
        ids = self.ids[ragged(begin, n)]
        of = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, offs)]
        if odd.any():  # the library's ids of whole texts, put between
            rows = np.flatnonzero(odd)
            got = self.library([raw[offs[i] : offs[i + 1]].decode() for i in rows])
            ids = np.insert(ids, np.repeat(of[rows], [len(x) for x in got]), np.array([x for y in got for x in y], np.uint32))
            more = np.zeros(len(offs), np.int64)
            more[rows + 1] = [len(x) for x in got]
            of = of + np.cumsum(more)
        return ids, of


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder: what it has encoded serves later batches and tasks as well."""
    return Encoder(path)
