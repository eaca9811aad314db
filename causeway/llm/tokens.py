"""Token ids of whole Arrow columns of text, by the tokenizers library.

Both tokenizers cut a text before merging, and never merge across the cuts found here, so a piece has the same ids
wherever it stands. Each distinct piece that a worker meets is encoded once by the library and kept (up to KEPT
pieces, then the memory starts anew); a text's ids are put together from its pieces. Tests compare this with
encoding texts whole.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from .textkit import SPACE, chunks, hashes, pieces, sums

KEPT, BATCH = 1_500_000, 4096
_U = np.uint64
#: Bytes after a blank that surely begin a word: printable ASCII, or the lead byte of a Latin-1 letter.
_BEGINS = np.zeros(256, bool)
_BEGINS[0x21:0x7F] = True
_BEGINS[0xC3] = True
#: An ASCII letter before one of these marks ends a word too.
_LETTER, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP[list(b".,;:!?)|")] = True


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Encodes columns of text with one tokenizer file. at_blanks: cut before single blanks that begin a word (byte
    level), else at all white space, which the tokenizer drops."""

    def __init__(self, path: str, at_blanks: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.at_blanks = Tokenizer.from_file(path), at_blanks
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slot = np.zeros(0, _U), np.zeros(0, np.int64)
        self.begin, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _pieces(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.at_blanks:
            return pieces(data, offs, SPACE[data])
        n = len(data)
        if not n:
            return pieces(data, offs, np.zeros(0, bool))
        cut = np.zeros(n, bool)
        cut[:-1] = (data[:-1] == 0x20) & _BEGINS[data[1:]]
        cut[1:] |= _LETTER[data[:-1]] & _STOP[data[1:]]
        cut[offs[:-1][offs[:-1] < n]] = True
        starts = np.flatnonzero(cut)
        # a blank at the end of a row doesn't begin a word of the next row
        ends = np.append(starts[1:], n)
        return starts, ends, np.searchsorted(offs, starts, "right") - 1

    def _ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, some thousand at a time: the library keeps much beside the ids of a batch."""
        out = []
        for k in range(0, len(texts), BATCH):
            got = self.tokenizer.encode_batch_fast(texts[k : k + BATCH], add_special_tokens=False)
            out += [e.ids for e in got]
        return out

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        if len(self.keys) + len(keys) > KEPT:
            self._forget()
        got = self._ids(texts)
        size = np.fromiter(map(len, got), np.int64, len(got))
        slot = np.arange(len(self.begin) - 1, len(self.begin) - 1 + len(keys))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(size)])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slot = np.insert(self.keys, at, keys), np.insert(self.slot, at, slot)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows as uint32, number of ids of each row). A null is an empty text."""
        out, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for first, data, offs in chunks(column, 1 << 21):
            raw = data.tobytes()
            if any(s in raw for s in self.special):  # the library reads these strings as one token
                whole = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:], strict=True)]
                got = self._ids(whole)
                sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
                out.append(np.fromiter(chain.from_iterable(got), np.uint32, int(sizes[-1].sum())))
                continue
            starts, ends, row = self._pieces(data, offs)
            key, where, back = np.unique(
                hashes(sums(data), starts, ends), return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            new = self.keys[at] != key if len(self.keys) else np.ones(len(key), bool)
            if new.any():
                need = np.flatnonzero(new)
                if len(self.keys) + len(need) > KEPT:  # all of this chunk's pieces are needed at once
                    self._forget()
                    need = np.arange(len(key))
                self._learn(key[need], [raw[a:b].decode("utf-8", "replace") for a, b in zip(
                    starts[where[need]].tolist(), ends[where[need]].tolist(), strict=True)])
                at = np.searchsorted(self.keys, key)
            slot = self.slot[at] if len(key) else np.zeros(0, np.int64)
            begin, size = self.begin[slot][back], (self.begin[slot + 1] - self.begin[slot])[back]
            total = np.concatenate([[0], np.cumsum(size)])
            out.append(self.ids[np.arange(total[-1]) + np.repeat(begin - total[:-1], size)])
            words = np.searchsorted(row, np.arange(len(offs)))
            sizes.append(total[words[1:]] - total[words[:-1]])
        return np.concatenate(out), np.concatenate(sizes)


_held: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, at_blanks: bool) -> PieceEncoder:
    """The encoder of this worker, which keeps its pieces from task to task."""
    if (path, at_blanks) not in _held:
        _held[path, at_blanks] = PieceEncoder(path, at_blanks)
    return _held[path, at_blanks]
