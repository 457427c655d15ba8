"""Encoding of whole texts with a public word-level BPE file, memoised by word.

The file's pre-tokeniser drops white space and never joins across it, so the ids of a text are those of its blank-separated words in order.
Words of plain letters (ASCII, or U+00C0 to U+00FF) and plain marks are also cut between the two, as the pre-tokeniser does; their letters
are lower-cased and need no normalisation, so a tokenizer with the file's model alone encodes them. All other words go to the full one.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np

from .textscan import scan_words

#: 1 letters, 2 marks that only join each other, 3 the rest: digits, apostrophes, angle brackets, controls, other characters.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[[ord(c) for c in '!"#$%&()*+,-./:;=?@[]^_`{|}~' + chr(92)]] = 2
#: Second bytes of U+00C0 to U+00FF, without the signs for times and divided by.
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False
_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|[" + re.escape('!"#$%&()*+,-./:;=?@[]^_`{|}~' + chr(92)) + "]+")


def _cut_plain(b: np.ndarray, word: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For scan_words: plain words lower-cased, and cut between letters and marks."""
    kind = _CLASS[b]
    second = np.zeros(b.size, bool)
    second[1:] = (b[:-1] == 0xC3) & _SECOND[b[1:]]
    kind[second] = 1
    kind[:-1][second[1:]] = 1
    number = np.cumsum(begins)
    plain = word & ~(np.bincount(number, word & (kind == 3)) > 0)[number]
    begins = begins.copy()
    begins[1:] |= plain[1:] & plain[:-1] & (kind[1:] != kind[:-1])
    upper = plain & (((b >= 65) & (b <= 90)) | (second & (b <= 0x9E)))
    return b + (upper.astype(np.uint8) << 5), begins


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """``encode`` gives the ids of all rows of a text buffer and the bounds of each row. At most ``remember`` words stay in memory."""

    def __init__(self, path: str, remember: int = 300_000):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.full, self.model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        kinds = [x["type"] for x in [file["normalizer"], *(file["normalizer"] or {}).get("normalizers", [])] + file["pre_tokenizer"]["pretokenizers"]]
        suffix = file["model"]["end_of_word_suffix"]
        if kinds != ["Sequence", "NFC", "Replace", "Lowercase", "Split", "ByteLevel"] or not suffix:
            raise ValueError("the file isn't a word-level BPE of the expected kind")
        self.model.normalizer, self.model.pre_tokenizer = None, WhitespaceSplit()
        vocabulary = self.full.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        # the printable stand-ins of bytes: those of Latin-1 stand for themselves, the others follow from U+0100
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.remember = remember
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has."""
        plain = np.fromiter((_PLAIN.fullmatch(w) is not None for w in words), bool, len(words))
        easy = [w.lower() for w, ok in zip(words, plain.tolist(), strict=True) if ok]
        runs = [" ".join(easy[k : k + 64]).encode().decode("latin-1").translate(self.shown).replace(self.shown[32], " ") for k in range(0, len(easy), 64)]
        found = [np.array([i for e in self.model.encode_batch_fast(runs[k : k + 500], add_special_tokens=False) for i in e.ids], np.uint32) for k in range(0, len(runs), 500)]
        ids = np.concatenate([np.zeros(0, np.uint32), *found])
        sizes = np.zeros(len(words), np.int64)
        stops = np.flatnonzero(self.ends[ids])
        if stops.size != len(easy):
            raise ValueError("a word has no end")
        sizes[plain] = np.diff(np.append(-1, stops))
        rest = [e.ids for e in self.full.encode_batch([w for w, ok in zip(words, plain.tolist(), strict=True) if not ok], add_special_tokens=False)]
        sizes[~plain] = [len(r) for r in rest]
        out = np.empty(int(sizes.sum()), np.uint32)
        of = np.repeat(plain, sizes)
        out[of] = ids
        out[~of] = np.array([i for r in rest for i in r], np.uint32)
        return out, sizes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, lengths, hashes, bounds = scan_words(data, offsets, fold=False, refine=_cut_plain)
        if not starts.size:
            return np.zeros(0, np.uint32), np.zeros(offsets.size, np.int64)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        slot = np.fromiter(map(self.slots.get, distinct.tolist(), repeat(-1)), np.int64, distinct.size)
        new = np.flatnonzero(slot < 0)
        if new.size and len(self.slots) + new.size > self.remember:
            self._forget()
            new = np.arange(distinct.size)
        if new.size:
            low, high = int(offsets[0]), int(offsets[-1])
            raw = data[low:high].tobytes()
            words = [raw[s - low : s - low + n].decode("utf-8", "replace") for s, n in zip(starts[first[new]].tolist(), lengths[first[new]].tolist(), strict=True)]
            ids, sizes = self._of(words)
            slot[new] = np.arange(len(self.slots), len(self.slots) + new.size)
            self.slots.update(zip(distinct[new].tolist(), slot[new].tolist(), strict=True))
            self.begin = np.concatenate([self.begin, self.pool.size + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.pool = np.concatenate([self.pool, ids])
        of = slot[inverse]
        sizes = self.size[of]
        ends = np.cumsum(sizes)
        within = np.arange(int(ends[-1])) - np.repeat(ends - sizes, sizes)
        ids = self.pool[np.repeat(self.begin[of], sizes) + within]
        return ids, np.concatenate([[0], ends])[bounds]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder in each worker process; its memory of words carries over between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
