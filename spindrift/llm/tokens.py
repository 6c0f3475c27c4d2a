"""Token ids of whole texts, fast: every distinct stretch between white space goes to the tokenizer once.

The tokenizer (a ``tokenizers`` JSON file that drops white space) treats each stretch between ASCII
white space by itself, so a text's ids are those of its stretches, one after another.  Stretches are
found with numpy; a direct-mapped table of fixed size remembers the ids of those of at most 16 bytes,
a dictionary those of longer ones.  A stretch is found there only if all its bytes and its length are
the same: a hash just says where to look.  What the table has lost is simply encoded again, so memory
is bounded and results don't depend on it.
"""

from __future__ import annotations

import os

import numpy as np

from spindrift.llm.wordscan import Texts, mix

#: Slots of the table, and ids it may hold before it's emptied.
SLOTS = 1 << 21
MOST_IDS = 1 << 24
#: Bytes of stretches that the dictionary may hold before it's emptied.
MOST_LONG = 1 << 25

_open: dict[tuple[str, bool], StretchTokenizer] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class StretchTokenizer:
    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.clear()

    def clear(self) -> None:
        # a stretch of 1 to 16 bytes is its two lanes and its size; size 0 is an empty slot
        self.one, self.two, self.size = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint8)
        self.begin, self.count = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint16 if self.vocabulary <= 1 << 16 else np.uint32), 0
        self.long: dict[bytes, tuple[int, int]] = {}
        self.long_bytes = 0

    def _encode(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Adds the ids of the stretches; returns begin and count of each."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(stretches, add_special_tokens=False)]
        count = np.fromiter(map(len, found), np.int64, len(found))
        total = int(count.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), total), self.ids.dtype)])
        self.ids[self.used : self.used + total] = np.fromiter((i for f in found for i in f), np.uint32, total)
        begin = self.used + np.cumsum(count) - count
        self.used += total
        return begin, count

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        if self.used > MOST_IDS or self.long_bytes > MOST_LONG:
            self.clear()
        texts.words()
        size = texts.ends - texts.starts
        one, two = texts.lane(texts.starts, size), texts.lane(texts.starts + 8, size - 8)
        slot = (mix(one ^ mix(two + size.astype(np.uint64))) & np.uint64(SLOTS - 1)).astype(np.int64)
        begin, count = self.begin[slot].astype(np.int64), self.count[slot].astype(np.int64)
        lost = np.flatnonzero((self.one[slot] != one) | (self.two[slot] != two) | (self.size[slot] != size) | (size > 16))
        if len(lost):
            data = texts.data.tobytes()
            words = [data[s:e] for s, e in zip(texts.starts[lost].tolist(), texts.ends[lost].tolist(), strict=True)]
            new = list(dict.fromkeys(w for w in words if w not in self.long))
            b, c = self._encode([w.decode("utf-8", "replace") for w in new])
            found = dict(zip(new, zip(b.tolist(), c.tolist(), strict=True), strict=True))
            for w in new:
                if len(w) > 16:
                    self.long[w] = found[w]
                    self.long_bytes += len(w) + 64
            got = np.array([found[w] if w in found else self.long[w] for w in words], dtype=np.int64)
            begin[lost], count[lost] = got[:, 0], got[:, 1]
            put = lost[size[lost] <= 16]
            self.one[slot[put]], self.two[slot[put]], self.size[slot[put]], self.begin[slot[put]], self.count[slot[put]] = one[put], two[put], size[put], begin[put], count[put]
        ends = np.cumsum(count)
        where = np.repeat(begin - ends + count, count)
        where += np.arange(len(where))
        per_text = np.bincount(texts.doc, weights=count, minlength=texts.n).astype(np.int64)
        return self.ids[where], per_text


def tokenizer(path: str, plain: bool = False) -> StretchTokenizer:
    """One for each Python worker and file; plain: a special token's name in a text is ordinary text."""
    if (path, plain) not in _open:
        _open[path, plain] = StretchTokenizer(path, plain)
    return _open[path, plain]


def with_end(ids: np.ndarray, per_text: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with one more at the end of each text."""
    ends = np.cumsum(per_text)
    out = np.insert(ids, ends, end)
    return out, per_text + 1
