import random

import numpy as np
import pyarrow as pa

from spindrift.llm import wordscan as W
from tests.llm.fixtures import AWKWARD, MORSE, THUE, words

rng = random.Random(3)
TEXTS = [r[1] for r in AWKWARD] + ["".join(rng.choice(" \t\n\x0b\x0c\r  ab é\U0001f600\x1c") for _ in range(rng.randint(0, 60))) for _ in range(300)]


def test_words_lines_and_hashes():
    t = W.texts_of(pa.array(TEXTS, pa.string())).words()
    raw = t.data.tobytes()
    got = [[] for _ in TEXTS]
    for s, e, d in zip(t.starts, t.ends, t.doc, strict=True):
        got[d].append(raw[s:e].decode())
    assert got == [words(x) for x in TEXTS]
    flat, h = [w for x in got for w in x], t.word_hashes()
    names = {}
    for w, x in zip(flat, h.tolist(), strict=True):
        assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)
    lines = [[] for _ in TEXTS]
    for s, e, d in zip(*t.lines(), strict=True):
        lines[d].append(raw[s:e].decode())
    assert lines == [(x or "").split("\n") for x in TEXTS]


def test_words_of_one_pattern_have_hashes_of_their_own():
    made = [THUE[:n] for n in range(1, 1025, 3)] + [MORSE[:n] for n in range(1, 1025, 3)] + ["a" * n for n in range(2, 200)] + ["\x00" * n for n in range(1, 40)] + ["a" + "\x00" * n for n in range(1, 40)]
    t = W.texts_of(pa.array([" ".join(made)])).words()
    assert len(set(t.word_hashes().tolist())) == len(set(made))


def test_grams_stay_inside_a_text():
    h, doc = np.arange(7, dtype=np.uint64), np.array([0, 0, 0, 1, 1, 2, 2])
    g, at = W.grams(h, doc, 3)
    assert at.tolist() == [0] and len(g) == 1
    assert W.grams(h[:2], doc[:2], 3)[0].size == 0


def test_slices_hold_all_rows():
    batch = pa.RecordBatch.from_pydict({"i": range(len(TEXTS)), "text": pa.array(TEXTS, pa.string())})
    for limit in (1, 50, 1 << 20):
        parts = list(W.slices(batch, "text", limit))
        assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(len(TEXTS)))
        assert all(p.num_rows == 1 or sum(len((x or "").encode()) for x in p.column("text").to_pylist()) <= limit for p in parts)
    assert list(W.slices(batch.slice(0, 0), "text")) == []
