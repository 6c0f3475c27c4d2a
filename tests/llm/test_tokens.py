import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from spindrift.llm import matrices as M
from spindrift.llm import tokenfiles as T
from spindrift.llm import tokens as K
from spindrift.llm.wordscan import texts_of
from tests.llm.fixtures import AWKWARD, MORSE, SCHEMA, THUE

ODD = ["It's we'LL ΣΑΣ ΟΔΟΣ e\u0301 \u0301x", "<|endoftext|> x<|endoftext|>y", "İ ſt \x1c z\x85q\u2003r ’s 's 't 42 4.2", "\u0bc6\u0bbe \ud7ff \U0010ffff", "a\x00b", ""]


def encode(text):
    t = Tokenizer.from_file(K.tokenizer_path())
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizers(monkeypatch):
    import pyarrow as pa

    for slots, most in ((1 << 21, 1 << 24), (8, 30)):  # the second forgets nearly everything at once
        monkeypatch.setattr(K, "SLOTS", slots)
        monkeypatch.setattr(K, "MOST_IDS", most)
        t = K.StretchTokenizer(K.tokenizer_path(), plain=True)
        texts = ODD + [r[1] for r in AWKWARD]
        for _ in range(2):
            ids, per = t.encode(texts_of(pa.array(texts, pa.string())))
            at = np.concatenate([[0], np.cumsum(per)])
            for i, x in enumerate(texts):
                assert ids[at[i] : at[i + 1]].tolist() == encode(x), x


def rebuilt(rows, length):
    parts = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, dtype="<u2")
        assert len(ids) == length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= length
        assert (ids[r.n_tokens :] == M.PAD).all() and r.resets == r.cu_seqlens[:-1] and len(r.doc_ids) == len(r.resets)
        pos = M.position_ids(r.cu_seqlens)
        assert len(pos) == r.n_tokens and [i for i, p in enumerate(pos) if p == 0] == r.resets
        for k, (d, s) in enumerate(zip(r.doc_ids, r.doc_starts, strict=True)):
            parts[d].append((s, ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()))
    out = Counter()
    for d, ps in parts.items():
        docs = defaultdict(list)
        for s, p in sorted(ps):
            docs[s].append(p)
        n = len(docs[0])
        for i in range(n):  # rows that share a doc_id are equal in the fixtures
            out[(d, tuple(x for s in sorted(docs) for x in docs[s][i if len(docs[s]) > i else 0]))] += 1
    return out


@pytest.mark.parametrize(("length", "chunk"), [(2048, 1 << 21), (64, 500)])
def test_matrices_give_documents_back(spark, length, chunk):
    docs = spark.createDataFrame(AWKWARD, SCHEMA).selectExpr("*", "1 as ids", "2 as sequence_id")
    rows = M.pack_matrices(docs.repartition(2), length=length, chunk=chunk).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert rebuilt(rows, length) == Counter((r[0], (*encode(r[1]), M.END)) for r in AWKWARD)
    assert M.pack_matrices(docs.limit(0)).count() == 0


def test_matrices_of_real_rows_are_full(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = M.pack_matrices(docs.coalesce(1)).collect()
    assert rebuilt(rows, 2048) == Counter((r.doc_id, (*encode(r.text), M.END)) for r in docs.collect())
    total = sum(r.n_tokens for r in rows)
    assert len(rows) <= -(-total // 2048) + 2


def test_best_fit_decreasing_against_plain_search():
    rng = np.random.default_rng(4)
    for _ in range(30):
        sizes = rng.integers(1, 101, rng.integers(0, 200)).tolist()
        room, want = [], []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fits = [r for r in room if r >= sizes[i]]
            room.remove(min(fits)) if fits else want.append(1)
            room.append((min(fits) if fits else 100) - sizes[i])
        rows = M.best_fit_decreasing(sizes, 100)
        assert len(rows) == len(want) and sorted(i for r in rows for i in r) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in r) <= 100 for r in rows)


def test_token_files_round_trip(spark, tmp_path):
    rows = [*AWKWARD, *((100 + i, x, "en", "s", 1) for i, x in enumerate(ODD))]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as value", "2 as path")
    got = T.count_tokens(docs.repartition(3)).collect()
    assert Counter(r.n_tokens for r in got) == Counter(len(encode(r[1])) for r in rows)
    assert all(r.ended for r in got) and len({(r.path, r.ordinal) for r in got}) == len(rows)
    assert T.count_tokens(docs.limit(0)).count() == 0


def test_words_of_one_pattern_keep_their_own_ids():
    import pyarrow as pa

    texts = [f"{THUE} {MORSE}", f"{MORSE} {THUE}", THUE[:20] + " " + MORSE[:20], "a" * 16 + " " + "a" * 17 + " " + "a" * 15 + "b"]
    t = K.StretchTokenizer(K.tokenizer_path(), plain=True)
    for _ in range(2):
        ids, per = t.encode(texts_of(pa.array(texts)))
        at = np.concatenate([[0], np.cumsum(per)])
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [encode(x) for x in texts]


@pytest.mark.parametrize(("record", "records"), [(1, 1), (200, 2), (1 << 22, 32)])
def test_files_are_cut_by_bytes(spark, tmp_path, monkeypatch, record, records):
    monkeypatch.setattr(T, "RECORD_BYTES", record)
    monkeypatch.setattr(T, "RECORDS", records)
    rows = [r for r in AWKWARD if len(r[1] or "") < 5000]
    out = str(tmp_path / "flat")
    T.write_token_files(spark.createDataFrame(rows, SCHEMA).coalesce(1), out)
    want = [encode(r[1]) for r in rows]
    files = sorted((tmp_path / "flat").glob("part-*"))
    sizes = [f.stat().st_size for f in files]
    assert sum(sizes) == sum(2 * len(w) + 2 for w in want)
    most = max(2 * len(w) + 2 for w in want)
    assert max(sizes) <= records * max(record, most) and (record > 1 or len(files) == len(rows))
    assert Counter(r.n_tokens for r in T.separator_scan(spark, out).collect()) == Counter(map(len, want))


@pytest.mark.parametrize("width", [2, 4])
def test_large_files_are_read_in_ranges(spark, tmp_path, width):
    rng = np.random.default_rng(width)
    end = 0x0102 if width == 2 else 0x01020304  # bytes that other ids make, too, across their borders
    near = [end, 0x0201, 0x0102, 0x0301, 0x0203, 5] if width == 2 else [end, 0x04030201, 0x02030401, 0x03040102, 0x01020403, 0x02030104, 7]
    want = set()
    for f, n in enumerate((5000, 1, 0, 4097, 30)):
        ids = [near[i] for i in rng.integers(0, len(near), n)] + ([end] if f % 2 else [])
        (tmp_path / f"f{f}").write_bytes(struct.pack(f"<{len(ids)}{'H' if width == 2 else 'I'}", *ids))
        start = k = 0
        for i, x in enumerate([*ids, None]):
            if x == end or x is None and i > start:
                want.add((f"f{f}", k, start, i - start, x == end))
                start, k = i + 1, k + 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        for most in (-1, 500, 10**6):  # all in ranges, the large ones, none
            got = T.separator_scan(spark, str(tmp_path), end=end, width=width, most=most).collect()
            assert {(r.path.rsplit("/", 1)[1], *r[1:]) for r in got} == want and len(got) == len(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(ValueError, match="overlap"):
        T.range_scan(spark, str(tmp_path), end=0x0101, width=2)


@pytest.mark.parametrize("width", [2, 4])
def test_separator_scan_against_plain_search(spark, tmp_path, width):
    rng = np.random.default_rng(width)
    want = set()
    for f in range(12):
        ids = rng.integers(0, 9 if f % 3 else 200, rng.integers(0, 700)).tolist()
        if f % 2:
            ids = [7] * (f // 2) + ids
        (tmp_path / f"f{f}").write_bytes(struct.pack(f"<{len(ids)}{'H' if width == 2 else 'I'}", *ids))
        start = k = 0
        for i, x in enumerate([*ids, None]):
            if x == 7 or x is None and i > start:
                want.add((f"f{f}", k, start, i - start, x == 7))
                start, k = i + 1, k + 1
    got = T.separator_scan(spark, str(tmp_path), end=7, width=width, block=16).collect()
    assert {(r.path.rsplit("/", 1)[1], *r[1:]) for r in got} == want and len(got) == len(want)
    (tmp_path / "broken").write_bytes(b"\x00" * (width + 1))
    with pytest.raises(Exception, match="whole number"):
        T.separator_scan(spark, str(tmp_path), width=width).collect()
