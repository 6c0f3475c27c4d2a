import random
import time
from collections import Counter

import pyarrow as pa

from spindrift.llm import licenses as L
from spindrift.llm.wordscan import LOWER, Texts, texts_of
from tests.llm.fixtures import AWKWARD, SCHEMA

FILL = "lorem ipsum the work is under dolor this version sit amet of general to".split()


def test_planted_notices_are_found_and_nothing_else(spark):
    rng = random.Random(1)
    rows, want = [], set()
    for i, (name, notice) in enumerate(sorted(L.TEMPLATES.items()) * 3):
        words = [rng.choice(FILL) for _ in range(rng.choice([0, 5, 400]))]
        cut = rng.randint(0, len(words))
        rows.append((i, " ".join(words[:cut]) + "\n" + (notice.upper() if i % 3 == 0 else notice) + "\n" + " ".join(words[cut:])))
        want.add((i, name))
    rows += [(1000 + i, " ".join(rng.choice(FILL) for _ in range(500))) for i in range(50)]
    got = L.license_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.license) for r in got if r.doc_id >= 1000} == set()
    assert want <= {(r.doc_id, r.license) for r in got if r.coverage == 1.0}
    assert len(got) == len(rows) - 50
    text = dict(rows)
    for r in got:
        span = text[r.doc_id].encode()[r.first_byte : r.end_byte].decode().lower()
        assert [w for w in "".join(c if c.isalnum() else " " for c in span).split()] == [w for w in "".join(c if c.isalnum() else " " for c in L.TEMPLATES[r.license]).lower().split()]


def test_edits_versions_and_repeats(spark):
    rows = [
        (1, "x Licensed under the famous Apache License, Version 2.0. y"), (2, "Licensed under the Apache License, Version 1.1."), (3, "This work is licensed under the GNU General Public License, version 2."),
        (4, "Released under the MIT License. " * 3), (5, "released the hounds under the table near the mit campus with a driving license"), (6, "Licensed under CC BY-NC 4.0."), (7, "Licensed under CC BY-NC 3.0."),
    ]
    got = L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((r.doc_id, r.license) for r in got)
    assert found == [(1, "Apache-2.0"), (3, "GPL-2.0"), (4, "MIT"), (4, "MIT"), (4, "MIT"), (6, "CC-BY-NC-4.0")]


def test_license_lines_of_documents(spark, sf):
    # the lines as the documents carry them, written out here and not taken from the templates
    lines = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "all-rights-reserved", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    }
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = Counter()
    for r in docs.collect():
        text = r.text.encode()
        for line, name in lines.items():
            at = text.find(line.encode())
            while at >= 0:
                want[r.doc_id, name, at] += 1
                at = text.find(line.encode(), at + 1)
    assert "all-rights-reserved" in {name for _, name, _ in want}
    assert Counter((r.doc_id, r.license, r.first_byte) for r in L.license_scan(docs).collect()) == want


def test_rights_reserved_with_and_without_copyright(spark):
    rows = [(1, "x All rights reserved. y"), (2, "x Copyright. All rights reserved. y"), (3, "all is reserved by rights"), (4, "all rights")]
    got = L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license, r.first_word) for r in got) == [(1, "all-rights-reserved", 1), (2, "copyright-all-rights-reserved", 1)]


def edited(rng, name, n):
    words = L.TEMPLATES[name].split()
    for _ in range(n):
        k, r = rng.randrange(len(words)), rng.random()
        if r < 0.4:
            words[k] = f"edit{rng.randrange(99)}"
        elif r < 0.7:
            del words[k]
        else:
            words.insert(k, f"extra{rng.randrange(99)}")
    return " ".join(words)


def scanned(text, step=None):
    t = texts_of(pa.array([text]))
    return L.Scanner(L.TEMPLATES, L.MIN_COVERAGE).scan(Texts(LOWER[t.data], t.offsets), step)


def test_windows_against_every_window():
    # aligning every template at every word finds the same notices, at most a few words at their ends better
    rng = random.Random(4)
    fill = [*FILL, "license", "you", "may", "zebra", "quartz"]
    long = [n for n, t in L.TEMPLATES.items() if len(t.split()) >= L.SHORT]
    same = total = 0
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += [" ".join(rng.choice(fill) for _ in range(rng.randint(0, 60))), edited(rng, rng.choice(long), rng.randint(0, 4))]
        got, want = scanned("\n".join(parts)), scanned("\n".join(parts), 1)
        assert sorted(r[1] for r in got) == sorted(r[1] for r in want)
        for a, b in zip(sorted(got, key=lambda r: r[2]), sorted(want, key=lambda r: r[2]), strict=True):
            assert a[1] == b[1] and a[2] < b[2] + b[3] and b[2] < a[2] + a[3] and a[7] >= b[7] - 0.1
            same += a == b
            total += 1
    assert total > 100 and same >= 0.95 * total


def test_a_long_text_of_edited_notices_takes_time_in_proportion():
    rng = random.Random(5)
    seconds = []
    for n in (400, 3600):
        text = "\n".join(edited(rng, "Apache-2.0-header", 3) for _ in range(n))
        began = time.time()
        found = scanned(text)
        seconds.append(time.time() - began)
        # an edit that takes a version away leaves a header that isn't one
        assert 0.9 * n < sum(r[1] == "Apache-2.0-header" for r in found) <= n
    assert len(text) > 1_800_000 and seconds[1] < 25 * seconds[0] + 1 and seconds[1] < 60


def test_awkward_rows(spark):
    docs = spark.createDataFrame([*AWKWARD, (50, "word " * 20000 + L.TEMPLATES["MIT"] + " word" * 20000, "en", "s", 1), (51, L.TEMPLATES["MIT"], None, None, None), (51, L.TEMPLATES["MIT"], None, None, None)], SCHEMA)
    got = L.license_scan(docs.selectExpr("*", "1 as license", "2 as matched"))
    assert sorted((r.doc_id, r.license, r.first_word) for r in got.collect()) == [(50, "MIT", 20000), (51, "MIT", 0), (51, "MIT", 0)]
    assert L.license_scan(docs.limit(0)).count() == 0


def test_alignment_is_increasing_and_exact_on_unique_words():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.randrange(12) for _ in range(rng.randint(0, 15))] for _ in range(2))
        pairs = L.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    order = rng.sample(range(200), 200)
    tails = []
    for v in order:
        import bisect

        k = bisect.bisect_left(tails, v)
        tails[k : k + 1] = [v]
    assert len(L.align([-1, *order, -2], [-3, *range(200), -4])) == len(tails)
