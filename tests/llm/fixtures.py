"""Plain-Python models of the definitions, and awkward rows that every operator must survive."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Two different words of 1,024 letters in which every pattern of a stands against the same pattern of b.
THUE = "".join("ab"[i.bit_count() % 2] for i in range(1024))
MORSE = THUE.translate(str.maketrans("ab", "ba"))

AWKWARD = [
    (1, None, "en", "src0", None),
    (2, "", "en", None, 0),
    (3, " \t\n ", None, "src1", 3),
    (4, "one", "en", "src0", 3),
    (5, "a b c a b c\n\na b c a b c\nx y   z", "fr", "src0", 1),
    (6, "été ß \U0001f600 \U0001f600 # * $ % & | < >\nété ß", "de", "src1", 1),
    (7, "same words in this text\n" * 40, "en", "src0", 1),
    (7, "same words in this text\n" * 40, "en", "src0", 1),
    (8, "same words in this text\n" * 40, "en", "src2", 1),
    (None, "no id here", "en", None, 1),
    (9, "long " * 9000 + "end", "en", "src0", 1),
    (10, " ".join(f"w{i}" for i in range(400)), "en", "src0", 1),
    (11, " ".join(f"w{i}" for i in range(399)), "en", "src1", 1),
    (12, " ".join(f"W{i}" for i in range(400)), "en", "src1", 1),
    (13, "x" * 3000, "en", "src0", 1),
    (14, f"{THUE} q\n{MORSE} q\nx y z\n{THUE} q", "en", "src0", 1),
    (15, f"{THUE} p q r", "en", "src0", 1),
    (16, f"{MORSE} p q r", "en", "src0", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def shingles(text, k):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
