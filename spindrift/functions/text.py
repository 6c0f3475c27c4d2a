"""Text: normalization, word validity and transliteration of the script, CTC decoding, small helpers.

Short values stay inside the JVM as built-in expressions.  What goes over whole texts (normalization,
words, validity, transliteration) and ``edit_distance`` are Arrow functions: Spark has no expression for
canonical composition, and a dozen passes of regular expressions over a text cost far more than one look-up
for each word.  A worker remembers what it found for short words, in a table of bounded size.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

# The script's letters and their romanization.
CONSONANTS = {
    "க": "k", "ங": "ng", "ச": "s", "ஞ": "nj", "ட": "t", "ண": "n", "த": "th", "ந": "n", "ப": "p", "ம": "m", "ய": "y",
    "ர": "r", "ல": "l", "வ": "v", "ழ": "zh", "ள": "l", "ற": "r", "ன": "n", "ஜ": "j", "ஷ": "sh", "ஸ": "s", "ஹ": "h",
}
VOWELS = {"அ": "a", "ஆ": "aa", "இ": "i", "ஈ": "ii", "உ": "u", "ஊ": "uu", "எ": "e", "ஏ": "ee", "ஐ": "ai", "ஒ": "o", "ஓ": "oo", "\u0b94": "au"}
VOWEL_SIGNS = {
    "\u0bbe": "aa", "\u0bbf": "i", "\u0bc0": "ii", "\u0bc1": "u", "\u0bc2": "uu", "\u0bc6": "e",
    "\u0bc7": "ee", "\u0bc8": "ai", "\u0bca": "o", "\u0bcb": "oo", "\u0bcc": "au",
}
PULLI, AU_MARK, E_SIGN = "\u0bcd", "\u0bd7", "\u0bc6"
#: Two code points that are one letter, and that letter.
COMPOSED = (("\u0b92\u0bd7", "\u0b94"), ("\u0bc6\u0bbe", "\u0bca"), ("\u0bc7\u0bbe", "\u0bcb"), ("\u0bc6\u0bd7", "\u0bcc"))
# What normalization removes, and what words are stripped of.
JOINERS = "\u200b\u200c\u200d\ufeff"
PUNCTUATION = ".,;:!?\"'()[]{}<>–—-‘’“”"

_C = "".join(CONSONANTS)
_D = "".join(VOWEL_SIGNS)
#: What Python's str.split() takes for white space.
SPACE = "(?U)[\\s\\x1c-\\x1f]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def compose(x) -> Column:
    out = _c(x)
    for pair, one in COMPOSED:
        out = F.replace(out, F.lit(pair), F.lit(one))
    return out


_NO_JOINERS = dict.fromkeys(map(ord, JOINERS))


def _normal(t: str | None) -> str:
    if not t:
        return ""
    if not t.isascii():
        t = unicodedata.normalize("NFC", t).translate(_NO_JOINERS)
    return " ".join(t.split())


class _Known(dict):
    """What f gives for words, remembered for short ones; emptied when it's full."""

    MOST, LONGEST = 1 << 17, 64

    def __init__(self, f: Callable):
        super().__init__()
        self.f = f

    def __missing__(self, word: str):
        out = self.f(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = out
        return out


@F.pandas_udf(StringType())
def _normalized(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for p in parts:
        yield pd.Series([_normal(t) for t in p], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def _normalized_all(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for p in parts:
        yield pd.Series([None if ts is None else [_normal(t) for t in ts] for ts in p], dtype=object)


def normalize_text(x) -> Column:
    """Canonically composed, without joiners, white space collapsed and trimmed; null becomes empty."""
    return _normalized(_c(x))


def normalize_texts(x) -> Column:
    """normalize_text of every text in an array; a null array stays null."""
    return _normalized_all(_c(x))


def has_script(x) -> Column:
    """Whether any character is in the script's block."""
    return _c(x).rlike("[\\x{0B80}-\\x{0BFF}]")


def is_valid_word(x) -> Column:
    """All in the block, and every sign follows a consonant (the length mark also the e sign)."""
    t = compose(_c(x))
    bad_sign = t.rlike(f"(^|[^{_C}])[{_D}{PULLI}]")
    bad_mark = t.rlike(f"(^|[^{_C}{E_SIGN}]){AU_MARK}")
    return F.coalesce(_c(x).rlike("^[\\x{0B80}-\\x{0BFF}]+$") & ~bad_sign & ~bad_mark, F.lit(False))


#: Every unit that is romanized as a whole; whatever else stays.
_UNITS = {**VOWELS, PULLI: ""} | {c + s: r + v for c, r in CONSONANTS.items() for s, v in {"": "a", PULLI: "", **VOWEL_SIGNS}.items()}
_UNIT = re.compile(f"[{_C}][{_D}{PULLI}]?|[{''.join(VOWELS)}{PULLI}]")


def _roman_word(word: str) -> str | None:
    """Romanized, or null for a word of which normalization leaves nothing."""
    if word.isascii():
        return word
    t = _normal(word)
    return _UNIT.sub(lambda m: _UNITS[m[0]], t) if t else None


@F.pandas_udf(StringType())
def _romanized(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known = _Known(_roman_word)
    for p in parts:
        yield pd.Series([" ".join([w for w in map(known.__getitem__, t.split()) if w is not None]) if t else "" for t in p], dtype=object)


def transliterate(x) -> Column:
    """Normalized and romanized text: a consonant takes its sign's vowel, none before a pulli, else an a.  A unit never goes beyond a word."""
    return _romanized(_c(x))


@F.pandas_udf(ArrayType(StringType()))
def _words(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known = _Known(lambda w: _normal(w.strip(PUNCTUATION)))
    for p in parts:
        yield pd.Series([[w for w in map(known.__getitem__, t.split()) if w] if t else [] for t in p], dtype=object)


def words(x) -> Column:
    """Words between white space, stripped of punctuation at both ends and normalized."""
    return _words(_c(x))


_IN_BLOCK = re.compile("[\u0b80-\u0bff]")
_ALL_BLOCK = re.compile("[\u0b80-\u0bff]+")
_BAD = re.compile(f"(?:^|[^{_C}])[{_D}{PULLI}]|(?:^|[^{_C}{E_SIGN}]){AU_MARK}")
_LAYER = StructType([StructField("script_words", IntegerType()), StructField("valid_words", IntegerType()), StructField("score", DoubleType()), StructField("trusted", BooleanType())])


def _kind(word: str) -> int:
    """2 for a valid word of the script, 1 for another word with a character of its block, else 0."""
    t = "" if word.isascii() else _normal(word.strip(PUNCTUATION))
    if not _IN_BLOCK.search(t):
        return 0
    return 2 if _ALL_BLOCK.fullmatch(t) and not _BAD.search(t) else 1


def _plain_kind(word: str) -> int:
    """As _kind, by the plainer rules."""
    t = "" if word.isascii() else word.strip(".,;:!?\"'()[]").translate({0x200C: None, 0x200D: None})
    if not _IN_BLOCK.search(t):
        return 0
    return 2 if _ALL_BLOCK.fullmatch(t) and not _BAD.search(t) else 1


def _layer(x, minimum: float, kind: Callable[[str], int]) -> Column:
    @F.pandas_udf(_LAYER)
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = _Known(kind)
        for p in parts:
            kinds = [list(map(known.__getitem__, t.split())) if t else [] for t in p]
            n = np.array([len(k) - k.count(0) for k in kinds], dtype=np.int32)
            valid = np.array([k.count(2) for k in kinds], dtype=np.int32)
            score = np.divide(valid, n, out=np.zeros(len(n)), where=n > 0)
            yield pd.DataFrame({"script_words": n, "valid_words": valid, "score": score, "trusted": (n > 0) & (score >= minimum)})

    return judge(_c(x))


def text_layer(x, minimum: float = 0.95) -> Column:
    """struct(script_words, valid_words, score unrounded, trusted) of a text layer."""
    return _layer(x, minimum, _kind)


def text_layer_plain(x, minimum: float = 0.95) -> Column:
    """The plainer check: fewer punctuation marks are stripped, two joiners removed, nothing composed."""
    return _layer(x, minimum, _plain_kind)


def ctc_decode(tokens, charset: str | list[str]) -> Column:
    """Greedy decoding of an array<int>: immediate repeats and blanks (0) go; id k is the k-th character."""
    p = _c(tokens)
    kept = F.filter(p, lambda x, i: (x != 0) & ((i == 0) | (x != F.get(p, F.greatest(i - 1, F.lit(0))))))
    letters = F.array(*(F.lit(c) for c in charset))
    return F.array_join(F.transform(kept, lambda k: F.get(letters, k - 1)), "")


def encode_text(x, charset: str | list[str]) -> Column:
    """Ids from 1 of the characters; one that isn't in the charset is an error."""
    letters = F.array(*(F.lit(c) for c in charset))
    place = lambda c: F.array_position(letters, c).cast("int")
    return F.transform(F.filter(F.split(_c(x), ""), lambda c: c != ""), lambda c: F.when(place(c) > 0, place(c)).otherwise(F.raise_error(F.concat(F.lit("not in the charset: "), c))))


def levenshtein(a: str, b: str) -> int:
    """Edit distance over code points; exact.

    Two bounds settle it where they meet: texts of one length differ by at most their unequal places,
    and by at least the characters of which one has more.  The rest is Myers' bit-parallel table with
    the longer text's rows in one integer.
    """
    if a == b:
        return 0
    if len(a) == len(b):
        x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in (a, b))
        at = np.flatnonzero(x != y)
        if (Counter(x[at].tolist()) - Counter(y[at].tolist())).total() == len(at):
            return len(at)
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    top = 1 << (len(a) - 1)
    full = (top << 1) - 1
    more, less, out = full, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        v = eq | less
        h = (((eq & more) + more) ^ more) | eq
        up, down = less | (full & ~(h | more)), more & h
        out += bool(up & top) - bool(down & top)
        up, down = (up << 1) | 1, down << 1
        more, less = (down | ~(v | up)) & full, up & v & full
    return out


@F.pandas_udf(IntegerType())
def _levenshtein(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for p, q in parts:
        yield pd.Series([None if a is None or b is None else levenshtein(a, b) for a, b in zip(p, q, strict=True)], dtype="Int32")


def edit_distance(a, b) -> Column:
    """Levenshtein distance over code points; null if either is null."""
    return _levenshtein(_c(a), _c(b))


def tsv_field(x) -> Column:
    """Tabs become spaces, ends are stripped of all white space."""
    return strip(F.replace(_c(x), F.lit("\t"), F.lit(" ")))


def strip(x) -> Column:
    """Without the white space at both ends, whatever Python takes for that."""
    return F.regexp_replace(_c(x), f"^{SPACE}|{SPACE}$", "")


def is_blank(x) -> Column:
    """Null, empty or nothing but white space."""
    return F.coalesce(_c(x).rlike(f"^({SPACE})?$"), F.lit(True))


def slashes(x) -> Column:
    return F.replace(_c(x), F.lit("\\"), F.lit("/"))


def extension(path) -> Column:
    return F.lower(F.regexp_extract(_c(path), "\\.([^./\\\\]+)$", 1))


def filename(path) -> Column:
    return F.element_at(F.split(slashes(path), "/"), -1)


def html_escape(x) -> Column:
    t = _c(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def first_text(first, second) -> Column:
    """first unless it's null or empty, else second."""
    return F.coalesce(F.nullif(_c(first), F.lit("")), _c(second))


def crop_name(page, line) -> Column:
    return F.format_string("page-%04d-line-%04d.png", _c(page), _c(line))


def document_id(day, key) -> Column:
    """DOC-yyyymmdd-XXXXXX, the end from a hash of the key so that reruns agree."""
    return F.concat(F.lit("DOC-"), F.date_format(_c(day), "yyyyMMdd"), F.lit("-"), F.upper(F.substring(F.md5(_c(key)), 1, 6)))


TIME = "yyyy-MM-dd HH:mm:ss"


def time_text(at) -> Column:
    """A point in time as the text that is stored; ``F.current_timestamp()`` for now."""
    return F.date_format(_c(at), TIME)


def text_time(x) -> Column:
    """The point in time that such a text says; anything else is null."""
    return F.try_to_timestamp(_c(x), F.lit(TIME)).cast("timestamp_ntz")


def shard_number(path) -> Column:
    return F.regexp_extract(_c(path), "train_shard_(\\d+)", 1).try_cast("int")


def shard_path(number, rows: int = 5000) -> Column:
    """Folder named after the first row and the first of the next shard, then the shard's file."""
    n = _c(number)
    return F.format_string("%d-%d/train_shard_%03d", n * rows, n * rows + rows, n)
