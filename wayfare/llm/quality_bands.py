"""Quality rules: word statistics plus compression bands.

A text is compressed with zstandard as a whole and in fixed chunks.  Short
input compresses worse than long input of the same kind, so the allowed band
of ``bytes / compressed bytes`` depends on the length that was compressed
(``LOW``, ``HIGH``).  Above a band the text is repetitive, below it is
incompressible (random or encoded).  Hexadecimal text compresses as well as
short prose; where many words mix letters and digits, the band therefore
begins above what sixteen signs can reach (``CODE_LOW``).  A document is
rejected when

* its whole text lies outside the band of its length, or
* more than ``max_chunk_share`` of its bytes lie in chunks outside the band
  of a chunk's length (one bad region in a long text that the whole-text
  ratio averages away).

``base_failed`` is the word rule: too few words, or over half of the words in
three-word windows that repeat within the text.

Defined results: a null text counts as an empty one (no words, base_failed,
ratio null); white space alone likewise; texts of any length are read whole;
each row is judged on its own, so repeated rows get the same answer and an
empty table an empty one; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import by_row

#: (bytes, lowest ratio) of the compressed piece, straight lines between them; any ratio below 256 bytes.
#: Above base64 and random signs in words of four or more, below prose (figures in the README).
#: Longer texts are judged by their chunks as well, so a sound text with one odd region passes as a whole.
LOW = ((256, 1.17), (300, 1.20), (400, 1.25), (512, 1.29), (640, 1.32), (800, 1.36), (1024, 1.39), (1500, 1.41),
       (2048, 1.44), (3072, 1.55), (4096, 1.73), (16384, 1.55))
#: (bytes from, highest ratio).
HIGH = ((0, 3.0), (256, 4.0), (512, 4.5), (1024, 5.0), (4096, 6.0), (16384, 7.0), (65536, 8.0))
#: Lowest ratio of a piece of ``CODE_WORDS`` mixed words: sixteen signs and spaces stay under it at any length.
CODE_LOW = 2.25
CODE_WORDS = 0.4
CHUNK_BYTES = 4096
LEVEL = 3
MAX_CHUNK_SHARE = 0.25
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
DIGIT, LETTER = re.compile(rb"[0-9]"), re.compile(rb"[A-Za-z]")

COLUMNS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean, ratio double, bad_chunk_share double")


def word_statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()                       # bytes split on exactly \x20 and \x09-\x0D
    n = len(words)
    white = len(raw) - len(raw.translate(None, WHITE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and line.split(None, 1):
            seen.add(line)
    return n, len(text) - white, symbols, dup, _repeat_words(words)


def _repeat_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def band(size: int, code: bool = False) -> tuple[float, float]:
    """(lowest, highest) ratio of a piece of ``size`` bytes; ``code``: its words mix letters and digits."""
    low = 0.0
    if size >= LOW[0][0]:
        low = LOW[-1][1]
        for (start, x), (stop, y) in zip(LOW, LOW[1:]):
            if start <= size < stop:
                low = x + (y - x) * (size - start) / (stop - start)
                break
        if code:
            low = max(low, CODE_LOW)
    return low, next(h for start, h in reversed(HIGH) if size >= start)


def coded(piece: bytes) -> bool:
    """Whether ``CODE_WORDS`` of the words hold both a letter (A-Z, a-z) and a digit."""
    words = piece.split()
    return bool(words) and sum(1 for w in words if DIGIT.search(w) and LETTER.search(w)) >= CODE_WORDS * len(words)


def compression_verdict(raw: bytes, compressor, chunk_bytes: int = CHUNK_BYTES,
                        max_chunk_share: float = MAX_CHUNK_SHARE) -> tuple[bool, float | None, float]:
    """(inside the bands, whole-text ratio, share of bytes in chunks outside their band)."""
    if not raw:
        return True, None, 0.0

    def judged(piece: bytes) -> tuple[float, bool]:
        """The ratio, and whether it lies inside the band."""
        r = len(piece) / len(compressor.compress(piece))
        low, high = band(len(piece), r < CODE_LOW and coded(piece))
        return r, low <= r <= high

    whole, ok = judged(raw)
    bad = 0
    if len(raw) > chunk_bytes:
        for start in range(0, len(raw), chunk_bytes):
            piece = raw[start:start + chunk_bytes]
            if not judged(piece)[1]:
                bad += len(piece)
    share = bad / len(raw)
    return ok and share <= max_chunk_share, whole, share


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES,
            max_chunk_share: float = MAX_CHUNK_SHARE, min_words: int = MIN_WORDS,
            max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """One row per document: the statistics, base_failed, kept, whole-text ratio and bad chunk share."""
    id_type = docs.select(f"`{id_col}`").schema[0].dataType.simpleString()

    def row(compressor, key, text):
        text = text or ""
        n, chars, symbols, dup, repeat = word_statistics(text)
        base_failed = n < min_words or 100 * repeat > max_repeat_percent * n
        ok, whole, share = compression_verdict(text.encode("utf-8", "surrogatepass"), compressor,
                                               chunk_bytes, max_chunk_share)
        return key, n, chars, symbols, dup, repeat, base_failed, ok and not base_failed, whole, share

    return by_row(docs, {"id": id_col, "text": text_col}, f"`{id_col}` {id_type}, {COLUMNS}", row,
                  lambda: zstandard.ZstdCompressor(level=LEVEL))


def kept_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose text passes ``quality`` (narrow, no join)."""
    def passes(texts: pd.Series) -> pd.Series:
        compressor = zstandard.ZstdCompressor(level=LEVEL)

        def one(text) -> bool:
            text = text or ""
            n, _, _, _, repeat = word_statistics(text)
            if n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n:
                return False
            return compression_verdict(text.encode("utf-8", "surrogatepass"), compressor)[0]

        return pd.Series([one(t) for t in texts], dtype=bool)

    return docs.filter(F.pandas_udf(passes, "boolean")(F.col(f"`{text_col}`")))
