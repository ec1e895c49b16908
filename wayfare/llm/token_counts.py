"""Token counts: count-only Viterbi over a unigram vocabulary.

A vocabulary of pieces with scores is matched against a text by an
Aho-Corasick automaton; dynamic programming over end positions carries the
best score and the number of pieces of that best segmentation, and nothing
else, so no segmentation is ever built.

Tokenizer rules that the count keeps exactly:

* normalisation: every space becomes ``MARK`` and one ``MARK`` is put in
  front of a non-empty text; nothing else is changed;
* at an end position the segmentation found first keeps its place: a later
  candidate must score strictly higher, and candidates come in order of their
  start, so at equal score the longer last piece stays;
* a character that is no piece by itself scores ``lowest score - 10`` and
  counts one piece for each of its UTF-8 bytes (byte fallback).

If no piece has ``MARK`` after another character, no piece crosses the start
of a marked word, words can be counted one by one and their counts are kept
in a bounded table.  The scores of the given file are whole numbers, for
which sums in floating point are exact, so the cut changes no tie.

Defined results: a null or empty text has 0 tokens; texts are read whole;
each row is counted on its own; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from wayfare.llm.common import bounded_broadcast, by_row

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose counts a task keeps at most; the table starts anew when it is full.
KEPT_WORDS = 500_000
KEPT_WORD_CHARS = 64


def read_vocabulary(path: str = MODEL) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file, without control, unknown and byte pieces."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class Counter:
    """Counts the pieces of the best segmentation."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        crossing = any(MARK in p.lstrip(MARK) for p, _ in vocabulary)
        whole = all(float(s).is_integer() for _, s in vocabulary)
        self.word = None if crossing or not whole else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")
        self.kept: dict[str, int] = {}

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        normal = MARK + text.replace(" ", MARK)
        if self.word is None:
            return self.viterbi(normal)
        kept, total = self.kept, 0
        for w in self.word.findall(normal):
            n = kept.get(w)
            if n is None:
                n = self.viterbi(w)
                if len(w) <= KEPT_WORD_CHARS:
                    if len(kept) >= KEPT_WORDS:
                        kept.clear()
                    kept[w] = n
            total += n
        return total

    def viterbi(self, text: str) -> int:
        n = len(text)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        done = 0                  # positions up to here are settled
        found = None              # (score, pieces) at the end position being settled
        single = False            # it has a one-character piece

        def settle(end: int, found, single: bool) -> None:
            if not single:
                score = best[end - 1] + self.unknown
                if found is None or score > found[0]:
                    found = score, count[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass"))
            best[end], count[end] = found

        for last, (length, score) in self.automaton.iter(text):
            end = last + 1
            if end != done + 1:
                settle(done + 1, found, single)
                for e in range(done + 2, end):
                    settle(e, None, False)
                done, found, single = end - 1, None, False
            score += best[end - length]
            if found is None or score > found[0]:      # matches of one end come longest first
                found = score, count[end - length] + 1
            single = single or length == 1
        if done < n:
            settle(done + 1, found, single)
            for e in range(done + 2, n + 1):
                settle(e, None, False)
        return count[n]


def token_counts(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of every row; the vocabulary is read on the driver and its measured copy broadcast."""
    vocabulary = bounded_broadcast(docs.sparkSession, read_vocabulary(model))
    id_type = docs.select(f"`{id_col}`").schema[0].dataType.simpleString()
    return by_row(docs, {"id": id_col, "text": text_col}, f"`{id_col}` {id_type}, n_tokens long",
                  lambda counter, key, text: (key, counter(text)), lambda: Counter(vocabulary.value))
