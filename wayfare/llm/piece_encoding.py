"""SentencePiece encoding and decoding by a prefix table (models of merge type with byte fallback).

A merge tokenizer starts from single characters and joins, again and again,
the adjacent pair whose concatenation is the best piece (leftmost at equal
score).  Merges inside a piece never depend on what stands around it, so a
sequence of pieces is the encoding of its text exactly where every two
neighbours are *compatible*: joining starts from their characters and ends
with just these two.  Hence every prefix of a text has one last piece:

* an Aho-Corasick automaton names the pieces that end at a position;
* the one of them that is compatible with the last piece of the prefix in
  front of it is stored;
* ids are recovered backwards from the end, in time linear in the text.

Compatibility is read off the two pieces' last merges: from the outside in,
the merge that came later is undone, and the pair standing at the seam must
not be a piece that would have been joined before the merge just undone.
Pieces that are not scored worse than all their parts (runs of spaces share
one score) have no such order; their pairs are joined from characters.

What the library does around it is kept exactly: every space becomes ``MARK``
and one ``MARK`` is put in front of a non-empty text; a character without a
piece becomes the ids of its UTF-8 bytes; decoding turns ``MARK`` into a
space, leaves out the first piece's own, and turns each byte that is no valid
UTF-8 into U+FFFD.  Texts are cut where no piece can cross: in front of a
space, after the letters of a word, around line feeds.

Defined results: a null or empty text has only the end id; texts are read
whole; each row is encoded on its own, so ties and repeated rows need no rule;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterable
from hashlib import sha256
from itertools import groupby
from string import ascii_letters

import ahocorasick
from pyspark.sql import DataFrame

from wayfare.llm.common import bounded_broadcast, by_row

MARK = "▁"
UNKNOWN_SURFACE = " ⁇ "      # fixed value: what the library writes for an unknown id
#: Entries that a worker keeps at most: encoded pieces of text, and tested pairs.
KEPT_CHUNKS, KEPT_CHUNK_CHARS, KEPT_PAIRS = 400_000, 64, 1_000_000

codecs.register_error("wayfare_each_byte", lambda e: ("�", e.start + 1))


def joined(text: str, rank: dict[str, float], least: int = 1) -> list[str]:
    """The symbols left when no adjacent pair of ``text`` is a piece (or ``least`` are left);
    the best pair goes first, then the leftmost."""
    symbols = list(text)
    while len(symbols) > least:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in rank), default=None)
        if best is None:
            break
        i = best[1]
        symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
    return symbols


class Vocabulary:
    """What tasks need of a model file: ids, ranks, last merges, byte ids and the text of every id."""

    def __init__(self, ids: dict[str, int], rank: dict[str, float], byte_ids: list[int], surface: list[bytes],
                 begin: int, end: int, controls: set[int]):
        self.ids, self.rank, self.byte_ids, self.surface, self.begin, self.end = ids, rank, byte_ids, surface, begin, end
        self.controls = frozenset(controls)
        self.leads = frozenset(i for p, i in ids.items() if p.startswith(MARK))   # their MARK is left out at the front
        #: the two parts that joining a piece from its characters joins last, for pieces that are reached so
        self.parts = {p: m for p in rank if len(p) > 1 and len(m := joined(p, rank, 2)) == 2}
        self.ordered = {p for p in rank if len(p) == 1}
        for p in sorted(self.parts, key=len):
            # in order: each part is one character or was itself joined earlier
            if all(len(x) == 1 or (x in self.ordered and rank[x] < rank[p]) for x in self.parts[p]):
                self.ordered.add(p)


def read_vocabulary(model: str) -> Vocabulary:
    """The vocabulary of a model file; a model that is encoded in another way is refused."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2
    proto = sentencepiece_model_pb2.ModelProto()
    with open(model, "rb") as f:
        proto.ParseFromString(f.read())
    norm = proto.normalizer_spec
    kinds = {type(proto.pieces[0]).Type.Name(p.type) for p in proto.pieces}
    if (proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or norm.precompiled_charsmap
            or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces
            or proto.trainer_spec.treat_whitespace_as_suffix or kinds - {"NORMAL", "UNKNOWN", "CONTROL", "BYTE"}):
        raise ValueError("only merge-type models with byte fallback, identity normalisation and a space in front are read")
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    size = sp.get_piece_size()
    special = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
    ids = {sp.id_to_piece(i): i for i in range(size) if i not in special}
    surface = [sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(size)]
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    for b, i in enumerate(byte_ids):
        surface[i] = bytes([b])
    controls = {i for i in range(size) if sp.is_control(i)}
    for i in controls:
        surface[i] = b""
    surface[sp.unk_id()] = UNKNOWN_SURFACE.encode()
    return Vocabulary(ids, {p: -sp.get_score(i) for p, i in ids.items()}, byte_ids, surface, sp.bos_id(), sp.eos_id(), controls)


def cutter(pieces: Iterable[str]) -> re.Pattern | None:
    """Cuts a marked text at places that no piece crosses: in front of MARK, after the letters of a
    word, around line feeds; None where a piece has MARK after another character or holds a line feed."""
    pieces = list(pieces)
    if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
        return None
    follows: dict[str, set[str]] = {}
    for p in pieces:
        for x, y in zip(p, p[1:]):
            follows.setdefault(x, set()).add(y)
    word, new = set(), set(ascii_letters)          # closed: in a piece, only these follow one of these
    while new:
        word |= new
        new = set().union(*(follows.get(x, ()) for x in new)) - word
    w = re.escape("".join(sorted(word)))
    return re.compile(f"{MARK}*[^{MARK}\n{w}]*[{w}]+|{MARK}*[^{MARK}\n{w}]+|{MARK}+|\n")


class Codec:
    """Encodes and decodes texts; one a worker, with bounded tables of what it has seen."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece in v.ids:
            if len(piece) == 1 or piece in v.parts:
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.decimal = [str(i) for i in range(len(v.surface))]
        self.cut = cutter(v.ids)
        self.kept: dict[str, tuple[int, ...]] = {}
        self.tested: dict[tuple[str, str], bool] = {}

    def compatible(self, a: str, b: str) -> bool:
        """Whether joining the characters of ``a + b`` ends with the pieces ``a`` and ``b``."""
        found = self.tested.get((a, b))
        if found is None:
            if len(self.tested) >= KEPT_PAIRS:
                self.tested.clear()
            found = self.tested[a, b] = self._compatible(a, b)
        return found

    def _compatible(self, a: str, b: str) -> bool:
        rank, parts, ordered = self.vocabulary.rank, self.vocabulary.parts, self.vocabulary.ordered
        if not ((len(a) == 1 or a in ordered) and (len(b) == 1 or b in ordered)):
            return joined(a + b, rank) == [a, b]
        until, by_left = None, False       # the merge that ends the time of the pair (a, b) at the seam
        while True:
            r = rank.get(a + b)
            if r is not None and (until is None or r < until or (r == until and not by_left)):
                return False
            if len(a) > 1 and (len(b) == 1 or rank[a] > rank[b]):
                until, by_left, a = rank[a], True, parts[a][1]
            elif len(b) > 1:               # of two equal merges the right one came later
                until, by_left, b = rank[b], False, parts[b][0]
            else:
                return True

    def last_pieces(self, text: str) -> list[str]:
        """For each prefix of ``text`` (by length, from 0) the last piece of its encoding."""
        last = [""] * (len(text) + 1)
        at = 0                             # prefixes up to here are settled
        for end, piece in self.automaton.iter(text):
            end += 1
            while at < end - 1:            # ends without a compatible piece: the character stands for itself
                at += 1
                last[at] = last[at] or text[at - 1]
            if not last[end]:
                start = end - len(piece)
                if start == 0 or self.compatible(last[start], piece):
                    last[end] = piece
        while at < len(text):
            at += 1
            last[at] = last[at] or text[at - 1]
        return last

    def chunk(self, text: str) -> tuple[int, ...]:
        last, ids, out, at = self.last_pieces(text), self.vocabulary.ids, [], len(text)
        while at:
            piece = last[at]
            if (i := ids.get(piece)) is not None:
                out.append(i)
            else:
                out.extend(self.vocabulary.byte_ids[b] for b in reversed(piece.encode("utf-8", "surrogatepass")))
            at -= len(piece)
        return tuple(reversed(out))

    def encode(self, text: str | None, add_end: bool = True) -> list[int]:
        out: list[int] = []
        if text:
            normal, kept = MARK + text.replace(" ", MARK), self.kept
            for c in self.cut.findall(normal) if self.cut else [normal]:
                ids = kept.get(c)
                if ids is None:
                    ids = self.chunk(c)
                    if len(c) <= KEPT_CHUNK_CHARS:
                        if len(kept) >= KEPT_CHUNKS:
                            kept.clear()
                        kept[c] = ids
                out += ids
        if add_end:
            out.append(self.vocabulary.end)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        v, parts = self.vocabulary, [[]]
        for stop, group in groupby(ids, v.controls.__contains__):      # bytes on two sides of a control id are no character
            if not stop:
                parts.append(list(group))
        out = [b"".join(map(v.surface.__getitem__, p)) for p in parts]
        first = next((p[0] for p in parts if p), None)
        text = "".join(o.decode("utf-8", "wayfare_each_byte") for o in out)
        return text[1:] if first in v.leads else text


_CODECS: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """The worker's codec of a broadcast vocabulary; a worker keeps it from task to task."""
    v = shared.value
    if id(v) not in _CODECS or _CODECS[id(v)].vocabulary is not v:
        _CODECS.clear()
        _CODECS[id(v)] = Codec(v)
    return _CODECS[id(v)]


def _type(df: DataFrame, column: str) -> str:
    return df.select(f"`{column}`").schema[0].dataType.simpleString()


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", add_end: bool = True) -> DataFrame:
    """(id, ids) of every row; the vocabulary is read on the driver and its measured copy broadcast."""
    shared = bounded_broadcast(docs.sparkSession, read_vocabulary(model))
    return by_row(docs, {"id": id_col, "text": text_col}, f"`{id_col}` {_type(docs, id_col)}, ids array<int>",
                  lambda codec, key, text: (key, codec.encode(text, add_end)), lambda: _codec(shared))


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids; null ids give a null text."""
    shared = bounded_broadcast(encoded.sparkSession, read_vocabulary(model))
    return by_row(encoded, {"id": id_col, "ids": ids_col}, f"`{id_col}` {_type(encoded, id_col)}, text string",
                  lambda codec, key, ids: (key, None if ids is None else codec.decode(ids)), lambda: _codec(shared))


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text encoded, its ids decoded again, both digested."""
    shared = bounded_broadcast(docs.sparkSession, read_vocabulary(model))

    def row(codec: Codec, key, text):
        ids = codec.encode(text)
        decimal = " ".join(map(codec.decimal.__getitem__, ids))
        return key, len(ids), sha256(decimal.encode()).hexdigest(), sha256(codec.decode(ids).encode()).hexdigest()

    return by_row(docs, {"id": id_col, "text": text_col},
                  f"`{id_col}` {_type(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string",
                  row, lambda: _codec(shared))
