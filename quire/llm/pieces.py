"""What the SentencePiece operators share: the vocabulary of a .model file and the cut of a text into independent words.

The model's normaliser is the identity with a dummy prefix: a text is " " + text with spaces as U+2581. No piece
holds U+2581 after another character, so no piece reaches over the start of a run of spaces, and every run with
the word behind it can be tokenised by itself. Both facts are checked when the model is loaded.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import public_tokenizers
import sentencepiece

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
WORD = re.compile("[ ▁]*[^ ▁]+|[ ▁]+")


def words(text: str) -> list[str]:
    """The text, with its dummy prefix, as words that each start with a run of spaces; none for an empty text."""
    return WORD.findall(" " + text) if text else []


def fields(message: bytes):
    """(number, value) of each field of a serialized protocol buffer; bytes of those with a length, None of fixed ones."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(message):
        key = varint()
        kind, value = key & 7, None
        if kind == 0:
            value = varint()
        elif kind == 2:
            size = varint()
            value = message[at : at + size]
            at += size
        else:
            at += {1: 8, 5: 4}[kind]
        yield key >> 3, value


def model_type(model: bytes) -> int:
    """trainer_spec.model_type of a serialized model: 1 unigram (also if it isn't set), 2 BPE, 3 words, 4 characters."""
    return max([x for n, spec in fields(model) if n == 2 for k, x in fields(spec) if k == 3], default=1)


class Vocabulary:
    def __init__(self, path: str):
        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_bpe = model_type(p.serialized_model_proto()) == 2
        n = p.vocab_size()
        self.pieces = [p.id_to_piece(i) for i in range(n)]
        special = np.array([p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i) for i in range(n)])
        self.ids = np.flatnonzero(~special)
        self.scores = np.array([p.get_score(i) for i in range(n)], np.float64)
        self.unknown = p.unk_id()
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in self.ids):
            raise ValueError("a piece reaches over a space: texts can't be cut into words")
        if p.encode("a  ａ") != p.encode("a") + p.encode(" ａ"):
            raise ValueError("the model's normaliser isn't the identity with a dummy prefix")
        self.byte_ids = np.full(256, -1, np.int32)
        for i in range(n):
            if p.is_byte(i):
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        self.raw = [x.replace(SPACE, " ").encode() for x in self.pieces]
        for b, i in enumerate(self.byte_ids.tolist()):
            if i >= 0:
                self.raw[i] = bytes([b])


@cache
def vocabulary(name: str = MODEL) -> Vocabulary:
    """Loaded once in a process, from the worker's own copy of the public files."""
    return Vocabulary(public_tokenizers.path(name))
