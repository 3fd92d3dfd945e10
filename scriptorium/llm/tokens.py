"""Encoding of whole texts with public tokenizer files, on the executors.

The driver reads the vocabulary file once and ships its bytes (a megabyte or two,
whatever the corpus), so executors need no file of their own.

Byte-level BPE without a normaliser never merges across a single space that stands
between two non-space characters: such a space always starts a new pre-token. Texts
are therefore cut there, and each worker remembers the ids of the pieces it has seen;
only a text's unseen pieces reach the tokenizer, in one call. A text with other runs of white space is cut
by a look-around, and any other kind of tokenizer gets whole texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

#: Pieces a worker remembers, in each of two generations (160 bytes a piece), and the longest one.
PIECES, LONGEST = 500_000, 64
_SPACE = re.compile(r"(?<=\S) (?=\S)")


class _Uncut(Exception):
    """A piece with white space at an end: the text must be cut another way."""


class _Pieces:
    """piece -> bytes of the ids of a space and the piece. Two generations: when the
    young one is full it becomes the old one, and what is used again is kept.

    What a text has of unseen pieces is encoded in one call: a space stands only where a
    piece starts, so the ids of tokens that start with a space are where to split.
    """

    def __init__(self, encode, code: str, starts: np.ndarray, limit: int):
        self.encode, self.code, self.starts, self.limit = encode, code, starts, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _alone(self, piece: str) -> bytes:
        return array(self.code, self.encode(" " + piece)).tobytes()

    def _learn(self, unseen: list[str]) -> None:
        ids = np.array(self.encode(" " + " ".join(unseen)), dtype=self.code)
        edges = np.flatnonzero(self.starts[ids])
        if len(edges) == len(unseen):
            data, at = ids.tobytes(), [*(edges * ids.itemsize).tolist(), ids.nbytes]
            self.young.update(zip(unseen, [data[a:b] for a, b in zip(at, at[1:])]))
        else:
            self.young.update((piece, self._alone(piece)) for piece in unseen)

    def joined(self, parts: list[str], plain: bool) -> bytes:
        """The ids of all parts. ``plain``: parts with white space at an end aren't allowed."""
        if len(self.young) >= self.limit:
            self.young, self.old = {}, self.young
        young, unseen, once = self.young, [], []
        for piece in set(parts).difference(young):
            held = self.old.get(piece)
            if held is not None:
                young[piece] = held
            elif not piece or len(piece.strip()) < len(piece):
                if plain:
                    raise _Uncut
                once.append(piece)
            elif len(piece) > LONGEST:
                once.append(piece)
            elif " " in piece:
                young[piece] = self._alone(piece)
            else:
                unseen.append(piece)
        if unseen:
            self._learn(unseen)
        for piece in once:
            young[piece] = self._alone(piece)
        out = b"".join(map(young.__getitem__, parts))
        for piece in once:
            del young[piece]
        return out


@dataclass(frozen=True)
class TokenizerFile:
    """A tokenizer file's name and bytes; pickled into tasks. ``pieces`` trades a worker's
    memory for CPU time and has no part in the results."""

    name: str
    data: bytes = field(repr=False)
    pieces: int = PIECES

    @classmethod
    def read(cls, path: str, pieces: int = PIECES) -> TokenizerFile:
        with open(path, "rb") as f:
            return cls(os.path.basename(path), f.read(), pieces)

    @property
    def digest(self) -> str:
        """Digest of the vocabulary and the library's version: the tokenizer's version."""
        if self.name.endswith(".model"):
            import sentencepiece as library
        else:
            import tokenizers as library
        return hashlib.sha256(self.data + f"{self.name.rpartition('.')[2]} {library.__version__}".encode()).hexdigest()


class Encoder:
    """Ids of whole texts as the library gives them: no truncation, no padding, no
    special tokens added; special strings inside texts as the library's default."""

    def __init__(self, file: TokenizerFile):
        if file.name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=file.data)
            self.size, self._ids, cut = model.get_piece_size(), lambda text: model.encode(text, num_threads=1), False
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_buffer(file.data)
            model.no_truncation()
            model.no_padding()
            self.size = model.get_vocab_size(with_added_tokens=True)
            # The fast form skips offsets, which are not used.
            self._ids = lambda text: model.encode_batch_fast([text], add_special_tokens=False)[0].ids
            spec = json.loads(file.data)
            pre = spec.get("pre_tokenizer") or {}
            cut = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
            cut = cut and spec["model"].get("type") == "BPE" and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec.get("added_tokens", []))
        #: Unsigned type of the ids: two bytes where the vocabulary allows.
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.dtype = "<u2" if self.code == "H" else "<u4"
        self._pieces = _Pieces(self._ids, self.code, self._starts(spec), file.pieces) if cut else None

    def _starts(self, spec: dict) -> np.ndarray:
        """By id: whether the token's bytes start with a space, which byte-level BPE writes as \u0120."""
        starts = np.zeros(self.size, bool)
        starts[[i for token, i in spec["model"]["vocab"].items() if token.startswith("\u0120")]] = True
        starts[[t["id"] for t in spec.get("added_tokens", [])]] = False
        return starts

    def packed(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned integers of ``dtype``; null is empty."""
        if not text:
            return b""
        if self._pieces is not None:
            head, *rest = text.split(" ")
            if head and not head[-1].isspace():
                try:
                    return array(self.code, self._ids(head)).tobytes() + self._pieces.joined(rest, True)
                except _Uncut:
                    head, *rest = _SPACE.split(text)
                    return array(self.code, self._ids(head)).tobytes() + self._pieces.joined(rest, False)
        return array(self.code, self._ids(text)).tobytes()


_encoders: dict[tuple[str, int, int], Encoder] = {}


def encoder(file: TokenizerFile) -> Encoder:
    """This worker's encoder for a file; reused from task to task."""
    key = (file.name, hash(file.data), file.pieces)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(file)
    return _encoders[key]
