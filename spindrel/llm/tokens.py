"""Token ids by the tokenizers library, with a bounded memory of encoded words."""

from __future__ import annotations

import json
import os
import re
from array import array

from .common import only

#: Words remembered per worker, and the longest one remembered (bytes).
MEMORY_WORDS, MEMORY_BYTES = 300_000, 64

#: A word of Latin letters, digits and marks other than the apostrophe, and what a split of the kind SPLIT makes of it.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿŒœ0-9!-&(-/:-@\[-`{-~]+")
_PIECE = re.compile(r"[a-zß-öø-ÿœ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
#: The split of the vocabulary's file for which the short way below holds.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on, in order.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_BYTES = {b: chr(b if b in _SHOWN else 256 + _HIDDEN.index(b)) for b in range(256)}

_encoders: dict[str, WordEncoder] = {}


class WordEncoder(dict):
    """Word (bytes without ASCII white space) to its ids as little-endian uint32 bytes.

    The vocabulary's pre-tokenizer never joins text across ASCII white space and its normaliser maps such a run to one
    blank that yields no id, so a text's ids are its words' ids in order; the tests hold this against encoding whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        known = json.loads(self.tokenizer.to_str())
        split = [(p.get("pattern") or {}).get("Regex") for p in (known["pre_tokenizer"] or {}).get("pretokenizers", [])]
        steps = [n["type"] for n in (known["normalizer"] or {}).get("normalizers", [])]
        self.short = split == [SPLIT, None] and steps == ["NFC", "Replace", "Lowercase"]
        self.pieces: dict[str, bytes] = {}
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def __missing__(self, word: bytes) -> bytes:
        """By the library's whole pipeline; for plain words by its BPE model alone, over the pieces that the pipeline would
        make of them, which takes a quarter of the time."""
        text = word.decode()
        if self.short and _PLAIN.fullmatch(text) and "<|" not in text:
            ids = b"".join([self.pieces.get(p) or self._piece(p) for p in _PIECE.findall(text.lower())])
        else:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) >= MEMORY_WORDS:
            self.clear()
        if len(word) <= MEMORY_BYTES:
            self[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join([_BYTES[b] for b in piece.encode()])
        ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        if len(self.pieces) >= MEMORY_WORDS:
            self.pieces.clear()
        if len(piece) <= MEMORY_BYTES:
            self.pieces[piece] = ids
        return ids

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Null counts as empty."""
        return [b"".join(map(self.__getitem__, (t or "").encode().split())) for t in texts]


def encoder(path: str) -> WordEncoder:
    """One per Python worker and vocabulary file, until the worker works for an operator that remembers other words."""
    only(_encoders)
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
