"""Token ids of whole texts, by the tokenizers library, with the ids of recurring pieces kept.

The word vocabulary's tokenizer lower-cases a text and cuts it into pieces (words, digits, runs of marks) that its
merges never join. Over the alphabet below those steps are plain string operations, so they are done here for a whole text
at once, and the library's model encodes each piece that isn't kept. Any other text goes through the library's whole tokenizer.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: Pieces whose ids a worker keeps; beyond that it starts afresh. Bounds memory (about 80 MB), not the pieces.
KEPT = 400_000

# The vocabulary file's own split pattern, its added tokens, and its normalizer and pre-tokenizer names.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ADDED = ["<|startoftext|>", "<|endoftext|>"]
STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])

#: The same pattern for texts of ASCII and the letters of Latin-1 in lower case.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
_OTHER = re.compile(r"[^\x09-\x0d\x20-~À-ÖØ-öø-ÿ]|<\|(?:start|end)oftext\|>")
_SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as a visible character: itself where it has one, else one above 255."""
    out, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class TextEncoder:
    """Ids of texts under one vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        spec = json.loads(self.whole.to_str())
        steps = tuple([s["type"] for s in (spec[part] or {}).get(names, [])] for part, names in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        self.direct = steps == STEPS and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": PATTERN} and [t["content"] for t in spec["added_tokens"]] == ADDED
        self.letters = _byte_letters()
        self.kept: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        name = piece if piece.isascii() else "".join(self.letters[b] for b in piece.encode())
        ids = np.array([t.id for t in self.model.tokenize(name)], np.uint32).tobytes()
        if len(piece) <= 64:  # longer ones are rare, and large in memory
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[piece] = ids
        return ids

    def text(self, text: str | None) -> bytes:
        """Little-endian uint32 ids of a whole text; none for null."""
        if not text:
            return b""
        if not self.direct:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        if _OTHER.search(text):  # white space separates pieces, so only the spaced parts with other characters need the whole tokenizer
            parts = []
            for part in _SPACED.findall(text):
                parts.append(np.array(self.whole.encode(part, add_special_tokens=False).ids, np.uint32).tobytes() if _OTHER.search(part) else self.text(part))
            return b"".join(parts)
        pieces = _PIECE.findall(text.lower())
        found = list(map(self.kept.get, pieces))
        if None in found:
            found = [(self.kept.get(p) or self._piece(p)) if f is None else f for p, f in zip(pieces, found)]
        return b"".join(found)


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def default_path() -> str:
    """The 49k word vocabulary among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
