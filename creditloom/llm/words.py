"""Token ids of texts by the word vocabulary, with a bounded memory of words seen."""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import regex

#: The vocabulary's own pattern: only what it matches is encoded, so white space is never part of a token.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Separators that Python takes for white space and the pattern does not.
ODD_SPACE = regex.compile("[\x1c-\x1f]")
#: Entries of a memory before it starts afresh; the memory of words holds up to twice as many.
REMEMBERED = 300_000


def letters() -> list[str]:
    """A visible character for each byte: itself where it is printable, else one from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def cut(word: str) -> list[str]:
    """Pieces of a word without white space."""
    if word.isalpha():
        return [word]
    if word[:-1].isalpha() and word[-1] in ".,":
        return [word[:-1], word[-1]]
    return PIECES.findall(word)


class WordEncoder:
    """Encodes texts like the tokenizer file, but each distinct word once.

    A text is normalised as the file's normalizers do it (canonical composition, lower case by character), cut at white
    space, and every word's ids are looked up. Words not met before are cut by the file's own pattern; pieces not met
    before are encoded together by the tokenizer. Since no piece crosses white space, the ids are those of the whole
    text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        #: The same merges for pieces that are normalised, cut and written in letters already.
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = dict(enumerate(letters()))
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for word, i in vocab.items() if word.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _learn_pieces(self, new: list[str]) -> None:
        """Many pieces in one call; each ends with an end-of-word token, and no other token is one."""
        for at in range(0, len(new), 500):
            part = new[at : at + 500]
            mapped = " ".join(part).encode().decode("latin-1").split(" ")
            joined = " ".join(x.translate(self.letters) for x in mapped)
            ids = np.array(self.merger.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            data, bounds = ids.tobytes(), [0, *(4 * stops).tolist()]
            self.pieces.update(zip(part, (data[a:b] for a, b in zip(bounds, bounds[1:])), strict=True))

    def _learn(self, new: list[str]) -> None:
        parts = [cut(w) for w in new]
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        unknown = {p for ps in parts for p in ps if p not in self.pieces}
        self._learn_pieces(sorted(unknown))
        get = self.pieces.__getitem__
        self.words.update((w, b"".join(map(get, ps))) for w, ps in zip(new, parts))

    def _looked_up(self, words: list[str]) -> bytes:
        out: list[bytes] = []
        for at in range(0, len(words), REMEMBERED):
            part = words[at : at + REMEMBERED]
            new = [w for w in dict.fromkeys(part) if w not in self.words]
            if len(self.words) + len(new) > 2 * REMEMBERED:
                self.words.clear()
                new = list(dict.fromkeys(part))
            self._learn(new)
            out += map(self.words.__getitem__, part)
        return b"".join(out)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = []
        for text in texts:
            if ODD_SPACE.search(text):
                found = self.tokenizer.encode(text, add_special_tokens=False)
                out.append(np.array(found.ids, "<u4").tobytes())
                continue
            words = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower().split()
            try:
                out.append(b"".join(map(self.words.__getitem__, words)))
            except KeyError:
                out.append(self._looked_up(words))
        return out
