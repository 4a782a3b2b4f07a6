"""Token ids of whole texts by the tokenizers library, fast enough for terabytes.

The byte-level pattern never joins characters across a single space or newline between two visible
characters, and only a space is ever attached to what follows. So a text is a row of words that are
encoded alike wherever they stand; each worker encodes a word once and looks it up from then on.
Plain words go to the library's BPE model directly, everything else through its whole pipeline.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm._common import KEPT

#: Kind of the tasks that keep encoded words.
KIND = "tokens"
DEFAULT = public_tokenizers.path("byte_bpe_50k.json")
#: Bytes of words and ids kept by a worker, about; later words are encoded each time.
CACHE_BYTES = 64 << 20
#: What an entry takes besides its characters: two objects and its place in the table.
ENTRY_BYTES = 220
#: Stands before a word that no space precedes.
_BARE = "\x01"
#: White space besides space and newline, and the mark itself.
_OTHER = re.compile(r"[^\S \n]|\x01")
#: One pre-token of letters, and maybe one of marks behind it.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%*$&|#]*)")


def _odd(text: str) -> bool:
    """Whether there is white space other than single spaces and newlines between visible characters."""
    return "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace() or _OTHER.search(text) is not None


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _byte_letters() -> dict[int, str]:
    """What the byte-level alphabet writes for each byte: printable ones stand for themselves."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """Maps words to their ids, little-endian uint32. One per worker process and file."""

    _known: dict[str, Encoder] = {}

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        self._tokenize = self.tokenizer.model.tokenize
        self._letters = _byte_letters()
        self._left = CACHE_BYTES

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    @classmethod
    def forget(cls) -> None:
        """Drop the words, not the tokenizers."""
        for e in cls._known.values():
            e.clear()
            e._left = CACHE_BYTES

    def __missing__(self, word: str) -> bytes:
        bare = word[:1] == _BARE
        text = word[1:] if bare else word
        plain = _PLAIN.fullmatch(text)
        if plain and plain[2]:
            out = self[text[: plain.end(1)] if not bare else word[: plain.end(1) + 1]] + self[_BARE + plain[2]]
        elif plain:
            letters = text if text.isascii() else text.encode().decode("latin-1").translate(self._letters)
            out = array("I", [t.id for t in self._tokenize(letters if bare else "Ġ" + letters)]).tobytes()
        elif word == "\n":
            out = _bytes(self.whole(["\n"])[0])
        else:
            out = _bytes(self.whole([text if bare else " " + text])[0])
        if self._left > 0:
            self._left -= ENTRY_BYTES + len(word) + len(out)
            self[word] = out
        return out

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; few large calls are the fast ones."""
        out = [b""] * len(texts)
        usual = []
        for i, t in enumerate(texts):
            if t:
                if _odd(t):
                    out[i] = b"".join(map(self._part, _parts(t)))
                else:
                    usual.append(i)
        if usual:
            # Arrow finds the distinct words; only those are looked up, and their ids are gathered.
            lists = pc.split_pattern(pa.array([_BARE + texts[i].replace("\n", " \n " + _BARE) for i in usual]), " ")
            words = lists.flatten().dictionary_encode()
            taken = pa.array([self[w] for w in words.dictionary.to_pylist()], type=pa.binary()).take(words.indices)
            ends = np.frombuffer(taken.buffers()[1], dtype=np.int32)[np.frombuffer(lists.buffers()[1], dtype=np.int32)]
            ids = memoryview(taken.buffers()[2])
            for i, a, b in zip(usual, ends.tolist(), ends[1:].tolist(), strict=False):
                out[i] = bytes(ids[a:b])
        return out

    def _part(self, text: str) -> bytes:
        if text == "\n":
            return self[text]
        spaced = text[0] == " "
        word = text[1:] if spaced else text
        if not word or re.search(r"\s|\x01", word):
            return _bytes(self.whole([text])[0])
        return self[word if spaced else _BARE + word]


KEPT.append((KIND, Encoder.forget))

#: Places where the pattern always cuts: before a single space, or around a newline, between visible characters.
_CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")


def _parts(text: str) -> list[str]:
    """Pieces encoded alike anywhere; an odd one keeps its white space, and a leading space is marked by itself."""
    return [p for p in _CUT.split(text) if p]
