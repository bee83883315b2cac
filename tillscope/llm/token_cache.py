"""Encoding with the tokenizers library, each distinct piece of text once.

A BPE tokenizer encodes each match of its split pattern by itself, so a
text's ids are the ids of its pieces, one after the other (words between white
space where the tokenizer drops white space).  Words repeat, so a
worker keeps the ids of the pieces it has met (a bounded dictionary) and asks
the library for new ones only, many in one call.  Texts for which this
reasoning could fail (characters past U+024F, text not in NFC, control
separators, text that holds a special token's string) go to the library whole.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import unicodedata
from array import array

import numpy as np
import regex

from tillscope.llm.worker import kept

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Split pattern of the rank files; a fixed value.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Entries of one generation of a worker's dictionary of pieces.
CACHE_ENTRIES = 700_000
#: Pieces looked up at a time; new ones among them go to the library in one call.
CALL_PIECES = 20_000
#: Words given to the library in one call.
CALL_WORDS = 500

_CONTROLS = "\x1c\x1d\x1e\x1f"
_STEM = re.compile(r"[^\W\d_]+")
_ODD = re.compile("[^\x00-ɏ]|[\x1c-\x1f]")


def _packed(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


class _Known:
    """ids of the pieces met so far: two generations, so it stays bounded and keeps what recurs."""

    def __init__(self, ask, share: float = 1.0):
        self.ask, self.share, self.new, self.old = ask, share, {}, {}

    def joined(self, pieces: list[str]) -> bytes:
        if len(pieces) > CALL_PIECES:
            return b"".join([self.joined(pieces[at:at + CALL_PIECES]) for at in range(0, len(pieces), CALL_PIECES)])
        got = list(map(self.new.get, pieces))
        try:
            return b"".join(got)
        except TypeError:  # some piece is new
            return b"".join(self._filled(pieces, got))

    def each(self, pieces: list[str]) -> list[bytes]:
        return self._filled(pieces, list(map(self.new.get, pieces)))

    def _filled(self, pieces: list[str], got: list[bytes | None]) -> list[bytes]:
        holes = [i for i, ids in enumerate(got) if ids is None]
        if holes:
            self._learn({pieces[i] for i in holes})
            for i in holes:
                got[i] = self.new[pieces[i]]
        return got

    def _learn(self, pieces: set[str]) -> None:
        if len(self.new) > CACHE_ENTRIES * self.share:
            self.old, self.new = self.new, {}
        missing = []
        for p in pieces:
            had = self.old.get(p)
            if had is None:
                missing.append(p)
            else:
                self.new[p] = had
        if missing:
            self.new.update(zip(missing, self.ask(missing)))


def _ask_words(library, words: list[str]) -> list[bytes]:
    """ids of each word, asked for in one text; a token belongs to the word it starts in."""
    out = []
    for at in range(0, len(words), CALL_WORDS):
        part = words[at:at + CALL_WORDS]
        got = library.encode(" ".join(part), add_special_tokens=False)
        begin = np.fromiter((a for a, _ in got.offsets), np.int64, len(got))
        size = np.fromiter(map(len, part), np.int64, len(part)) + 1
        out += _cut(_packed(got.ids), np.searchsorted(begin, np.cumsum(size)))
    return out


def _ask_pieces(library, pieces: list[str]) -> list[bytes]:
    """ids of each piece, white space included, in one call of the library."""
    got = library.encode(pieces, is_pretokenized=True, add_special_tokens=False)
    word = np.asarray(got.word_ids, dtype=np.int64)
    return _cut(_packed(got.ids), np.searchsorted(word, np.arange(len(pieces)), side="right"))


def _cut(ids: bytes, ends: np.ndarray) -> list[bytes]:
    at, out = 0, []
    for end in (ends * 4).tolist():
        out.append(ids[at:end])
        at = end
    return out


class WordEncoder:
    """ids of ``word_bpe`` files: lower-cased words, white space dropped."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.model._resize_cache(0)  # this worker's dictionaries take its place
        specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.pack = _packed if sys.byteorder == "big" else (lambda ids: array("I", ids).tobytes())
        self.spelled = {b: c for b, c in enumerate(byte_characters())}
        self.stems = _Known(self._ask_model, share=1 / 2)
        self.tails = _Known(lambda words: _ask_words(self.library, words), share=1 / 8)
        self.known = _Known(self._ask)

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if text.isascii():
            odd = any(c in text for c in _CONTROLS)
        else:
            odd = _ODD.search(text) or not unicodedata.is_normalized("NFC", text)
        if odd or (self.special and self.special.search(text)):
            return _packed(self.library.encode(text, add_special_tokens=False).ids)
        return self.known.joined(text.lower().split())

    def _ask_model(self, words: list[str]) -> list[bytes]:
        """ids of words of letters only, in lower case and NFC, which the split pattern leaves whole."""
        ask, out = self.model.tokenize, []
        for w in words:
            if not w.isascii():  # the model's vocabulary has one character for each byte
                w = w.encode().decode("latin-1").translate(self.spelled)
            out.append(self.pack([t.id for t in ask(w)]))
        return out

    def _ask(self, words: list[str]) -> list[bytes]:
        """New words: the letters that a word begins with are one piece, the rest is tokenized by itself."""
        cuts = [m.end() if (m := _STEM.match(w)) and m[0].isalpha() else 0 for w in words]
        stems = self.stems.each([w[:k] for w, k in zip(words, cuts) if k])
        tails = self.tails.each([w[k:] for w, k in zip(words, cuts) if k < len(w)])
        stem, tail = iter(stems), iter(tails)
        return [(next(stem) if k else b"") + (next(tail) if k < len(w) else b"") for w, k in zip(words, cuts)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes → rank of a rank file (base64, space, rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE.

    Printable bytes stand for themselves, the others for the characters from
    U+0100 on, in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that each token of two or more bytes was merged from, by rank.

    A token's pair is what lower-ranked merges leave of its bytes.
    """
    pairs = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            pairs.append((parts[0], parts[1]))
    return pairs


class ByteTable:
    """Bytes and lengths of the tokens of a rank file, by id."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        size = max(self.ranks.values()) + 1
        self.lengths, self.bytes_of = np.zeros(size, dtype=np.int64), [b""] * size
        for token, rank in self.ranks.items():
            self.lengths[rank], self.bytes_of[rank] = len(token), token

    def offsets(self, ids: bytes) -> np.ndarray:
        """Byte offset of each id's first byte in the encoded text, and the end."""
        return np.concatenate([[0], np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])])

    def decode(self, ids: bytes) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


class ByteEncoder(ByteTable):
    """ids of a rank file through the tokenizers library, and back.

    The library's vocabulary is made of characters: each byte is written as
    one printable character, and the merges follow from the ranks.
    """

    def __init__(self, path: str, pattern: str = BYTE_PATTERN):
        from tokenizers import Regex, Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        super().__init__(path)
        letters = byte_characters()
        spell = lambda b: "".join(letters[x] for x in b)
        self.library = Tokenizer(BPE(vocab={spell(t): r for t, r in self.ranks.items()},
                                     merges=[(spell(a), spell(b)) for a, b in merges_of(self.ranks)]))
        self.library.pre_tokenizer = Sequence([Split(Regex(pattern), "isolated"),
                                               ByteLevel(add_prefix_space=False, use_regex=False)])
        self.split = regex.compile(pattern)
        self.known = _Known(lambda pieces: _ask_pieces(self.library, pieces), share=1 / 4)

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if _ODD.search(text):
            return _packed(self.library.encode(text, add_special_tokens=False).ids)
        return self.known.joined(self.split.findall(text))


def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder for that file; made once in each Python worker."""
    return _made("word", path, WordEncoder)


def byte_encoder(path: str) -> ByteEncoder:
    return _made("byte", path, ByteEncoder)


def byte_table(path: str) -> ByteTable:
    return _made("table", path, ByteTable)


def _made(name: str, path: str, kind):
    own = kept("tokens")
    if (name, path) not in own:
        own[name, path] = kind(path)
    return own[name, path]
