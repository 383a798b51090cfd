"""Byte-level BPE on top of the `tokenizers` library: one encoding for each distinct pre-token, kept by the worker.

Pre-tokens are independent, so a text's ids are the ids of its pre-tokens in turn. A single space that has no white
space after it begins a pre-token, so the texts of a step are first cut at such spaces, and Arrow tells which pieces differ. Those are
cut into pre-tokens as one text; the ids of most are kept, and the others go to the library's model together. Arrow then
puts the pieces' ids in place. Nothing is trained here: a vocabulary file is always given.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from public_tokenizers import PATTERN  # noqa: E402
from tokenizers import Regex, Tokenizer, models, pre_tokenizers  # noqa: E402

#: Entries of each of the two generations of pre-tokens that a worker keeps, and characters of the longest one kept (so about 300 MB
#: in all at most); characters of all texts under which they are not cut at spaces, as that takes longer to begin.
KEPT, KEPT_CHARS, FEW = 800_000, 40, 1 << 12
#: Bytes of text that are best encoded together, as pieces repeat within them: an Arrow batch, by common.BATCH_BYTES.
CODED_BYTES = 1 << 22

#: Code point ranges in which Python's regular expressions have the letters, numbers and spaces that the library has.
#: The two know different versions of Unicode; a text with other code points goes to the library uncut.
SAME_CLASSES = ((0x0000, 0x0557), (0x058D, 0x088E), (0x0890, 0x0C5B), (0x0C5D, 0x0CDB), (0x0CDD, 0x208E), (0x20A0, 0xA7CD), (0xAB6E, 0x107BA), (0x1E700, 0x2B739))
_OTHER = re.compile("[^" + "".join(f"{chr(a)}-{chr(b)}" for a, b in SAME_CLASSES) + "]")

_WIDE_SPACE = re.compile(r" \s").search


def _ranges(of: str) -> str:
    """The code points of a class of the `regex` module, as ranges within a class of Python's expressions. SAME_CLASSES only: encoding others is left to the library."""
    every = "".join(chr(x) for a, b in SAME_CLASSES for x in range(a, b + 1) if not 0xD800 <= x < 0xE000)
    return "".join(f"{re.escape(found[0])}-{re.escape(found[-1])}" for found in regex.findall(f"{of}+", every) for found in _runs(found))


def _runs(chars: str) -> list[str]:
    """Runs of code points that follow one another."""
    cuts = [0, *(i for i in range(1, len(chars)) if ord(chars[i]) != ord(chars[i - 1]) + 1), len(chars)]
    return [chars[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=1)
def _same_pattern() -> re.Pattern:
    """PATTERN for texts without code points outside of SAME_CLASSES, with its classes written out; Python's own expressions take less time."""
    letters, numbers, spaces = map(_ranges, (r"\p{L}", r"\p{N}", r"\s"))
    made = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]")
    for name, found in ((r"\p{L}", letters), (r"\p{N}", numbers), (r"\s", spaces)):
        made = made.replace(name, f"[{found}]")
    return re.compile(made.replace(r"\S", f"[^{spaces}]"))


def _rare(text: str) -> bool:
    """Whether a text has code points outside of SAME_CLASSES; most have none over U+00FF, which is seen at once."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(_OTHER.search(text))
    return False


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def from_ranks(ranks: dict[bytes, int]) -> Tokenizer:
    """A `tokenizers` model with the merges that a rank file implies: each token is made by its last merge.

    The last merge of a token is what lower ranks leave of its bytes when two parts are left.
    """
    chars, merges = byte_chars(), []
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found, at = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if found >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            merges.append(tuple("".join(map(chars.__getitem__, part)) for part in parts))
    made = Tokenizer(models.BPE(vocab={"".join(map(chars.__getitem__, token)): rank for token, rank in ranks.items()}, merges=merges))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(PATTERN), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


class Latest:
    """Ids of the texts that came up lately: up to KEPT new ones, and those that were new before them."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def keep(self, found: dict[str, bytes]) -> None:
        if len(found) > KEPT:
            return
        if len(self.new) + len(found) > KEPT:
            self.old, self.new = self.new, {}
        if max(map(len, found), default=0) > KEPT_CHARS:
            found = {x: ids for x, ids in found.items() if len(x) <= KEPT_CHARS}
        self.new.update(found)


class WordBPE:
    """Encodes and decodes whole texts.

    The ids of a text are little-endian integers of `dtype` in a bytes object, as they are stored. Special tokens in a
    text are text like any other, or with `special` what the library makes of them by default.
    """

    def __init__(self, path: str, special: bool = False):
        make = lambda: Tokenizer.from_file(path) if path.endswith(".json") else from_ranks(read_ranks(path))
        self.tokenizer = self.plain = make()
        if special and self.tokenizer.get_added_tokens_decoder():
            self.plain = make()
        self.plain.encode_special_tokens = True
        added = [re.escape(token.content) for token in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.special = re.compile("|".join(added)).search if added else None
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        back = {c: b for b, c in byte_chars().items()}
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.split = _same_pattern().findall
        self.sizes = np.array(list(map(len, self.bytes_of)), np.int64)
        self.chars = byte_chars() | {0xFF: " "}  # no byte of a text is 0xFF
        self.bare = Tokenizer(self.plain.model)
        self.bare.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.words = Latest()

    def _library(self, text: str, tokenizer: Tokenizer | None = None) -> bytes:
        return np.array((tokenizer or self.plain).encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def _fresh(self, words: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens, given to the library's model together as their bytes' characters. The bytes of the ids tell where each one ends."""
        if not words:
            return {}
        coded = list(map(str.encode, words))
        ids = np.array(self.bare.encode_batch_fast([b"\xff".join(coded).decode("latin-1").translate(self.chars)], add_special_tokens=False)[0].ids, self.dtype)
        have, want = np.cumsum(self.sizes[ids]), np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))
        ends = np.searchsorted(have, want) + 1
        if not len(ids) or have[-1] != want[-1] or (have[ends - 1] != want).any():
            raise RuntimeError("the vocabulary lacks bytes, or an id goes over a pre-token's end")
        packed, ends = ids.tobytes(), (ends * self.dtype.itemsize).tolist()
        return {word: packed[a:b] for word, a, b in zip(words, [0, *ends], ends, strict=False)}

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of each pre-token; words that come up often are better given once."""
        ids = list(map(self.words.new.get, words))
        if None in ids:
            missing, old = [at for at, known in enumerate(ids) if known is None], self.words.old.get
            again = {(word := words[at]): old(word) for at in missing}
            again |= self._fresh([word for word, known in again.items() if known is None])
            for at in missing:
                ids[at] = again[words[at]]
            self.words.keep(again)
        return ids

    def _found(self, words: Iterable[str]) -> dict[str, bytes]:
        every = list(set(words))
        return dict(zip(every, self._ids(every), strict=True))

    def _together(self, pieces: list[str], whole: list[str]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """Ids of a space and each of the pieces, none of which is empty or begins with white space, and of texts as they are; and where in these each one is."""
        letters = np.fromiter(map(str.isalpha, pieces), bool, len(pieces))
        single = [" " + piece for piece, alone in zip(pieces, letters.tolist(), strict=True) if alone]
        pieces = [piece for piece, alone in zip(pieces, letters.tolist(), strict=True) if not alone]
        words = self.split(" " + " ".join(pieces)) if pieces else []
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        want = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1)
        at = np.searchsorted(ends, want) + 1
        if (ends[at - 1] != want).any():
            raise RuntimeError("a pre-token crosses a space that begins one")
        lists = list(map(self.split, whole))
        at = len(single) + np.concatenate([at, len(words) + np.cumsum(list(map(len, lists)), dtype=np.int64)])
        words.extend(chain.from_iterable(lists))
        every = list(set(words))
        ids = self._ids(single + every)
        known = dict(zip(every, ids[len(single) :], strict=True))
        _, starts, packed = pa.array(ids[: len(single)] + list(map(known.__getitem__, words)), pa.large_binary()).buffers()
        at = np.concatenate([np.arange(len(single) + 1), at])
        place = np.where(letters, np.cumsum(letters) - 1, len(single) + np.cumsum(~letters) - 1)
        place = np.concatenate([place, np.arange(len(letters), len(at) - 1)])
        return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.frombuffer(starts, np.int64)[at]), packed]), place

    def _cut(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that may be cut at spaces. Arrow cuts them and tells the pieces apart, so that only different ones go through Python."""
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        told, ends = cut.values.dictionary_encode(), cut.offsets.to_numpy()
        pieces, codes = told.dictionary.to_numpy(zero_copy_only=False).tolist(), np.array(told.indices)
        first, last = ends[:-1], ends[1:] - 1
        begins = [pieces[code] for code in codes[first].tolist()]  # no space is before these
        bare = np.array([not pieces[code] for code in codes[last].tolist()])  # a space and nothing more, if it is not the first
        for code in {*codes[first].tolist(), *codes[last].tolist()}:
            if not pieces[code] or pieces[code][0].isspace():
                pieces[code] = "."  # comes up only as one of these
        codes[last[bare]] = len(pieces)
        codes[first] = np.arange(len(begins)) + len(pieces) + 1
        ids, place = self._together(pieces, [" ", *begins])
        _, starts, packed = ids.take(pa.array(place[codes])).buffers()
        at, packed = np.frombuffer(starts, np.int64)[ends].tolist(), memoryview(packed or b"")
        return [packed[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, without special tokens at its ends."""
        out: list = [b""] * len(texts)
        few = sum(map(len, texts)) < FEW
        cut: list[int] = []
        whole: dict[int, list[str]] = {}
        for i, text in enumerate(texts):
            if self.special and self.special(text):
                out[i] = self._library(text, self.tokenizer)
            elif _rare(text):
                out[i] = self._library(text)
            elif few or _WIDE_SPACE(text) or text[-2:-1].isspace():
                whole[i] = self.split(text)
            elif text:
                cut.append(i)
        if whole:
            found = self._found(chain.from_iterable(whole.values())).__getitem__
            for i, words in whole.items():
                out[i] = b"".join(map(found, words))
        if cut:
            for i, ids in zip(cut, self._cut([texts[i] for i in cut]), strict=True):
                out[i] = ids
        return out

    def encode_one(self, text: str) -> bytes:
        return self.encode([text])[0]

    def ids(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, self.dtype)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that the ids stand for; a character split over ids comes back whole."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def word_bpe(path: str, special: bool = False) -> WordBPE:
    """One for each worker, vocabulary file and treatment of special tokens."""
    return WordBPE(path, special)
