"""Subword ids of whole texts by a public byte-level vocabulary."""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from itertools import chain

import numpy as np

#: The vocabulary as ranks; the same ids as ``byte_bpe_50k.json``.
RANKS = "byte_bpe_50k.tiktoken"
#: The one string which that vocabulary reads as a special token, and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
VOCABULARY = 50257


@lru_cache(maxsize=2)
def _encoding(ranks_path: str | None):
    import public_tokenizers
    import tiktoken

    path = ranks_path or public_tokenizers.path(RANKS)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})


#: White space that the vocabulary's pattern joins with a space beside it, or may.
_OTHER_SPACE = re.compile(r"[^\S ]")


@lru_cache(maxsize=2)
def _lengths(ranks_path: str | None) -> np.ndarray:
    """How many bytes each id stands for."""
    encoding = _encoding(ranks_path)
    return np.array([len(encoding.decode_single_token_bytes(k)) for k in range(VOCABULARY)], np.int64)


def starting_with_space(ranks_path: str | None = None) -> np.ndarray:
    """Which ids stand for bytes that begin with a space."""
    encoding = _encoding(ranks_path)
    return np.array([k != SPECIAL_ID and encoding.decode_single_token_bytes(k).startswith(b" ") for k in range(VOCABULARY)])


class Subwords:
    """Ids of texts, as ``Tokenizer.from_file("byte_bpe_50k.json")`` gives them without added tokens.

    The vocabulary file is read once in each Python worker; ``ranks_path`` names another one.
    """

    def __init__(self, ranks_path: str | None = None) -> None:
        self.ranks_path = ranks_path

    def encode(self, text: str) -> np.ndarray:
        encoding = _encoding(self.ranks_path)
        if SPECIAL in text:
            return encoding.encode_to_numpy(text, allowed_special="all").astype(np.uint32, copy=False)
        return encoding.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)

    def encode_ordinary(self, text: str) -> np.ndarray:
        """The ids of a text in which no string is special: SPECIAL is ordinary subwords too."""
        return _encoding(self.ranks_path).encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many short texts, one after another, and how many each has."""
        ordinary = _encoding(self.ranks_path).encode_ordinary
        made = [ordinary(t) if SPECIAL not in t else self.encode(t).tolist() for t in texts]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter(chain.from_iterable(made), np.uint32, int(sizes.sum())), sizes

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words, none with a space in it, each cut with a space before it; and how many each has."""
        return self.encode_joined(" ".join(words), np.fromiter((len(w.encode()) for w in words), np.int64, len(words)))

    def encode_joined(self, joined: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words joined by spaces, with their lengths in bytes.

        Pieces of the vocabulary's pattern begin at a space, so the words are cut in one go, and the
        bytes that ids stand for tell where words end. Words with other white space or SPECIAL are
        cut alone.
        """
        if not len(lengths):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if SPECIAL in joined or _OTHER_SPACE.search(joined):
            return self._encode_odd(joined.split(" "), lengths)
        ids = _encoding(self.ranks_path).encode_to_numpy(" " + joined, disallowed_special=()).astype(np.uint32, copy=False)
        ends = np.cumsum(_lengths(self.ranks_path)[ids])
        last = np.cumsum(lengths + 1)
        at = np.searchsorted(ends, last)
        if not np.array_equal(ends[at], last):
            raise AssertionError("an id spans two words")
        return ids, np.diff(np.concatenate(([0], at + 1)))

    def _encode_odd(self, words: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odd = np.array([bool(_OTHER_SPACE.search(w)) or SPECIAL in w for w in words])
        sizes, parts = np.zeros(len(words), np.int64), []
        for some, of in ((np.flatnonzero(~odd), lambda part: self.encode_joined(" ".join(part), lengths[~odd])), (np.flatnonzero(odd), lambda part: self.encode_many([" " + w for w in part]))):
            ids, sizes[some] = of([words[k] for k in some])
            parts.append((some, ids, sizes[some]))
        made, begin = np.empty(int(sizes.sum()), np.uint32), np.cumsum(sizes) - sizes
        for some, ids, own in parts:
            made[np.repeat(begin[some] - (np.cumsum(own) - own), own) + np.arange(len(ids))] = ids
        return made, sizes
