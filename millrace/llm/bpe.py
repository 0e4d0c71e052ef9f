"""Token ids of whole texts, fast enough for a corpus.

A text is cut before each single blank that stands between two other characters. The vocabulary's pattern starts a piece at
every such blank, so the cuts never change the ids. The ids of a unit are kept in a bounded cache of the worker, which most
words of a text hit; only new units go to the tokenizer.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
import sys
from array import array

import pyarrow as pa

#: Units in either generation of a worker's cache, and the longest unit (characters) that is kept: the bound of its size.
CACHE_UNITS = 200_000
CACHE_CHARS = 48
_SPACES = re.compile(r"\s\s|^\s|\s$")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Units of these characters alone (no special token has only such) are merged by tiktoken, from the very vocabulary of the file: both libraries split such
#: units alike (tests hold them against each other) and it takes half the time. All other units go to tokenizers.
_PLAIN = re.compile("[!-;=-~\u00c0-\u024f]+")
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class _Cache(dict):
    """Ids of units. A full generation becomes the old one; what is asked for again moves back to the young one."""

    def __init__(self, whole, plain, lead: str):
        self._whole, self._plain, self._lead, self._old = whole, plain, lead, {}

    def __missing__(self, unit: str) -> bytes:
        ids = self._old.get(unit)
        if ids is None:
            text = self._lead + unit
            ids = _bytes(self._plain(text) if self._plain and _PLAIN.fullmatch(unit) else self._whole.encode(text, add_special_tokens=False).ids)
        if len(unit) <= CACHE_CHARS:
            if len(self) >= CACHE_UNITS:
                self._old = dict(self)
                self.clear()
            self[unit] = ids
        return ids


def _merger(file: dict, special: set[str]):
    """tiktoken's merging by the file's vocabulary, or None unless ids follow the order of merges."""
    vocab, merges = file["model"]["vocab"], file["model"]["merges"]
    pairs = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in merges]
    ids = [vocab[p] for p in pairs]
    if file.get("normalizer") or file["pre_tokenizer"]["type"] != "ByteLevel" or ids != sorted(ids):
        return None
    import tiktoken

    # The printable stand-ins of the 256 bytes in byte-level vocabularies.
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in own)}
    ranks = {bytes(stand_in[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Encoder:
    """A text to ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        plain = _merger(file, {t["content"] for t in file.get("added_tokens", [])})
        self._first, self._next = _Cache(whole, plain, ""), _Cache(whole, plain, " ")

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ") if _SPACES.search(text) is None else _CUT.split(text)
        return self._first[first] + b"".join(map(self._next.__getitem__, rest))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Free what ``encoder`` keeps. Other operators call it where their tasks begin: a worker that packed before would hold
    the vocabulary and its units (over 100 MB) beside what they need."""
    if _ENCODERS:
        _ENCODERS.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)
