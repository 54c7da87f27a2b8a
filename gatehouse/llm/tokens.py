"""Loads a public byte-level BPE and encodes texts with it, one encoder per Python worker."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from functools import lru_cache

import tiktoken
from tokenizers import Tokenizer

# The word pattern of this family of byte-level BPEs.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Texts with longer words or white-space runs go to the plain library, whose cost stays near linear in them.
_LONG_RUN = re.compile(r"\S{2000}|\s{2000}")

_PROBES = ["", " ", "a  b\n\n c\t\td ", "It's 42nd, we'll see... ", "Größe über naïve Éléphant — 東京 🙂  x", "x<|endoftext|>y <|endoftext|>", "\x00\x1c\x85"]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: itself where it prints, else from 256 upwards."""
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], Sequence[int]]:
    """Text -> ids as ``tokenizers`` gives them for the file, special tokens in a text included.

    The ids are made by ``tiktoken`` from the same vocabulary, several times faster, if the file is a plain
    byte-level BPE whose ids follow its merges and both give equal ids on a set of probes; else by ``tokenizers``.
    """
    slow = Tokenizer.from_file(path)

    def plain(text: str) -> Sequence[int]:
        return slow.encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, special = spec["model"], {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
    if model.get("type") != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
        return plain
    alphabet = byte_alphabet()
    try:
        ranks = {bytes(alphabet[c] for c in piece): n for piece, n in model["vocab"].items() if piece not in special}
        fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        if any(list(fast.encode(t, allowed_special="all")) != plain(t) for t in _PROBES):
            return plain
    except (KeyError, ValueError):
        return plain

    def encode(text: str) -> Sequence[int]:
        if _LONG_RUN.search(text):
            return plain(text)
        return fast.encode(text, allowed_special="all")

    return encode
