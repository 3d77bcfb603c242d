"""Token ids of the public byte-level BPE, made one text at a time in the workers.

The vocabulary is byte_bpe_50k.json, the file that the tokenizers library reads; ids are those that this library gives
with add_special_tokens=False, strings of added tokens in a text included (tests compare both). The merging itself
is done by tiktoken, which needs a quarter of the time for the same ids.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import cache

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
#: The pre-token pattern of byte-level BPE in possessive form, which doesn't backtrack.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
PART = 1 << 16


@dataclass(frozen=True)
class Encoder:
    """merge: tiktoken's encoding; added: ids of the strings that a text is cut at, cut: their pattern (None: ordinary text)."""

    merge: object
    added: dict[str, int]
    cut: re.Pattern | None


def byte_letters() -> dict[str, int]:
    """The letter that byte-level BPE writes for each byte: printable ones stand for themselves, others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def encoder(path: str | None = None, literal: bool = False) -> Encoder:
    """The tokenizer behind a vocabulary file of byte-level BPE. literal: strings of added tokens are ordinary text, too."""
    import tiktoken

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    letters, extra = byte_letters(), told["added_tokens"]
    if told["model"]["type"] != "BPE" or told["pre_tokenizer"]["type"] != "ByteLevel" or told["pre_tokenizer"]["add_prefix_space"] or told["normalizer"] or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in extra):
        raise ValueError(f"{path} isn't a plain byte-level BPE")
    added = {t["content"]: t["id"] for t in extra}
    ranks = {bytes(letters[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in added}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in told["model"]["merges"]]
    ids = [told["model"]["vocab"][m] for m in merges]
    if sorted(ids) != ids or len(set(ids)) != len(ids):  # an id is also the rank of its merge
        raise ValueError(f"the ids of {path} don't follow its merges")
    cut = None if literal or not added else re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    return Encoder(tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), added, cut)


def encode(enc: Encoder, text: str) -> np.ndarray:
    """Ids of a whole text, uint32."""
    if enc.cut is not None and any(t in text for t in enc.added):
        parts = [np.array([enc.added[x]], np.uint32) if i % 2 else plain(enc, x) for i, x in enumerate(enc.cut.split(text))]
        return np.concatenate(parts)
    return plain(enc, text)


def plain(enc: Encoder, text: str) -> np.ndarray:
    """Long texts are cut before a space between two other characters, where the pattern always starts a new piece, so that
    the encoder's lists stay small."""
    if len(text) <= PART:
        return np.array(enc.merge.encode_ordinary(text), np.uint32)
    parts, at = [], 0
    while at < len(text):
        end = at + PART
        if end < len(text):
            while (end := text.find(" ", end)) >= 0 and (text[end - 1].isspace() or text[end + 1 : end + 2].isspace() or end + 1 == len(text)):
                end += 1
            end = len(text) if end < 0 else end
        parts.append(np.array(enc.merge.encode_ordinary(text[at:end]), np.uint32))
        at = end
    return np.concatenate(parts)
