"""Encoders of the public tokenizers, made once per Python worker."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache

#: White-space runs of this length are split off before the pattern sees them: its matcher runs out of stack beyond a million.
LONG_RUN = 250_000
_RUN = re.compile(r"\s{%d,}" % LONG_RUN)


def split_long_runs(text: str) -> list[tuple[str, bool]]:
    """(part, is one pre-token) of a text; joined, the parts are the text.

    The pattern takes a run of white space as one pre-token up to its last
    character, which goes with what follows, or whole at the end of the text.
    """
    parts, at = [], 0
    if len(text) >= LONG_RUN:
        for m in _RUN.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            parts += [(text[at : m.start()], False), (text[m.start() : end], True)]
            at = end
    return [*parts, (text[at:], False)]


@lru_cache(maxsize=4)
def byte_bpe(path: str, special: bool) -> Callable[[str], list[int]]:
    """text -> ids for a byte-level BPE vocabulary in tiktoken's rank format.

    With ``special``, the string of the special token in a text gets its own id,
    as ``tokenizers`` does by default; else it is ordinary text.
    """
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe_entries(path)
    names = {"<|endoftext|>": len(ranks)} if special else {}
    made = tiktoken.Encoding(
        "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in enumerate(ranks)}, special_tokens=names
    )

    def plain(text: str) -> list[int]:
        return made.encode(text, allowed_special="all") if special else made.encode_ordinary(text)

    def encode(text: str) -> list[int]:
        if len(text) < LONG_RUN:
            return plain(text)
        out = []
        for part, whole in split_long_runs(text):
            out += made._encode_single_piece(part) if whole else plain(part)
        return out

    return encode


@lru_cache(maxsize=4)
def byte_bpe_entries(path: str) -> list[bytes]:
    """The bytes of each id."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [ranks[i] for i in range(len(ranks))]


@lru_cache(maxsize=4)
def piece_bpe(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def piece_bpe_entries(path: str) -> list[bytes]:
    """The bytes of each id: its piece with U+2581 as a space, or the byte that it stands for."""
    model = piece_bpe(path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [
        bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i, p in enumerate(pieces)
    ]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
