"""Length measures for chunking: factories called once per task. Files must be readable on every executor."""

from __future__ import annotations

import base64
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class TokenizerFile:
    """Tokens of a tokenizer saved as JSON."""

    path: str

    def __call__(self) -> Callable[[str], int]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@dataclass(frozen=True)
class RankFile:
    """Tokens of a byte-pair vocabulary given as ranks."""

    path: str
    pattern: str

    def __call__(self) -> Callable[[str], int]:
        import tiktoken

        with open(self.path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text))


@dataclass(frozen=True)
class Words:
    """White-space separated words."""

    def __call__(self) -> Callable[[str], int]:
        return lambda text: len(text.split())
