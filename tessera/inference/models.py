"""Deterministic local models.

A model is a picklable factory: calling it (once per task) gives a function from a list of texts
to a list of answers. A remote model has the same shape.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

BatchCall = Callable[[list], list]
ModelFactory = Callable[[], BatchCall]

#: Words whose bucket a task remembers; the memory of a worker does not grow with the vocabulary beyond.
KNOWN_WORDS = 200_000


@dataclass(frozen=True)
class HashedEmbedder:
    """Word counts hashed to a fixed number of buckets, scaled to unit length."""

    dim: int = 64

    def __call__(self) -> BatchCall:
        word = re.compile(r"\w+")
        bucket: dict[str, int] = {}

        def slot(token: str) -> int:
            at = bucket.get(token)
            if at is None:
                at = int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16) % self.dim
                # frequent words come early; later ones are hashed again each time
                if len(bucket) < KNOWN_WORDS:
                    bucket[token] = at
            return at

        def embed(texts: list) -> list:
            out = []
            for text in texts:
                slots = [slot(t) for t in word.findall((text or "").lower())]
                counts = np.bincount(slots, minlength=self.dim).astype("float64")
                size = math.sqrt(float((counts * counts).sum()))
                out.append((counts / size if size else counts).astype("float32").tolist())
            return out

        return embed


@dataclass(frozen=True)
class PatternExtractor:
    """JSON record of the first (or, for names in ``many``, every) match of each pattern."""

    patterns: dict[str, str]
    many: tuple[str, ...] = ()

    def __call__(self) -> BatchCall:
        compiled = {name: re.compile(p) for name, p in self.patterns.items()}

        def one(text: str) -> str:
            record = {}
            for name, pattern in compiled.items():
                found = [m.group(m.lastindex or 0) for m in pattern.finditer(text)]
                record[name] = found if name in self.many else (found[0] if found else None)
            return json.dumps(record, ensure_ascii=False)

        return lambda texts: [one(t) for t in texts]


@dataclass(frozen=True)
class CoverageJudge:
    """Answers yes if enough words of the text after ``mark`` occur before it."""

    mark: str = "\nQuestion: "
    share: float = 0.5

    def __call__(self) -> BatchCall:
        word = re.compile(r"\w+")

        def one(text: str) -> str:
            context, _, question = text.rpartition(self.mark)
            asked = set(word.findall(question.lower()))
            seen = asked & set(word.findall(context.lower()))
            return "Yes" if asked and len(seen) >= self.share * len(asked) else "No"

        return lambda texts: [one(t) for t in texts]


@dataclass(frozen=True)
class WordPolarity:
    """positive, negative or neutral by counting words of two lists."""

    good: tuple[str, ...]
    bad: tuple[str, ...]

    def __call__(self) -> BatchCall:
        word = re.compile(r"\w+")
        good, bad = set(self.good), set(self.bad)

        def one(text: str) -> str:
            tokens = word.findall(text.lower())
            balance = sum(t in good for t in tokens) - sum(t in bad for t in tokens)
            return "positive" if balance > 0 else "negative" if balance < 0 else "neutral"

        return lambda texts: [one(t) for t in texts]


@dataclass(frozen=True)
class Checksum:
    """Length and digest of the prompt: a stand-in that shows exactly what a model was sent."""

    prefix: str = ""

    def __call__(self) -> BatchCall:
        return lambda texts: [f"{self.prefix}{len(t)}:{hashlib.md5(t.encode('utf-8')).hexdigest()}" for t in texts]


@dataclass(frozen=True)
class BatchSize:
    """Answers with the number of texts in the call."""

    def __call__(self) -> BatchCall:
        return lambda texts: [str(len(texts))] * len(texts)


@dataclass(frozen=True)
class Flaky:
    """Wraps a model and fails: always on texts that hold ``poison``, else ``fails`` times before each success."""

    inner: ModelFactory
    poison: str | None = None
    fails: int = 0

    def __call__(self) -> BatchCall:
        call = self.inner()
        failed = 0

        def run(texts: list) -> list:
            nonlocal failed
            if self.poison is not None and any(self.poison in text for text in texts):
                raise ValueError("refused input")
            if failed < self.fails:
                failed += 1
                raise TimeoutError("rate limit")
            failed = 0
            return call(texts)

        return run
