"""Rule-based readings of text: polarity, verdicts, field extraction, routing."""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import scoring
from tessera.functions.core import let
from tessera.functions.text import extract_citations, strip_ws, tokenize_words

#: Bytes of text that are counted together, about.
PIECE_BYTES = 1 << 20
# A short polarity list; callers pass their own for real work.
POLARITY = {
    "good": 1.9, "great": 3.1, "love": 3.2, "happy": 2.7, "joy": 2.8, "hope": 1.9, "kind": 2.4, "best": 3.2, "peace": 2.5,
    "bad": -2.5, "poor": -2.1, "hate": -2.7, "sad": -2.1, "fear": -2.2, "death": -2.9, "war": -2.9, "worst": -3.1,
    "pain": -2.3, "cruel": -2.8, "wrong": -2.1,
}


def sentiment(text: Column, lexicon: dict[str, float] | None = None) -> Column:
    """Struct (neg, neu, pos, compound) from word polarities, all inside the row.

    compound is sum / sqrt(sum^2 + 15); the shares count a polar word as its strength plus one and
    any other word as one. Words are counted in Arrow; the few texts with characters that are not known there
    are counted by ``tokenize_words``, with the same result.
    """
    lexicon = POLARITY if lexicon is None else lexicon
    levels: dict[float, list[str]] = defaultdict(list)
    for word, value in lexicon.items():
        levels[float(value)].append(word)

    def shares(bound: Column) -> Column:
        words, hits = bound[0], bound[1]
        counts = [(v, bound[i + 2]) for i, v in enumerate(levels)]
        zero = F.lit(0.0)
        total = sum((F.lit(v) * n for v, n in counts), zero)
        pos = sum((F.lit(v + 1) * n for v, n in counts if v > 0), zero)
        neg = sum((F.lit(1 - v) * n for v, n in counts if v < 0), zero)
        return let(F.struct(total.alias("s"), pos.alias("p"), neg.alias("n"), (words - hits).alias("u")), _polarity)

    found = let(tokenize_words(text), lambda t: F.struct(
        t.alias("t"), F.filter(t, lambda w: w.isin(list(lexicon))).alias("hits")))
    plain = let(found, lambda f: F.array(F.size(f["t"]), F.size(f["hits"]), *[F.size(_members(f["hits"], ws)) for ws in levels.values()]))
    return let(F.coalesce(word_counts(list(levels.values()))(text), plain), shares)


def _common_characters() -> tuple[np.ndarray, np.ndarray]:
    """(kind, lower) of the characters up to U+FFFF: kind 0 no part of a word, 1 part of a word, 2 left to the exact rule.

    Only Latin letters, marks of punctuation and signs of currency are known here. Their classes never change, each has one lower-case
    character and none depends on its neighbours; U+0130 is left out, as its lower case has two.
    """
    at = np.arange(0x10000)
    known = (at < 0x250) & (at != 0x130) | (at >= 0x2000) & (at < 0x2070) | (at >= 0x20A0) & (at < 0x20D0)
    kind = [int(chr(c) == "_" or unicodedata.category(chr(c))[0] in "LN") if k else 2 for c, k in enumerate(known)]
    lower = [ord(chr(c).lower()) if k else c for c, k in enumerate(known)]
    return np.array(kind, np.uint8), np.array(lower, np.uint32)


def word_counts(groups: list[list[str]]):
    """Arrow function from a text to [words, words of any group, of group 1, of group 2, ...], words as ``tokenize_words`` sees them.

    The texts of a piece are looked at together, as one array of characters. A text with characters other than the common ones (``_common_characters``)
    gives null: its words must be counted by the rule itself.
    """
    chosen = sorted((w, g) for g, ws in enumerate(groups) for w in ws if w and max(w) < "\U00010000")
    by_size = {n: [(w, g) for w, g in chosen if len(w) == n] for n in sorted({len(w) for w, _ in chosen})}
    width = len(groups) + 2

    def count(texts: list[bytes], kinds: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """([words, ...] of each text, whether it has common characters only)."""
        text = b"\n".join(texts).decode("utf-8")
        try:
            raw = text.encode("latin-1")
            codes, kind = np.frombuffer(raw, np.uint8), np.frombuffer(raw.translate(kinds[:256].tobytes()), np.uint8)
        except UnicodeEncodeError:
            # characters beyond U+FFFF are two codes, both left to the exact rule
            codes = np.frombuffer(text.encode("utf-16-le"), np.uint16)
            kind = kinds[codes]
        ends, sizes = np.flatnonzero(codes == 10), np.array([t.count(b"\n") for t in texts])
        last = np.append(ends, len(codes))[np.cumsum(sizes + 1) - 1]
        odd = np.zeros(len(texts), bool)
        if kind.max(initial=0) == 2:
            odd[np.searchsorted(last, np.flatnonzero(kind == 2))] = True
        inside = np.zeros(len(codes) + 2, bool)
        inside[1:-1] = kind == 1
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        starts, stops = turns[::2], turns[1::2]
        out = np.zeros((len(texts), width), np.int64)
        out[:, 0] = np.diff(np.searchsorted(starts, last), prepend=0)
        length = stops - starts
        for n, words in by_size.items():
            some = starts[length == n]
            for j in range(min(n, 3)):
                letter = np.zeros(len(kinds), bool)
                letter[[ord(w[j]) for w, _ in words]] = True
                some = some[letter[lower[codes[some + j]]]]
            if len(some):
                letters = lower[codes[some[:, None] + np.arange(n)]].view(f"<U{n}").ravel()
                table = np.array([w for w, _ in words], f"<U{n}")
                place = np.minimum(np.searchsorted(table, letters), len(table) - 1)
                hit = table[place] == letters
                group = np.array([g for _, g in words])[place[hit]]
                np.add.at(out, (np.searchsorted(last, some[hit]), group + 2), 1)
        out[:, 1] = out[:, 2:].sum(axis=1)
        return out, ~odd

    @F.arrow_udf("array<int>")
    def counted(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds, lower = _common_characters()
        for batch in column:
            made, sizes = [], np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            pieces = np.flatnonzero(np.diff(sizes // PIECE_BYTES, prepend=0) > 0).tolist()
            for at, to in zip([0, *pieces], [*pieces, len(batch)]):
                raw = batch.slice(at, to - at).cast(pa.binary()).to_pylist()
                try:
                    out, good = count([t or b"" for t in raw], kinds, lower) if raw else (np.zeros((0, width), np.int64), np.zeros(0, bool))
                except UnicodeDecodeError:
                    out, good = np.zeros((len(raw), width), np.int64), np.zeros(len(raw), bool)
                good &= np.array([t is not None for t in raw], bool)
                values = pa.array(out.ravel().astype(np.int32))
                lists = pa.FixedSizeListArray.from_arrays(values, width).cast(pa.list_(pa.int32()))
                made.append(pc.if_else(pa.array(good), lists, pa.scalar(None, lists.type)))
            yield pa.chunked_array(made, pa.list_(pa.int32())).combine_chunks()

    return counted


def _members(words: Column, chosen: list[str]) -> Column:
    return F.filter(words, lambda w: w.isin(chosen))


def _polarity(b: Column) -> Column:
    whole = b["p"] + b["n"] + b["u"]
    share = lambda x: F.coalesce(F.round(F.try_divide(x, whole), 3), F.lit(0.0))
    return F.struct(share(b["n"]).alias("neg"), share(b["u"].cast("double")).alias("neu"), share(b["p"]).alias("pos"),
                    F.round(b["s"] / F.sqrt(b["s"] * b["s"] + 15), 4).alias("compound"))


# Verdicts on an answer; a caller may add rules of the same form.
RULES: dict[str, Callable[[Column], Column]] = {
    "unique_items": scoring.not_duplicative,
    "is_list": scoring.is_listed,
    "cites": lambda answer: F.size(extract_citations(answer)) > 0,
    "not_empty": lambda answer: scoring.nonempty_score(answer) > 0,
}


def verdict(passed: Column) -> Column:
    return F.when(passed, F.lit("Yes")).otherwise(F.lit("No"))


@dataclass(frozen=True)
class FieldPattern:
    """How a field is read from text.

    text     first match
    list     every match
    records  every match as a struct, one pattern per member over the same matches
    checked  whether the pattern occurs
    A value in ``placeholders`` stands for nothing.
    """

    name: str
    pattern: str
    kind: str = "text"
    group: int = 1
    members: tuple[str, ...] = ()
    placeholders: tuple[str, ...] = ("", "N/A", "n/a", "none", "null", "<UNKNOWN>")


def extract_field(text: Column, field: FieldPattern) -> Column:
    every = lambda group: F.regexp_extract_all(text, F.lit(field.pattern), F.lit(group))
    if field.kind == "text":
        return let(strip_ws(F.regexp_extract(text, field.pattern, field.group)),
                   lambda v: F.when(~v.isin(*field.placeholders), v))
    if field.kind == "list":
        return F.filter(every(field.group), lambda v: ~v.isin(*field.placeholders))
    if field.kind == "records":
        groups = [every(i + 1).alias(m) for i, m in enumerate(field.members)]
        return F.arrays_zip(*groups)
    if field.kind == "checked":
        return F.regexp_like(text, F.lit(field.pattern))
    raise ValueError(f"unknown kind {field.kind}")


def extract_fields(text: Column, fields: list[FieldPattern]) -> Column:
    return F.struct(*[extract_field(text, f).alias(f.name) for f in fields])


UNSURE = "No context to judge by, so documents are searched."


def route_with_default(question: Column, history: Column, context: Column, share: float = 0.6) -> Column:
    """Struct (need_retrieval, reasoning): fetch documents unless the known text covers the question's words."""
    def decide(b: Column) -> Column:
        cover = F.try_divide(F.size(F.array_intersect(b["asked"], b["known"])), F.size(b["asked"]))
        need = cover < share
        reason = F.when(need, F.lit("Question asks for words not seen before.")).otherwise(
            F.lit("Question is covered by the conversation."))
        return F.struct(F.coalesce(need, F.lit(True)).alias("need_retrieval"),
                        F.coalesce(F.when(need.isNotNull(), reason), F.lit(UNSURE)).alias("reasoning"))

    known = F.concat_ws(" ", history, context)
    sides = F.struct(F.array_distinct(tokenize_words(question)).alias("asked"),
                     F.when(history.isNotNull() | context.isNotNull(), tokenize_words(known)).alias("known"))
    return let(sides, decide)
