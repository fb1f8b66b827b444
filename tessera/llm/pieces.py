"""SentencePiece BPE ids of whole texts by vectorised merge rounds, and texts from ids."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.memory import give_back

#: How a model writes a space.
SPACE = "▁"
#: Words in each of the two generations that a Python worker keeps with their ids, over all its tasks.
MEMO = 150_000
#: Characters of texts that one batch of merge rounds takes at least (one text may be longer).
ROUND_CHARS = 1 << 19
NONE = np.int32(2**31 - 1)

codecs.register_error("tessera-one-byte", lambda e: ("�", e.start + 1))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _word_pattern(bigrams: set[tuple[str, str]]) -> re.Pattern | None:
    """Words that no piece goes across, as a pattern over texts with plain spaces; none if pieces hold a space after other characters.

    Characters that stand together in some piece are of one kind. Kinds without a letter, and ASCII marks and digits of no
    kind, make words of their own; both sorts of words begin with the spaces before them.
    """
    if any(b == SPACE and a != SPACE for a, b in bigrams):
        return None
    kind: dict[str, set[str]] = {}
    for a, b in bigrams:
        if SPACE not in (a, b) and kind.get(a) is not (both := kind.get(b, {b})):
            both |= kind.get(a, {a})
            kind.update(dict.fromkeys(both, both))
    marks = {c for c in map(chr, range(128)) if not c.isalpha() and c not in kind} | {c for c, k in kind.items() if not any(map(str.isalpha, k))}
    marks = re.escape("".join(sorted(marks - {" ", SPACE})))
    return re.compile(f" *[^ {marks}]+| *[{marks}]+| +")


class PieceModel:
    """The tables of a BPE model with byte fallback: characters, pairs with their rank, bytes of each piece.

    Models with another normalizer, without byte fallback, or with unused or user-defined pieces are refused.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(size)]
        byte_ids = [i for i in range(size) if lib.is_byte(i)]
        plain = [i for i in range(size) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
        probe = " ﬁ  Aéé\t "
        if (len(byte_ids) != 256 or any(lib.is_unused(i) for i in plain)
                or lib.normalize(probe) != SPACE + probe.replace(" ", SPACE)):
            raise ValueError("only BPE models with byte fallback, the identity normalizer and a space put before the text")
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        chars = sorted({c for i in plain for c in names[i]})
        symbols = {names[i]: i for i in plain}
        for c in chars:
            symbols.setdefault(c, len(names) + len(symbols) - len(plain))
        self.size, self.symbols = size, len(names) + len(symbols) - len(plain) + 1
        #: Symbol of each code point; the last symbol stands for characters of no piece.
        self.of_char = np.full(0x110000, self.symbols - 1, np.int32)
        self.of_char[[ord(c) for c in chars]] = [symbols[c] for c in chars]
        scores = sorted({lib.get_score(i) for i in plain}, reverse=True)
        rank = {s: n for n, s in enumerate(scores)}
        pairs: dict[int, tuple[int, int]] = {}
        bigrams: set[tuple[str, str]] = set()
        for i in plain:
            p = names[i]
            bigrams.update(zip(p, p[1:]))
            for k in range(1, len(p)):
                if p[:k] in symbols and p[k:] in symbols:
                    pairs[symbols[p[:k]] * self.symbols + symbols[p[k:]]] = rank[lib.get_score(i)], i
        keys = sorted(pairs)
        self.keys = np.array(keys + [2**62], np.int64)
        self.ranks = np.array([pairs[k][0] for k in keys] + [NONE], np.int32)
        self.merged = np.array([pairs[k][1] for k in keys] + [0], np.int32)
        #: Pairs of neighbouring characters that some piece holds; no merge goes across any other pair.
        self.bigrams = np.array(sorted((ord(a) << 21) + ord(b) for a, b in bigrams) + [2**62], np.int64)
        self.words = _word_pattern(bigrams)
        self.byte_ids = np.zeros(256, np.int32)
        self.byte_ids[[int(names[i][3:5], 16) for i in byte_ids]] = byte_ids
        raw = {i: bytes([int(names[i][3:5], 16)]) for i in byte_ids} | {i: names[i].replace(SPACE, " ").encode() for i in plain}
        raw |= {i: " ⁇ ".encode() for i in range(size) if lib.is_unknown(i)}
        blob = [raw.get(i, b"") for i in range(size)]
        self.blob = np.frombuffer(b"".join(blob), np.uint8)
        self.widths = np.array([len(b) for b in blob], np.int64)
        self.offsets = np.cumsum(self.widths) - self.widths
        self.leads = np.zeros(size, bool)
        self.leads[[i for i in plain if names[i].startswith(SPACE)]] = True
        self.silent = np.array([lib.is_control(i) for i in range(size)])
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NONE`` if there is no such piece) and merged symbol of neighbours."""
        keys = left.astype(np.int64) * self.symbols + right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE), self.merged[at]

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word (written with ``SPACE``).

        All symbols lie in one flat array, cut where no piece holds the two neighbouring characters. Each round finds the
        smallest pair rank per segment, merges its places from left to right, and closes the gaps; segments without a
        pair leave. Places of one rank are merged in one round only if no pair that arises from them ranks before or like them; else
        the segment merges its leftmost place, which is the order of a queue.
        """
        codes = _codes("".join(words))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        total = len(codes)
        final = np.full(total, -1, np.int32)
        sym, place = self.of_char[codes], np.arange(total)
        grams = (codes[:-1].astype(np.int64) << 21) + codes[1:]
        apart = np.ones(total, bool)
        apart[1:] = self.bigrams[np.searchsorted(self.bigrams, grams)] != grams
        apart[ends[:-1]] = True
        starts = np.flatnonzero(apart)
        rank, new = self._pair(sym, np.append(sym[1:], 0))
        rank[np.append(starts[1:], total) - 1] = NONE
        while len(starts):
            sizes = np.diff(np.append(starts, len(sym)))
            least = np.minimum.reduceat(rank, starts)
            live = least < NONE
            if not live.all():
                held = np.repeat(live, sizes)
                final[place[~held]] = sym[~held]
                sym, place, rank, new = sym[held], place[held], rank[held], new[held]
                sizes, least = sizes[live], least[live]
                starts = np.cumsum(sizes) - sizes
                if not len(starts):
                    break
            segment = np.repeat(np.arange(len(starts)), sizes)
            chosen = rank == least[segment]
            index = np.arange(len(sym))
            before = np.append(False, chosen[:-1])
            run = np.maximum.accumulate(np.where(chosen & ~before, index, 0))
            at = np.flatnonzero(chosen & ((index - run) % 2 == 0))
            own = segment[at]
            first = np.append(True, own[1:] != own[:-1])
            if not first.all():
                # a pair made with either neighbour, before or after the neighbour's own merge, must rank after this round's
                after = sym.copy()
                after[at + 1] = new[at]
                left, _ = self._pair(after[np.maximum(at - 1, 0)], new[at])
                right, _ = self._pair(new[at], sym[np.minimum(at + 2, len(sym) - 1)])
                early = (left <= least[own]) & (segment[np.maximum(at - 1, 0)] == own) | (right <= least[own]) & (segment[np.minimum(at + 2, len(sym) - 1)] == own)
                late = np.zeros(len(starts), bool)
                late[own[early]] = True
                at = at[first | ~late[own]]
                own = segment[at]
            sym[at] = new[at]
            stays = np.ones(len(sym), bool)
            stays[at + 1] = False
            last = np.zeros(len(sym), bool)
            last[starts + sizes - 1] = True
            last[at] = last[at + 1]
            changed = np.zeros(len(sym), bool)
            changed[at] = True
            sym, place, rank, new, last, changed = sym[stays], place[stays], rank[stays], new[stays], last[stays], changed[stays]
            changed[:-1] |= changed[1:]
            todo = np.flatnonzero(changed & ~last)
            rank[last] = NONE
            rank[todo], new[todo] = self._pair(sym[todo], sym[todo + 1])
            sizes = sizes - np.bincount(own, minlength=len(sizes))
            starts = np.cumsum(sizes) - sizes
        there = final >= 0
        ids, counts = final[there], np.cumsum(there)
        stops = counts[ends - 1]
        odd = np.flatnonzero(ids >= self.size)
        if len(odd):
            raw = [chr(c).encode() for c in codes[there][odd]]
            times = np.ones(len(ids), np.int64)
            times[odd] = [len(b) for b in raw]
            shift = np.append(0, np.cumsum(times))
            ids = np.repeat(ids, times)
            ids[np.concatenate([np.arange(shift[i], shift[i + 1]) for i in odd])] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            stops = shift[stops]
        return np.split(ids, stops[:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts with the begin and end id; an empty text has these two only."""
        out, group, held = [], [], 0
        for t in texts:
            group.append(t)
            held += len(t)
            if held >= ROUND_CHARS:
                out += self._encode(group)
                group, held = [], 0
        return out + self._encode(group)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        begin, end = np.array([self.begin], "<u4").tobytes(), np.array([self.end], "<u4").tobytes()
        spaced = [" " + t.replace(SPACE, " ") if t else "" for t in texts]
        cut = [self.words.findall(t) if self.words else [t] * bool(t) for t in spaced]
        if len(self.memo) > MEMO:
            self.older, self.memo = self.memo, {}
        missing = list(set().union(*cut).difference(self.memo))
        self.memo.update((w, self.older[w]) for w in missing if w in self.older)
        if learn := [w for w in missing if w not in self.memo]:
            self.memo.update(zip(learn, (x.astype("<u4").tobytes() for x in self.merge([w.replace(" ", SPACE) for w in learn]))))
        find = self.memo.__getitem__
        return [np.frombuffer(begin + b"".join(map(find, c)) + end, "<u4") for c in cut]

    def decode(self, lists: list[np.ndarray]) -> list[str]:
        """Texts of id lists: bytes are put together, what is no UTF-8 becomes U+FFFD per byte, the space put before the text goes."""
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        if not sizes.sum():
            return [""] * len(lists)
        ids = np.concatenate(lists).astype(np.int64)
        width = self.widths[ids]
        ends = np.cumsum(width)
        raw = self.blob[np.repeat(self.offsets[ids] - ends + width, width) + np.arange(ends[-1])]
        edges = np.append(0, ends)[np.append(0, np.cumsum(sizes))]
        heard = np.append(np.flatnonzero(~self.silent[ids]), len(ids))
        firsts = heard[np.searchsorted(heard, np.cumsum(sizes) - sizes)]
        inside = firsts < np.cumsum(sizes)
        drop = inside & self.leads[ids[np.minimum(firsts, len(ids) - 1)]]
        whole = raw.tobytes()
        out = [whole[i + d:j].decode("utf-8", "tessera-one-byte") for i, j, d in zip(edges[:-1].tolist(), edges[1:].tolist(), drop.tolist())]
        # a control id inside a list parts the bytes around it
        stops = np.cumsum(sizes)
        inner = np.flatnonzero(self.silent[ids])
        owner = np.searchsorted(stops, inner, "right")
        inside = (inner > (stops - sizes)[owner]) & (inner < stops[owner] - 1)
        for k in np.unique(owner[inside]).tolist():
            borders = [edges[k] + int(drop[k]), *(ends[i] for i in inner[owner == k]), edges[k + 1]]
            out[k] = "".join(whole[max(i, borders[0]):j].decode("utf-8", "tessera-one-byte") for i, j in zip(borders, borders[1:]))
        return out


@cache
def piece_model(path: str) -> PieceModel:
    """The worker's model; it goes from task to task with its words."""
    return PieceModel(path)


def _slices(column: pa.Array, rows: int = 250) -> Iterator[pa.Array]:
    return (column.slice(i, rows) for i in range(0, len(column), rows))


def encode_pieces(df: DataFrame, model_path: str, text_col: str = "text", out: str = "ids", packed: bool = False) -> DataFrame:
    """``df`` with the ids of its texts, begin and end ids included: ``array<int>``, or packed as little-endian 32-bit integers.

    Whole texts of any length are encoded; null counts as empty, which has the begin and end id. Rows are independent, so
    repeated rows give repeated results, ties do not arise, and an empty table gives an empty one. Other columns stay
    as they are; one named ``out`` is replaced.
    """
    names = [f"_c{i}" for i in range(len(df.columns))]
    text = names[df.columns.index(text_col)]
    kind, kind_of = ("binary", pa.binary()) if packed else ("array<int>", pa.list_(pa.int32()))
    rows = df.toDF(*names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for texts in _slices(batch.column(text)):
                ids = piece_model(model_path).encode([t or "" for t in texts.to_pylist()])
                if packed:
                    made.append(pa.array([x.tobytes() for x in ids], pa.binary()))
                else:
                    ends = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
                    made.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids).astype(np.int32))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.chunked_array(made, kind_of).combine_chunks()], names=[*names, "_out"])
        give_back()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    found = rows.mapInArrow(work, f"{schema}, _out {kind}")
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, df.columns) if c != out], F.col("_out").alias(out))


def decode_pieces(df: DataFrame, model_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the texts of its ids (``array<int>`` without nulls, or packed); null ids give null. Other columns stay; one named ``out`` is replaced."""
    names = [f"_c{i}" for i in range(len(df.columns))]
    ids_name = names[df.columns.index(ids_col)]
    rows = df.toDF(*names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for column in _slices(batch.column(ids_name)):
                if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
                    lists = [np.frombuffer(b or b"", "<u4") for b in column.to_pylist()]
                else:
                    at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
                    lists = [flat[i:j] for i, j in zip(at[:-1], at[1:])]
                made += [t if ok else None for t, ok in zip(piece_model(model_path).decode(lists), column.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*names, "_out"])
        give_back()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    found = rows.mapInArrow(work, f"{schema}, _out string")
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, df.columns) if c != out], F.col("_out").alias(out))
