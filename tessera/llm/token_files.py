"""Token ids in Parquet list columns, in document order, with metadata that is read without the ids."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.memory import give_back

#: Bytes of texts whose words are cut and looked up together (at least one text).
SLICE = 3 << 20
#: Stands for a line feed before a piece; a text that holds it is encoded in one call.
MARK = "\x00"
#: White space that is neither a space nor a line feed.
OTHER_SPACE = "[\\t\\x0b-\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Letters up to U+024F: the pattern never cuts between them, and always after them where marks follow.
LETTER = "[A-Za-z\\x{aa}\\x{b5}\\x{ba}\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{24f}]"
MARKS = ".,!?;:"

#: How a byte-level vocabulary writes the bytes that are not visible characters: from U+0100 on, in order. Line feeds stay, as they part the words.
BYTE_CHARS = np.arange(256, dtype="<u2")
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
BYTE_CHARS[_HIDDEN] = 256 + np.arange(len(_HIDDEN))
BYTE_CHARS[ord("\n")] = ord("\n")


class Encoder:
    """Ids of whole texts. With the byte-level pattern, the different words of many texts are encoded once and put together.

    The pattern starts a piece at every space before a visible character, and a lone line feed is a piece of its own. So where all white
    space is single spaces and line feeds inside the text, the ids of the words follow each other. Marks at the end of a word of letters are
    pieces of their own too. Any other text, a text with a special string and every text of another kind of tokenizer is encoded in one call.
    Nothing is kept from call to call.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.feed = self._ids("\n")
        self.by_word = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                        and not spec.get("normalizer") and len(self.feed) == 1)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        model = spec.get("model") or {}
        self.letters = None
        if self.by_word and model.get("type") == "BPE" and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout")):
            from tokenizers.models import BPE
            from tokenizers.pre_tokenizers import CharDelimiterSplit

            # every word comes once, so the model's own memory of words would only cost time
            pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            self.letters = Tokenizer(BPE(model["vocab"], pairs, cache_capacity=0, ignore_merges=bool(model.get("ignore_merges"))))
            self.letters.pre_tokenizer = CharDelimiterSplit("\n")
            vocab = self.tokenizer.get_vocab()
            self.widths = np.zeros(max(vocab.values()) + 1, np.int32)
            self.widths[list(vocab.values())] = list(map(len, vocab))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, sizes = self.encode_column(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(sizes)[:-1]) if len(texts) else []

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        if not self.by_word or not len(texts):
            lists = [self._ids(t) for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, np.int32), *lists]), np.fromiter(map(len, lists), np.int64, len(lists))
        bad = pc.match_substring(texts, MARK)
        for special in self.special:
            bad = pc.or_(bad, pc.match_substring(texts, special))
        whole = pc.or_(bad, pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        words = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(MARK), pc.replace_substring(texts, "\n", " " + MARK), ""), " ")
        bounds = words.offsets.to_numpy()
        coded = words.values.dictionary_encode()
        which, pieces = coded.indices.to_numpy(), coded.dictionary
        # empty pieces and those with other white space mark the texts to encode in one call
        odd = pc.or_(pc.match_substring_regex(pieces, OTHER_SPACE), pc.or_(pc.equal(pieces, ""), pc.equal(pieces, MARK))).to_numpy(zero_copy_only=False)
        if odd.any():
            whole = whole | np.logical_or.reduceat(odd[which], bounds[:-1])
        store, begins, widths = self._piece_ids(pieces, ~odd)
        # the first piece of a text has the id of a line feed before it, which the text has not
        begin, width = begins[which], widths[which]
        begin[bounds[:-1]] += 1
        width[bounds[:-1]] = np.maximum(width[bounds[:-1]] - 1, 0)
        if whole.any():
            width[np.repeat(whole, np.diff(bounds))] = 0
        ends = np.cumsum(width, dtype=np.int32)
        ids = store[np.repeat(begin - ends + width, width) + np.arange(ends[-1], dtype=np.int32)]
        sizes = np.diff(np.append(0, ends)[bounds]).astype(np.int64)
        if whole.any():
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i in np.flatnonzero(whole).tolist():
                parts[i] = self._ids(texts[i].as_py())
            ids, sizes = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, sizes

    def _piece_ids(self, pieces: pa.Array, fine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, number) of each piece: those of its stem, then those of the marks at its end."""
        stems = pc.utf8_rtrim(pieces, MARKS)
        cut = pc.match_substring_regex(stems, LETTER + "$")
        tail = pc.if_else(cut, pc.struct_field(pc.extract_regex(pieces, f"(?P<t>[{MARKS}]*)$"), "t"), "").dictionary_encode()
        stem = pc.if_else(cut, stems, pieces).dictionary_encode()
        used = np.zeros(len(stem.dictionary), bool)
        used[stem.indices.to_numpy()[fine]] = True
        store, first, width = self._word_ids(stem.dictionary, used)
        there = np.flatnonzero(pc.not_equal(tail.dictionary, "").to_numpy(zero_copy_only=False))
        first2, width2 = np.zeros(len(tail.dictionary), np.int32), np.zeros(len(tail.dictionary), np.int32)
        store2, first2[there], width2[there] = self._lines(tail.dictionary.take(pa.array(there)), "")
        a, b = stem.indices.to_numpy(), tail.indices.to_numpy()
        wa, wb = width[a], np.where(fine, width2[b], 0).astype(np.int32)
        total = wa + wb
        begins = np.cumsum(total, dtype=np.int32) - total
        out = np.empty(int(total.sum()), np.int32)
        for own, start, count, at in ((store, first[a], wa, begins), (store2, first2[b], wb, begins + wa)):
            steps = np.arange(int(count.sum()), dtype=np.int32) - np.repeat(np.cumsum(count, dtype=np.int32) - count, count)
            out[np.repeat(at, count) + steps] = own[np.repeat(start, count) + steps]
        return out, begins, total

    def _word_ids(self, words: pa.Array, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, number) of words after a space, or after a line feed where ``MARK`` stands before them; unused ones have none."""
        after_feed = pc.starts_with(words, MARK).to_numpy(zero_copy_only=False)
        plain = pc.match_substring_regex(words, f"^{LETTER}+$").to_numpy(zero_copy_only=False) if self.letters else np.zeros(len(words), bool)
        first, width = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
        stores, base = [], 0
        for mask, encode in ((plain, self._letter_words), (~plain & ~after_feed, lambda w: self._lines(w, " ")),
                             (~plain & after_feed, lambda w: self._lines(pc.utf8_slice_codeunits(w, 1), "", feed=True))):
            at = np.flatnonzero(mask & used)
            if len(at):
                store, own, count = encode(words.take(pa.array(at)))
                first[at], width[at] = own + base, count
                stores.append(store)
                base += len(store)
        return np.concatenate([np.zeros(0, np.int32), *stores]), first, width

    @staticmethod
    def _joined(words: pa.Array, lead: str) -> bytes:
        whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        return lead.encode() + pc.binary_join(whole, "\n" + lead)[0].as_buffer().to_pybytes()

    def _letter_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of letters alone, each after a space. The pattern does not cut them, so the model gets them as they are.

        Its vocabulary writes bytes as characters; the characters of the ids show where each word ends.
        """
        lines = BYTE_CHARS[np.frombuffer(self._joined(words, " "), np.uint8)].tobytes().decode("utf-16-le")
        ids = np.array(self.letters.encode_batch_fast([lines], add_special_tokens=False)[0].ids, np.int32)
        ends = np.cumsum(self.widths[ids])
        last = np.cumsum(pc.binary_length(words).to_numpy() + 1)
        cuts = np.searchsorted(ends, last).astype(np.int32)
        if ends[-1] != last[-1] or (ends[cuts] != last).any():
            raise AssertionError("ids do not match words")
        stops = cuts + 1
        first = np.append(0, stops[:-1]).astype(np.int32)
        return ids, first, stops - first

    def _lines(self, words: pa.Array, lead: str, feed: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words as the lines of one text, each after ``lead``; with ``feed`` the line feed before a word belongs to it."""
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        text = ("\n" if feed else "") + self._joined(words, lead).decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        feeds = np.flatnonzero(ids == self.feed[0]).astype(np.int32)
        if len(feeds) != len(words) - (not feed):
            raise AssertionError("lines do not match words")
        first = feeds if feed else np.append(-1, feeds).astype(np.int32) + 1
        stops = np.append(feeds[1:] if feed else feeds, len(ids)).astype(np.int32)
        return ids, first, stops - first


@cache
def encoder(path: str) -> Encoder:
    """The worker's encoder; it goes from task to task with its words."""
    return Encoder(path)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of stretches of about ``SLICE`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield at, upto - at
        at = upto


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 order_cols: list[str] | None = None, end_id: int = 0, row_group_bytes: int = 32 << 20, page_rows: int = 2_000) -> None:
    """Encodes every whole text, appends ``end_id`` and writes files whose rows follow ``order_cols`` (by default the id).

    Columns: ``part`` (number of the file's task, files follow each other by it), ``doc_id``, ``local_start`` (ids before the document in its
    part), ``n_tokens``, ``tokens``. The ids are dictionary-encoded lists, the other columns delta-encoded; row groups and pages are
    bounded, and page indexes let a reader skip to a range of documents or read the metadata columns alone.

    The texts are range-partitioned once, before encoding; rows that share an order value are spread by a hash of the text. A null
    text counts as empty, a null id is written first. Repeated rows are all written. Other columns are ignored. An empty table
    gives a table without rows.
    """
    keys = order_cols or [id_col]
    names = [f"_o{i}" for i in range(len(keys))]
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       *[F.col(c).alias(n) for c, n in zip(keys, names)]).withColumn("_h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(*names, "_h").sortWithinPartitions(*names, "_h", "text").select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, rows in _slices(batch.column("text")):
                piece = batch.slice(at, rows)
                ids, sizes = encoder(tokenizer_path).encode_column(piece.column("text"))
                ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
                ends = before + np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), part, np.int32)), piece.column("doc_id"), pa.array(ends - sizes),
                                                  pa.array(sizes), lists], names=["part", "doc_id", "local_start", "n_tokens", "tokens"])
                before = int(ends[-1])
        give_back()

    encoded = ordered.mapInArrow(work, "part int, doc_id bigint, local_start bigint, n_tokens bigint, tokens array<int>")
    writer = encoded.write.option("compression", "zstd").option("parquet.writer.version", "v2")
    for column in ("doc_id", "local_start", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.option("parquet.block.size", str(row_group_bytes)).option("parquet.page.row.count.limit", str(page_rows)).parquet(path)


def _starts(rows: DataFrame) -> DataFrame:
    """(part, before): ids in all earlier parts, from the metadata columns; as many rows as there were writing tasks."""
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return F.broadcast(sums.selectExpr("part", "sum(n) over (order by part) - n as before"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, tokens): the written rows with ``start``, the number of ids in all documents before."""
    rows = spark.read.parquet(path)
    return rows.join(_starts(rows), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "tokens")


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the written rows; ids count as little-endian unsigned 32-bit integers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            offsets = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crcs = pa.array([zlib.crc32(ids[i:j]) for i, j in zip(offsets, offsets[1:])], pa.int64())
            sizes = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), batch.column("local_start"), sizes, crcs],
                                             names=["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])
        give_back()

    rows = spark.read.parquet(path)
    digests = rows.select("part", "doc_id", "local_start", "tokens").mapInArrow(work, "part int, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint")
    return digests.join(_starts(rows), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
