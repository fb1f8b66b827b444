"""Fill-in-the-middle: documents cut at token borders and put in another order, with chunk counts kept by content."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: A token is a run of ASCII letters or any other single character.
RUNS = re.compile("[A-Za-z]+")
TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")
#: Marks of the output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Characters of the rolling window (a power of two) and bits of its hash that are zero at a border: chunks of about 512 characters.
WINDOW, BITS = 16, 9
FACTOR = np.uint32(2654435769)
#: Chunks in each of the two generations that a Python worker keeps, and the longest one it keeps.
MEMO, LONGEST = 50_000, 4096


def chunk_ends(text: str) -> list[int]:
    """Ends of the chunks of a text. A border follows each window of ``WINDOW`` characters whose polynomial hash has ``BITS``
    leading zeros, unless the window before it has so too: copies of a passage are cut alike wherever they stand."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if len(codes) <= WINDOW:
        return [len(codes)] if len(codes) else []
    rolling, width, factor = codes + np.uint32(1), 1, FACTOR
    with np.errstate(over="ignore"):
        while width < WINDOW:
            rolling = rolling[:-width] * factor + rolling[width:]
            width, factor = 2 * width, factor * factor
        zero = (rolling * FACTOR) >> np.uint32(32 - BITS) == 0
    zero[1:] &= ~zero[:-1]
    ends = (np.flatnonzero(zero) + WINDOW).tolist()
    return ends if ends and ends[-1] == len(codes) else [*ends, len(codes)]


class ChunkCounts:
    """Token counts of chunks, kept by the chunk's whole content, in two generations of bounded size.

    A summary is (tokens, whether the first character is a letter, whether the last one is): where a letter meets a letter
    at a border, the two chunks share a token, which belongs to the earlier one.
    """

    def __init__(self) -> None:
        self.memo: dict[str, tuple[int, bool, bool]] = {}
        self.older: dict[str, tuple[int, bool, bool]] = {}

    def summary(self, chunk: str) -> tuple[int, bool, bool]:
        found = self.memo.get(chunk) or self.older.get(chunk)
        if not found:
            found = len(RUNS.sub("a", chunk)), bool(RUNS.match(chunk)), bool(RUNS.match(chunk[-1]))
        if len(chunk) <= LONGEST:
            self.memo[chunk] = found
            if len(self.memo) > MEMO:
                self.older, self.memo = self.memo, {}
        return found

    def cuts(self, text: str, h1: int, h2: int) -> tuple[int, int, int]:
        """(n, first, second): tokens of the text, and the offsets at which its prefix and its middle end."""
        chunks, starts, before, goes_on, total, open_word, at = [], [], [], [], 0, False, 0
        for end in chunk_ends(text):
            chunk = text[at:end]
            count, first, last = self.summary(chunk)
            shared = open_word and first
            chunks.append(chunk)
            starts.append(at)
            before.append(total)
            goes_on.append(shared)
            total, open_word, at = total + count - shared, last, end
        units = sorted((h1 % (total + 1), h2 % (total + 1)))
        return total, *(self._offset(u, total, len(text), chunks, starts, before, goes_on) for u in units)

    @staticmethod
    def _offset(unit: int, total: int, size: int, chunks: list[str], starts: list[int], before: list[int], goes_on: list[bool]) -> int:
        """Where the token number ``unit`` begins: only the chunk that holds this begin is cut into tokens."""
        if unit == total:
            return size
        i = int(np.searchsorted(before, unit, "right")) - 1
        skip = unit - before[i] + goes_on[i]
        return starts[i] + sum(map(len, TOKEN.findall(chunks[i])[:skip]))


@cache
def chunk_counts() -> ChunkCounts:
    """The worker's counts; they go from task to task."""
    return ChunkCounts()


def _group(id_col: str, k: int) -> Column:
    """The k-th group of eight hex digits of the hash of the id, as a number."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("bigint")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every whole text.

    n counts the tokens; the id's hash says which token borders end the prefix and the middle, and the form: ``plain`` (the
    text as it is: empty, holding a mark, or one in ten), ``spm`` (one in five of the others) or ``psm``. Lengths count
    code points and are null for ``plain``. Null texts count as empty; a null id hashes like an empty one, so repeated and
    null ids give each row its result. Rows are independent: there are no ties, other columns are ignored, and an empty table
    gives an empty one. Very long texts take one pass and the memory of four bytes a character.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), _group(id_col, 1).alias("h1"), _group(id_col, 2).alias("h2"))
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = chunk_counts()
        for batch in batches:
            cuts = [counts.cuts(t, a, b) for t, a, b in zip(*(batch.column(c).to_pylist() for c in ("text", "h1", "h2")))]
            n, first, second = (pa.array([c[i] for c in cuts], pa.int64()) for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), n, first, second], names=["id", "text", "n", "a", "b"])

    cut = rows.mapInArrow(work, f"id {kind}, text string, n bigint, a bigint, b bigint")
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("text") == "") | marked | (_group("id", 3) % 100 >= 90), "plain").when(_group("id", 4) % 100 < 20, "spm").otherwise("psm")
    a, b = F.col("a").cast("int"), F.col("b").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), a), F.substring("text", a + 1, b - a), F.substring("text", b + 1, F.length("text"))
    output = (F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
              .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)))
    moved = F.col("form") != "plain"
    return cut.withColumn("form", form).select(F.col("id").alias(id_col), "n", "form", F.when(moved, F.col("a")).alias("prefix_chars"),
                                               F.when(moved, F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made from: no part holds a mark, so the marks cut it in its parts."""
    parts = F.split(output, "<[PSM]>", -1)
    return (F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .otherwise(F.concat(parts[2], parts[3], parts[1])))
