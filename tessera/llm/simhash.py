"""SimHash fingerprints of word shingles and groups of fingerprints that differ in few bits (pigeonring filter)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.graph import components
from tessera.llm.memory import give_back
from tessera.session import pin

#: Seed of the shingle hash.
SEED = 42
#: Shingle hashes whose bits are counted at a time, so that a very long text needs no more memory than this.
BLOCK = 1 << 15


def fingerprint(raw: bytes | None, shingle: int) -> int:
    """Signed 64-bit majority fingerprint: words are cut at ASCII white space, A-Z is lower-cased; no words give zero."""
    words = (raw or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(words) - size + 1], ends[size - 1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        cuts = zip(starts[at:at + BLOCK].tolist(), ends[at:at + BLOCK].tolist())
        hashes = np.array([digest(joined[i:j], SEED) for i, j in cuts], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp) per row; a null text counts as empty."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(1)
            fps = pa.array((fingerprint(raws[i].as_py(), shingle) for i in range(len(raws))), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["id", "fp"])
        give_back()

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, fp bigint")


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``max_bits + 1`` even segments of the ring of 64 bits."""
    cuts = [64 * i // (max_bits + 1) for i in range(max_bits + 2)]
    return [(i, j - i) for i, j in zip(cuts, cuts[1:])]


def _part(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND((1 << width) - 1)


def _ring_keys(fp: Column, max_bits: int, flips: bool) -> Column:
    """Array of (segment, key): the segment's bits and the next segment's, with ``flips`` also with each of its bits turned."""
    parts, out = _segments(max_bits), []
    for i, (at, width) in enumerate(parts):
        at2, width2 = parts[(i + 1) % len(parts)]
        key = F.shiftleft(_part(fp, at, width), width2).bitwiseOR(_part(fp, at2, width2))
        turned = [0, *(1 << bit for bit in range(width2))] if flips else [0]
        out += [F.struct(F.lit(i).alias("seg"), key.bitwiseXOR(F.lit(t).cast("bigint")).alias("key")) for t in turned]
    return F.array(*out)


def _chain(diff: Column, seg: Column, max_bits: int) -> Column:
    """True if from ``seg`` on every chain of n consecutive segments differs in at most ``n * max_bits / (max_bits + 1)`` bits."""
    parts = _segments(max_bits)
    counts = [F.bit_count(_part(diff, at, width)) for at, width in parts]
    test = F.lit(False)
    for i in range(len(parts)):
        total, fits = F.lit(0), F.lit(True)
        for n in range(1, len(parts) + 1):
            total = total + counts[(i + n - 1) % len(parts)]
            fits = fits & (total <= n * max_bits // (max_bits + 1))
        test = test | ((seg == i) & fits)
    return test


def _close_by_points(fps: DataFrame) -> DataFrame:
    """Edges that connect all fingerprints within one bit of a common point, hence within two bits of each other.

    At most 65 fingerprints lie within one bit of a point, so a group is bounded; each is linked to the smallest one, no pairs
    are listed.
    """
    points = F.array(*[F.col("fp").bitwiseXOR(F.lit(v).cast("bigint")) for v in [0, *(1 << b for b in range(63)), -(1 << 63)]])
    seen = (fps.select("fp", F.explode(points).alias("point")).groupBy("point")
            .agg(F.min("fp").alias("a"), F.max("fp").alias("_most"), F.collect_list("fp").alias("all")).where("a <> _most"))
    return seen.select("a", F.explode("all").alias("b"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) per row; rows link if their fingerprints differ in at most ``max_bits`` bits.

    1. Rows are reduced to their different fingerprints with the smallest id, so copies cost nothing further.
    2. With two or more bits allowed, fingerprints near a common point are linked in stars; this contracts dense groups.
    3. Pigeonring: the ring of 64 bits is cut in ``max_bits + 1`` segments. If two fingerprints differ in at most ``max_bits``
       bits, some segment starts a chain whose first n segments differ in at most ``n - 1`` bits for every n. So a segment must
       be equal and the next one within one bit: this is the join key; then the longer chains and the whole distance are
       checked. Only fingerprints of groups not yet connected meet, and only links between groups are kept.
    4. Components over the links.

    Tables that grow with the rows meet in sorted joins; none of them goes through the driver.

    A null or empty text has fingerprint zero and links like any other. A null id keeps its row; the smallest id of a
    component ignores nulls. Repeated rows stay. Other columns are ignored. An empty table gives an empty result.
    """
    if not 0 <= max_bits <= 31:
        raise ValueError("max_bits must be between 0 and 31")
    rows = pin(fingerprints(docs, id_col, text_col, shingle))
    firsts = pin(rows.groupBy("fp").agg(F.min("id").alias("first")))
    fps = firsts.select("fp")
    grouped = fps.withColumn("part", F.col("fp"))
    if max_bits >= 2:
        near = components(_close_by_points(fps)).select(F.col("node").alias("fp"), F.col("root"))
        grouped = pin(fps.join(near, "fp", "left").select("fp", F.coalesce("root", "fp").alias("part")))
    labels = grouped
    if max_bits >= 1:
        def keyed(flips: bool) -> DataFrame:
            return grouped.select("fp", "part", F.explode(_ring_keys(F.col("fp"), max_bits, flips)).alias("k")).select("fp", "part", "k.seg", "k.key")

        # Spark takes keys after an explode for no more rows than before and would send them to every task
        base = keyed(False).select("seg", "key", F.col("fp").alias("fp2"), F.col("part").alias("part2")).hint("merge")
        parts = base.select("seg", "key", "part2").distinct().hint("merge")
        met = keyed(True).join(parts, ["seg", "key"]).where("part <> part2")
        diff = F.col("fp").bitwiseXOR(F.col("fp2"))
        links = (met.join(base, ["seg", "key", "part2"]).where(_chain(diff, F.col("seg"), max_bits) & (F.bit_count(diff) <= max_bits))
                 .select(F.least("part", "part2").alias("a"), F.greatest("part", "part2").alias("b")))
        joined = components(links).select(F.col("node").alias("part"), F.col("root"))
        labels = grouped.join(joined, "part", "left").select("fp", F.coalesce("root", "part").alias("part"))
    named = labels.join(firsts.hint("merge"), "fp")
    smallest = named.groupBy("part").agg(F.min("first").alias("component_id"))
    found = named.join(smallest, "part").select("fp", "component_id")
    return rows.hint("merge").join(found, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
