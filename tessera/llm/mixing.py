"""Interleaving of sources by target weight: Pfair release times and deadlines, earliest deadline first."""

from __future__ import annotations

import heapq
import json
from fractions import Fraction

from pyspark.sql import DataFrame, functions as F


def quotas(weights: dict[int, float], frame: int) -> dict[int, int]:
    """Slots per frame of each stream, at least one each, by largest remainder; they add up to ``frame``."""
    total = sum(weights.values())
    free = frame - len(weights)
    exact = {s: free * Fraction(w) / Fraction(total) for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: frame - sum(out.values())]:
        out[s] += 1
    return out


def schedule(slots: dict[int, int]) -> dict[int, list[int]]:
    """Slots of each stream's blocks in one frame.

    Block k of a stream with quota a in a frame of H is released at floor(k H / a) and due at ceil((k + 1) H / a); among
    the released blocks the one due first runs. Every block runs inside its window, so a stream is never a whole block
    ahead of or behind its share.
    """
    size = sum(slots.values())
    waiting = sorted(((k * size // a, -(-(k + 1) * size // a), s) for s, a in slots.items() for k in range(a)), reverse=True)
    out: dict[int, list[int]] = {s: [] for s in slots}
    ready: list[tuple[int, int]] = []
    for t in range(size):
        while waiting and waiting[-1][0] <= t:
            heapq.heappush(ready, waiting.pop()[1:])
        due, s = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a block missed its deadline")
        out[s].append(t)
    return out


def plan(rows: dict[int, int], weights: dict[int, float], block: int, frame: int) -> list[dict]:
    """Stretches of the schedule: while the same streams have blocks left, one frame is repeated.

    A stretch ends with the last block of the first stream that runs out; the others go on with their weights scaled up.
    """
    left = {s: -(-n // block) for s, n in rows.items() if n and s in weights}
    done, start, gaps, out = dict.fromkeys(left, 0), 0, 0, []
    while left:
        share = quotas({s: weights[s] for s in left}, max(frame, 2 * len(left)))
        size, places = sum(share.values()), schedule(share)
        ends = {s: (n - 1) // share[s] * size + places[s][(n - 1) % share[s]] + 1 for s, n in left.items()}
        last = min(ends, key=ends.get)
        full, rest = divmod(ends[last], size)
        for s in left:
            served = full * share[s] + sum(p < rest for p in places[s])
            out.append({"s": s, "from": done[s], "upto": done[s] + served, "quota": share[s], "size": size, "start": start, "gaps": gaps,
                        "places": places[s]})
            done[s] += served
        left = {s: n for s in left if (n := -(-rows[s] // block) - done[s])}
        start += ends[last]
        gaps += -rows[last] % block
    return out


def mix(docs: DataFrame, weights: dict[str, float], rest: float, id_col: str = "doc_id", source_col: str = "source", block: int = 16,
        frame: int = 1000, classes: int = 1024) -> DataFrame:
    """All rows with ``mix_slot`` and ``mix_position`` (0 to n - 1), their place in the interleaved order.

    ``weights`` gives each named source its share of the order and ``rest`` that of all other sources and rows without one, which form
    one stream. A stream's rows are ordered by a hash of the id and cut in blocks of ``block`` rows; one block fills one slot.
    Shares are rounded to 1 / ``frame``. While the same streams have rows left, each is less than one block off its
    share at every slot; no row is dropped or repeated, a stream that ends leaves its share to the others.

    The number of a row in its stream comes from numbers in ``classes`` hash classes of the stream, so a source with a third of all
    rows is spread over that many groups. The driver sees one count per stream, and the schedule sent to the tasks has at most
    ``(streams ** 2)`` rows. A null id is hashed like any other, rows that share an id are ordered by a
    hash of the whole row, so a task that runs again numbers them alike (rows that are wholly equal are interchangeable). Columns named ``mix_slot`` and ``mix_position`` are replaced. An empty table stays empty.
    """
    if any(w <= 0 for w in weights.values()) or rest <= 0:
        raise ValueError("weights must be positive")
    names = {source: i for i, source in enumerate(sorted(weights))}
    shares = {**{i: weights[source] for source, i in names.items()}, len(names): rest}
    docs = docs.drop("mix_slot", "mix_position")
    own = [f.name for f in docs.schema if "map" not in f.dataType.simpleString()]
    number = F.lit(len(names))
    for source, i in names.items():
        number = F.when(F.col(source_col) == source, i).otherwise(number)
    keyed = docs.withColumn("_s", number).withColumn("_h", F.xxhash64(F.col(id_col).cast("string"))).withColumn("_c", F.pmod("_h", F.lit(classes)))
    keyed = keyed.withColumn("_o", F.xxhash64(*own))
    counts = keyed.groupBy("_s", "_c").agg(F.count(F.lit(1)).alias("_n"))
    rows = {r["_s"]: r["n"] for r in counts.groupBy("_s").agg(F.sum("_n").alias("n")).collect()}
    stretches = plan(rows, shares, block, frame)
    if not stretches:
        return docs.withColumn("mix_slot", F.lit(0).cast("bigint")).withColumn("mix_position", F.lit(0).cast("bigint"))
    before = counts.selectExpr("_s as _s2", "_c as _c2", "sum(_n) over (partition by _s order by _c) - _n as _before")
    kind = "array<struct<s:int,`from`:bigint,upto:bigint,quota:bigint,size:bigint,start:bigint,gaps:bigint,places:array<int>>>"
    table = docs.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(stretches)), kind)).alias("_p"))
    numbered = (keyed.selectExpr("*", "row_number() over (partition by _s, _c order by _h, _o) - 1 as _i")
                .join(before, (F.col("_s") == F.col("_s2")) & (F.col("_c") == F.col("_c2")))
                .withColumn("_i", F.col("_i") + F.col("_before")).withColumn("_k", F.floor(F.col("_i") / block)))
    placed = numbered.join(F.broadcast(table), (F.col("_s") == F.col("_p.s")) & (F.col("_k") >= F.col("_p.from")) & (F.col("_k") < F.col("_p.upto")))
    j = F.col("_k") - F.col("_p.from")
    slot = F.col("_p.start") + F.floor(j / F.col("_p.quota")) * F.col("_p.size") + F.element_at("_p.places", ((j % F.col("_p.quota")) + 1).cast("int"))
    placed = placed.withColumn("mix_slot", slot.cast("bigint"))
    return placed.withColumn("mix_position", (F.col("mix_slot") * block + F.col("_i") % block - F.col("_p.gaps")).cast("bigint")).select(
        *[placed[c] for c in docs.columns], "mix_slot", "mix_position")
