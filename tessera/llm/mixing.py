"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only).

The documents of each source form blocks. A source with target weight w is due w blocks per slot of the mixture; when a
source is used up, the others share its weight, so its fluid curve F(t) is piecewise linear and all curves sum to t.
Block j is released when F passes j - 1 and must be placed before F reaches j. Earliest deadline first over these
windows places every block inside its window, so in every prefix of the mixture a source deviates from its fluid share
by less than one block. Nothing is repeated or dropped: each document has one position.

Blocks are sized so that there are at most max_blocks (plus one short block per source). That schedule is planned on the
driver from one count per source, in (blocks + sources) log sources; sources have numbers and are joined as a table. The
rank inside a source is built from hash bins, so a source with a third of all rows is spread over all tasks.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import sided, table, written_table

#: Blocks of the whole mixture, which bounds the schedule.
MAX_BLOCKS = 1 << 15
#: Target weights where none are given: the count of a source to this power.
TEMPERATURE = 0.5
#: Columns that the operator makes; those of the same name in its input are replaced.
_OWN = tuple(f"mix_{x}" for x in ("source_no", "block", "slot", "position", "rows", "first", "bin", "bins", "n", "before", "in", "rank", "name"))
#: Rows that a bin of a source has at most, on average.
BIN_ROWS = 4096


def fluid_time(blocks: Sequence[int], weights: Sequence[float]) -> Callable[[float], float]:
    """How many slots have passed when a source of weight 1 has got so many blocks: each has its weight's multiple then, or is used up."""
    ends = sorted((n / w, n, w) for n, w in zip(blocks, weights, strict=True) if n and w > 0)
    used, rate = [0.0], [math.fsum(w for _, _, w in ends)]
    for _, n, w in ends:
        used.append(used[-1] + n)
        rate.append(max(rate[-1] - w, 0.0))
    at = [x for x, _, _ in ends]

    def time(v: float) -> float:
        k = bisect_right(at, v)
        return used[k] + v * rate[k]

    return time


def fluid_windows(blocks: Sequence[int], weights: Sequence[float]) -> list[list[tuple[int, int]]]:
    """Release and deadline of every block of each source. Sources without weight come last, by their size."""
    weighted = [w if n else 0.0 for n, w in zip(blocks, weights, strict=True)]
    rest = [float(n) if w <= 0 else 0.0 for n, w in zip(blocks, weighted, strict=True)]
    first = float(sum(n for n, w in zip(blocks, weighted, strict=True) if w > 0))
    phases = ((fluid_time(blocks, weighted), weighted, 0.0), (fluid_time([int(n) for n in rest], rest), rest, first))
    out = []
    for s, n in enumerate(blocks):
        time, weight, begin = phases[weighted[s] <= 0]
        due = [begin] + [begin + time(j / weight[s]) for j in range(1, n + 1)]
        out.append([(math.floor(due[j] + 1e-6), math.ceil(due[j + 1] - 1e-6)) for j in range(n)])
    return out


def edf_schedule(blocks: Sequence[int], weights: Sequence[float]) -> list[tuple[int, int]]:
    """The source and its block of each slot."""
    windows = fluid_windows(blocks, weights)
    waiting = [(w[0][0], w[0][1], s, 0) for s, w in enumerate(windows) if w]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    order: list[tuple[int, int]] = []
    for slot in range(sum(blocks)):
        while waiting and (waiting[0][0] <= slot or not ready):
            _, due, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, j))
        _, s, j = heapq.heappop(ready)
        order.append((s, j))
        if j + 1 < len(windows[s]):
            release, due = windows[s][j + 1]
            heapq.heappush(waiting, (max(release, slot + 1), due, s, j + 1))
    return order


def mix_positions(docs: DataFrame, weights: Mapping[str | None, float] | None = None, max_blocks: int = MAX_BLOCKS, temperature: float = TEMPERATURE) -> DataFrame:
    """docs with columns mix_source_no, mix_block, mix_slot, mix_position added (columns of docs named mix_... are replaced).

    weights: target weight by source; where none are given, the source's count to the power temperature. A source without
    a weight follows when the weighted ones are used up. Inside a source the order is by a hash of doc_id and text, then
    doc_id: repeated rows get a position each. A null source is a source, a null doc_id comes first among equal hashes.
    Positions are 0 to the number of rows - 1. An empty table gives an empty result.
    """
    docs = docs.drop(*_OWN)
    spark = docs.sparkSession
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    sources = docs.groupBy(name.alias("mix_name")).agg(F.count("*").alias("mix_n"))
    sources = sources.withColumn("mix_source_no", F.row_number().over(Window.orderBy("mix_name")) - 1).withColumn("mix_bins", F.ceil(F.col("mix_n") / BIN_ROWS))
    sources = written_table(sources, "sources")
    listed = sorted((r["mix_source_no"], r["mix_name"], r["mix_n"]) for r in sources.collect())
    counts = [n for _, _, n in listed]
    if weights is None:
        target = [float(n) ** temperature for n in counts]
    else:
        given = {"null" if s is None else f"={s}": float(w) for s, w in weights.items()}
        target = [given.get(x, 0.0) for _, x, _ in listed]
    size = max(1, -(-sum(counts) // max_blocks))

    # The schedule, at most max_blocks + sources rows, as text: source, block and first position of each slot.
    written, position = [], 0
    for s, j in edf_schedule([-(-n // size) for n in counts], target):
        written.append(f"{s} {j} {position}")
        position += min(size, counts[s] - j * size)
    slots = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(written)), ",")).alias("mix_slot", "mix_rows")).where("mix_rows <> ''")
    part = F.split("mix_rows", " ")
    slots = slots.select(part[0].cast("int").alias("mix_source_no"), part[1].cast("long").alias("mix_block"), F.col("mix_slot").cast("long").alias("mix_slot"), part[2].cast("long").alias("mix_first"))

    # Ranks inside a source: bins of its hash, then the rank inside the bin.
    key = F.xxhash64("doc_id", "text") if "text" in docs.columns else F.xxhash64("doc_id")
    rows = docs.withColumn("mix_name", name).join(sided(sources.select("mix_name", "mix_source_no", "mix_bins")), "mix_name").withColumn("mix_bin", F.pmod(key, "mix_bins"))
    offsets = rows.groupBy("mix_source_no", "mix_bin").agg(F.count("*").alias("mix_n"))
    offsets = offsets.withColumn("mix_before", F.sum("mix_n").over(Window.partitionBy("mix_source_no").orderBy("mix_bin")) - F.col("mix_n")).drop("mix_n")
    inside = Window.partitionBy("mix_source_no", "mix_bin").orderBy(key, "doc_id")
    ranked = rows.withColumn("mix_in", F.row_number().over(inside) - 1).join(offsets, ["mix_source_no", "mix_bin"]).withColumn("mix_rank", F.col("mix_before") + F.col("mix_in"))
    ranked = ranked.withColumn("mix_block", F.floor(F.col("mix_rank") / size).cast("long"))
    placed = ranked.join(sided(slots), ["mix_source_no", "mix_block"])
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], "mix_source_no", "mix_block", "mix_slot", (F.col("mix_first") + F.pmod("mix_rank", F.lit(size))).alias("mix_position"))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, max_blocks: int = MAX_BLOCKS, temperature: float = TEMPERATURE) -> DataFrame:
    """docs, all rows and the same columns, in the order of the mixture: partitions are ranges of it and sorted."""
    placed = mix_positions(docs, weights, max_blocks, temperature)
    return placed.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mix_positions(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return placed.select("doc_id", "source", F.col("mix_block").alias("block"), F.col("mix_slot").alias("slot"), F.col("mix_position").alias("position"))
