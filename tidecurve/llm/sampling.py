"""Problem 3: a sample that follows target category shares, by swap repair.

Records are grouped by their category signature; only the counts of the
targeted signatures (at most one per row of the target table) and one count
for everything else reach the driver.

1. start: every category gives its floor, as far as it has records, and the
   rest of the sample is dealt at random over all remaining records;
2. repair: as long as some exchange of one block of records between two
   signatures lowers the summed deviation from the targets, the best such
   exchange is made.  Block sizes halve from n/2 to 1, so the number of
   exchanges is logarithmic in n times the number of categories.  A signature
   without enough records weighs a little more, so that the repair uses it up;
3. report: what a category still lacks after the repair is held against what
   the repair has left of its records;
4. materialise: of each signature the wanted number of records is drawn
   uniformly by a seeded hash.  Counts per hash cell tell the one cell in which
   a signature's draw ends; only the rows of that cell are ranked.

Defined results: a null in a category column is no category; such records
and those of untargeted categories fill the sample only where the targeted
ones are used up.  Null shares and floors count as 0.  An empty table gives an
empty sample and reports every category that asks for a record.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

#: Rows of a hash cell, and the most bits of the hash that name a cell.
CELL_ROWS, CELL_BITS = 4096, 16
#: Added weight of a signature that cannot meet its target.
SCARCE = 1e-6


def _deal(left: list[int], n: int, rng: random.Random) -> list[int]:
    """A uniform draw of ``n`` records without replacement, as counts per signature."""
    out, total = [0] * len(left), sum(left)
    for i, have in enumerate(left):
        if total <= 0 or n <= 0:
            break
        mean = n * have / total
        spread = (max(0.0, mean * (1 - have / total) * (total - n) / max(1, total - 1))) ** 0.5
        take = round(rng.gauss(mean, spread)) if i < len(left) - 1 else n
        take = min(have, n, max(take, n - (total - have), 0))
        out[i], n, total = take, n - take, total - have
    return out


def swap_repair(have: list[int], want: list[float], floors: list[int], n: int, seed: int = 0) -> list[int]:
    """Counts per signature: random and floor-satisfying, then repaired until no exchange helps."""
    rng = random.Random(seed)
    n = min(n, sum(have))
    base = [min(h, f) for h, f in zip(have, floors)]
    if sum(base) > n:  # the floors alone overflow the sample: serve them in proportion
        scale = n / sum(base)
        base = [int(b * scale) for b in base]
    drawn = _deal([h - b for h, b in zip(have, base)], n - sum(base), rng)
    counts = [b + d for b, d in zip(base, drawn)]
    block, weight = max(1, n // 2), [1 + SCARCE * (h < w) for h, w in zip(have, want)]
    while True:
        # exchange value: what one signature loses or wins in deviation for a block
        rows = list(enumerate(zip(counts, want, weight)))
        give = [(k * (abs(c - block - w) - abs(c - w)), i) for i, (c, w, k) in rows if c - block >= base[i]]
        take = [(k * (abs(c + block - w) - abs(c - w)), i) for i, (c, w, k) in rows if c + block <= have[i]]
        best = min(((g + t, i, j) for g, i in sorted(give)[:2] for t, j in sorted(take)[:2] if i != j), default=None)
        if best and best[0] < -1e-9:
            counts[best[1]] -= block
            counts[best[2]] += block
        elif block == 1:
            return counts
        else:
            block //= 2


def plan_sample(
    records: DataFrame, targets: DataFrame, signature: list[str], share: str, floor: str, fraction: float, seed: int = 0
) -> DataFrame:
    """One row per target category: records there, asked for, drawn, and whether it falls short.

    ``need`` is the larger of the floor and share x n, n being ``fraction`` of
    all records rounded down.  ``short`` marks categories whose repaired count
    lacks more than the repair has left of their records, so that no exchange
    can meet their target.  The row with null signature stands for all records
    outside the targeted categories.
    """
    spark = records.sparkSession
    wanted = targets.select(*[F.col(c).alias(f"s{i}") for i, c in enumerate(signature)],
                            F.coalesce(F.col(share), F.lit(0.0)).alias("share"),
                            F.coalesce(F.col(floor), F.lit(0)).cast("bigint").alias("floor"))
    keys = [f"s{i}" for i in range(len(signature))]
    counted = records.groupBy(*[F.col(c).alias(f"s{i}") for i, c in enumerate(signature)]).agg(F.count(F.lit(1)).alias("have"))
    total = counted.agg(F.coalesce(F.sum("have"), F.lit(0)).alias("total")).collect()[0]["total"]
    rows = wanted.join(counted, keys, "left").fillna(0, ["have"]).orderBy(*keys).collect()
    n = int(total * fraction + 1e-9)
    have, floors = [r["have"] for r in rows], [r["floor"] for r in rows]
    ask = [r["share"] * n for r in rows]
    need = [max(float(f), a) for f, a in zip(floors, ask)]
    counts = swap_repair([*have, total - sum(have)], [*need, 0.0], [*floors, 0], n, seed)
    out = [(*[r[k] for k in keys], r["share"], r["floor"], r["have"], q, c, q - c > r["have"] - c)
           for r, q, c in zip(rows, need, counts)]
    out.append((*[None] * len(keys), None, None, total - sum(have), 0.0, counts[-1], False))
    kinds = ", ".join(f"{c} {wanted.schema[k].dataType.simpleString()}" for c, k in zip(signature, keys))
    return spark.createDataFrame(out, f"{kinds}, share double, floor bigint, have bigint, need double, drawn bigint, short boolean")


def draw_sample(records: DataFrame, plan: DataFrame, signature: list[str], key: str, seed: int = 0) -> DataFrame:
    """The planned number of records of each signature, uniformly at random, whole rows."""
    spark = records.sparkSession
    keys = [f"_s{i}" for i in range(len(signature))]
    rows = plan.collect()  # one per target and one for the rest
    rest = sum(r["drawn"] for r in rows if all(r[c] is None for c in signature))
    asked = [(*[r[c] for c in signature], r["drawn"], g) for g, r in enumerate(rows) if all(r[c] is not None for c in signature)]
    kinds = ", ".join(f"{k} {plan.schema[c].dataType.simpleString()}" for c, k in zip(signature, keys))
    groups = spark.createDataFrame(asked, f"{kinds}, _asked bigint, _group bigint")
    bits = min(CELL_BITS, max(1, sum(r["have"] for r in rows) // CELL_ROWS).bit_length())
    marked = (
        records.select(F.struct("*").alias("row"), F.col(key).alias("key"), *[F.col(c).alias(k) for c, k in zip(signature, keys)])
        .join(F.broadcast(groups), keys, "left")  # one row per target
        .select("row", "key", F.coalesce("_group", F.lit(-1)).alias("group"), F.xxhash64(F.lit(seed), "key").alias("draw"))
        .withColumn("cell", F.shiftrightunsigned("draw", 64 - bits))
    )
    cells = marked.groupBy("group", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("group").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = F.coalesce(F.create_map(*[F.lit(v) for *_, n, g in asked for v in (g, n)] or [F.lit(-2), F.lit(0)])[F.col("group")], F.lit(rest))
    # every group's draw ends in one cell, of which so many rows are still wanted
    last = cells.select("group", "cell", (take - before).alias("wanted"), "n").where("wanted > 0").groupBy("group").agg(F.max_by(F.struct("cell", "wanted"), "cell").alias("l"))
    ends = F.broadcast(last.select("group", F.col("l.cell").alias("last"), F.col("l.wanted").alias("wanted")))  # one row per target
    taken = marked.join(ends, "group")
    nth = F.row_number().over(Window.partitionBy("group").orderBy("draw", "key"))
    partial = taken.where("cell = last").withColumn("nth", nth).where("nth <= wanted")
    return taken.where("cell < last").select("row.*").unionByName(partial.select("row.*"))
