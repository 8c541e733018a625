"""Whole-table verification by set reconciliation: work beyond two scans is in proportion to the differences.

Every row of both sides becomes an item: the hash of its key and the hash of its values. A sketch adds up the items in cells,
those of the source with plus, those of the copy with minus, so equal rows cancel wherever they lie. An item goes to one cell in
each of three tables; a cell that holds one item only shows it, the item is taken out of its other cells, and so on: the
difference is peeled off. Sums are plain additions that combine on the map side, so a scan shuffles at most the cells of a
task, never rows.

1. The first sketch samples items into strata (a half, a quarter, an eighth ...), each with cells of its own. If all of them can
   be peeled, the difference is known. Otherwise the sparsest strata tell how large it is.
2. A second sketch deals the items to parts of a size that can be peeled, as many as the estimate asks for. Parts are peeled
   independently; items of a part that does not peel are compared one by one.
3. Rows of the keys found, and only those, are read from both sides and compared key by key, which decides the result.

If the estimate is beyond ``max_differences``, the tables are compared by buckets, see :func:`verify_full`.
"""

from __future__ import annotations

import struct

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.functions.columns import quoted, resolve_key
from tablesync.functions.hashing import hash_words, text_columns, value_hash
from tablesync.functions.text import text_of
from tablesync.model import Key
from tablesync.operators.keyed import BROADCAST_BYTES, ROW_OVERHEAD
from tablesync.operators.verify import comparable_sides, compare_keys, verify_full
from tablesync.sinks.files import stage
from tablesync.sources.folders import fresh_folder

TABLES = 3
#: Cells of one table of a stratum and of a part; three tables of m cells peel up to about 2.4 m items.
STRATUM_CELLS, PART_CELLS = 32, 256
#: Items that a part should hold: far enough below what it can peel for uneven parts and an estimate that is too low.
PART_ITEMS = 320
STRATA = 32
#: Bits of the item's own hash that say its cell in each table.
CELL_BITS = 20
#: A sketch of this many differences has some 250,000 cells; that is what a task may shuffle.
MAX_DIFFERENCES = 100_000
_KEY, _ROW, _SIGN, _OWN = "__key_hash", "__row_hash", "__sign", "__own_hash"
WORDS = 4
_PEELED = "part int, key_hash long, row_hash long, n long"


def _items(src: DataFrame, dst: DataFrame, key: Key, float_scale: int | None) -> tuple[list[DataFrame], list[str], set[str]]:
    """Both sides with the hashes of every row and its sign, the columns compared, and those compared by text."""
    src, dst, cols = comparable_sides(src, dst, key)
    as_text, sides = text_columns(src, dst, cols), []
    for df, sign in ((src, 1), (dst, -1)):
        keys = [text_of(F.col(quoted(k)), df.schema[k].dataType) if k in as_text else F.col(quoted(k)) for k in resolve_key(dst, key)]
        hashed = df.withColumns({
            _KEY: F.xxhash64(*keys), _ROW: value_hash(df, cols, as_text, float_scale), _SIGN: F.lit(sign).cast("bigint"),
        })
        sides.append(hashed.withColumn(_OWN, F.xxhash64(_KEY, _ROW)))
    return sides, cols, as_text


def _stratum() -> Column:
    """Number of trailing zero bits of a hash of the item: half of the items in 0, a quarter in 1, and so on."""
    h = F.xxhash64(F.col(_OWN), F.lit(1)).bitwiseAND((1 << 62) - 1)
    return F.least(F.bit_count(h.bitwiseAND(-h) - 1), F.lit(STRATA - 1)).cast("int")


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64(F.col(_OWN), F.lit(2)), F.lit(parts)).cast("int")


def sketch(items: list[DataFrame], part: Column, cells: int) -> DataFrame:
    """Cells (part, cell, n, word sums) of both sides together that are not zero. Rows are added up before the shuffle."""
    parts = []
    for side in items:
        own = F.col(_OWN)
        places = F.array(*[
            (F.pmod(F.shiftrightunsigned(own, CELL_BITS * t).bitwiseAND((1 << CELL_BITS) - 1), F.lit(cells)) + t * cells).cast("int")
            for t in range(TABLES)
        ])
        words = [w for h in (_KEY, _ROW, _OWN) for w in hash_words(F.col(h))]
        parts.append(side.select(
            part.alias("part"), F.explode(places).alias("cell"), F.col(_SIGN).alias("n"),
            *[(w * F.col(_SIGN)).alias(f"w{i}") for i, w in enumerate(words)],
        ))
    sums = ["n", *[f"w{i}" for i in range(3 * WORDS)]]
    both = parts[0].unionByName(parts[1]).groupBy("part", "cell").agg(*[F.sum(s).alias(s) for s in sums])
    empty = F.lit(True)
    for s in sums:
        empty = empty & (F.col(s) == 0)
    return both.where(~empty)


def own_hash(key_hash: int, row_hash: int) -> int:
    """The hash Spark gives to the pair, as an unsigned number."""
    first = xxhash.xxh64_intdigest(struct.pack("<q", key_hash), 42)
    return xxhash.xxh64_intdigest(struct.pack("<q", row_hash), first)


def _from_words(words: list[int]) -> int:
    """A signed 64-bit number from its words of 21 bits."""
    value = sum(w << (21 * i) for i, w in enumerate(words))
    return value - (1 << 64) if value >= 1 << 63 else value


def _split(value: int) -> list[int]:
    return [((value % (1 << 64)) >> at) & ((1 << 21) - 1) for at in range(0, 64, 21)]


def single_item(sums: list[int]) -> tuple[int, int, int] | None:
    """(key hash, row hash, own hash) if a cell holds copies of one item only."""
    n, words = sums[0], sums[1:]
    if n == 0 or any(w % n for w in words):
        return None
    words = [w // n for w in words]
    if any(not 0 <= w < 1 << 21 for w in words) or any(words[i] > 1 for i in (WORDS - 1, 2 * WORDS - 1, 3 * WORDS - 1)):
        return None
    key_hash, row_hash = _from_words(words[:WORDS]), _from_words(words[WORDS : 2 * WORDS])
    own = own_hash(key_hash, row_hash)
    return (key_hash, row_hash, own) if _split(own) == words[2 * WORDS :] else None


def peel_cells(cells: dict[int, list[int]], size: int) -> tuple[list[tuple[int, int, int]], bool]:
    """(key hash, row hash, net number) of the items of one sketch, and whether nothing else is in it."""
    found, open_ = [], list(cells)
    while open_:
        at = open_.pop()
        sums = cells.get(at)
        item = single_item(sums) if sums else None
        if item is None:
            continue
        key_hash, row_hash, own = item
        n, words = sums[0], [*_split(key_hash), *_split(row_hash), *_split(own)]
        found.append((key_hash, row_hash, n))
        for t in range(TABLES):
            place = ((own >> (CELL_BITS * t)) & ((1 << CELL_BITS) - 1)) % size + t * size
            have = cells.get(place, [0] * (1 + 3 * WORDS))
            left = [have[0] - n, *[h - n * w for h, w in zip(have[1:], words, strict=True)]]
            if any(left):
                cells[place] = left
                open_.append(place)
            else:
                cells.pop(place, None)
        if len(found) > TABLES * size:  # a sketch holds fewer items than cells
            return found, False
    return found, not cells


def peeled(cells: DataFrame, size: int) -> DataFrame:
    """(part, key_hash, row_hash, n) of all items found; a part that does not peel has one more row without hashes."""

    def run(group: pa.Table) -> pa.Table:
        columns = [group[c].to_pylist() for c in group.column_names]
        held = {cell: list(sums) for _, cell, *sums in zip(*columns, strict=True)}
        part = columns[0][0]
        found, whole = peel_cells(held, size)
        rows = [(part, k, r, n) for k, r, n in found] + ([] if whole else [(part, None, None, None)])
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.Table.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["part", "key_hash", "row_hash", "n"]
        )

    return cells.groupBy("part").applyInArrow(run, _PEELED)


def _state(found: DataFrame) -> dict[int, tuple[int, bool]]:
    """Items and whether it peeled, by part: at most as many rows as parts."""
    counts = found.groupBy("part").agg(F.count("key_hash").alias("n"), F.count_if(F.col("key_hash").isNull()).alias("stuck"))
    return {r["part"]: (r["n"], r["stuck"] == 0) for r in counts.collect()}


def estimate(strata: dict[int, tuple[int, bool]]) -> tuple[int, bool]:
    """(number of differing items, whether all of them were found) from what the strata gave."""
    stuck = max((s for s, (_, whole) in strata.items() if not whole), default=-1)
    above = sum(n for s, (n, _) in strata.items() if s > stuck)
    # A stratum that does not peel holds about as many items as its cells, or more.
    return (above, True) if stuck < 0 else ((1 << (stuck + 1)) * max(above, 2 * STRATUM_CELLS), False)


def _differing_in_parts(items: list[DataFrame], part: Column, stuck: list[int]) -> DataFrame:
    """Key hashes of the items of some parts that the sides hold in different numbers."""
    rows = [side.where(part.isin(stuck)).select(_KEY, _ROW, _SIGN) for side in items]
    per_item = rows[0].unionByName(rows[1]).groupBy(_KEY, _ROW).agg(F.sum(_SIGN).alias("n"))
    return per_item.where("n <> 0").select(F.col(_KEY).alias("key_hash"))


def verify_sets(
    src: DataFrame,
    dst: DataFrame,
    key: Key,
    float_scale: int | None = None,
    max_differences: int = MAX_DIFFERENCES,
    part_items: int = PART_ITEMS,
    work: str | None = None,
) -> DataFrame:
    """Every key that differs: ``(key, status)``, the result of :func:`verify_full`, by set reconciliation.

    The sketches are built when this is called (one or two scans of both sides); the result reads both sides once more, for the
    keys found. Both sides should be stable tables. What is peeled is written under ``work``, which may be removed
    once the result was read.
    """
    spark = dst.sparkSession
    work = work or fresh_folder(spark, "reconcile")
    items, cols, as_text = _items(src, dst, key, float_scale)
    found = stage(peeled(sketch(items, _stratum(), STRATUM_CELLS), STRATUM_CELLS), f"{work}/strata", spark)
    differences, whole = estimate(_state(found))
    if not whole:
        if differences > max_differences:
            return verify_full(src, dst, key, float_scale=float_scale)
        parts = max(1, -(-differences * 5 // (4 * part_items)))
        found = stage(peeled(sketch(items, _part(parts), PART_CELLS), PART_CELLS), f"{work}/parts", spark)
        state = _state(found)
        differences = sum(n for n, _ in state.values())
        stuck = [p for p, (_, ok) in state.items() if not ok]
        keys = found.where(F.col("key_hash").isNotNull() & ~F.col("part").isin(stuck)).select("key_hash")
        if stuck:
            more = _differing_in_parts(items, _part(parts), stuck)
            keys = stage(keys.unionByName(more).distinct(), f"{work}/keys", spark)
            differences = keys.count()
    else:
        keys = found.select("key_hash")
    keys = keys.distinct().withColumnRenamed("key_hash", _KEY)
    if differences * (ROW_OVERHEAD + 8) <= BROADCAST_BYTES:
        keys = F.broadcast(keys)
    suspects = [side.join(keys, _KEY, "left_semi").select(*[quoted(c) for c in cols]) for side in items]
    return compare_keys(*suspects, key, cols, as_text, key_types={k: dst.schema[k].dataType for k in resolve_key(dst, key)}, float_scale=float_scale)
