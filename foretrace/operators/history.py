"""Features of each event computed from strictly earlier events of its entity.

Every feature reads a frame that ends one row before the current one, so the
event's own measurement can never leak into it. All features of a call share
one partitioning and one ordering: one shuffle, one sort. Many rolling means
are added up from shorter sums, in a second window over the same sort.

Hot entities. A window puts all rows of a key in one task. ``with_history``
therefore counts rows per key and handles any key above ``SPLIT_ROWS`` another
way: its rows are range-partitioned by (key, order) into even chunks, each
chunk receives copies of the few rows that precede it (the halo a bounded frame
can reach) and the running totals of the chunks before it. The result is the
same; no task ever sees more than a chunk. The side tables hold at most two
rows per chunk and are broadcast only if they are measured to be small.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretrace.session import bounded, pin

SPLIT_ROWS = 4_000_000
CHUNK_ROWS = 1_000_000
# A row this many half-lives back weighs 2**-64 of the newest: below double
# precision unless values differ by more than about 2**11 in size.
DECAY_HALF_LIVES = 64
# Decay weights grow to 2**(DECAY_BLOCK_HALF_LIVES) inside a block.
DECAY_BLOCK_HALF_LIVES = 512

# A second window over the same sort pays if it saves this many values added up at a row.
BLOCK_SAVES = 64
# Types whose mean Spark takes as a double.
_AS_DOUBLE = {"double", "float", "tinyint", "smallint", "int", "bigint"}

_CHUNK = "_chunk"
_HALO = "_halo"


@dataclass(frozen=True)
class Rolling:
    """Mean of ``source`` over the previous ``window`` rows.

    The window counts rows, not values: nulls (also those made by a mask inside
    ``source``) take a slot. Fewer than ``min_count`` values give null.
    """

    name: str
    source: str
    window: int
    min_count: int = 1


@dataclass(frozen=True)
class Decayed:
    """Exponentially weighted mean of all previous rows, by half-life in rows."""

    name: str
    source: str
    half_life: float


@dataclass(frozen=True)
class Total:
    """Sum of ``source`` over all previous rows, zero for the first row."""

    name: str
    source: str


@dataclass(frozen=True)
class Previous:
    """Value of ``source`` in the previous row."""

    name: str
    source: str


@dataclass(frozen=True)
class Recent:
    """Array of the non-null values of ``source`` in the previous ``window`` rows."""

    name: str
    source: str
    window: int


@dataclass(frozen=True)
class Latest:
    """Newest non-null value of ``source`` in any previous row, however far back."""

    name: str
    source: str


# ``source`` is SQL text: a wide family is one ``selectExpr`` call on the JVM
# rather than a dozen round trips per expression.
Feature = Rolling | Decayed | Total | Previous | Recent | Latest


def games_before(name: str = "games_played") -> Total:
    """How many events the entity had before this one."""
    return Total(name, "CAST(1 AS BIGINT)")


def with_history(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    features: Sequence[Feature],
    row_bound: int | DataFrame | None = None,
    split_rows: int | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Append ``features`` to ``df``; ``order`` must be total within a key.

    ``row_bound`` is a known upper limit of the row count (for instance from
    file footers); under ``split_rows`` it saves the counting job. It may also
    be a frame that has every key at least as often as ``df`` and is cheaper
    to count: a schedule bounds the facts derived from it.
    """
    split_rows = split_rows or SPLIT_ROWS
    chunk_rows = chunk_rows or CHUNK_ROWS
    keys, order = list(keys), list(order)
    counted = df
    if isinstance(row_bound, DataFrame):
        counted = row_bound if set(keys) <= set(row_bound.columns) else df
    elif row_bound is not None and row_bound <= split_rows:
        return _in_windows(df, keys, order, features)
    counts = counted.groupBy(*keys).count().where(F.col("count") > split_rows)
    summary = counts.agg(F.count("*").alias("n"), F.sum("count").alias("rows")).first()
    if not summary["n"]:
        return _in_windows(df, keys, order, features)
    # At most total_rows / split_rows keys can be hot.
    hot = counts.select(*keys)
    match = [F.col(f"d.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
    condition = match[0]
    for extra in match[1:]:
        condition = condition & extra
    left, right = df.alias("d"), bounded(hot).alias("h")
    calm = _in_windows(left.join(right, condition, "left_anti"), keys, order, features)
    chunks = max(2, math.ceil(summary["rows"] / chunk_rows))
    split = _in_chunks(left.join(right, condition, "left_semi"), keys, order, features, chunks)
    return calm.unionByName(split)


def _over(partition, order, frame: str = "") -> str:
    return f"OVER (PARTITION BY {', '.join(partition)} ORDER BY {', '.join(order)} {frame})"


BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _block_rows(windows: Sequence[int]) -> int:
    """How many rows a block sum covers, so that every window is a few whole blocks; the widest window: no blocks."""
    common, widest = math.gcd(*windows), max(windows)
    return min((d for d in range(common, 0, -1) if common % d == 0), key=lambda d: d + widest // d)


def _in_blocks(df, partition, order, features) -> tuple[DataFrame, dict[Rolling, str]]:
    """Block sums beside the rows of ``df``, and each rolling mean as an expression of them.

    A sliding frame is summed anew at every row. The sums and counts of a short
    block are therefore taken once, and a window adds up those of the blocks it
    is made of, read a whole number of blocks back. Nothing is ever subtracted,
    so one large or infinite value spoils no other window. Means that are not
    taken as doubles keep a frame of their own.
    """
    rolling = [f for f in features if isinstance(f, Rolling)]
    if sum(f.window for f in rolling) < BLOCK_SAVES:
        return df, {}
    types = [t for _, t in df.selectExpr(*[f"{f.source} AS _{i}" for i, f in enumerate(rolling)]).dtypes]
    rolling = [f for f, t in zip(rolling, types) if t in _AS_DOUBLE]
    if not rolling:
        return df, {}
    block = _block_rows([f.window for f in rolling])
    widest = {}
    for f in rolling:
        widest[f.source] = max(f.window, widest.get(f.source, 0))
    if sum(f.window for f in rolling) - sum(block + w // block - 1 for w in widest.values()) < BLOCK_SAVES:
        return df, {}
    place = {source: i for i, source in enumerate(widest)}
    over = _over(partition, order, f"ROWS BETWEEN {block} PRECEDING AND 1 PRECEDING")
    sums = [x for source, i in place.items() for x in (
        f"coalesce(sum(CAST({source} AS DOUBLE)) {over}, 0D) AS _s{i}_0", f"count({source}) {over} AS _n{i}_0")]
    back = [f"coalesce(lag(_{kind}{i}_0, {at}) {_over(partition, order)}, {zero}) AS _{kind}{i}_{at}"
            for source, i in place.items() for at in range(block, widest[source], block) for kind, zero in (("s", "0D"), ("n", "0L"))]
    out = df.selectExpr("*", *sums)
    out = out.selectExpr("*", *back) if back else out

    def mean(f: Rolling) -> str:
        total, n = (" + ".join(f"_{kind}{place[f.source]}_{at}" for at in reversed(range(0, f.window, block))) for kind in "sn")
        return f"CASE WHEN {n} >= {max(f.min_count, 1)} THEN ({total}) / ({n}) END"

    return out, {f: mean(f) for f in rolling}


def _weighted(partition, order, features, halo: bool, means: dict[Rolling, str]) -> list[str]:
    """Window expressions of every feature that needs no decay; ``means`` has those made of blocks."""
    out = []
    for f in features:
        if f in means:
            value = means[f]
        elif isinstance(f, Rolling):
            over = _over(partition, order, f"ROWS BETWEEN {f.window} PRECEDING AND 1 PRECEDING")
            value = f"avg({f.source}) {over}"
            if f.min_count > 1:
                value = f"CASE WHEN count({f.source}) {over} >= {f.min_count} THEN {value} END"
        elif isinstance(f, Total):
            own = f"CASE WHEN NOT {_HALO} THEN {f.source} END" if halo else f.source
            value = f"coalesce(sum({own}) {_over(partition, order, BEFORE)}, 0)"
        elif isinstance(f, Latest):
            own = f"CASE WHEN NOT {_HALO} THEN {f.source} END" if halo else f.source
            value = f"last({own}, true) {_over(partition, order, BEFORE)}"
        elif isinstance(f, Previous):
            value = f"lag({f.source}, 1) {_over(partition, order)}"
        elif isinstance(f, Recent):
            value = f"collect_list({f.source}) {_over(partition, order, f'ROWS BETWEEN {f.window} PRECEDING AND 1 PRECEDING')}"
        else:
            continue
        out.append(f"{value} AS {f.name}")
    return out


def _in_windows(df, keys, order, features) -> DataFrame:
    base = df.columns
    decayed = [f for f in features if isinstance(f, Decayed)]
    rows = _decay(df, keys, order, decayed) if decayed else df
    placed, means = _in_blocks(rows, keys, order, features)
    plain = _weighted(keys, order, features, False, means)
    if not decayed and not means:
        return df.selectExpr("*", *plain)
    over = _over(keys, order, BEFORE)
    kept = [f"`{c}`" for c in base]
    out = placed.selectExpr(*kept, *[f"last(_e_{f.name}, true) {over} AS {f.name}" for f in decayed], *plain)
    return out.select(*kept, *[f.name for f in features])


def _decay(df, partition, order, decayed) -> DataFrame:
    """Decayed mean *including* the current row, null where its value is null.

    The weights are powers of two that grow along the rows, so a running sum
    gives the mean in one pass. They would overflow on a long history, so rows
    are cut into blocks, each preceded by copies of the rows still in reach.
    """
    half_life = decayed[0].half_life
    if any(f.half_life != half_life for f in decayed):
        raise ValueError("one half-life per call")
    reach = math.ceil(DECAY_HALF_LIVES * half_life)
    block = max(reach, math.floor(DECAY_BLOCK_HALF_LIVES * half_life))
    base = df.columns
    numbered = df.selectExpr("*", f"row_number() {_over(partition, order)} - 1 AS _rn")
    blocks = (f"CASE WHEN _rn % {block} >= {block - reach} THEN array(_rn div {block}, _rn div {block} + 1) "
              f"ELSE array(_rn div {block}) END")
    weight = f"power(2.0D, (_rn - _block * {block}) / {float(half_life)}D)"
    placed = numbered.selectExpr("*", f"explode({blocks}) AS _block").selectExpr("*", f"{weight} AS _weight")
    over = _over([*partition, "_block"], ["_rn"], "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    values = [
        f"CASE WHEN {f.source} IS NOT NULL THEN sum(CAST({f.source} AS DOUBLE) * _weight) {over} / "
        f"sum(CASE WHEN {f.source} IS NOT NULL THEN _weight END) {over} END AS _e_{f.name}" for f in decayed
    ]
    return placed.selectExpr("*", *values).where(f"_block = _rn div {block}").select(
        *base, *[f"_e_{f.name}" for f in decayed])


def reach_of(features: Sequence[Feature]) -> int:
    """How many rows back the widest bounded frame reads."""
    far = 1
    for f in features:
        if isinstance(f, (Rolling, Recent)):
            far = max(far, f.window)
        elif isinstance(f, Decayed):
            far = max(far, math.ceil(DECAY_HALF_LIVES * f.half_life))
    return far


def _in_chunks(df, keys, order, features, chunks: int) -> DataFrame:
    """The same features for hot keys, chunk by chunk."""
    base = df.columns
    reach = reach_of(features)
    totals = [f for f in features if isinstance(f, Total)]
    latest = [f for f in features if isinstance(f, Latest)]
    decayed = [f for f in features if isinstance(f, Decayed)]
    # The checkpoint fixes the sampled range bounds: a lost executor re-reads it.
    rows = pin(
        df.repartitionByRange(chunks, *keys, *order).withColumn(_CHUNK, F.spark_partition_id())
    )
    by_chunk = [*keys, _CHUNK]
    line = Window.partitionBy(*keys).orderBy(_CHUNK)
    # One row per (key, chunk): ranges are contiguous, so at most one per chunk
    # plus one per key; both are bounded by the chunk and hot-key counts.
    sizes = rows.groupBy(*by_chunk).agg(
        F.count("*").alias("_n"),
        *[F.expr(f"sum({f.source})").alias(f"_t_{f.name}") for f in totals],
        *[F.expr(f"max_by({f.source}, CASE WHEN {f.source} IS NOT NULL THEN struct({', '.join(order)}) END)").alias(f"_t_{f.name}") for f in latest],
    )
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *by_chunk, "_n",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
        *[F.coalesce(F.sum(f"_t_{f.name}").over(earlier), F.lit(0)).alias(f"_b_{f.name}") for f in totals],
        *[F.last(f"_t_{f.name}", ignorenulls=True).over(earlier).alias(f"_b_{f.name}") for f in latest],
    )
    ahead = F.collect_list(F.struct(F.col(_CHUNK).alias("chunk"), F.col("_start").alias("start")))
    end = F.col("_start") + F.col("_n")
    sizes = pin(sizes.select(
        "*", ahead.over(line.rowsBetween(1, reach)).alias("_ahead"),
    ).withColumn("_ahead", F.filter("_ahead", lambda t: t["start"] - end < reach)))

    # Rows close enough to a chunk's end to be read from a later chunk.
    back = Window.partitionBy(*by_chunk).orderBy(*[F.desc(c) for c in order])
    tails = rows.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= reach)
    side = sizes.select(*by_chunk, end.alias("_end"), "_ahead").where(F.size("_ahead") > 0)
    halo = (
        tails.join(bounded(side), by_chunk)
        .select(*[c for c in base], F.col("_back"), F.col("_end"), F.explode("_ahead").alias("_to"))
        .where(F.col("_back") - 1 + F.col("_to.start") - F.col("_end") < reach)
        .select(*base, F.col("_to.chunk").alias(_CHUNK), F.lit(True).alias(_HALO))
    )
    placed = rows.select(*base, _CHUNK, F.lit(False).alias(_HALO)).unionByName(halo)
    if decayed:
        placed = _decay(placed, by_chunk, order, decayed)
    over = _over(by_chunk, order, BEFORE)
    local = [f"last(CASE WHEN NOT {_HALO} THEN _e_{f.name} END, true) {over} AS _l_{f.name}" for f in decayed]
    placed, means = _in_blocks(placed, by_chunk, order, features)
    out = placed.selectExpr("*", *_weighted(by_chunk, order, features, True, means), *local).where(~F.col(_HALO))
    carry = sizes.select(*by_chunk, *[f"_b_{f.name}" for f in [*totals, *latest]])
    if decayed:
        out = pin(out)
        newest = out.groupBy(*by_chunk).agg(*[
            F.max_by(f"_e_{f.name}", F.when(F.col(f"_e_{f.name}").isNotNull(), F.struct(*order))).alias(f"_c_{f.name}")
            for f in decayed
        ])
        newest = newest.select(*by_chunk, *[
            F.last(f"_c_{f.name}", ignorenulls=True).over(earlier).alias(f"_c_{f.name}") for f in decayed
        ])
        carry = carry.join(newest, by_chunk)
    if totals or latest or decayed:
        out = out.join(bounded(carry), by_chunk, "left")
    final = []
    for f in features:
        if isinstance(f, Total):
            final.append((F.col(f.name) + F.col(f"_b_{f.name}")).alias(f.name))
        elif isinstance(f, Latest):
            final.append(F.coalesce(f.name, f"_b_{f.name}").alias(f.name))
        elif isinstance(f, Decayed):
            final.append(F.coalesce(f"_l_{f.name}", f"_c_{f.name}").alias(f.name))
        else:
            final.append(F.col(f.name))
    return out.select(*base, *final)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group by ``order``.

    Spark keeps only ``n`` rows per group on the map side before the shuffle,
    so a hot group costs no more than a small one.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(w)).where(F.col("_row") <= n).drop("_row")


def tail_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], source: str, n: int, name: str) -> DataFrame:
    """Mean of the last ``n`` non-null values per key, the newest included."""
    newest = first_per_group(df.where(F.col(source).isNotNull()), keys, [F.desc(c) for c in order], n)
    return newest.groupBy(*keys).agg(F.avg(source).alias(name), F.count("*").alias(f"{name}_n"))


def snapshot_next(build, history: DataFrame, entities: DataFrame | None, entity: str,
                  order: Sequence[str], features: Sequence[str], fill: dict[str, Column] | None = None) -> DataFrame:
    """Features of every entity's *next* event.

    Appends one placeholder per entity after its last row, runs ``build`` (the
    function that makes the training rows) and returns the placeholders. An
    entity without history gets a row of nulls.
    """
    wanted = history.select(entity)
    if entities is not None:
        wanted = wanted.unionByName(entities.select(entity))
    late = {c: F.lit(2**31 - 1).cast(dict(history.dtypes)[c]) for c in order}
    blank = wanted.where(F.col(entity).isNotNull()).distinct().select(
        entity,
        *[late[c].alias(c) for c in order if c != entity],
        *[(fill or {})[c].alias(c) for c in (fill or {}) if c not in late],
        F.lit(True).alias("is_next"),
    )
    both = history.withColumn("is_next", F.lit(False)).unionByName(blank, allowMissingColumns=True)
    return build(both).where("is_next").select(entity, *features)
