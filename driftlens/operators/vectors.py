"""Similarity of target embeddings between quarters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quarters import to_string

KEY = ("company", "q_int")
MAINTAINED, REPHRASED = 0.65, 0.40


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda a, x: a + x * x))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    # the length is bound once and not computed for each element
    lengths = F.transform(F.array(norm(v)), lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n))
    return F.element_at(F.transform(lengths, lambda n: F.transform(_doubles(v), lambda x: x / n)), 1)


#: Vectors of a block at about most; larger groups are cut into several.
TILE = 512
#: Pairs that leave a task at once.
STEP_PAIRS = 100_000


def moved_ahead(vectors: DataFrame, lag: int = 4, window: int | None = None) -> DataFrame:
    """Vectors with the quarters that they are held against, ``lag`` or 1 to ``window`` after their own, as ``q_int``; their own is ``from_q``."""
    ahead = F.explode(F.sequence(F.col("q_int") + 1, F.col("q_int") + window)) if window else F.col("q_int") + lag
    return vectors.withColumn("from_q", F.col("q_int")).withColumn("q_int", ahead)


def blocks(vectors: DataFrame, name: str, extra: list[str] = (), tile: int = TILE) -> DataFrame:
    """company, q_int and ``name``: the vectors of a company's quarter as one array of (idx, v, extra), or as several of about ``tile`` each.

    Null vectors are left out. Only groups of over ``tile`` vectors, if there are any, take part in the join that cuts them.
    """
    v = vectors.where("v is not null").select(*KEY, "idx", _doubles(F.col("v")).alias("v"), *extra)
    cut = v.groupBy(*KEY).agg(F.ceil(F.count(F.lit(1)) / tile).alias("__tiles")).where("__tiles > 1")
    at = F.pmod(F.xxhash64("idx"), F.coalesce("__tiles", F.lit(1)))
    return v.join(cut, list(KEY), "left").groupBy(*KEY, at.alias("__tile")).agg(F.collect_list(F.struct("idx", "v", *extra)).alias(name)).drop("__tile")


def _unit_rows(values: pa.Array, n: int) -> np.ndarray:
    m = values.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    length = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(length == 0, 1.0, length)[:, None]


def _multiplied(pick: Callable, names: list[tuple[str, str]]):
    """Over rows of two blocks, ``cur`` and ``hist``: the pairs that ``pick`` takes from their matrix of similarities.

    ``names`` are output columns after those of KEY and ``sim``: (side, field of its block).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = {s: (b.column(s).flatten(), b.column(s).offsets.to_numpy()) for s in ("cur", "hist")}
            held: list[tuple[np.ndarray, ...]] = []
            n = 0
            for r in range(b.num_rows):
                (cur, c), (hist, h) = sides["cur"], sides["hist"]
                x = cur.field("v")[c[r] - c[0] : c[r + 1] - c[0]]
                y = hist.field("v")[h[r] - h[0] : h[r + 1] - h[0]]
                ids = cur.field("idx")[c[r] - c[0] : c[r + 1] - c[0]].to_numpy(zero_copy_only=False)
                i, j, sim = pick(_unit_rows(x, len(x)) @ _unit_rows(y, len(y)).T, ids)
                held.append((np.full(len(i), r), i + (c[r] - c[0]), j + (h[r] - h[0]), sim))
                n += len(i)
                if n >= STEP_PAIRS or r == b.num_rows - 1:
                    row, i, j, sim = (np.concatenate(x) for x in zip(*held))
                    for at in range(0, len(row), STEP_PAIRS):
                        part = slice(at, at + STEP_PAIRS)
                        rows = {"cur": pa.array(i[part]), "hist": pa.array(j[part])}
                        cols = [b.column(k).take(pa.array(row[part])) for k in KEY] + [pa.array(sim[part])]
                        yield pa.RecordBatch.from_arrays(cols + [sides[s][0].field(f).take(rows[s]) for s, f in names], [*KEY, "sim", *(f"{s}_{f}" for s, f in names)])
                    held, n = [], 0

    return run


def _all_pairs(sims: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = sims.shape
    return np.repeat(np.arange(n), m), np.tile(np.arange(m), n), sims.ravel()


def _best_of_each(sims: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best current vector of each historical one, the one with the smallest idx of those equal to nine places."""
    order = np.argsort(ids, kind="stable")
    j = np.arange(sims.shape[1])
    i = order[np.argmax(np.round(sims[order], 9), axis=0)]
    return i, j, sims[i, j]


def _held_against(current: DataFrame, history: DataFrame, pick: Callable, names: list[tuple[str, str]]) -> DataFrame:
    """Blocks of a call's vectors with those of the history moved ahead to it, multiplied as matrices."""
    both = current.join(history, list(KEY))
    kinds = {"cur": dict(_fields(current, "cur")), "hist": dict(_fields(history, "hist"))}
    own = dict(both.dtypes)
    schema = ", ".join([*(f"{k} {own[k]}" for k in KEY), "sim double", *(f"{s}_{f} {kinds[s][f]}" for s, f in names)])
    return both.mapInArrow(_multiplied(pick, names), schema)


def _fields(df: DataFrame, column: str) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema[column].dataType.elementType.fields]


_IDS = [("cur", "idx"), ("hist", "idx")]


def pair_similarities(vectors: DataFrame, lag: int = 4, window: int | None = None, tile: int = TILE) -> DataFrame:
    """(company, q_int, cur_idx, hist_idx, sim) of each call's targets with those ``lag`` quarters, or 1 to ``window`` quarters, before.

    History is moved forward to the call, so that the join is on company and quarter; it moves blocks of vectors, not
    pairs, and each two blocks are multiplied where they meet. A zero vector is 0 alike to all; null vectors have no pairs.
    """
    both = _held_against(blocks(vectors, "cur", tile=tile), blocks(moved_ahead(vectors, lag, window), "hist", tile=tile), _all_pairs, _IDS)
    return both.select(*KEY, "cur_idx", "hist_idx", "sim")


def best_matches(vectors: DataFrame, lag: int = 4, window: int | None = None, tile: int = TILE) -> DataFrame:
    """The rows of :func:`pair_similarities` that :func:`continuity` needs: of each two blocks the best current target of each historical one."""
    both = _held_against(blocks(vectors, "cur", tile=tile), blocks(moved_ahead(vectors, lag, window), "hist", tile=tile), _best_of_each, _IDS)
    return both.select(*KEY, "cur_idx", "hist_idx", "sim")


def pair_log(vectors: DataFrame, maintained: float = MAINTAINED, rephrased: float = REPHRASED, lag: int = 4, window: int | None = None, name: str = "name", tile: int = TILE) -> DataFrame:
    """All pairs with labels to read: company, q_int, cur_idx, hist_idx, current_label, historical_label, similarity, label, is_best.

    ``label`` is what becomes of the historical target, ``is_best`` whether this pair decides it. Both are found from
    the best matches first and go along with the historical blocks, so that the pairs themselves are never exchanged.
    ``idx`` sets targets of one name apart.
    """
    told = continuity(best_matches(vectors, lag, window, tile), maintained, rephrased).select(*KEY, F.col("hist_idx").alias("idx"), F.col("cur_idx").alias("best"), "label")
    history = moved_ahead(vectors, lag, window).join(told, [*KEY, "idx"])
    names = [*_IDS, ("cur", name), ("hist", name), ("hist", "from_q"), ("hist", "best"), ("hist", "label")]
    both = _held_against(blocks(vectors, "cur", [name], tile), blocks(history, "hist", [name, "from_q", "best", "label"], tile), _all_pairs, names)
    shown = lambda side, *more: F.concat(F.col(f"{side}_{name}"), *more, F.lit(" ["), F.col(f"{side}_idx").cast("string"), F.lit("]"))
    quarter = F.concat(F.lit(" ("), to_string(F.col("hist_from_q")), F.lit(")"))
    return both.select(*KEY, "cur_idx", "hist_idx", shown("cur").alias("current_label"), shown("hist", quarter).alias("historical_label"), F.col("sim").alias("similarity"), F.col("hist_label").alias("label"), (F.col("cur_idx") == F.col("hist_best")).alias("is_best"))


def continuity(pairs: DataFrame, maintained: float = MAINTAINED, rephrased: float = REPHRASED) -> DataFrame:
    """Each historical target's best match (the first of equals) and label; bounds are exclusive."""
    best = F.max(F.struct(F.round("sim", 9).alias("sim"), (-F.col("cur_idx")).alias("neg")))
    out = pairs.groupBy(*KEY, "hist_idx").agg(best.alias("b"))
    label = F.when(F.col("b.sim") > maintained, "maintained").when(F.col("b.sim") > rephrased, "rephrased").otherwise("dropped")
    return out.select(*KEY, "hist_idx", (-F.col("b.neg")).alias("cur_idx"), F.col("b.sim").alias("sim"), label.alias("label"))


def semantic_mt(vectors: DataFrame, calls: DataFrame, maintained: float = MAINTAINED, rephrased: float = REPHRASED, lag: int = 4, window: int | None = None) -> DataFrame:
    """Strict and lenient scores of each call; 0 without history."""
    labels = continuity(best_matches(vectors, lag, window), maintained, rephrased)
    n = lambda x: F.sum((F.col("label") == x).cast("long"))
    by = labels.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_historical"), n("maintained").alias("n_maintained"), n("rephrased").alias("n_rephrased"), n("dropped").alias("n_dropped"))
    current = vectors.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_current"))
    out = calls.select(*KEY).distinct().join(current, list(KEY), "left").join(by, list(KEY), "left").fillna(0)
    share = lambda x: F.coalesce(F.try_divide(x.cast("double"), F.col("n_historical").cast("double")), F.lit(0.0))
    return out.withColumns({"mt_score_strict": share(F.col("n_dropped")), "mt_score_lenient": share(F.col("n_dropped") + F.col("n_rephrased"))})


def threshold_grid(pairs: DataFrame, maintained: list[float], rephrased: list[float], sim: str = "sim", kept: str = "kept") -> DataFrame:
    """The false-drop rate at each pair of bounds r < m: kept targets that would be called dropped; 1 without kept ones.

    The grid is a handful of literals; each row meets all its bounds within one pass.
    """
    grid = [(m, r) for m in maintained for r in rephrased if r < m]
    aggs = []
    for i, (m, r) in enumerate(grid):
        wrong = F.sum(F.when(F.col(kept) & (F.col(sim) <= r), 1).otherwise(0))
        right = F.sum(F.when(F.col(kept) & (F.col(sim) > m), 1).otherwise(0))
        aggs.append(F.struct(F.lit(m).alias("m"), F.lit(r).alias("r"), wrong.alias("n_false"), right.alias("n_maintained"), F.sum(F.col(kept).cast("long")).alias("n_kept")).alias(f"g{i}"))
    rows = pairs.agg(*aggs).select(F.explode(F.array(*[f"g{i}" for i in range(len(grid))])).alias("g")).select("g.*")
    return rows.withColumn("fp_rate", F.coalesce(F.try_divide(F.col("n_false").cast("double"), F.col("n_kept").cast("double")), F.lit(1.0)))


def best_bounds(grid: DataFrame) -> DataFrame:
    """The grid by false-drop rate, with the first as the best; equal rates by their bounds."""
    return grid.orderBy("fp_rate", "m", "r").limit(1)


def upserted(index: DataFrame, new: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """The index with rows of ``new`` in the place of those with the same key; of several new ones the last by ``order``."""
    cols = [c for c in new.columns if c != key]
    last = new.groupBy(key).agg(F.max(F.struct(order, *[c for c in cols if c != order])).alias("__r")).select(key, "__r.*")
    return index.join(last.select(key), key, "left_anti").unionByName(last.select(*index.columns))
