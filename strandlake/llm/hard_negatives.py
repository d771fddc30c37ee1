"""Hard negatives by a norm-bucketed search.

For every anchor, the rows of its label with the highest inner products are its positives; for each positive, the negatives
are the rows of other labels whose inner product lies in a window under that of the positive, highest first.

Candidates are ranked by falling norm, over many tasks, and cut at ranks into strips of ``STRIP`` rows and at most
``BUCKETS`` buckets of strips. By Cauchy-Schwarz no row of a bucket has a product above the anchor's norm times the bucket's
largest. A search begins with the first bucket; this gives a kth product for most windows. An anchor then needs only the
buckets whose bound reaches the lower limit of one of its windows and the kth product found so far: as norms fall, these
are the first ones. Anchors are ranked by the least norm that they need and cut into blocks of ``ANCHORS``, so a bucket is
sent only to the blocks that need it. A task holds one block and one strip, goes through the strip in falling norms with the
running kth products, and ends where no window can take another row.

Only the largest norm of each bucket goes to the driver. Every two rows that may matter are multiplied: nothing is sampled.

Components are ``floor(scale * x)``, and products are exact: as doubles while they are below 2^53, else as integers of any
size, which end at the bounds of a long.

Defined cases: rows without an id, label or vector, or with a component that is null or not finite, take no part; a vector
with fewer components counts as zero in those it lacks; an empty vector has the product 0 with all; repeated rows are rows
of their own, but an anchor that comes more than once is answered once, and rows of its own id are no positives; ties go
to the smaller id; windows under a negative product are empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, packed, running, ship

STRIP, BUCKETS, ANCHORS, PIECE = 8192, 256, 4096, 512
#: Beyond this a sum of products of doubles may be inexact; nothing, in scores; the bounds of a long.
EXACT, NONE, MOST = 1 << 53, -(1 << 63), (1 << 63) - 1
#: Norms are rounded, so a bound has to fail by more than this share.
SLACK = 1e-9

SLOTS = "array<struct<slot:int,positive_id:long,positive_score:long,low:long,high:long,kth:long>>"


def _scaled(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.floor(scale * np.array(x.as_py(), dtype=np.float64)) for x in batch.column("vector")]
            norms = [float(np.sqrt(np.dot(x, x))) if len(x) else 0.0 for x in rows]
            bodies = pa.array([x.astype("<f8").tobytes() for x in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(norms, pa.float64()), bodies], ["id", "label", "norm", "body"])

    return run


def scaled(embeddings: DataFrame, scale: float, vec_id: str, vector: str, label: str) -> DataFrame:
    """``id, label, norm, body`` of the rows that take part; the body holds the components as doubles."""
    ship(embeddings.sparkSession)
    named = packed(embeddings, id=vec_id, vector=vector, label=label)
    plain = named.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return plain.where("id is not null and label is not null and vector is not null").where(finite).mapInArrow(_scaled(scale), "id long, label long, norm double, body binary")


def _matrix(bodies: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(bodies), width))
    for i, x in enumerate(bodies):
        row = np.frombuffer(x.as_buffer(), "<f8")
        out[i, : len(row)] = row
    return out


def products(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Inner products of rows of integers that are held as doubles; ``largest``: a bound on them."""
    if largest < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in b]
    return np.array([[min(max(sum(x * y for x, y in zip(mine, row, strict=True)), NONE + 1), MOST) for row in whole] for mine in ([int(x) for x in row] for row in a)], np.int64).reshape(len(a), len(b))


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The kth largest of every row; ``NONE`` where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), NONE)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def _search(k: int, same: bool):
    """The rows of a strip that may be among the first ``k`` of a window of the anchors of a block."""

    def run(anchors: pa.Table, strip: pa.Table) -> pa.Table:
        names, kinds = ["anchor", "slot", "id", "score"], [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        out: list[tuple[np.ndarray, ...]] = []
        if anchors.num_rows and strip.num_rows:
            strip = strip.sort_by([("norm", "descending"), ("id", "ascending")])
            width = max(len(x.as_buffer()) for t in (anchors, strip) for x in t.column("body")) // 8
            theirs, labels, ids, norms = _matrix(strip.column("body"), width), *(strip.column(c).to_numpy() for c in ("label", "id", "norm"))
            for at in range(0, anchors.num_rows, PIECE):
                out += _piece(anchors.slice(at, PIECE), theirs, labels, ids, norms, width)
        columns = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(4)]
        return pa.table([pa.array(c).cast(kind) for c, kind in zip(columns, kinds, strict=True)], names)

    def _piece(anchors: pa.Table, theirs: np.ndarray, labels: np.ndarray, ids: np.ndarray, norms: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, ...]]:
        mine, label, own, norm, key = _matrix(anchors.column("body"), width), *(anchors.column(c).to_numpy() for c in ("label", "id", "norm", "anchor"))
        windows = [(i, w["slot"], w["low"], w["high"], w["kth"]) for i, x in enumerate(anchors.column("slots").to_pylist()) for w in x]
        if not windows:
            return
        row, slot, low, high, kth = (np.array(c, np.int64) for c in zip(*windows, strict=True))
        for at in range(0, len(ids), PIECE):
            # no row from here on has a larger norm
            alive = norm[row] * norms[at] * (1 + SLACK) >= np.maximum(low, kth)
            if not alive.any():
                return
            here = slice(at, at + PIECE)
            used, which = np.unique(row[alive], return_inverse=True)
            scores = products(mine[used], theirs[here], float(norm[used].max() * norms[at]) * (1 + SLACK))
            fits = label[used][:, None] == labels[here][None, :]
            fits = fits & (own[used][:, None] != ids[here][None, :]) if same else ~fits
            scores = np.where(fits, scores, NONE)[which]
            scores[(scores < low[alive][:, None]) | (scores > high[alive][:, None])] = NONE
            kth[alive] = np.maximum(kth[alive], _kth(scores, k))
            of, column = np.nonzero((scores >= kth[alive][:, None]) & (scores > NONE))
            windows_of = np.flatnonzero(alive)[of]
            yield key[row[windows_of]], slot[windows_of], ids[here][column], scores[of, column]

    return run


_FOUND = "anchor long, slot int, id long, score long"


class Candidates:
    """Rows cut into strips and buckets by falling norm; ``tops``: the largest norm of each bucket."""

    def __init__(self, rows: DataFrame):
        ranked = running(rows, [F.desc("norm"), F.asc("id")], [], "negatives-ranked")
        self.rows = materialize(ranked.select("id", "label", "norm", "body", F.floor(F.col("rank") / STRIP).alias("strip")), "negatives-strips")
        n = self.rows.agg(F.coalesce(F.max("strip"), F.lit(-1))).first()[0] + 1
        self.n_strips, self.per_bucket = n, max(1, -(-n // BUCKETS))
        self.bucket = F.floor(F.col("strip") / self.per_bucket)
        found = self.rows.groupBy(self.bucket.alias("bucket")).agg(F.max("norm").alias("top")).collect()  # at most BUCKETS rows
        self.tops = [r["top"] for r in sorted(found)]

    def against(self, anchors: DataFrame, first: int, k: int, same: bool) -> DataFrame:
        """What :func:`_search` finds for ``anchors``, which have ``block`` and ``last``, the last bucket that they need, in
        the buckets from ``first`` on."""
        reach = {r["last"]: r["block"] for r in anchors.groupBy("last").agg(F.max("block").alias("block")).collect()}  # at most BUCKETS rows
        blocks = [max((b for last, b in reach.items() if last >= bucket), default=-1) + 1 for bucket in range(len(self.tops))]
        wanted = F.element_at(F.array(*[F.lit(x) for x in blocks]), (self.bucket + 1).cast("int")).cast("long")
        zero = F.lit(0).cast("long")
        rows = self.rows.where(self.bucket >= first).withColumn("needed", wanted).where("needed > 0")
        dealt = rows.select("id", "label", "norm", "body", "strip", F.explode(F.sequence(zero, F.col("needed") - 1)).alias("block"))
        end = F.least((F.col("last") + 1) * self.per_bucket, F.lit(self.n_strips)) - 1
        asked = anchors.where(F.col("last") >= first).select("anchor", "id", "label", "norm", "body", "slots", "block", F.explode(F.sequence(F.lit(first * self.per_bucket).cast("long"), end.cast("long"))).alias("strip"))
        return asked.groupBy("block", "strip").cogroup(dealt.groupBy("block", "strip")).applyInArrow(_search(k, same), _FOUND)

    def best(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """``anchor, slot, id, score, rank``: the first ``k`` rows of every window of ``anchor, id, label, norm, body, slots``."""
        begun = self._placed(anchors.withColumn("need", F.lit(0.0)), 0)
        found = materialize(_first(self.against(begun, 0, k, same), k), "negatives-first")
        if len(self.tops) < 2:
            return found
        kth = found.where(F.col("rank") == k).select("anchor", "slot", F.col("score").alias("kth_now"))
        lists = kth.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "kth_now"))).alias("now"))
        known = anchors.join(lists, "anchor", "left").withColumn("slots", F.transform("slots", lambda w: w.withField("kth", F.coalesce(F.col("now")[w["slot"]], w["kth"])))).drop("now")
        least = F.array_min(F.transform("slots", lambda w: F.greatest(w["low"], w["kth"]))).cast("double")
        need = F.when(F.col("norm") > 0, F.greatest(least / F.col("norm"), F.lit(0.0)) * (1 - SLACK)).when(least > 0, F.lit(float("inf"))).otherwise(0.0)
        more = self.against(self._placed(known.withColumn("need", need), len(self.tops) - 1), 1, k, same)
        return materialize(_first(found.drop("rank").unionByName(more), k), "negatives-best")

    def _placed(self, anchors: DataFrame, most: int) -> DataFrame:
        """``anchors`` in blocks, those that need most buckets first, with ``last`` of at most ``most``."""
        last = F.size(F.filter(F.array(*[F.lit(float(x)) for x in self.tops]), lambda top: top >= F.col("need"))) - 1
        ranked = running(anchors.withColumn("last", F.least(last, F.lit(most))), [F.asc("need"), F.asc("anchor")], [], "negatives-blocks")
        return materialize(ranked.withColumn("block", F.floor(F.col("rank") / ANCHORS)).drop("rank", "need"), "negatives-asked")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _slot(slot: Column, positive_id: Column, positive_score: Column, low: Column, high: Column) -> Column:
    return F.struct(slot.cast("int").alias("slot"), positive_id.alias("positive_id"), positive_score.alias("positive_score"), low.alias("low"), high.alias("high"), F.lit(NONE).cast("long").alias("kth"))


def window(score: Column, low: int, high: int, whole: int) -> tuple[Column, Column]:
    """The least and the greatest product p with ``low * score <= whole * p <= high * score``, for scores from 0 on."""
    times = lambda by: score.cast("decimal(20,0)") * F.lit(by).cast("decimal(10,0)")
    by = F.lit(whole).cast("decimal(10,0)")
    return F.call_function("div", times(low) + (by - 1).cast("decimal(10,0)"), by), F.call_function("div", times(high), by)


def hard_negatives(
    embeddings: DataFrame,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    whole: int = 100,
    scale: float = 256.0,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``. Anchors are rows whose id is divisible by
    ``every``; a negative's product is from ``low / whole`` to ``high / whole`` of the positive's."""
    rows = materialize(scaled(embeddings, scale, vec_id, vector, label), "negatives-rows")
    candidates = Candidates(rows)
    any_score = F.array(_slot(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(NONE).cast("long"), F.lit(MOST).cast("long")))
    chosen = rows.where(F.col("id") % every == 0).dropDuplicates(["id", "label", "body"])
    anchors = materialize(chosen.withColumn("anchor", F.monotonically_increasing_id()).withColumn("slots", any_score.cast(SLOTS)), "negatives-anchors")
    near = candidates.best(anchors, positives, same=True)
    least, greatest = window(F.col("score"), low, high, whole)
    windows = near.where("score >= 0").where(least <= greatest).select("anchor", _slot(F.col("rank"), F.col("id"), F.col("score"), least, greatest).alias("w"))
    asked = materialize(anchors.drop("slots").join(windows.groupBy("anchor").agg(F.collect_list("w").cast(SLOTS).alias("slots")), "anchor"), "negatives-windows")
    found = candidates.best(asked, negatives, same=False)
    named = asked.select("anchor", F.col("id").alias("anchor_id"), F.explode("slots").alias("w")).select("anchor", "anchor_id", F.col("w.slot").alias("slot"), "w.positive_id", "w.positive_score")
    return found.join(named, ["anchor", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
