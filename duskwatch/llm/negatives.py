"""Hard negatives from vectors: angles to reference directions bound scores, whole numbers decide."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.llm.common import scratch, settled

#: Vectors are stored in whole steps of 1 / SCALE; larger components than this have no place in an exact score.
SCALE, LARGEST = 256, 1 << 24
#: Reference directions, the sample they are fitted on, and rows of a run whose angles are bounded together.
DIRECTIONS, SAMPLE_ROWS, RUN_ROWS = 16, 4096, 512
#: Rows a task sorts at once, and numbers of the anchors that meet all rows in one pass: eight bytes each.
SORTED_ROWS, PACK_NUMBERS = 65_536, 1 << 20
#: Safety of the bounds: angles are stored as 32-bit numbers and cosines are rounded.
ANGLE_SLACK, SCORE_SLACK = 2e-6, 1e-9
INDEX = "id bigint, label bigint, comps array<int>, norm double, near int, angles array<float>"


# --- the index: norms and angles to reference directions -------------------------------------------------


def directions(dim: int, sample=None):
    """Unit vectors, one a row: centres of the sample's directions by a few rounds of k-means, else axes."""
    import numpy as np

    axes = np.zeros((DIRECTIONS, dim))
    if not dim:
        return axes
    axes[np.arange(DIRECTIONS), np.arange(DIRECTIONS) % dim] = 1.0
    if sample is None or len(sample) < DIRECTIONS:
        return axes
    unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
    centres = unit[np.linspace(0, len(unit) - 1, DIRECTIONS).astype(int)].copy()
    for _ in range(5):
        near = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), axes)
    return centres / np.linalg.norm(centres, axis=1, keepdims=True)


def angles_to(vectors, norms, towards):
    """Angle of every vector to every direction; of a vector without length, 0."""
    import numpy as np

    cosine = (vectors @ towards.T) / np.maximum(norms, 1e-300)[:, None]
    out = np.arccos(np.clip(cosine, -1.0, 1.0))
    out[norms == 0] = 0.0
    return out


def _index_rows(fitted):
    """(id, label, embedding) to rows of the index, those of one label and direction next to each other."""
    import numpy as np

    def sort_out(ids, labels, vectors):
        import pyarrow as pa

        by_dim: dict[int, list[int]] = {}
        for row, vector in enumerate(vectors):
            by_dim.setdefault(len(vector), []).append(row)
        for dim, rows in sorted(by_dim.items()):
            whole = np.array([vectors[r] for r in rows], dtype=np.float64).reshape(len(rows), dim)
            norms = np.sqrt((whole * whole).sum(1))
            towards = fitted if fitted is not None and fitted.shape[1] == dim else directions(dim)
            angles = angles_to(whole, norms, towards)
            near = angles.argmin(1)
            label = np.array([labels[r] for r in rows], dtype=np.int64)
            order = np.lexsort((angles[np.arange(len(rows)), near], near, label))
            count = len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array([ids[r] for r in rows], dtype=np.int64)[order]), pa.array(label[order]),
                    pa.ListArray.from_arrays(
                        pa.array((np.arange(count + 1) * dim).astype(np.int32)), pa.array(whole[order].astype(np.int32).reshape(-1))
                    ),
                    pa.array(norms[order]), pa.array(near[order].astype(np.int32)),
                    pa.ListArray.from_arrays(
                        pa.array((np.arange(count + 1) * DIRECTIONS).astype(np.int32)), pa.array(angles[order].astype(np.float32).reshape(-1))
                    ),
                ],
                names=["id", "label", "comps", "norm", "near", "angles"],
            )

    def run(batches):
        ids, labels, vectors, held = [], [], [], 0
        for batch in batches:
            for key, label, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = scaled(vector.values)
                if found is None:
                    continue
                ids.append(key)
                labels.append(label)
                vectors.append(found)
                held += len(found)
                if len(ids) >= SORTED_ROWS or held >= 64 * SORTED_ROWS:
                    yield from sort_out(ids, labels, vectors)
                    ids, labels, vectors, held = [], [], [], 0
        if ids:
            yield from sort_out(ids, labels, vectors)

    return run


def scaled(values):
    """floor(SCALE * x) of an Arrow array of components; None where one is null, not finite or too large."""
    import numpy as np

    if values.null_count:
        return None
    with np.errstate(over="ignore", invalid="ignore"):
        found = np.floor(SCALE * values.to_numpy(zero_copy_only=False))
    # Not a number compares with nothing, so it fails as well.
    return found if bool((np.abs(found) < LARGEST).all()) else None


# --- bounds ---------------------------------------------------------------------------------------------


def score_bounds(phi, norms, low, high, least, most):
    """(lower, upper) bounds of the scores of anchors with every row of a run.

    ``phi``: angles of the anchors to the directions; ``low`` and ``high``: the least and the greatest angle of the run's
    rows to each; ``least`` and ``most``: their norms. By the triangle inequality on the sphere the angle between an anchor
    and a row is at least the difference of their angles to any direction, and at most their sum or what that lacks to the
    full turn. Angles are widened and scores moved outwards by more than all rounding can amount to.
    """
    import numpy as np

    gap = np.maximum(np.maximum(phi - high, low - phi), 0.0).max(1) - ANGLE_SLACK
    reach = np.minimum(phi + high, 2 * np.pi - phi - low).min(1) + ANGLE_SLACK
    top = np.cos(np.clip(gap, 0.0, np.pi))
    bottom = np.cos(np.clip(reach, 0.0, np.pi))
    upper = norms * np.where(top > 0, most, least) * top
    lower = norms * np.where(bottom > 0, least, most) * bottom
    slack = SCORE_SLACK * norms * most + 1.0
    return lower - slack, upper + slack


def dot(a, b):
    """Exact inner products of whole-numbered rows, on floating-point units where their sums are whole there."""
    import numpy as np

    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 2**52:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Best:
    """The first rows of every slot: higher scores first, then smaller ids; equal (score, id) count once."""

    def __init__(self, slots: int, keep: int):
        import numpy as np

        self.keep = keep
        self.slot = np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0, dtype=np.int64)
        self.id = np.zeros(0, dtype=np.int64)
        self.new: list[tuple] = []
        self.waiting = 0
        #: The least score that still matters to a slot.
        self.floor = np.full(slots, np.iinfo(np.int64).min)

    def add(self, slot, score, key) -> None:
        self.new.append((slot, score, key))
        self.waiting += len(slot)
        if self.waiting > max(20_000, len(self.slot)):
            self.merge()

    def merge(self) -> None:
        import numpy as np

        if not self.waiting:
            return
        held = [(self.slot, self.score, self.id), *self.new]
        slot, score, key = (np.concatenate([part[i] for part in held]) for i in range(3))
        self.new, self.waiting = [], 0
        order = np.lexsort((key, -score, slot))
        slot, score, key = slot[order], score[order], key[order]
        new = np.r_[True, (slot[1:] != slot[:-1]) | (score[1:] != score[:-1]) | (key[1:] != key[:-1])]
        slot, score, key = slot[new], score[new], key[new]
        begins = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        place = np.arange(len(slot)) - np.repeat(begins, np.diff(np.r_[begins, len(slot)]))
        within = place < self.keep
        self.slot, self.score, self.id = slot[within], score[within], key[within]
        last = place == self.keep - 1
        self.floor[slot[last]] = score[last]


class Anchors:
    """A pack of anchors as arrays, with the score windows that each searches."""

    def __init__(self, rows: list[tuple], windows: list[list[tuple[int, int]]] | None = None):
        import numpy as np

        self.label = np.array([r[1] for r in rows], dtype=np.int64)
        self.id = np.array([r[0] for r in rows], dtype=np.int64)
        self.norm = np.array([r[3] for r in rows], dtype=np.float64)
        self.angles = np.array([r[4] for r in rows], dtype=np.float64).reshape(len(rows), DIRECTIONS)
        dims = np.array([len(r[2]) for r in rows], dtype=np.int64)
        #: Per dimension: the anchors of it and their components.
        self.of_dim = {}
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            self.of_dim[dim] = (at, np.array([rows[i][2] for i in at.tolist()], dtype=np.float64).reshape(len(at), dim))
        # Windows as two tables; a slot that is not used has its floor above its ceiling.
        width = max([1, *map(len, windows)]) if windows is not None else 1
        self.width = width
        self.low = np.full((len(rows), width), 1, dtype=np.int64)
        self.high = np.zeros((len(rows), width), dtype=np.int64)
        if windows is None:
            self.low[:], self.high[:] = -(1 << 62), 1 << 62
        for i, found in enumerate(windows or []):
            for j, (lo, hi) in enumerate(found):
                self.low[i, j], self.high[i, j] = lo, hi


def _search(shared, same_label: bool, keep: int):
    """Per task: the first ``keep`` rows of every window of every anchor of the pack."""
    import numpy as np

    def run_of(anchors: Anchors, best: Best, at, comps, ids, label, norms, angles, near, vectors):
        """One run of rows of one label: bound, choose the anchors and rows that may matter, score them."""
        wanted = anchors.label[at] == label if same_label else anchors.label[at] != label
        if not wanted.any():
            return
        at, comps = at[wanted], comps[wanted]
        floor = np.maximum(anchors.low[at], best.floor.reshape(-1, anchors.width)[at])
        ceiling = anchors.high[at]
        idle = floor > ceiling
        least, most = np.where(idle, 1 << 62, floor).min(1), np.where(idle, -(1 << 62), ceiling).max(1)
        lower, upper = score_bounds(anchors.angles[at], anchors.norm[at], angles.min(0), angles.max(0), norms.min(), norms.max())
        meet = (upper >= least) & (lower <= most) & ~idle.all(1)
        if not meet.any():
            return
        at, comps, floor, ceiling, least = at[meet], comps[meet], floor[meet], ceiling[meet], least[meet]
        # Rows are in the order of their angle to one direction: each anchor needs a window of them.
        phi, theta, scale = anchors.angles[at, near], angles[:, near], anchors.norm[at] * norms.max()
        enough = np.clip((least - 1.0 - SCORE_SLACK * scale) / np.maximum(scale, 1e-300), -1.0, 1.0)
        reach = np.where(least > 0, np.arccos(enough), np.pi) + 2 * ANGLE_SLACK
        first = int(np.searchsorted(theta, phi - reach, "left").min())
        last = int(np.searchsorted(theta, phi + reach, "right").max())
        if first >= last:
            return
        scores = dot(comps, vectors[first:last])
        keys = ids[first:last]
        for j in range(anchors.width):
            fits = (scores >= floor[:, j, None]) & (scores <= ceiling[:, j, None])
            if same_label:
                fits &= anchors.id[at][:, None] != keys[None, :]
            row, column = np.nonzero(fits)
            if len(row):
                best.add(at[row] * anchors.width + j, scores[row, column], keys[column])

    def run(batches):
        import pyarrow as pa

        anchors: Anchors = shared.value
        best = Best(len(anchors.id) * anchors.width, keep)
        for batch in batches:
            ids, labels = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            norms, nears = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy(zero_copy_only=False)
            offsets = batch.column(2).offsets.to_numpy()
            comps = batch.column(2).values.to_numpy(zero_copy_only=False)
            first = batch.column(5).offsets[0].as_py()
            angles = batch.column(5).values.to_numpy(zero_copy_only=False)[first : first + len(ids) * DIRECTIONS]
            angles = angles.astype(np.float64).reshape(-1, DIRECTIONS)
            dims = np.diff(offsets)
            # Runs: rows of one dimension, label and direction, which the index keeps next to each other.
            # Where two sorted parts meet, the angle falls.
            own = angles[np.arange(len(ids)), nears]
            change = (np.diff(dims) != 0) | (np.diff(labels) != 0) | (np.diff(nears) != 0) | (np.diff(own) < 0)
            ends = np.r_[np.flatnonzero(change) + 1, len(ids)]
            start = 0
            for end in ends.tolist():
                for lo in range(start, end, RUN_ROWS):
                    hi = min(end, lo + RUN_ROWS)
                    dim = int(dims[lo])
                    if dim in anchors.of_dim:
                        at, theirs = anchors.of_dim[dim]
                        vectors = comps[offsets[lo] : offsets[hi]].astype(np.float64).reshape(hi - lo, dim)
                        run_of(anchors, best, at, theirs, ids[lo:hi], labels[lo], norms[lo:hi], angles[lo:hi], int(nears[lo]), vectors)
                start = end
        best.merge()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array((best.slot // anchors.width).astype(np.int32)), pa.array((best.slot % anchors.width).astype(np.int32)),
                pa.array(best.score), pa.array(best.id),
            ],
            names=["anchor", "window", "score", "id"],
        )

    return run


FOUND = "anchor int, window int, score bigint, id bigint"


def _first(found: DataFrame, keep: int) -> DataFrame:
    """What the tasks found, merged: the first ``keep`` of every window, numbered from 1."""
    rank = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc("id")))
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= keep)


def _packs(anchors: DataFrame, numbers: int) -> Iterator[list[tuple]]:
    """The anchors in packs of about so many ``numbers``, each in a fixed order: only one at a time is at the driver."""
    total = anchors.agg(F.sum(F.size("comps") + F.size("angles"))).first()[0] or 0
    count = -(-total // numbers)
    for number in range(count):
        part = anchors.filter(F.pmod(F.xxhash64("id", "label"), F.lit(count)) == number)
        rows = part.select("id", "label", "comps", "norm", "angles").collect()
        if rows:
            yield sorted((r.id, r.label, tuple(r.comps), r.norm, tuple(r.angles)) for r in rows)


def build_index(rows: DataFrame) -> DataFrame:
    """The index over ``rows(id, label, embedding)``: every row that takes part, with norm and angles."""
    import numpy as np
    import pyarrow as pa

    narrow = rows.filter("id is not null and label is not null and embedding is not null").select(
        F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    # Only the directions depend on this sample; whatever they are, the bounds hold.
    sample = narrow.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("embedding").collect()
    vectors = [found for r in sample if (found := scaled(pa.array(r.embedding, pa.float64()))) is not None]
    fitted = None
    if vectors:
        dim = max(sorted({len(v) for v in vectors}), key=lambda d: sum(len(v) == d for v in vectors))
        fitted = directions(dim, np.array([v for v in vectors if len(v) == dim]))
    return narrow.mapInArrow(_index_rows(fitted), INDEX)


def mine_hard_negatives(
    vectors: DataFrame, is_anchor=None, positives: int = 5, negatives: int = 10, percent: tuple[int, int] = (30, 90),
    pack: int = PACK_NUMBERS,
) -> DataFrame:
    """Hard negatives of every anchor and each of its positives, from ``vectors(id, label, embedding)``.

    Components become floor(256 x); a score is the inner product of these whole numbers, higher ones first, ties by smaller id.
    The positives of an anchor (``is_anchor``, a condition on the id; default: divisible by 100) are its first rows of the same label with another
    id. For each, the first ``negatives`` rows of another label with a score between the two ``percent`` of the positive's are returned.

    Every row's norm and angles to fixed directions are stored. For a run of rows they bound the scores that an anchor can have with it;
    where the bounds miss all windows that the anchor still searches, the run is passed over, else the rows whose angle can reach the least
    score wanted are scored in whole numbers. Anchors travel in packs of about ``pack`` numbers; each meets all rows, block by
    block, once for positives and once for negatives, so the work is bounded in memory at any number of them.

    Rows with a null id, label or vector, with a null or non-finite component, or one of 2^16 and more take no part. Vectors of different lengths
    are not compared. Rows that share id and score count once; a negative positive score has no window. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    is_anchor = F.col("id") % 100 == 0 if is_anchor is None else is_anchor
    low, high = percent
    shape = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    with scratch(spark) as finished:
        index = settled(build_index(vectors), "vector-index")
        anchors = settled(index.filter(is_anchor).dropDuplicates(["id", "label", "comps"]), "anchors")
        out = None
        for rows in _packs(anchors, pack):
            with scratch(spark) as keep:
                near = index.mapInArrow(_search(spark.sparkContext.broadcast(Anchors(rows)), True, positives), FOUND)
                best = settled(_first(near, positives), "positives")
                # As many rows as anchors times positives.
                found = [[] for _ in rows]
                for r in sorted(best.collect(), key=lambda r: (r.anchor, r.rank)):
                    found[r.anchor].append(r.score)
                windows = [[(-(-low * s // 100), high * s // 100) for s in scores] for scores in found]
                shared = spark.sparkContext.broadcast(Anchors(rows, windows))
                hard = _first(index.mapInArrow(_search(shared, False, negatives), FOUND), negatives)
                names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "anchor int, anchor_id bigint")
                done = (
                    hard.select("anchor", "window", F.col("score").alias("negative_score"), F.col("id").alias("negative_id"), "rank")
                    .join(
                        best.select("anchor", (F.col("rank") - 1).alias("window"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")),
                        ["anchor", "window"],
                    )
                    .join(F.broadcast(names), "anchor")
                    .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
                )
                done = keep(done, "hard-negatives")
            out = done if out is None else out.unionByName(done)
        return finished(out if out is not None else spark.createDataFrame([], shape), "hard-negatives")
