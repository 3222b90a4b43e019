"""Copies of images by local descriptors (operator 8).

Corners are maxima of the Harris response over a small square, at scales a factor of the square root of two apart; how
many an image has is up to its area and detail, there is no cap. A corner's orientation is the direction of the intensity
centroid around it; its descriptor holds 128 comparisons of smoothed intensities at points turned by that orientation.

Bands of descriptor bits are the tables of a Hamming join. All bands are ``BAND`` bits wide, so the same two images are
linked in small and large tables; in return a bucket grows with the number of features. In a bucket of up to ``SMALL`` features all pairs are compared; in a
larger one first each feature with the bucket's least and greatest. Once these links are verified, components are known,
and in all buckets all pairs of different components are compared as well. For that, images are dealt to blocks, and each
pair of blocks (a tile) is one task's work: nearly all matches are single ones of unlike images, whose number grows with the square
of the table, and where two images meet with all their features those with fewer than ``LEAST_MATCHES`` are told at once and make
no rows. Comparisons still grow with that square, as do rows of tiles once blocks are full (``MOST_BLOCK``).
Which pairs meet is up to the features alone, not to blocks or partitions. Pairs within ``MOST_BITS`` bits are matches: pairs that differ in fewer bits than there are
bands are always found, others by the chance that one of the bands is equal.

Of two images with enough matches a turn, scaling and shift is sought that several matches agree on; it is fitted to
these, and the pixels of the box that holds them and those around each of them must correlate under it. Links found are
joined into components.

An image is a column of bytes: binary PGM ("P5", one byte a pixel).

Results for special input: images that are null, damaged, flat or smaller than a descriptor have no features and are
alone; equal images and repeated rows are copies; a null id never names a component unless it is alone, and is not kept;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlark.llm.components import components
from meshlark.llm.scratch import Scratch, pick, released, tasks_for

#: Levels of the pyramid, each smaller than the one before by the square root of two.
SCALES = 5
#: A corner is the strongest within so many places up, down, left and right.
APART = 5
RADIUS, TURNS, BITS = 9, 32, 128
#: Bits of a band, whatever the number of features: which pairs meet must not be up to other images.
BAND = 16
#: Features of a bucket that are all compared at once.
SMALL = 64
#: Images are dealt to as many blocks as there are such numbers of features, up to ``BLOCKS``, and to more only where a block would hold too many.
BLOCK, BLOCKS, MOST_BLOCK = 8192, 8, 1 << 19
#: Pairs of features from which on those of a word are compared by themselves, pairs compared at once, and matches held at once.
DENSE, AT_ONCE, MOST_MATCHES = 512, 1 << 16, 1 << 22
MOST_BITS = 10
#: Bytes of stored features for one task of the join, where each feature is there once for each band.
FEATURE_BYTES = 512 << 10
LEAST_MATCHES, LEAST_AGREEING, SHIFT, TURN = 4, 4, 5.0, 2
#: Correlation of the pixels around a match, over so many places to each side, and of those in the box that holds all matches.
LEAST_CORRELATION, SIDE, LEAST_OVERALL = 0.8, 8, 0.5
#: Side of the images that vectors are drawn as, and the spread of their grey levels.
DRAWN, SPREAD = 80, 45.0
_HEADER = re.compile(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s")


def to_pgm(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % pixels.shape[::-1] + np.ascontiguousarray(pixels, np.uint8).tobytes()


def from_pgm(raw: bytes | None) -> np.ndarray | None:
    head = _HEADER.match(raw or b"")
    if not head or int(head[3]) > 255:
        return None
    width, height = int(head[1]), int(head[2])
    if len(raw) - head.end() < width * height:
        return None
    return np.frombuffer(raw, np.uint8, width * height, head.end()).reshape(height, width)


def _tests() -> np.ndarray:
    """(turn, test, end, axis): points inside the circle, for each orientation."""
    rng = np.random.default_rng(8)
    points = rng.normal(0, RADIUS / 2.2, (BITS * 8, 2, 2))
    points = points[(np.hypot(points[..., 0], points[..., 1]) <= RADIUS).all(1)][:BITS]
    angle = 2 * np.pi * np.arange(TURNS) / TURNS
    turn = np.stack([np.stack([np.cos(angle), -np.sin(angle)], 1), np.stack([np.sin(angle), np.cos(angle)], 1)], 1)
    return np.rint(np.einsum("kij,pej->kpei", turn, points)).astype(np.int64)


_TESTS = _tests()
_Y, _X = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_INSIDE = np.hypot(_X, _Y) <= RADIUS


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of side 2 r + 1 of a stack of images, the border repeated."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        total = np.cumsum(np.pad(a, pad, "edge"), axis)
        n = a.shape[axis]
        a = (np.take(total, np.arange(2 * r + 1, n + 2 * r + 1), axis) - np.take(total, np.arange(n), axis)) / (2 * r + 1)
    return a


def corners(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, y, x) of the corners of equally sized images, away from the border."""
    gy, gx = np.gradient(stack, axis=(1, 2))
    xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
    response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    margin = RADIUS + 1
    best = response
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (APART, APART)
        around = np.pad(best, pad, constant_values=-np.inf)
        best = np.max([np.take(around, np.arange(best.shape[axis]) + s, axis) for s in range(2 * APART + 1)], axis=0)
    peak = (response >= best) & (response > 1.0)
    peak[:, :margin] = peak[:, -margin:] = False
    peak[:, :, :margin] = peak[:, :, -margin:] = False
    return np.nonzero(peak)


def _resized(stack: np.ndarray, height: int, width: int) -> np.ndarray:
    """Linear interpolation along both axes."""
    for axis, size in ((1, height), (2, width)):
        n = stack.shape[axis]
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.minimum(at.astype(np.int64), max(0, n - 2))
        part = (at - low).reshape([-1 if k == axis else 1 for k in range(3)])
        stack = np.take(stack, low, axis) * (1 - part) + np.take(stack, np.minimum(low + 1, n - 1), axis) * part
    return stack


def describe(stack: np.ndarray) -> dict[str, np.ndarray]:
    """Features of a stack of equally sized images: image, y, x (of the full size), scale, turn, high, low."""
    out: dict[str, list] = {k: [] for k in ("image", "y", "x", "scale", "turn", "high", "low")}
    level, full = stack.astype(np.float64), stack.shape[1:]
    for scale in range(SCALES):
        if scale:
            height, width = (int(round(n / 2 ** (scale / 2))) for n in full)
            if min(height, width) < 2 * (RADIUS + 1) + 1:
                break
            level = _resized(_box(level, 1), height, width)
        elif min(full) < 2 * (RADIUS + 1) + 1:
            break
        smooth = _box(_box(level, 1), 1)
        image, y, x = corners(smooth)
        patch = smooth[image[:, None, None], y[:, None, None] + _Y, x[:, None, None] + _X] * _INSIDE
        angle = np.arctan2((patch * _Y).sum((1, 2)), (patch * _X).sum((1, 2)))
        turn = np.rint(angle / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
        at = _TESTS[turn]
        value = smooth[image[:, None, None], y[:, None, None] + at[..., 1], x[:, None, None] + at[..., 0]]
        words = np.packbits(value[..., 0] < value[..., 1], axis=1).view(">u8").astype(np.uint64)
        place = [np.minimum(np.rint((v + 0.5) * n / m - 0.5), n - 1).astype(np.int64) for v, n, m in zip((y, x), full, level.shape[1:], strict=True)]
        for k, v in zip(out, (image, *place, np.full(len(y), scale), turn, words[:, 0], words[:, 1]), strict=True):
            out[k].append(v)
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def features(df: DataFrame) -> DataFrame:
    """(node, spot, y, x, scale, turn, high, low) for the corners of images (node, image); ``spot`` numbers an image's."""
    names = ["node", "spot", "y", "x", "scale", "turn", "high", "low"]

    def run(batches):
        for batch in batches:
            node, pixels = batch.column("node").to_numpy(), [from_pgm(raw) for raw in batch.column("image").to_pylist()]
            by_size: dict[tuple, list[int]] = {}
            for i, p in enumerate(pixels):
                if p is not None:
                    by_size.setdefault(p.shape, []).append(i)
            for shape, members in by_size.items():
                most = max(1, (1 << 18) // max(1, shape[0] * shape[1]))
                for k in range(0, len(members), most):
                    part = members[k : k + most]
                    found = describe(np.stack([pixels[i] for i in part]))
                    order = np.argsort(found["image"], kind="stable")
                    found = {c: v[order] for c, v in found.items()}
                    image = found["image"]
                    arrays = [pa.array(node[np.array(part)[image]]), pa.array((np.arange(len(image)) - np.searchsorted(image, image)).astype(np.int32))]
                    arrays += [pa.array(found[c].astype(np.int32)) for c in ("y", "x", "scale", "turn")] + [pa.array(found[c].view(np.int64)) for c in ("high", "low")]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    return df.select("node", "image").mapInArrow(released(run), "node long, spot int, y int, x int, scale int, turn int, high long, low long")


def _bucketed(found: DataFrame, count: int | None = None) -> DataFrame:
    """(bucket, node, spot, high, low, and component if it is there) once for each band; a count of features changes nothing."""
    width = BAND
    mask = (1 << width) - 1

    def bits(at: int):  # bits ``at`` to ``at + width`` of high and low together, from the top
        if at + width <= 64:
            return F.shiftrightunsigned("high", 64 - at - width).bitwiseAND(mask)
        if at >= 64:
            return F.shiftrightunsigned("low", 128 - at - width).bitwiseAND(mask)
        return F.shiftleft("high", at + width - 64).bitwiseOR(F.shiftrightunsigned("low", 128 - at - width)).bitwiseAND(mask)

    buckets = F.array(*[bits(k * width) + F.lit(k << width).cast("long") for k in range(BITS // width)])
    return found.select(F.explode(buckets).alias("bucket"), *[c for c in ("node", "spot", "high", "low", "component") if c in found.columns])


PAIRS = "a_node long, a_spot int, b_node long, b_spot int"


def _pairs(node: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    swap = node[i] > node[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (node[i], own[i], node[j], own[j])], ["a_node", "a_spot", "b_node", "b_spot"])


def _apart(high: np.ndarray, low: np.ndarray, i, j) -> np.ndarray:
    return np.bitwise_count(high[i] ^ high[j]) + np.bitwise_count(low[i] ^ low[j])


def _columns(batches, names: list[str]):
    held = [b for b in batches if b.num_rows]
    return [c.to_numpy() for c in pa.Table.from_batches(held).select(names).columns] if held else None


def _in_small(batches):
    """All matches within buckets."""
    columns = _columns(batches, ["bucket", "node", "spot", "high", "low"])
    if columns is None:
        return
    order = np.argsort(columns[0], kind="stable")
    bucket, node, own, high, low = (c[order] for c in columns)
    high, low, left, step = high.view(np.uint64), low.view(np.uint64), np.arange(len(bucket)), 1
    while len(left := left[left + step < len(bucket)]) and len(left := left[bucket[left] == bucket[left + step]]):
        on = left[(node[left] != node[left + step]) & (_apart(high, low, left, left + step) <= MOST_BITS)]
        if len(on):
            yield _pairs(node, own, on, on + step)
        step += 1


def _tiles(batches, names: list[str]):
    """The columns of one tile (i, j) after the other, from batches sorted by tile."""
    held, last = [], None
    for batch in batches:
        i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
        cut = [0, *(np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cut[:-1], cut[1:], strict=True):
            if stop > start:
                if held and (i[start], j[start]) != last:
                    yield *last, _columns(held, names)
                    held = []
                last = (i[start], j[start])
                held.append(batch.slice(start, stop - start))
    if held:
        yield *last, _columns(held, names)


def _met(order: tuple, against: tuple, high: np.ndarray, low: np.ndarray):
    """Pairs (p, q) within ``MOST_BITS`` bits, of features (words, numbers) sorted by a band's word that is the same for both."""
    (word, p), (words, q) = order, against
    low_end, high_end = np.searchsorted(words, word, "left"), np.searchsorted(words, word, "right")
    cut = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1, [len(word)]])
    size = np.diff(cut) * (high_end - low_end)[cut[:-1]]
    for g in np.flatnonzero(size >= DENSE).tolist():  # word by word
        x, y = p[cut[g] : cut[g + 1]], q[low_end[cut[g]] : high_end[cut[g]]]
        step = max(1, AT_ONCE // len(y))
        for k in range(0, len(x), step):
            i, j = np.divmod(np.flatnonzero(_apart(high, low, x[k : k + step, None], y[None, :]) <= MOST_BITS), len(y))
            yield x[i + k], y[j]
    few = np.repeat(size < DENSE, np.diff(cut))  # words of few pairs together
    x, begin, n = p[few], low_end[few], (high_end - low_end)[few]
    before, k = np.cumsum(n) - n, 0
    while k < len(x):
        stop = max(k + 1, int(np.searchsorted(before, before[k] + AT_ONCE)))
        i, m = np.repeat(x[k:stop], n[k:stop]), n[k:stop]
        j = q[np.arange(len(i)) + np.repeat(begin[k:stop] - before[k:stop] + before[k], m)]
        on = _apart(high, low, i, j) <= MOST_BITS
        yield i[on], j[on]
        k = stop


def _in_tile(left: slice, right: slice, node: np.ndarray, high: np.ndarray, low: np.ndarray, component: np.ndarray, least: int):
    """Matches (p, q) of different components, each once, of the images of ``left`` and ``right`` that have ``least`` or more.

    Rows are sorted by node. All matches of some images are held until they are counted; where these are too many, the images are halved.
    """
    bands = [((high if at < 64 else low) >> np.uint64(64 - BAND - at % 64)).astype(np.uint16) for at in range(0, BITS, BAND)]
    sort = lambda band, rows: (band[rows][by := np.argsort(band[rows], kind="stable")], by + rows.start)
    against = [sort(band, right) for band in bands]
    image = np.concatenate([[0], np.cumsum(node[1:] != node[:-1])])
    starts = np.append(np.unique(image[left], return_index=True)[1] + left.start, left.stop)
    todo = [(0, len(starts) - 1)]
    while todo:
        first, last = todo.pop()
        found, total = [(np.zeros(0, np.int64),) * 2], 0
        for k, band in enumerate(bands):
            for p, q in _met(sort(band, slice(int(starts[first]), int(starts[last]))), against[k], high, low):
                on = component[p] != component[q]
                if left == right:
                    on &= node[p] < node[q]
                for earlier in bands[:k]:
                    on &= earlier[p] != earlier[q]
                found.append((p[on], q[on]))
                total += len(found[-1][0])
                if total > MOST_MATCHES and last - first > 1:
                    break
            else:
                continue
            break
        if total > MOST_MATCHES and last - first > 1:
            todo += [(first, (first + last) // 2), ((first + last) // 2, last)]
            continue
        p, q = (np.concatenate(x) for x in zip(*found, strict=True))
        if least > 1:
            _, of, n = np.unique(image[p] * (image[-1] + 1) + image[q], return_inverse=True, return_counts=True)
            p, q = p[n[of] >= least], q[n[of] >= least]
        if len(p):
            yield p, q


def _in_tiles(least: int):
    def run(batches):
        for i, j, columns in _tiles(batches, ["block", "node", "spot", "high", "low", "component"]):
            order = np.lexsort((columns[1], columns[0]))
            block, node, own, high, low, component = (c[order] for c in columns)
            high, low, border = high.view(np.uint64), low.view(np.uint64), int(np.searchsorted(block, i, "right"))
            left, right = slice(0, border), slice(0, border) if i == j else slice(border, len(block))
            if left.stop and right.stop > right.start:
                for p, q in _in_tile(left, right, node, high, low, component, least):
                    yield _pairs(node, own, p, q)

    return run


def _first_matches(bucketed: DataFrame, sizes: DataFrame, tasks: int) -> DataFrame:
    """Matches, some more than once, of all pairs in small buckets, and of larger buckets' features with the least and the greatest one."""
    small = bucketed.join(sizes.filter(F.col("n") <= SMALL).select("bucket").hint("merge"), "bucket")
    pairs = small.repartition(tasks, "bucket").mapInArrow(released(_in_small), PAIRS)
    hubs = sizes.filter(F.col("n") > SMALL).select("bucket", F.explode(F.array("least", "greatest")).alias("hub"))
    met = bucketed.join(hubs.hint("merge"), "bucket").filter(F.col("node") != F.col("hub.node"))
    near = met.filter(F.bit_count(F.col("high").bitwiseXOR(F.col("hub.high"))) + F.bit_count(F.col("low").bitwiseXOR(F.col("hub.low"))) <= MOST_BITS)
    one, two = F.struct("node", "spot"), F.struct(F.col("hub.node").alias("node"), F.col("hub.spot").alias("spot"))
    ordered = near.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))
    return pairs.union(ordered.select("a.node", "a.spot", "b.node", "b.spot"))


def _grouped(features: DataFrame, group: DataFrame) -> DataFrame:
    return features.join(group.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))


def _further_matches(found: DataFrame, sizes: DataFrame | None, group: DataFrame | None, tasks: int, least: int = 1) -> DataFrame:
    """Matches between features of different components, each once, of images that have ``least`` or more of them.

    Features (or buckets with all their features; their ``sizes`` are of no matter) have their component, or ``group`` has it.
    Images are dealt to blocks, and a feature is shuffled once for each block, whatever the number of its matches: two images
    meet in one tile with all their features, so matches are counted there, and those of images with too few go no further.
    """
    if "bucket" in found.columns:
        found = found.filter(F.col("bucket") < 1 << BAND).drop("bucket")  # a feature is once in each band, so the first has all
    if group is not None:
        found = _grouped(found, group)
    n = found.count()
    blocks = max(1, min(-(-n // BLOCK), BLOCKS), -(-n // MOST_BLOCK))
    dealt = found.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    tiles = dealt.repartition(max(tasks, 2 * blocks * (blocks + 1)), "i", "j").sortWithinPartitions("i", "j")
    return tiles.mapInArrow(released(_in_tiles(least)), PAIRS)


def agreeing(m: np.ndarray) -> np.ndarray:
    """The largest set of matches (rows of a's y, x, scale, turn and b's) that one turn, scaling and shift explains, no feature twice."""
    turn = (m[:, 7] - m[:, 3]) % TURNS
    scale = 2.0 ** ((m[:, 6] - m[:, 2]) / 2)
    angle = 2 * np.pi * turn / TURNS
    a, b = m[:, 1] + 1j * m[:, 0], m[:, 5] + 1j * m[:, 4]
    factor = scale * np.exp(1j * angle)
    best = np.zeros(0, np.int64)
    for i in range(len(m)):  # each match as the hypothesis; the others are mapped by it
        turned = np.abs((turn - turn[i] + TURNS // 2) % TURNS - TURNS // 2) <= TURN
        away = np.abs(b[i] + factor[i] * (a - a[i]) - b)
        on = turned & (np.abs(m[:, 6] - m[:, 2] - m[i, 6] + m[i, 2]) <= 1) & (away <= np.maximum(SHIFT * max(1.0, scale[i]), 0.2 * np.abs(b - b[i])))
        held = np.flatnonzero(on)
        if len(held) > len(best):
            held = held[np.argsort(away[held], kind="stable")]
            for side in (slice(0, 2), slice(4, 6)):  # of matches at one place the nearest
                held = held[np.sort(np.unique(m[held][:, side], axis=0, return_index=True)[1])]
            if len(held) > len(best):
                best = held
    return best


def _sampled(image: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Grey levels between pixels at complex places x + iy; not a number outside."""
    x, y = at.real, at.imag
    height, width = image.shape
    inside = (x >= 0) & (y >= 0) & (x <= width - 1) & (y <= height - 1)
    x, y = np.clip(x, 0, width - 1), np.clip(y, 0, height - 1)
    x0, y0 = np.minimum(x.astype(np.int64), width - 2), np.minimum(y.astype(np.int64), height - 2)
    u, v = x - x0, y - y0
    value = (image[y0, x0] * (1 - u) + image[y0, x0 + 1] * u) * (1 - v) + (image[y0 + 1, x0] * (1 - u) + image[y0 + 1, x0 + 1] * u) * v
    return np.where(inside, value, np.nan)


_PATCH = (np.arange(-SIDE, SIDE + 1)[None, :] + 1j * np.arange(-SIDE, SIDE + 1)[:, None]).ravel()


def correlating(one: np.ndarray, two: np.ndarray, m: np.ndarray) -> int:
    """How many of the agreeing matches have like pixels around them, under the similarity fitted to all of them."""
    a, b = m[:, 1] + 1j * m[:, 0], m[:, 5] + 1j * m[:, 4]
    centre = a - a.mean()
    factor = (np.conj(centre) * (b - b.mean())).sum() / max(1e-9, (np.abs(centre) ** 2).sum())
    if not 0.2 < abs(factor) < 5:
        return 0
    one, two = one.astype(np.float64), two.astype(np.float64)
    there = lambda at: b.mean() + factor * (at - a.mean())
    x, y = (np.linspace(v.min() - SIDE, v.max() + SIDE, 64) for v in (a.real, a.imag))
    box = (x[None, :] + 1j * y[:, None]).reshape(1, -1)
    if not _correlation(_sampled(one, box), _sampled(two, there(box)))[0] >= LEAST_OVERALL:
        return 0
    at = a[:, None] + _PATCH[None, :] * max(1.0, 1 / abs(factor))  # in the finer of both rasters places lie further apart
    return int((_correlation(_sampled(one, at), _sampled(two, there(at))) >= LEAST_CORRELATION).sum())


def _correlation(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each row's places that both know; -1 where these are under a third."""
    known = np.isfinite(p) & np.isfinite(q)
    n = known.sum(1)
    p, q = (np.where(known, v, 0) for v in (p, q))
    p, q = (np.where(known, v - v.sum(1, keepdims=True) / np.maximum(n, 1)[:, None], 0) for v in (p, q))
    return np.where(n >= p.shape[1] // 3, (p * q).sum(1) / np.sqrt(np.maximum((p * p).sum(1) * (q * q).sum(1), 1e-9)), -1.0)


def _consensus(matches: DataFrame, found: DataFrame, images_of, scratch: Scratch) -> DataFrame:
    """Links (a, b) of images whose matches agree and whose pixels correlate; a match may be there once for each band."""
    matches = matches.repartition("a_node", "b_node").distinct()  # shuffled once for the match, the count and the join
    enough = matches.groupBy("a_node", "b_node").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_MATCHES).select("a_node", "b_node")
    pairs = matches.join(enough.hint("merge"), ["a_node", "b_node"])
    side = lambda s: found.select(F.col("node").alias(f"{s}_node"), F.col("spot").alias(f"{s}_spot"), *[F.col(c).alias(f"{s}_{c}") for c in ("y", "x", "scale", "turn")])
    columns = [f"{s}_{c}" for s in "ab" for c in ("y", "x", "scale", "turn")]
    pairs = pairs.join(side("a").hint("merge"), ["a_node", "a_spot"]).join(side("b").hint("merge"), ["b_node", "b_spot"]).select("a_node", "b_node", *columns)

    def agree(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        m, a, b = np.stack([table.column(c).to_numpy() for c in columns], 1).astype(np.int64), table.column("a_node").to_numpy(), table.column("b_node").to_numpy()
        order = np.lexsort((*m.T[::-1], b, a))
        m, a, b = m[order], a[order], b[order]
        cut = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), len(a)]
        out = []
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            on = agreeing(m[i:j])
            if len(on) >= LEAST_AGREEING:
                out.append((int(a[i]), int(b[i]), m[i:j][on].ravel().tolist()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.list_(pa.int64()))], ["a", "b", "m"])

    def check(batches):
        for batch in batches:
            on = []
            for one, two, m in zip(*(batch.column(c).to_pylist() for c in ("one", "two", "m")), strict=True):
                on.append(correlating(from_pgm(one), from_pgm(two), np.array(m).reshape(-1, 8)) >= LEAST_AGREEING)
            yield batch.select(["a", "b"]).filter(pa.array(on, pa.bool_()))

    agreed = scratch.write(pairs.repartition("a_node", "b_node").mapInArrow(released(agree), "a long, b long, m array<long>"), "agreed")
    pixels = scratch.write(images_of(agreed.select(F.col("a").alias("node")).union(agreed.select("b")).distinct()), "pixels")
    image = lambda k, c: pixels.select(F.col("node").alias(k), F.col("image").alias(c)).hint("merge")
    return agreed.join(image("a", "one"), "a").join(image("b", "two"), "b").select("a", "b", "m", "one", "two").mapInArrow(released(check), "a long, b long")


def copies(df: DataFrame, id_col: str, image_col: str) -> DataFrame:
    """id, n_features, component_id and kept for every row; equal images share their features."""
    scratch = Scratch(df.sparkSession, "images")
    rows = pick(df, id=id_col, image=image_col).withColumn("hash", F.xxhash64("image")).withColumn("digest", F.md5("image"))
    classes = rows.groupBy("hash", "digest").agg(F.min("id").alias("least"))
    classes = scratch.write(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    each = ["hash", "digest"]

    def images_of(nodes: DataFrame | None = None) -> DataFrame:
        """(node, image) of all classes or of some nodes; images are read again, never kept."""
        wanted = classes if nodes is None else classes.join(nodes.hint("merge"), "node", "left_semi")
        some = rows if nodes is None else rows.join(wanted.select(*each).hint("merge"), each, "left_semi")
        return some.groupBy(*each).agg(F.first("image").alias("image")).join(wanted.select(*each, "node").hint("merge"), each).select("node", "image")

    found = scratch.write(features(images_of()), "features")
    bucketed = _bucketed(found)
    tasks = tasks_for(found, FEATURE_BYTES)
    end = lambda f: f(F.struct("node", "spot", "high", "low"))
    sizes = scratch.write(bucketed.groupBy("bucket").agg(F.count("*").alias("n"), end(F.min).alias("least"), end(F.max).alias("greatest")).filter("n > 1"), "buckets")
    first = scratch.write(_first_matches(bucketed, sizes, tasks), "matches")
    links = scratch.write(_consensus(first, found, images_of, scratch), "links")
    group = scratch.write(components(links, scratch), "components")
    own = scratch.write(_grouped(found.select("node", "spot", "high", "low"), group), "grouped")
    further = scratch.write(_further_matches(own, sizes, None, tasks, LEAST_MATCHES), "matches")
    more = scratch.write(_consensus(further, found, images_of, scratch), "links")
    if not more.isEmpty():
        group = scratch.write(components(links.union(more), scratch), "components")
    of_node = classes.select("node", "hash", "digest", "least").join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of_node.groupBy("component").agg(F.min("least").alias("component_id"))
    count = found.groupBy("node").agg(F.count("*").alias("n_features"))
    of_class = scratch.write(of_node.join(least, "component").join(count, "node", "left").select("hash", "digest", "component_id", F.coalesce("n_features", F.lit(0)).alias("n_features")), "result")
    good = rows.filter("image is not null").drop("image").join(of_class, ["hash", "digest"]).select("id", "n_features", "component_id")
    none = rows.filter("image is null").select("id", F.lit(0).cast("long").alias("n_features"), F.col("id").alias("component_id"))
    return good.union(none).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


_patterns: dict[int, np.ndarray] = {}


def _basis(n: int) -> np.ndarray:
    """A smooth random pattern for each of ``n`` components, of mean 0 and variance 1."""
    if n not in _patterns:
        noise = np.random.default_rng([8, n]).standard_normal((n, DRAWN, DRAWN))
        smooth = _box(_box(noise, 2), 1)
        smooth -= smooth.mean((1, 2), keepdims=True)
        _patterns[n] = (smooth / smooth.std((1, 2), keepdims=True)).reshape(n, -1)
    return _patterns[n]


def draw_vectors(column: pa.Array) -> pa.Array:
    """A raster for each vector: the sum of one smooth pattern for each component, weighted by the standardised components."""
    out = []
    for v in column.to_pylist():
        if not v or None in v or not np.isfinite(v).all() or np.std(v) == 0:
            out.append(None)
            continue
        v = (np.array(v, float) - np.mean(v)) / np.std(v)
        out.append(to_pgm(np.clip(128 + SPREAD * (v @ _basis(len(v))).reshape(DRAWN, DRAWN) / np.sqrt(len(v)), 0, 255)))
    return pa.array(out, pa.binary())


draw_udf = F.arrow_udf(draw_vectors, T.BinaryType())
