"""Masks as bit-packed words: filling, overlap, painting order, run-length records.

A mask of height x width pixels is an array of longs, ceil(width / 64) for each
row; pixel x of a row is bit x % 64 of word x / 64.  Areas and intersections are
bit operations on whole words, polygons and run lengths are turned into words,
all by NumPy for the masks of an Arrow batch at once.  No pixel ever becomes a
row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_per_row(width: int) -> int:
    return -(-width // 64)


def packed(mask: np.ndarray) -> np.ndarray:
    """Words of a boolean height x width array."""
    height, width = mask.shape
    wide = np.zeros((height, 64 * words_per_row(width)), bool)
    wide[:, :width] = mask
    return np.packbits(wide, axis=1, bitorder="little").view("<i8").ravel()


def unpacked(words: np.ndarray, height: int, width: int) -> np.ndarray:
    rows = np.ascontiguousarray(words, "<i8").reshape(height, -1).view(np.uint8)
    return np.unpackbits(rows, axis=1, bitorder="little")[:, :width].astype(bool)


def polygons_words(xs: np.ndarray, ys: np.ndarray, sizes: np.ndarray, height: int, width: int) -> np.ndarray:
    """Words, a row for each polygon, of the pixels whose centres it holds (even-odd rule); xs and ys are the points of all, sizes how many each has.

    An edge that crosses the middle of a row turns all pixels to the right of
    the crossing; so the work is edges times the rows they cross, plus the words.
    """
    n, many = words_per_row(width), len(sizes)
    owner = np.repeat(np.arange(many), sizes)
    ends = np.cumsum(sizes)
    following = np.arange(1, len(xs) + 1)
    following[ends[sizes > 0] - 1] = (ends - sizes)[sizes > 0]
    x1, y1, x2, y2 = xs, ys, xs[following], ys[following]
    low = np.clip(np.floor(np.minimum(y1, y2)) - 1, 0, height).astype(np.int64)
    high = np.clip(np.ceil(np.maximum(y1, y2)) + 1, 0, height).astype(np.int64)
    rows_of = np.where(y1 == y2, 0, np.maximum(high - low, 0))
    edge = np.repeat(np.arange(len(xs)), rows_of)
    row = np.arange(len(edge)) - np.repeat(np.cumsum(rows_of) - rows_of, rows_of) + low[edge]
    y = row + 0.5
    crossing = (y1[edge] > y) != (y2[edge] > y)
    edge, row, y = edge[crossing], row[crossing], y[crossing]
    at = (x2[edge] - x1[edge]) * (y - y1[edge]) / (y2[edge] - y1[edge]) + x1[edge]
    start = np.clip(np.ceil(at - 0.5), 0, 64 * n).astype(np.int64)
    words, right = np.zeros((many, height, n + 1), np.uint64), np.zeros((many, height, n + 1), np.uint64)
    place = (owner[edge] * height + row) * (n + 1) + start // 64
    np.bitwise_xor.at(words.reshape(-1), place, ALL << (start % 64).astype(np.uint64))
    np.bitwise_xor.at(right.reshape(-1), place[start < 64 * n] + 1, ALL)
    words = (words ^ np.bitwise_xor.accumulate(right, axis=2))[:, :, :n]
    if width % 64:
        words[:, :, -1] &= ALL >> np.uint64(64 - width % 64)
    return np.ascontiguousarray(words).view(np.int64).reshape(many, height * n)


def polygon_words(xs: np.ndarray, ys: np.ndarray, height: int, width: int) -> np.ndarray:
    """Words of one polygon."""
    return polygons_words(xs, ys, np.array([len(xs)]), height, width)[0]


def flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """Elements of all lists, and how many each has; null counts as empty."""
    return lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def rows_as_lists(rows: np.ndarray) -> pa.ListArray:
    many, size = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(many + 1, dtype=np.int32) * size), pa.array(rows.reshape(-1)))


def around_nulls(rows: pa.Array, f) -> pa.Array:
    """f of the rows that aren't null; null stays null."""
    out = f(rows.drop_null())
    if not rows.null_count:
        return out
    there = rows.is_valid().to_numpy(zero_copy_only=False)
    return out.take(pa.array(np.cumsum(there) - 1, mask=~there))


def in_steps(f, rows: pa.Array, step: int) -> pa.Array:
    """f over some rows at once, so that no more of them are unpacked."""
    parts = [f(rows.slice(i, step)) for i in range(0, len(rows), step)]
    return pa.concat_arrays(parts) if parts else f(rows)


def fill_all(polygons: pa.Array, height: int, width: int) -> np.ndarray:
    """Words, a row for each list of (x, y)."""
    corners, sizes = flat(polygons)
    x, y = (pc.struct_field(corners, c).to_numpy(zero_copy_only=False).astype(float) for c in "xy")
    held = np.repeat(sizes >= 3, sizes)
    return polygons_words(x[held], y[held], np.where(sizes >= 3, sizes, 0), height, width)


def filled(points: Column, height: int, width: int, words_at_once: int = 1 << 21) -> Column:
    """Mask of an array of (x, y); null or fewer than three points are an empty mask."""
    step = max(1, words_at_once // (height * (words_per_row(width) + 1)))

    @F.arrow_udf("array<long>")
    def fill(polygons: pa.Array) -> pa.Array:
        return in_steps(lambda p: rows_as_lists(fill_all(p, height, width)), polygons, step)

    return fill(points)


def filled_counts(points: Column, height: int, width: int, words_at_once: int = 1 << 21) -> Column:
    """area, widest (pixels of the fullest row) and rows (that have pixels) of the mask of a polygon, which doesn't leave the task."""
    step = max(1, words_at_once // (height * (words_per_row(width) + 1)))

    def some(polygons: pa.Array) -> pa.Array:
        by_row = np.bitwise_count(fill_all(polygons, height, width).view(np.uint64)).reshape(len(polygons), height, -1).sum(2, dtype=np.int64)
        return pa.StructArray.from_arrays([pa.array(x) for x in (by_row.sum(1), by_row.max(1), np.count_nonzero(by_row, 1))], ["area", "widest", "rows"])

    @F.arrow_udf("area long, widest long, rows long")
    def count(polygons: pa.Array) -> pa.Array:
        return in_steps(some, polygons, step)

    return count(points)


def filled_with_area(points: Column, height: int, width: int, words_at_once: int = 1 << 21) -> Column:
    """mask and area of a polygon, found together."""
    step = max(1, words_at_once // (height * (words_per_row(width) + 1)))

    def some(polygons: pa.Array) -> pa.Array:
        words = fill_all(polygons, height, width)
        return pa.StructArray.from_arrays([rows_as_lists(words), pa.array(np.bitwise_count(words.view(np.uint64)).sum(1, dtype=np.int64))], ["mask", "area"])

    @F.arrow_udf("mask array<long>, area long")
    def fill(polygons: pa.Array) -> pa.Array:
        return in_steps(some, polygons, step)

    return fill(points)


def filled_overlap(points: Column, l_points: Column, height: int, width: int, words_at_once: int = 1 << 20) -> Column:
    """area, l_area and both of the masks of two polygons, which don't leave the task."""
    step = max(1, words_at_once // (height * (words_per_row(width) + 1)))

    def some(polygons: pa.Array) -> pa.Array:
        a, b = (fill_all(pc.struct_field(polygons, c), height, width) for c in "ab")
        count = lambda words: pa.array(np.bitwise_count(words.view(np.uint64)).sum(1, dtype=np.int64))
        return pa.StructArray.from_arrays([count(a), count(b), count(a & b)], ["area", "l_area", "both"])

    @F.arrow_udf("area long, l_area long, both long")
    def overlap(a: pa.Array, b: pa.Array) -> pa.Array:
        return in_steps(some, pa.StructArray.from_arrays([a, b], ["a", "b"]), step)

    return overlap(points, l_points)


def set_bits(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Set bits of each run of so many words."""
    upto = np.concatenate(([0], np.cumsum(np.bitwise_count(words.view(np.uint64)), dtype=np.int64)))
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes]


def area(mask: str | Column) -> Column:
    """Pixels that are set."""

    def count(masks: pa.Array) -> pa.Array:
        words, sizes = flat(masks)
        return pa.array(set_bits(words.to_numpy(), sizes))

    @F.arrow_udf("long")
    def pixels(masks: pa.Array) -> pa.Array:
        return around_nulls(masks, count)

    return pixels(F.col(mask) if isinstance(mask, str) else mask)


def intersection(a: Column, b: Column) -> Column:
    """Pixels that both masks, of one size, set."""

    @F.arrow_udf("long")
    def both(x: pa.Array, y: pa.Array) -> pa.Array:
        (p, sizes), (q, others) = flat(x), flat(y)
        if (sizes != others).any():
            raise ValueError("masks of unlike sizes")
        return pa.array(set_bits(p.to_numpy() & q.to_numpy(), sizes))

    return both(a, b)


def compared(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs whose masks reach an IoU, in the shape of evaluate.overlaps; pairs carry area, l_area and both, the pixels of either mask and of their intersection."""
    sized = pairs.where("both > 0").withColumn("iou", F.col("both") / (F.col("area") + F.col("l_area") - F.col("both") + 1e-7))
    return sized.where(F.col("iou") >= least).select("image_id", "det_id", "class_id", "conf", "label_id", "label_class", "iou")


def met(labels: DataFrame, detections: DataFrame, columns: list[str], by_class: bool = True) -> DataFrame:
    """All pairs of one image (and class); the columns of labels have l_ before their names."""
    lab = labels.select(F.col("image_id").alias("l_image"), "label_id", F.col("class_id").alias("label_class"), *(F.col(c).alias(f"l_{c}") for c in columns))
    on = [F.col("image_id") == F.col("l_image")] + ([F.col("class_id") == F.col("label_class")] if by_class else [])
    return detections.select("image_id", "det_id", "class_id", "conf", *columns).join(lab, on)


def mask_overlaps(labels: DataFrame, detections: DataFrame, least: float = 0.5, by_class: bool = True) -> DataFrame:
    """Pairs of one image (and class) whose masks reach an IoU, in the shape of evaluate.overlaps; both tables carry mask."""
    pairs = met(labels, detections, ["mask"], by_class)
    return compared(pairs.withColumns({"both": intersection(F.col("mask"), F.col("l_mask")), "area": area("mask"), "l_area": area("l_mask")}), least)


def hidden_by_later(masks: np.ndarray, image: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For each mask the bits of all masks of its image that stand before it; rows are by image, and before holds what the first image has so far."""
    begins = np.flatnonzero(np.diff(image, prepend=image[0] - 1))
    place = np.arange(len(image)) - np.repeat(begins, np.diff(np.append(begins, len(image))))
    order = np.argsort(place, kind="stable")
    ends = np.cumsum(np.bincount(place))
    out = np.zeros_like(masks)
    out[0] = before
    for i, k in zip(ends[:-1], ends[1:], strict=True):  # the second of each image, the third of each ...
        at = order[i:k]
        out[at] = out[at - 1] | masks[at - 1]
    return out


def painted(masks: DataFrame, words: int, count: bool = False) -> DataFrame:
    """masks(image_id, label_id, mask) painted from the largest to the smallest: rank, area and what stays visible, as words or with count as a number of pixels.

    Of equal areas the smaller label_id is painted first.  area is taken from
    masks if they have it.  Rows of an image come sorted from the last painted
    on, and the bits so far go along from batch to batch: a task holds a batch
    and the bits so far, however many labels an image has.
    """
    kinds = dict(masks.dtypes)

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, so_far = None, np.zeros(words, np.int64)
        for b in batches:
            if not len(b):
                continue
            mask, image = b.column("mask"), b.column("image_id")
            there = mask.is_valid().to_numpy(zero_copy_only=False)
            rows = np.zeros((len(b), words), np.int64)
            rows[there] = flat(mask)[0].to_numpy().reshape(-1, words)
            first = image[0].as_py()
            number = image.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            before = hidden_by_later(rows, number, so_far if (first,) == last else np.zeros(words, np.int64))
            last, so_far = (image[len(b) - 1].as_py(),), before[-1] | rows[-1]
            left = rows & ~before
            seen = pa.array(np.bitwise_count(left.view(np.uint64)).sum(1, dtype=np.int64), mask=~there) if count else rows_as_lists(left)
            if not count and not there.all():
                seen = pc.if_else(pa.array(there), seen, pa.scalar(None, seen.type))
            names = ["image_id", "label_id", "rank", "area"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), seen], names=[*names, "visible"])

    rows = masks.select("image_id", "label_id", "mask", F.col("area") if "area" in kinds else area("mask").alias("area"))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("area"), F.asc("label_id")))
    rows = rows.withColumn("rank", rank).sortWithinPartitions("image_id", F.desc("rank"))
    return rows.mapInArrow(paint, f"image_id {kinds['image_id']}, label_id {kinds['label_id']}, rank int, area long, visible {'long' if count else 'array<long>'}")


def counts_of_all(words: np.ndarray, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Column-major run lengths of masks, a row of words each, beginning with the zeros; and how many each mask has."""
    many, total = len(words), height * width
    bits = np.unpackbits(np.ascontiguousarray(words, "<i8").reshape(many, height, words_per_row(width)).view(np.uint8), axis=2, bitorder="little")[:, :, :width]
    line = np.ascontiguousarray(bits.transpose(0, 2, 1)).reshape(many, total)
    turns = line.copy()
    turns[:, 1:] ^= line[:, :-1]
    at = np.flatnonzero(turns.view(bool))
    sizes = np.bincount(at // total, minlength=many) + 1
    last = np.cumsum(sizes) - 1
    start, end = np.zeros(sizes.sum(), np.int64), np.full(sizes.sum(), total)
    inner = np.ones(len(start), bool)
    inner[last] = False
    end[inner] = at % total
    start[1:][inner[:-1]] = end[inner]
    return end - start, sizes


def words_of_all(counts: np.ndarray, sizes: np.ndarray, height: int, width: int) -> np.ndarray:
    """Words, a row for each mask, of the run lengths of all."""
    ends = np.cumsum(sizes)
    upto = np.concatenate(([0], np.cumsum(counts)))
    if (upto[ends] - upto[ends - sizes] != height * width).any():
        raise ValueError(f"run lengths don't add up to {height} x {width}")
    odd = (np.arange(len(counts)) - np.repeat(ends - sizes, sizes)) % 2 == 1
    wide = np.zeros((len(sizes), height, 64 * words_per_row(width)), bool)
    wide[:, :, :width] = np.repeat(odd, counts).reshape(len(sizes), width, height).transpose(0, 2, 1)
    return np.packbits(wide, axis=2, bitorder="little").view("<i8").reshape(len(sizes), height * words_per_row(width))


def compressed_all(counts: np.ndarray, sizes: np.ndarray) -> pa.StringArray:
    """The COCO strings: from the third on differences to the count before the last, five bits a character, 32 for more, from '0' on."""
    ends = np.cumsum(sizes)
    place = np.arange(len(counts)) - np.repeat(ends - sizes, sizes)
    x = counts.copy()
    x[2:] -= np.where(place[2:] > 2, counts[:-2], 0)
    letters, used, more = [], [], np.ones(len(x), bool)
    while more.any():
        low = x & 31
        x = x >> 5
        used.append(more)
        onward = x != np.where(low & 16, -1, 0)
        letters.append((low + 32 * onward + 48).astype(np.uint8))
        more = more & onward
    many = np.stack(used, 1) if used else np.zeros((0, 1), bool)
    upto = np.concatenate(([0], np.cumsum(many.sum(1))))
    text = np.stack(letters, 1)[many] if used else np.zeros(0, np.uint8)
    offsets = np.concatenate(([0], upto[ends])).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(text))


def decompressed_all(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all strings, and how many each has."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    letter = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8).astype(np.int64) - 48
    end = (letter & 32) == 0
    stop = np.cumsum(size)
    if not end[stop[size > 0] - 1].all():
        raise ValueError("a run-length string breaks off")
    found = np.concatenate(([0], np.cumsum(end)))
    sizes = found[stop] - found[stop - size]
    last = np.flatnonzero(end)
    first = np.concatenate(([0], last[:-1] + 1))[: len(last)]
    shift = 5 * (np.arange(len(letter)) - np.repeat(first, last + 1 - first))
    x = np.add.reduceat((letter & 31) << shift, first) if len(first) else np.zeros(0, np.int64)
    x -= np.where(letter[last] & 16, 1 << (shift[last] + 5), 0)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    chain = 3 * owner + np.where(place == 0, 0, 1 + place % 2)  # the first, then every second from the third and from the second on
    order = np.argsort(chain, kind="stable")
    total = np.concatenate(([0], np.cumsum(x[order])))
    begins = np.flatnonzero(np.diff(chain[order], prepend=-1))
    base = np.repeat(total[begins], np.diff(np.append(begins, len(x))))
    counts = np.empty_like(x)
    counts[order] = total[1:] - base
    return counts, sizes


def counts_of(words: np.ndarray, height: int, width: int) -> list[int]:
    """Column-major run lengths of one mask, beginning with the zeros."""
    return counts_of_all(words[None], height, width)[0].tolist()


def words_of(counts: list[int], height: int, width: int) -> np.ndarray:
    return words_of_all(np.array(counts), np.array([len(counts)]), height, width)[0]


def compressed(counts: list[int]) -> str:
    return compressed_all(np.array(counts, np.int64), np.array([len(counts)]))[0].as_py()


def decompressed(text: str) -> list[int]:
    return decompressed_all(pa.array([text]))[0].tolist()


def encoded(mask: Column, height: int, width: int, pixels_at_once: int = 1 << 24) -> Column:
    """The compressed run-length string of a mask; null stays null."""
    step = max(1, pixels_at_once // (height * width))

    def some(masks: pa.Array) -> pa.Array:
        words, _ = flat(masks)
        return compressed_all(*counts_of_all(words.to_numpy().reshape(len(masks), height * words_per_row(width)), height, width))

    @F.arrow_udf("string")
    def encode(masks: pa.Array) -> pa.Array:
        return around_nulls(masks, lambda m: in_steps(some, m, step))

    return encode(mask)


def decoded(counts: Column, height: int, width: int, pixels_at_once: int = 1 << 24) -> Column:
    """The mask of a compressed run-length string; null stays null."""
    step = max(1, pixels_at_once // (height * width))

    def some(texts: pa.Array) -> pa.Array:
        return rows_as_lists(words_of_all(*decompressed_all(texts), height, width))

    @F.arrow_udf("array<long>")
    def decode(texts: pa.Array) -> pa.Array:
        return around_nulls(texts, lambda t: in_steps(some, t, step))

    return decode(counts)


def record(height: int, width: int) -> Column:
    """A detection with its mask as a JSON line: image_id, category_id, bbox (corner and size, 3 places), score (5 places), segmentation."""
    box = F.array(*(F.round(c, 3) for c in (F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))))
    shape = F.array(F.lit(height), F.lit(width))
    segmentation = F.struct(shape.alias("size"), encoded(F.col("mask"), height, width).alias("counts"))
    return F.to_json(F.struct("image_id", F.col("class_id").alias("category_id"), box.alias("bbox"), F.round("conf", 5).alias("score"), segmentation.alias("segmentation")))


RECORD = "image_id long, category_id long, bbox array<double>, score double, segmentation struct<size: array<int>, counts: string>"


def write_records(detections: DataFrame, path: str, height: int, width: int) -> None:
    """A JSON line for each row of detections(image_id, class_id, conf, x1, y1, x2, y2, mask)."""
    detections.select(record(height, width).alias("value")).write.text(path)


def read_records(spark, path: str, height: int, width: int) -> DataFrame:
    """image_id, class_id, conf, bbox, counts and mask of records of one size; records of another size raise an error."""
    rows = spark.read.schema(RECORD).json(path)
    fits = F.col("segmentation.size") == F.array(F.lit(height), F.lit(width))
    counts = F.when(fits, F.col("segmentation.counts")).otherwise(F.raise_error(F.lit(f"a mask is not {height} x {width}")))
    rows = rows.select("image_id", F.col("category_id").alias("class_id"), F.col("score").alias("conf"), "bbox", counts.alias("counts"))
    return rows.withColumn("mask", decoded(F.col("counts"), height, width))
