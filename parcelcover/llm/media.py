"""Cropped and edited copies among images, by local descriptors.

Corners are found at several scales; around each, the direction to the intensity centroid gives an
orientation, and brightness tests between pairs of points, turned by it, give a 256-bit descriptor.
Descriptors that agree in one of eight 32-bit tables meet in a join (any two within seven bits do, and most of
those somewhat further); those near enough in all bits are matches. Each match says how one image would have to be turned, scaled and moved; a
pair of images in which enough corners say the same is linked, and links give classes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelcover.llm.components import components
from parcelcover.plans.materialize import materialize, release, sweep

#: Corners kept for each scale (the strongest), scales, radius of the tested patch, bits.
CORNERS, SCALES, RADIUS, BITS = 32, (1.0, 0.7071, 0.5), 8, 256
#: Most differing bits of a match; corners that must agree on the same movement; cell of a movement in pixels.
NEAR, AGREE, CELL = 24, 5, 6
#: Tables of descriptor parts, and parts of them that are shuffled one after the other, which bounds the disk in use.
TABLES, SLICES = 8, 8
#: Corners of one table key that are joined pair by pair at once; beyond, each meets so many hub images first, and in
#: a second pass, in blocks of so many, those of other classes.
BUCKET, HUBS, BLOCK = 24, 2, 2048
TURN = 30
#: Ids of repeated images that are sent to all at most; beyond, the images are shuffled.
FEW = 1 << 20

_rng = np.random.default_rng(5)
_TESTS = np.clip(_rng.normal(0, RADIUS / 2.2, (BITS, 4)), -RADIUS, RADIUS)


def decode(image: bytes | None) -> np.ndarray | None:
    """A binary grey-map (P5, maxval 255) as an array; None for anything else."""
    if not image or not image.startswith(b"P5"):
        return None
    parts = image.split(None, 4)
    try:
        w, h = int(parts[1]), int(parts[2])
        return np.frombuffer(image[-w * h :], np.uint8).reshape(h, w) if w * h else None
    except (ValueError, IndexError):
        return None


def encode(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape
    return b"P5\n%d %d\n255\n" % (w, h) + pixels.astype(np.uint8).tobytes()


def _blur(x: np.ndarray) -> np.ndarray:
    for axis in (0, 1):
        p = np.pad(x, [(2, 2) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        n = x.shape[axis]
        x = sum(wt * np.take(p, np.arange(k, k + n), axis) for k, wt in enumerate((1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16)))
    return x


def _resize(x: np.ndarray, scale: float) -> np.ndarray:
    h, w = max(1, round(x.shape[0] * scale)), max(1, round(x.shape[1] * scale))
    return _sample(x, np.repeat(np.arange(h)[:, None] / scale, w, 1), np.repeat(np.arange(w)[None] / scale, h, 0))


def _sample(x: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Bilinear values at rows r and columns c."""
    r, c = np.clip(r, 0, x.shape[0] - 1.001), np.clip(c, 0, x.shape[1] - 1.001)
    i, j = r.astype(int), c.astype(int)
    i2, j2 = np.minimum(i + 1, x.shape[0] - 1), np.minimum(j + 1, x.shape[1] - 1)
    u, v = r - i, c - j
    return (x[i, j] * (1 - u) + x[i2, j] * u) * (1 - v) + (x[i, j2] * (1 - u) + x[i2, j2] * u) * v


_DISC = np.array([(r, c) for r in range(-RADIUS, RADIUS + 1) for c in range(-RADIUS, RADIUS + 1) if r * r + c * c <= RADIUS * RADIUS])


def features(pixels: np.ndarray) -> list[tuple]:
    """(place, four 64-bit parts of the descriptor) of an image's corners; place packs row and column in quarters, scale step and degrees."""
    out = []
    for step, scale in enumerate(SCALES):
        x = _blur(_resize(pixels.astype(float), scale) if scale != 1 else pixels.astype(float))
        if min(x.shape) < 2 * RADIUS + 3:
            continue
        gy, gx = np.gradient(x)
        a, b, c = _blur(gx * gx), _blur(gx * gy), _blur(gy * gy)
        strength = a * c - b * b - 0.05 * (a + c) ** 2
        inner = strength[RADIUS:-RADIUS, RADIUS:-RADIUS]
        around = np.lib.stride_tricks.sliding_window_view(strength[RADIUS - 1 : -RADIUS + 1, RADIUS - 1 : -RADIUS + 1], (3, 3)).max((2, 3))
        r, k = np.nonzero((inner >= around) & (inner > 1.0))
        best = np.lexsort((k, r, -inner[r, k]))[:CORNERS]
        r, k = r[best] + RADIUS, k[best] + RADIUS
        if not len(r):
            continue
        patch = x[r[:, None] + _DISC[:, 0], k[:, None] + _DISC[:, 1]]
        patch = patch - patch.mean(1, keepdims=True)
        angle = np.arctan2(patch @ _DISC[:, 0], patch @ _DISC[:, 1])
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
        p = [_sample(x, r[:, None] + sin * _TESTS[:, m + 1] + cos * _TESTS[:, m], k[:, None] + cos * _TESTS[:, m + 1] - sin * _TESTS[:, m]) for m in (0, 2)]
        parts = np.packbits(p[0] < p[1], axis=1).view(">i8").astype(np.int64)
        degrees = np.degrees(angle).astype(int) % 360
        place = (np.rint(4 * r / scale).astype(np.int64) << 40) | (np.rint(4 * k / scale).astype(np.int64) << 16) | (step << 12) | degrees
        out += [(int(a), *map(int, q)) for a, q in zip(place, parts, strict=True)]
    return out


def describe(images: DataFrame) -> DataFrame:
    """(id, at, d0 to d3) of the corners of every image of images (id long, image binary)."""

    def run(batches):
        for b in batches:
            rows = [(i, *f) for i, image in zip(b.id.tolist(), b.image, strict=True) if (p := decode(image)) is not None for f in features(p)]
            yield pd.DataFrame(rows, columns=["id", "at", "d0", "d1", "d2", "d3"])

    return images.mapInPandas(run, "id long, at long, d0 long, d1 long, d2 long, d3 long")


_PARTS = ["d0", "d1", "d2", "d3"]


def _side(rows: DataFrame, s: str, *more: str) -> DataFrame:
    """rows with s before the names of a corner's columns; those of the join stay."""
    return rows.select("key", *[c for c in ("i", "j") if c in rows.columns], *[F.col(c).alias(f"{s}_{c}") for c in ("id", "at", *_PARTS, *more)])


def _close(near: int):
    return sum((F.bit_count(F.col(f"a_{k}").bitwiseXOR(F.col(f"b_{k}"))) for k in _PARTS), F.lit(0)) <= near


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs with the smaller id as a, each once."""
    less = F.col("a_id") < F.col("b_id")
    turned = [F.when(less, F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}")).alias(f"{x}_{c}") for x, y in ("ab", "ba") for c in ("id", "at")]
    return pairs.select(*turned).distinct()


def slice_keys(found: DataFrame, part: int, slices: int = SLICES) -> DataFrame:
    """(key, n, id, at, d0 to d3) of the corners and table keys of one slice that more than one image has; n is the key's corners.

    Most keys belong to one corner and go no further.
    """
    key = lambda t: (F.shiftrightunsigned(F.col(_PARTS[t // 2]), 32) if t % 2 else F.col(_PARTS[t // 2]).bitwiseAND(F.lit(0xFFFFFFFF))) + F.lit(t << 32)
    keys = F.explode(F.array(*[key(t) for t in range(part, TABLES, slices)])).alias("key")
    n = found.select("id", keys).groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    return found.select(keys, "id", "at", *_PARTS).join(n.where("low < high").select("key", "n"), "key")


def shared_keys(found: DataFrame) -> list[DataFrame]:
    """slice_keys of every slice, each written."""
    out = []
    for part in range(SLICES):
        out.append(materialize(slice_keys(found, part), "keys"))
        sweep(found.sparkSession)
    return out


def matches(rows: DataFrame, near: int = NEAR, bucket: int = BUCKET) -> DataFrame:
    """Pairs of corners of different images (a, b, a < b) that share a table key and differ in near bits or fewer.

    A key with over bucket corners belongs to a pattern, or a group of copies, that very many images show. Its
    corners aren't joined pair by pair, which would give the square of the group: each corner meets the HUBS hub
    images of the most crowded of its keys, the smallest ids of HUBS hash classes. Copies have their hubs in common,
    corner after corner, so they link to the same few images, and over these to each other. Its other crowded keys
    would mostly show it the same hubs again; matches_between does the rest, whatever the hubs have found.
    """
    return few_matches(rows, near, bucket).unionByName(hub_matches(rows, near, bucket)).distinct()


def few_matches(rows: DataFrame, near: int = NEAR, bucket: int = BUCKET) -> DataFrame:
    """The matches of keys with few corners, as in matches."""
    some = rows.where(F.col("n") <= bucket)
    return _ordered(_side(some, "a").join(_side(some, "b"), "key").where((F.col("a_id") < F.col("b_id")) & _close(near)))


def hub_matches(rows: DataFrame, near: int = NEAR, bucket: int = BUCKET) -> DataFrame:
    """The matches of crowded keys with their hubs, as in matches; rows has the keys of all tables."""
    hot = rows.where(F.col("n") > bucket)
    hot = hot.groupBy("id", "at").agg(F.max(F.struct("n", "key", *_PARTS)).alias("most")).select("id", "at", "most.*")
    hubs = hot.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(HUBS)).alias("class")).agg(F.min(F.struct("id", "at", *_PARTS)).alias("h")).select("key", "h.*")
    star = _side(hubs, "a").join(_side(hot, "b"), "key").where((F.col("a_id") != F.col("b_id")) & _close(near))
    return _ordered(star)


def matches_between(rows: DataFrame, label: DataFrame, near: int = NEAR, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """The matches in crowded keys of images in different classes (label: node, label), as in matches.

    Images that the hubs have brought into one class need not meet again. In each key, the corners outside its
    largest class meet all that are in other classes than they; one class alone means no work. Both sides of a key
    are cut into blocks, so that no task has a whole key. The work grows with the corners outside the largest class
    times the corners of the key: only for a pattern that many images show that don't come into one class by it does
    that near the square.
    """
    # Corners and the class of their image meet in a window over the image, which has few corners, not in a join.
    hot = rows.where(F.col("n") > bucket).select("key", "n", "id", "at", *_PARTS)
    known = label.select(F.col("node").alias("id"), F.col("label").alias("class"))
    hot = hot.unionByName(known, allowMissingColumns=True).withColumn("class", F.coalesce(F.max("class").over(Window.partitionBy("id")), "id")).where("key is not null")
    hot = materialize(hot, "crowded")
    size = hot.groupBy("key", "class").agg(F.count("*").alias("c"))
    most = size.groupBy("key").agg(F.max(F.struct("c", "class")).alias("most"), F.count("*").alias("classes")).where("classes > 1").select("key", F.col("most.class").alias("most"))
    every_class, hot = hot, materialize(hot.join(most, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "contested")
    release(every_class)
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    own = F.pmod(F.xxhash64("id", "at"), F.col("blocks")).cast("int")
    out = hot.where(F.col("class") != F.col("most")).withColumn("i", own).withColumn("j", every)
    all_ = hot.withColumn("j", own).withColumn("i", every)
    met = _side(out, "a", "class").join(_side(all_, "b", "class"), ["key", "i", "j"])
    return _ordered(met.where((F.col("a_class") != F.col("b_class")) & _close(near)))


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def consensus(pairs: DataFrame, agree: int = AGREE, cell: int = CELL) -> DataFrame:
    """(a, b): images of whose matches at least agree, from different corners, tell the same movement.

    The movement's turn, scale step and shift are counted in cells, the shift in each of the four grids that
    are half a cell apart, so that a border between cells parts no agreeing matches.
    """
    part = lambda side, low, bits: F.shiftright(F.col(f"{side}_at"), low).bitwiseAND(F.lit((1 << bits) - 1))
    ya, xa, yb, xb = (part(side, low, 24) / 4 for side in "ab" for low in (40, 16))
    scaled, turn = part("a", 12, 4) - part("b", 12, 4), F.pmod(part("b", 0, 12) - part("a", 0, 12), F.lit(360))
    c, s = F.cos(F.radians(turn)), F.sin(F.radians(turn))
    ratio = F.pow(F.lit(SCALES[1]), scaled)
    dx = xb - ratio * (c * xa - s * ya)
    dy = yb - ratio * (s * xa + c * ya)
    votes = pairs.select("a_id", "b_id", (F.floor((turn + TURN / 2) / TURN) % (360 // TURN)).alias("turned"), scaled.alias("scaled"), dx.alias("dx"), dy.alias("dy"), F.floor(xa / 2).alias("cx"), F.floor(ya / 2).alias("cy"))
    grids = F.array(*[F.struct(F.floor(F.col("dx") / (2 * cell) + i / 2).alias("gx"), F.floor(F.col("dy") / (2 * cell) + j / 2).alias("gy"), F.lit(2 * i + j).alias("g")) for i in (0, 1) for j in (0, 1)])
    votes = votes.withColumn("grid", F.explode(grids))
    votes = votes.groupBy("a_id", "b_id", "turned", "scaled", "grid", "cx", "cy").count()
    return votes.groupBy("a_id", "b_id", "turned", "scaled", "grid").agg(F.count("*").alias("n")).where(F.col("n") >= agree).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()


def near_copies(images: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """id, class_id, n_links of every row of images (id, image).

    Equal bytes are one image, of the smallest id. n_links counts the linked images with other bytes (inside a
    crowded group, its hubs at least: such a group isn't written out as all its pairs); class_id is the smallest id
    over links and equal bytes, and the same as if all pairs of corners that share a key had been compared. Null, empty and unreadable images are in classes of their own (if
    their bytes are equal, too: nothing was compared). Repeated rows come back as often; a row without id keeps
    its class and has none if no other row shows the image. Other columns are left aside; an empty table gives an
    empty one.
    """
    image = F.col("image")
    d = materialize(images.select(F.col("id").cast("long").alias("id"), F.sha2(image, 256).alias("bytes"), F.coalesce(F.substring(image, 1, 2) == F.lit(b"P5"), F.lit(False)).alias("readable")), "images")
    one = d.where("readable and id is not null").groupBy("bytes").agg(F.min("id").alias("first"))
    # Other rows with the same bytes, mostly few, are left out; the images themselves needn't be shuffled for it.
    others = materialize(d.join(one, "bytes").where("id <> first").select("id").distinct(), "others")
    few = F.broadcast(others) if others.count() <= FEW else others
    shown = images.select(F.col("id").cast("long").alias("id"), "image").where("id is not null").join(few, "id", "left_anti")
    corners = materialize(describe(shown), "corners")
    release(others)
    spark = images.sparkSession
    # One slice of the keys at a time, as its rows take several times the disk of the corners.
    parts, crowded = [], []
    for part in range(SLICES):
        rows = materialize(slice_keys(corners, part), "keys")
        parts.append(materialize(few_matches(rows, bucket=bucket), "matches"))
        crowded.append(materialize(rows.where(F.col("n") > bucket), "hot"))
        release(rows)
        sweep(spark)
    release(corners)
    parts.append(hub_matches(_all(crowded), bucket=bucket))
    near = materialize(_all(parts).distinct(), "matches")
    for s in parts[:-1]:
        release(s)
    sweep(spark)
    link = materialize(consensus(near), "links")
    label = components(link)
    sweep(spark)
    rest = []
    for rows in crowded:
        rest.append(materialize(matches_between(rows, label, bucket=bucket), "matches"))
        release(rows)
        sweep(spark)
    if _all(rest).limit(1).count():
        link = materialize(consensus(_all([near, *rest]).distinct()), "links")
        label = components(link)
    for s in (near, *rest):
        release(s)
    ends = link.select(F.col("a").alias("n")).unionByName(link.select(F.col("b").alias("n"))).groupBy("n").agg(F.count("*").alias("n_links"))
    groups = one.join(label, one["first"] == label.node, "left").join(ends, F.col("first") == F.col("n"), "left")
    groups = groups.select(F.col("bytes").alias("b"), F.coalesce("label", "first").alias("class"), F.coalesce("n_links", F.lit(0)).alias("links"))
    out = d.select("id", F.when(F.col("readable"), F.col("bytes")).alias("bytes")).join(groups, F.col("bytes") == F.col("b"), "left")
    return out.select("id", F.coalesce("class", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def paint(vectors: DataFrame, size: int = 64) -> DataFrame:
    """(id, image, kind): a grey image of each row of vectors (vec_id, embedding), waves with the vector's values.

    Of every ten ids, that with the last digit 7 shows a copy of its predecessor's image, by the digit before:
    cropped, turned by a right angle, brighter, with a painted corner, or smaller. kind says which, else "own".
    """
    v = vectors.selectExpr("cast(vec_id as long) id", "embedding")
    base = v.select((F.col("id") + 1).alias("next"), F.col("embedding").alias("before"))
    v = v.withColumn("copy", F.when(F.col("id") % 10 == 7, F.col("id"))).join(base, F.col("copy") == F.col("next"), "left")
    v = v.select("id", F.coalesce("before", "embedding").alias("embedding"), F.col("before").isNotNull().alias("edited")).withColumn("id", F.col("id").cast("string"))  # as text: a null among numbers makes them floats
    # An image has several times the bytes of its vector: the tasks' number is given, so that few vectors aren't put together.
    v = v.repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    kinds = ["crop", "turn", "bright", "corner", "scale"]

    def run(batches):
        at = np.arange(size) / size
        wave = np.random.default_rng(9).integers(1, 11, (64, 2)) * np.where(np.random.default_rng(8).random((64, 2)) < 0.5, -1, 1)
        shape = 2 * np.pi * (wave[:, 0, None, None] * at[None, :, None] + wave[:, 1, None, None] * at[None, None, :])
        cosines = np.cos(shape + np.arange(64)[:, None, None]).reshape(64, -1)
        for b in batches:
            rows = []
            for i, e, edited in zip(b.id, b.embedding, b.edited, strict=True):
                if i is None or e is None or len(e) == 0:
                    rows.append((i, None, "own"))
                    continue
                i = int(i)
                z = np.resize(np.nan_to_num(np.asarray(e, float)), 64)
                x = (z @ cosines).reshape(size, size)
                x = 128 + 42 * x / (x.std() + 1e-9)
                kind = kinds[i // 10 % len(kinds)] if edited else "own"
                if kind == "crop":
                    x = x[8:, 5:]
                elif kind == "turn":
                    x = np.rot90(x)
                elif kind == "bright":
                    x = 0.8 * x + 20
                elif kind == "corner":
                    x[:19, :19] = 255
                elif kind == "scale":
                    x = _resize(_blur(x), SCALES[1])
                rows.append((str(i), encode(np.clip(np.rint(x), 0, 255)), kind))
            yield pd.DataFrame(rows, columns=["id", "image", "kind"])

    return v.mapInPandas(run, "id string, image binary, kind string").withColumn("id", F.col("id").cast("long"))
