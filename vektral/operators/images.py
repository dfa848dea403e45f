"""Operators on images stored as one vector: element c*h*w + x*h + y (from 0) is row y, column x of
channel c."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import gather


def pixels(feat: Column, h: int, w: int) -> Column:
    """Array of structs y, x, c (from 1) and v."""
    at = F.sequence(F.lit(0), F.size(feat) - 1)
    return F.transform(F.arrays_zip(feat.alias("v"), at.alias("i")), lambda p: F.struct((p["i"] % h + 1).cast("int").alias("y"), (F.floor(p["i"] / h) % w + 1).cast("int").alias("x"), (F.floor(p["i"] / (h * w)) + 1).cast("int").alias("c"), p["v"].alias("v")))


def crop(feat: Column, h: int, w: int, ch: int, y: int, x: int, ph: int, pw: int) -> Column:
    """The ph x pw patch whose first pixel is (y, x), from 1."""
    return gather(feat, [c * h * w + (x - 1 + j) * h + (y - 1 + i) for c in range(ch) for j in range(pw) for i in range(ph)])


def patch_grid(h: int, w: int, ph: int, pw: int, ys: int, xs: int) -> list[tuple[int, int]]:
    """First pixels of all patches, rows outer; a stride of 0 gives one step."""
    ny = (h - ph) // ys + 1 if ys else 1
    nx = (w - pw) // xs + 1 if xs else 1
    return [(1 + i * ys, 1 + j * xs) for i in range(ny) for j in range(nx)]


def patches(ds: DataFrame, h: int, w: int, ch: int, ph: int, pw: int, ys: int, xs: int) -> DataFrame:
    """One row per sample and patch: patch_id y_x_h_w, patch."""
    each = [F.struct(F.lit(f"{y}_{x}_{ph}_{pw}").alias("patch_id"), crop(F.col("feat"), h, w, ch, y, x, ph, pw).alias("patch")) for y, x in patch_grid(h, w, ph, pw, ys, xs)]
    return ds.select("sample_id", F.inline(F.array(*each)))


def downsample(feat: Column, h: int, w: int, p: int) -> Column:
    return gather(feat, [x * h + y for x in range(0, w, p) for y in range(0, h, p)])


def export_order(feat: Column, h: int, w: int, ch: int, order: str) -> Column:
    """The vector by rows: CHW (channels outer) or HWC (channels inner)."""
    if order == "CHW":
        index = [c * h * w + x * h + y for c in range(ch) for y in range(h) for x in range(w)]
    else:
        index = [c * h * w + x * h + y for y in range(h) for x in range(w) for c in range(ch)]
    return gather(feat, index)


def flipped(feat: Column, h: int, w: int, ch: int, upside: bool = False) -> Column:
    """Mirrored left to right, or upside down."""
    index = [c * h * w + (x if upside else w - 1 - x) * h + (h - 1 - y if upside else y) for c in range(ch) for x in range(w) for y in range(h)]
    return gather(feat, index)


def grey(feat: Column, h: int, w: int) -> Column:
    n = h * w
    # fixed values: luma weights
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: 0.2989 * F.element_at(feat, i) + 0.5870 * F.element_at(feat, i + n) + 0.1140 * F.element_at(feat, i + 2 * n))


def occlusion(feat: Column, h: int, w: int, kind: str = "b", rate: float = 0.0, offset: float = 0.0) -> Column:
    """Rows or columns set to 0: b and r count from the end (ceil), t/v and l/h from the start (floor)."""
    import math

    side = h if kind in ("b", "t", "v") else w
    if kind in ("b", "r"):
        hide = math.ceil(rate * side)
        last = math.floor((1 - offset) * side)
        first = max(1, last - hide + 1)
    else:
        hide = math.floor(rate * side)
        first = math.floor(offset * side) + 1
        last = min(first + hide - 1, side)
    axis = "y" if kind in ("b", "t", "v") else "x"
    return F.transform(pixels(feat, h, w), lambda p: F.when(p[axis].between(first, last), F.lit(0.0)).otherwise(p["v"]))


def pooled(feat: Column, h: int, w: int, sizes: list[int], mean: bool = True) -> Column:
    """Mean or maximum of the non-overlapping patches of each size."""
    out = []
    for s in sizes:
        for y, x in patch_grid(h, w, s, s, s, s):
            part = crop(feat, h, w, 1, y, x, s, s)
            out.append(F.aggregate(part, F.lit(0.0), lambda a, v: a + v) / (s * s) if mean else F.array_max(part))
    return F.array(*out)


def equalized(ds: DataFrame, bins: int = 64, top: float = 255.0) -> DataFrame:
    """Histogram equalisation of each sample: a value becomes the share of values in its bin and below."""
    cell = lambda x: F.least(F.lit(bins - 1), F.floor(x / (top + 1) * bins)).cast("int")
    cells = F.transform("feat", cell)
    below = lambda x: F.size(F.filter("_c", lambda y: y <= cell(x))) / F.size("feat")
    return ds.withColumn("_c", cells).withColumn("feat", F.transform("feat", below)).drop("_c")


def image_grid(ds: DataFrame, columns: int, h: int, w: int, gap_y: int = 0, gap_x: int = 0) -> DataFrame:
    """Where each image (by ordinal, from 1) stands in a grid."""
    k = F.col("ordinal") - 1
    row, col = F.floor(k / columns), k % columns
    return ds.select("sample_id", row.cast("long").alias("row"), col.cast("long").alias("col"), (row * (h + gap_y) + 1).cast("long").alias("y0"), (col * (w + gap_x) + 1).cast("long").alias("x0"))


def illumination(feat: Column, h: int, w: int, pos: tuple[float, float], var: tuple[float, float], bright: float = 1.0, dark: float = 1.0, threshold: float = 1 / 255) -> Column:
    """A Gaussian light at pos (row, column): brighter inside, darker outside, saturated to 0..255."""
    from math import exp

    light = [exp(-0.5 * ((y - pos[0]) * (y - pos[0]) / var[0] + (x - pos[1]) * (x - pos[1]) / var[1])) for x in range(1, w + 1) for y in range(1, h + 1)]
    lit = F.lit(light)  # by column, as the pixels
    lit_at = lambda i: F.get(lit, i % (h * w))
    inside = F.filter(feat, lambda v, i: (lit_at(i) >= threshold) & (v != 0))
    mean = F.aggregate(inside, F.lit(0.0), lambda s, v: s + v, lambda s: s / F.size(inside))
    room = F.when(F.size(inside) > 0, 255 - mean).otherwise(255.0)
    out = lambda r, v, l: v + bright * r * l - F.when(l >= threshold, 0.0).otherwise(255.0 * dark)
    # the room is an argument, so that it is made once for an image, not once for each of its pixels
    return F.transform(F.array(room), lambda r: F.transform(feat, lambda v, i: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(out(r, v, lit_at(i)))))))[0]


#: Red, green, blue to other colour spaces, one row per new channel.
COLOURS = {
    "XYZ": [[0.607, 0.174, 0.201], [0.299, 0.587, 0.114], [0.0, 0.066, 1.117]],
    "YIQ": [[0.29, 0.587, 0.114], [0.5957, -0.2744, -0.3213], [0.2115, -0.5226, 0.3111]],
    "III": [[1 / 3, 1 / 3, 1 / 3], [1 / 2, 0.0, -1 / 2], [-1 / 2, 1.0, -1 / 2]],
    "YUV": [[0.299, 0.587, 0.114], [-0.1471, -0.2888, 0.4359], [0.6148, -0.5148, -0.1]],
    "nRGB": [[1.0, 0.0, 0.0], [-1 / 3, 2 / 3, -1 / 3], [-1 / 3, -1 / 3, 2 / 3]],
    "nXYZ": [[0.607, 0.174, 0.2], [-0.0343, 0.2537, -0.2193], [-0.394, -0.328, 0.722]],
}


def recoloured(feat: Column, h: int, w: int, space: str) -> Column:
    """The first three channels in another colour space."""
    n = h * w
    channel = lambda m: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: m[0] * F.element_at(feat, i) + m[1] * F.element_at(feat, i + n) + m[2] * F.element_at(feat, i + 2 * n))
    return F.concat(*[channel(m) for m in COLOURS[space]])


def resize_weights(size: int, new: int) -> list[list[float]]:
    """Rows of cubic (a = -0.5) weights of a one-dimensional resize; shrinking widens the kernel, and
    pixels outside are the mirrored ones inside."""
    import numpy as np

    scale = new / size
    wide = min(scale, 1.0)
    reach = int(np.ceil(4 / wide)) + 2
    out = np.zeros((new, size))
    for k in range(new):
        centre = (k + 0.5) / scale - 0.5
        at = np.floor(centre - 2 / wide).astype(int) + np.arange(reach)
        x = np.abs((centre - at) * wide)
        v = np.where(x <= 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x <= 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))
        v /= v.sum()
        turn = np.mod(at, 2 * size)
        np.add.at(out[k], np.where(turn < size, turn, 2 * size - 1 - turn), v)
    return out.tolist()


def resized(ds: DataFrame, h: int, w: int, ch: int, new_h: int, new_w: int) -> DataFrame:
    """Images of another size: one product with the (constant) weights of rows and columns."""
    import numpy as np

    from .learning import project

    both = np.kron(resize_weights(w, new_w), resize_weights(h, new_h))
    return project(ds, np.kron(np.eye(ch), both).T)


def matched(feat: Column, reference: Column) -> Column:
    """Values replaced by the reference's value of the same rank share."""
    ranked = F.array_sort(reference)
    share = lambda x: F.size(F.filter(feat, lambda y: y <= x)) / F.size(feat)
    return F.transform(feat, lambda x: F.element_at(ranked, F.ceil(share(x) * F.size(ranked) - 1e-9).cast("int")))


def frequency_mask(h: int, w: int, cutoff: float, order: int, kind: str = "low", boost: float = 1.0):
    """Butterworth gains, zero frequency first: low, high, or high with everything else kept at
    1 / boost (highboost)."""
    import numpy as np

    y, x = np.meshgrid(np.fft.fftfreq(h), np.fft.fftfreq(w), indexing="ij")
    low = 1 / (1 + (np.hypot(y, x) / cutoff) ** (2 * order))
    if kind == "low":
        return low
    return 1 - low if kind == "high" else (1 - 1 / boost) * (1 - low) + 1 / boost


def frequency_filtered(ds: DataFrame, h: int, w: int, cutoff: float, order: int, kind: str = "low", boost: float = 1.0) -> DataFrame:
    """One-channel images after a frequency filter."""
    import numpy as np

    mask = frequency_mask(h, w, cutoff, order, kind, boost)

    def run(x):
        img = x.reshape(-1, w, h).transpose(0, 2, 1)
        return np.fft.ifft2(np.fft.fft2(img) * mask).real.transpose(0, 2, 1).reshape(len(x), -1)

    return mapped(ds, run)


def truncated(feat: Column, low: float, high: float) -> Column:
    """The lowest and highest shares of the values clipped, the rest stretched to 0..255."""
    ranked, n = F.array_sort(feat), F.size(feat)
    lo = F.element_at(ranked, F.least(n, F.floor(n * F.lit(low)).cast("int") + 1))
    hi = F.element_at(ranked, F.greatest(F.lit(1), n - F.floor(n * F.lit(high)).cast("int")))
    return F.transform(feat, lambda x: F.when(hi == lo, F.lit(0.0)).otherwise((F.least(hi, F.greatest(lo, x)) - lo) / (hi - lo) * 255))


def dotted_block(feat: Column, key: Column, h: int, w: int, rate: float, seed: int = 0) -> Column:
    """A block of rate * h by rate * w at a place drawn from the key, half of its pixels (drawn too) white."""
    bh, bw = int(rate * h), int(rate * w)
    pick = lambda n, *k: F.pmod(F.xxhash64(key, F.lit(seed), *k), F.lit(n))
    y, x = pick(h - bh + 1, F.lit(1)) + 1, pick(w - bw + 1, F.lit(2)) + 1
    hit = lambda p: (p["y"] >= y) & (p["y"] < y + bh) & (p["x"] >= x) & (p["x"] < x + bw)
    return F.transform(pixels(feat, h, w), lambda p: F.when(hit(p), 255.0 * pick(2, p["y"], p["x"], F.lit(3))).otherwise(p["v"]))


def masked(feat: Column, mask: list[float]) -> Column:
    """Multiplied by a constant mask."""
    return F.zip_with(feat, F.array(*[F.lit(float(m)) for m in mask]), lambda x, m: x * m)


def mapped(ds: DataFrame, f) -> DataFrame:
    """feat through a numpy function of a batch of vectors (rows)."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at = batch.schema.get_field_index("feat")
                y = f(np.asarray(batch.column(at).flatten(), float).reshape(batch.num_rows, -1))
                feat = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([feat if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return ds.mapInArrow(run, ds.schema)


def brightness_equalized(ds: DataFrame, h: int, w: int, bins: int = 64) -> DataFrame:
    """Colour images (0..255) whose brightness, the greatest of the three channels, is equalised; hue and
    saturation stay, since all channels of a pixel grow by one factor."""
    import numpy as np

    def run(x):
        rgb = x.reshape(len(x), 3, h * w)
        v = rgb.max(1)
        cell = np.minimum(bins - 1, np.floor(v / 256 * bins)).astype(int)
        out = np.empty_like(rgb)
        for k in range(len(x)):
            share = np.cumsum(np.bincount(cell[k], minlength=bins)) / (h * w)
            out[k] = rgb[k] * np.divide(share[cell[k]] * 255, v[k], out=np.zeros(h * w), where=v[k] > 0)
        return out.reshape(len(x), -1)

    return mapped(ds, run)


def nonlocal_means(ds: DataFrame, h: int, w: int, reach: int = 2, patch: int = 1, strength: float = 0.5) -> DataFrame:
    """One-channel images: each pixel becomes a mean of the pixels within reach, weighed by how alike
    the patches around them are."""
    import numpy as np

    def run(x):
        img = x.reshape(len(x), w, h).transpose(0, 2, 1)
        wide = np.pad(img, ((0, 0), *[(reach + patch, reach + patch)] * 2), "symmetric")
        total, weight = np.zeros_like(img), np.zeros_like(img)
        cut = lambda dy, dx, extra: wide[:, reach + patch + dy - extra : reach + patch + dy + h + extra, reach + patch + dx - extra : reach + patch + dx + w + extra]
        here = cut(0, 0, patch)
        for dy in range(-reach, reach + 1):
            for dx in range(-reach, reach + 1):
                d = (here - cut(dy, dx, patch)) ** 2
                near = sum(d[:, a : a + h, b : b + w] for a in range(2 * patch + 1) for b in range(2 * patch + 1)) / (2 * patch + 1) ** 2
                g = np.exp(-near / strength**2)
                total += g * cut(dy, dx, 0)
                weight += g
        return (total / weight).transpose(0, 2, 1).reshape(len(x), -1)

    return mapped(ds, run)


def total_variation(ds: DataFrame, h: int, w: int, penalty: float, steps: int = 100) -> DataFrame:
    """One-channel images u of least |u - x|^2 / 2 + penalty TV(u), by projected steps on the dual."""
    import numpy as np

    def run(x):
        img = x.reshape(len(x), w, h).transpose(0, 2, 1)
        p, q = np.zeros_like(img), np.zeros_like(img)

        def back(p, q):
            out = p + q
            out[:, 1:] -= p[:, :-1]
            out[:, :, 1:] -= q[:, :, :-1]
            return out

        for _ in range(steps):
            u = back(p, q) - img / penalty
            dy, dx = np.zeros_like(img), np.zeros_like(img)
            dy[:, :-1] = u[:, 1:] - u[:, :-1]
            dx[:, :, :-1] = u[:, :, 1:] - u[:, :, :-1]
            size = 1 + 0.125 * np.hypot(dy, dx)
            p, q = (p + 0.125 * dy) / size, (q + 0.125 * dx) / size
        return (img - penalty * back(p, q)).transpose(0, 2, 1).reshape(len(x), -1)

    return mapped(ds, run)
