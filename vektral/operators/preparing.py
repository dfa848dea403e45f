"""Slices whose images are prepared on the way: size, colour, histograms, a function of the user's, and then
noise, hidden parts or light by place in the training list; batches of inputs and targets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import images as I
from .dataset import Selection, slice_dataset, with_ordinal


@dataclass(frozen=True)
class Preparation:
    """What is done to every image, in this order: scale (a share of height and width), colour ("grey" or a
    channel's number from 1), equalize, match (the place in its class of the image whose histogram all of
    the class take) and script, a function of (dataset, height, width, channels) that gives a dataset.

    Then by place in the training list, from the first: noise (shares of height and width of a dotted
    block), occlusion (kind, rate, offset), light (position, variances) with its bright and dark factors;
    mask multiplies all training images.  Lists may be shorter than the training list.
    """

    scale: float | None = None
    colour: str | int | None = None
    equalize: bool = False
    match: int | None = None
    script: Callable[[DataFrame, int, int, int], DataFrame] | None = None
    noise: tuple[float, ...] = ()
    occlusion: tuple[tuple[str, float, float], ...] = ()
    light: tuple[tuple[tuple[float, float], tuple[float, float]], ...] = ()
    bright: float = 1.0
    dark: float = 0.0
    mask: tuple[float, ...] | None = None

    def shape(self, h: int, w: int, ch: int) -> tuple[int, int, int]:
        """Height, width and channels afterwards."""
        if self.scale:
            h, w = math.ceil(h * self.scale), math.ceil(w * self.scale)
        return h, w, 1 if self.colour else ch


def _sized(ds: DataFrame, prep: Preparation, h: int, w: int, ch: int) -> DataFrame:
    """Scale and colour, which the image to be matched gets too."""
    new_h, new_w, _ = prep.shape(h, w, ch)
    if prep.scale:
        ds = I.resized(ds, h, w, ch, new_h, new_w)
    if prep.colour == "grey":
        ds = ds.withColumn("feat", I.grey(F.col("feat"), new_h, new_w))
    elif prep.colour:
        ds = ds.withColumn("feat", F.slice("feat", (int(prep.colour) - 1) * new_h * new_w + 1, new_h * new_w))
    return ds


def prepared(ds: DataFrame, prep: Preparation, h: int, w: int, ch: int = 1, canonical: DataFrame | None = None) -> DataFrame:
    """ds with feat prepared; canonical (cls, feat) holds the images to be matched, as they were."""
    out = _sized(ds, prep, h, w, ch)
    if prep.equalize:
        out = I.equalized(out)
    if canonical is not None:
        base = _sized(canonical, prep, h, w, ch).select("cls", F.col("feat").alias("_base"))
        out = out.join(base, "cls").withColumn("feat", I.matched(F.col("feat"), F.col("_base"))).drop("_base").select(*out.columns)
    return prep.script(out, *prep.shape(h, w, ch)) if prep.script else out


def _by_place(sliced: DataFrame, selection: Selection, changes: dict[int, Column]) -> DataFrame:
    """feat changed in training rows by their place in the training list (from 1)."""
    changes = {k: c for k, c in changes.items() if c is not None}
    if not changes:
        return sliced
    if selection.tr and isinstance(selection.tr[0], list):
        raise ValueError("places by class have no common list")
    seen: dict[int, int] = {}
    new = None
    for k, place in enumerate(sorted(selection.tr), 1):
        seen[place] = seen.get(place, 0) + 1
        if k in changes:
            here = (F.col("split") == "TR") & (F.col("col_idx") == place) & (F.col("dup") == seen[place])
            new = F.when(here, changes[k]) if new is None else new.when(here, changes[k])
    return sliced.withColumn("feat", new.otherwise(F.col("feat"))) if new is not None else sliced


def prepared_slice(ds: DataFrame, selection: Selection, prep: Preparation, h: int, w: int, ch: int = 1) -> DataFrame:
    """The samples that a selection asks for, prepared: the columns of slice_dataset."""
    canonical = ds.filter(F.col("col_idx") == prep.match) if prep.match else None
    out = prepared(slice_dataset(ds, selection), prep, h, w, ch, canonical)
    h, w, ch = prep.shape(h, w, ch)
    feat = F.col("feat")
    out = _by_place(out, selection, {k: I.dotted_block(feat, F.col("sample_id"), h, w, rate, k) if rate else None for k, rate in enumerate(prep.noise, 1)})
    out = _by_place(out, selection, {k: I.occlusion(feat, h, w, kind, rate, offset) if rate else None for k, (kind, rate, offset) in enumerate(prep.occlusion, 1)})
    if prep.mask:
        out = out.withColumn("feat", F.when(F.col("split") == "TR", I.masked(feat, list(prep.mask))).otherwise(feat))
    return _by_place(out, selection, {k: I.illumination(feat, h, w, pos, var, prep.bright, prep.dark) for k, (pos, var) in enumerate(prep.light, 1)})


def patch_slices(sliced: DataFrame, h: int, w: int, ch: int, ph: int, pw: int, ys: int, xs: int) -> DataFrame:
    """One row per sample and patch, with the sample's split and place: each patch_id is a dataset."""
    each = [F.struct(F.lit(f"{y}_{x}_{ph}_{pw}").alias("patch_id"), I.crop(F.col("feat"), h, w, ch, y, x, ph, pw).alias("patch")) for y, x in I.patch_grid(h, w, ph, pw, ys, xs)]
    return sliced.select(*[c for c in sliced.columns if c != "feat"], F.inline(F.array(*each)))


def shuffled_batches(inputs: DataFrame, targets: DataFrame | None, size: int, seed: int | None = None, epoch: int = 0) -> DataFrame:
    """(ordinal, batch, the columns of inputs[, target]): inputs in an order drawn from seed and epoch (by
    sample_id without a seed), cut into batches; each has the feat of targets with its sample_id."""
    draw = F.lit("") if seed is None else F.md5(F.concat_ws("_", F.lit(seed), F.lit(epoch), "sample_id").cast("binary"))
    rows = with_ordinal(inputs.withColumn("_draw", draw), ["_draw", "sample_id"]).drop("_draw")
    rows = rows.withColumn("batch", F.floor((F.col("ordinal") - 1) / size).cast("long"))
    return rows if targets is None else rows.join(targets.select("sample_id", F.col("feat").alias("target")), "sample_id")


@dataclass
class BatchIterator:
    """Batches one after the other, pulled as lists of rows; one with targets hands out both in one order."""

    inputs: DataFrame
    targets: DataFrame | None = None
    size: int = 32
    seed: int | None = None
    epoch: int = 0

    def __post_init__(self) -> None:
        self.reset()

    def reset(self) -> BatchIterator:
        """Begins anew, in the next order where there is a seed."""
        self._rows: Iterator | None = None
        self._next: list | None = None
        return self

    def set_batch_size(self, size: int) -> BatchIterator:
        self.size = size
        return self.reset()

    def set_shuffle(self, seed: int | None) -> BatchIterator:
        self.seed = seed
        return self.reset()

    def sync(self, other: BatchIterator) -> BatchIterator:
        """The order and batch size of another iterator."""
        self.size, self.seed, self.epoch = other.size, other.seed, other.epoch
        return self.reset()

    def clone(self) -> BatchIterator:
        return replace(self)

    def release(self) -> None:
        self.reset()

    def _pull(self) -> list:
        if self._rows is None:
            batches = shuffled_batches(self.inputs, self.targets, self.size, self.seed, self.epoch)
            # one partition at a time reaches the driver
            self._rows, self._ahead = batches.repartitionByRange("ordinal").sortWithinPartitions("ordinal").toLocalIterator(prefetchPartitions=False), None
        out = [self._ahead] if self._ahead is not None else []
        self._ahead = None
        for row in self._rows:
            if out and row["batch"] != out[0]["batch"]:
                self._ahead = row
                break
            out.append(row)
        return out

    def is_end(self) -> bool:
        if self._next is None:
            self._next = self._pull()
        return not self._next

    def next(self) -> list:
        """The next batch's rows; an empty list at the end, after which the next epoch begins."""
        out = self._pull() if self._next is None else self._next
        self._next = None
        if not out:
            self.epoch += 1
            self.reset()
        return out
