"""Sources and sinks of labelled-vector datasets.

A dataset is a DataFrame with sample_id, cls (from 1), col_idx (place inside its class, from 1) and
feat array<double>; images are stored as one vector, first by row, then by column, then by channel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ids to a run, a power of two
RUN = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder as a stream of its files; a table that is one file is found by its name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    return reader.parquet(f"{sf_dir}/{name}.parquet") if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def load_views(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Registers tables of a folder as temporary views."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def labelled(df: DataFrame, sample_id: str, cls: Column, feat: str) -> DataFrame:
    """A dataset from any rows: classes as given, samples in the order of their (whole) ids.  Places are
    counted inside runs of RUN ids and the runs' counts are summed up within the class, so no window
    sees more than one run, however large a class is."""
    rows = df.select(F.col(sample_id).alias("sample_id"), cls.cast("int").alias("cls"), F.col(feat).cast("array<double>").alias("feat"))
    rows = rows.withColumn("_run", F.shiftright(F.col("sample_id").cast("long"), RUN.bit_length() - 1))
    before = Window.partitionBy("_cls").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy(F.col("cls").alias("_cls"), F.col("_run").alias("_of")).agg(F.count("*").alias("_n"))
    runs = runs.select("_cls", "_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = Window.partitionBy("cls", "_run").orderBy("sample_id")
    rows = rows.withColumn("_at", F.row_number().over(place))
    both = F.col("cls").eqNullSafe(F.col("_cls")) & F.col("_run").eqNullSafe(F.col("_of"))
    return rows.join(runs, both).select("sample_id", "cls", "feat", (F.col("_before") + F.col("_at")).cast("int").alias("col_idx"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(table(spark, sf_dir, "embeddings"), "vec_id", F.col("label") + 1, "embedding")


def save_dataset(ds: DataFrame, path: str, split: str | None = None) -> None:
    """Parquet, a folder per split where there is one; labels are run-length encoded by the format."""
    writer = ds.write.mode("overwrite")
    (writer.partitionBy(split) if split else writer).parquet(path)


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def is_uniform(ds: DataFrame) -> bool:
    """Whether every class has the same number of samples."""
    counts = ds.groupBy("cls").count().agg(F.min("count").alias("lo"), F.max("count").alias("hi")).first()
    return counts["lo"] == counts["hi"]


def natural_key(name: Column) -> Column:
    """A key that sorts digits by value: runs of digits are padded, other runs stay."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def image_folder(spark: SparkSession, path: str) -> DataFrame:
    """Files of one folder per class: path, content, class by the natural order of the folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    folder = F.element_at(F.split("path", "/"), -2)
    named = files.select("path", "content", folder.alias("folder"))
    # one row per folder is ordered here, not the files
    order = named.select("folder").distinct().withColumn("cls", F.row_number().over(Window.orderBy(natural_key(F.col("folder")))))
    place = Window.partitionBy("cls").orderBy(natural_key(F.col("path")))
    return named.join(F.broadcast(order), "folder").withColumn("col_idx", F.row_number().over(place))


def image_name(cls: Column, col_idx: Column) -> Column:
    return F.format_string("%d_%d.jpg", cls, col_idx)


def high_pass_series(df: DataFrame, key: str, order: str, value: str, b: list[float], a: list[float]) -> DataFrame:
    """Causal IIR filter along each key's ordered samples; one key's series must fit a task."""
    import numpy as np
    import pandas as pd

    schema = df.select(key, order, F.col(value).cast("double").alias(value)).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x, y = pdf[value].to_numpy(float), np.zeros(len(pdf))
        state = np.zeros(max(len(a), len(b)) - 1)
        bb, aa = np.pad(b, (0, len(state) + 1 - len(b))), np.pad(a, (0, len(state) + 1 - len(a)))
        for i, v in enumerate(x):
            y[i] = bb[0] * v + state[0]
            state[:-1] = state[1:] + bb[1:-1] * v - aa[1:-1] * y[i]
            state[-1] = bb[-1] * v - aa[-1] * y[i]
        return pdf.assign(**{value: y})

    return df.select(key, order, value).groupBy(key).applyInPandas(run, schema)


def high_pass_sections(rate: float, stop: float, passed: float, stop_db: float = 60.0, pass_db: float = 1.0) -> list[tuple[list[float], list[float]]]:
    """(b, a) of the second-order sections of a Chebyshev type II high-pass: at least stop_db below
    `stop` Hz, at most pass_db lost above `passed` Hz."""
    import numpy as np

    ws, wp = np.tan(np.pi * stop / rate), np.tan(np.pi * passed / rate)
    n = int(np.ceil(np.arccosh(np.sqrt((10 ** (stop_db / 10) - 1) / (10 ** (pass_db / 10) - 1))) / np.arccosh(wp / ws)))
    eps = 1 / np.sqrt(10 ** (stop_db / 10) - 1)
    theta = np.pi * (2 * np.arange(1, n + 1) - 1) / (2 * n)
    mu = np.arcsinh(1 / eps) / n
    poles = 1 / (-np.sinh(mu) * np.sin(theta) + 1j * np.cosh(mu) * np.cos(theta))
    # low to high pass: s becomes ws / s; then the bilinear map
    to_z = lambda s: (1 + s) / (1 - s)
    out = []
    for k in range(n // 2):
        pole, zero = to_z(ws / poles[k]), to_z(-1j * ws * np.cos(theta[k]))
        b = np.array([1, -2 * zero.real, abs(zero) ** 2])
        a = np.array([1, -2 * pole.real, abs(pole) ** 2])
        out.append((b, a))
    if n % 2:
        pole = to_z(ws / poles[n // 2]).real
        out.append((np.array([1.0, -1.0]), np.array([1.0, -pole])))
    sign = lambda c: (c * (-1.0) ** np.arange(len(c))).sum()  # noqa: E731  the value at half the rate
    return [((b * sign(a) / sign(b)).tolist(), a.tolist()) for b, a in out]


def high_passed(df: DataFrame, key: str, order: str, value: str, sections: list[tuple[list[float], list[float]]]) -> DataFrame:
    """The sections one after the other over each key's ordered samples."""
    for b, a in sections:
        df = high_pass_series(df, key, order, value, b, a)
    return df


def bitmap(feat, h: int, w: int, ch: int) -> bytes:
    """An image (0..255, one or three channels) as a 24-bit bitmap file."""
    import struct

    import numpy as np

    x = np.clip(np.rint(np.asarray(feat, float)), 0, 255).astype(np.uint8).reshape(ch, w, h).transpose(2, 1, 0)[:, :, ::-1]
    rows = np.zeros((h, -(-w * 3 // 4) * 4), np.uint8)  # blue, green, red; from the last row up; in whole words
    rows[:, : 3 * w] = np.broadcast_to(x, (h, w, 3)).reshape(h, -1)
    data = rows[::-1].tobytes()
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(data), 0, 0, 54, 40, w, h, 1, 24, 0, len(data), 2835, 2835, 0, 0) + data


def read_bitmap(data: bytes, grey: bool = False) -> tuple:
    """(h, w, ch, values by column and channel) of a 24-bit bitmap file without compression; grey is the mean of
    the channels."""
    import struct

    import numpy as np

    if len(data) < 54 or data[:2] != b"BM" or struct.unpack_from("<HI", data, 28) != (24, 0):
        raise ValueError("not a plain 24-bit bitmap")
    first, (w, h) = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<ii", data, 18)
    wide = -(-w * 3 // 4) * 4
    rows = np.frombuffer(data, np.uint8, abs(h) * wide, first).reshape(abs(h), wide)[:, : 3 * w]
    x = (rows[::-1] if h > 0 else rows).reshape(abs(h), w, 3)[:, :, ::-1].astype(float)  # blue comes first
    if grey:
        x = x.mean(2, keepdims=True)
    return abs(h), w, x.shape[2], x.transpose(2, 1, 0).ravel()


def save_images(ds: DataFrame, path: str, h: int, w: int, ch: int = 1, folders: bool = True) -> DataFrame:
    """Writes each sample as an image file, <cls>/<col_idx>.bmp or <cls>_<col_idx>.bmp, and gives (sample_id, path).
    A file is moved to its name when it is whole, so repeated attempts do no harm; until then its name has a mark by which
    readers pass it over."""
    import uuid

    import numpy as np
    import pyarrow as pa

    path = path if "://" in path or path.startswith("file:") else f"file://{path}"

    def run(batches):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(path)
        made = set()
        for batch in batches:
            names = []
            for cls, idx, feat in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                name = f"{top}/{cls}/{idx}.bmp" if folders else f"{top}/{cls}_{idx}.bmp"
                folder = name.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/_{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(bitmap(np.asarray(feat.values), h, w, ch))
                store.move(part, name)
                names.append(name)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string())], names=["sample_id", "path"])

    return ds.select("sample_id", "cls", "col_idx", "feat").mapInArrow(run, "sample_id long, path string")


def image_samples(spark: SparkSession, path: str, grey: bool = False, read=None) -> DataFrame:
    """A dataset of image files, a folder per class in natural order: path, cls, col_idx, h, w, ch, feat.  Spark's
    image source decodes them; read, a function of a file's bytes that gives (h, w, ch, values by column and
    channel), does so instead where it is given: then each file is read once, the folders being known from the paths, and
    small files are put together in a bounded number of tasks."""
    import numpy as np
    import pyarrow as pa

    schema = "path string, h int, w int, ch int, feat array<double>"
    if read is None:
        files = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", "true").load(path)
        files = files.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

        def decoded(row) -> tuple:
            _, h, w, ch, data = row
            x = np.frombuffer(data, np.uint8).reshape(h, w, ch)[:, :, ::-1].astype(float)  # blue comes first
            if ch == 4:
                x, ch = x[:, :, 1:], 3
            if grey:
                x, ch = x.mean(2, keepdims=True), 1
            return h, w, ch, x.transpose(2, 1, 0).ravel()
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        tasks = 8 * max(1, spark.sparkContext.defaultParallelism)
        paths, files = found.select("path").coalesce(tasks), found.select("path", "content").coalesce(tasks)

        def decoded(row) -> tuple:
            return read(row[1])

    def run(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out = [(row[0], *decoded(row)) for row in zip(*columns)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64())))], names=["path", "h", "w", "ch", "feat"])

    folder = F.element_at(F.split("path", "/"), -2)
    rows = files.mapInArrow(run, schema).withColumn("_folder", folder)
    # one row per folder is ordered here, not the files
    order = (rows if read is None else paths).select(folder.alias("_folder")).distinct().withColumn("cls", F.row_number().over(Window.orderBy(natural_key(F.col("_folder")))))
    place = Window.partitionBy("cls").orderBy(natural_key(F.col("path")))
    return rows.join(order, "_folder").withColumn("col_idx", F.row_number().over(place)).select("path", "cls", "col_idx", "h", "w", "ch", "feat")


def save_windows(windows: DataFrame, path: str, size: int, step: int, cls: str = "cls") -> None:
    """Windows (split, cls, st, ...) as tables by split and class, each with the name its file would have."""
    name = F.format_string("%s/%s/%s_%s_%s_%s", F.lower("split"), F.col(cls), F.col(cls), F.lit(size), F.lit(step), F.col("st"))
    windows.withColumn("path", name).write.mode("overwrite").partitionBy("split", cls).parquet(path)


def save_cases(grid: DataFrame, path: str) -> None:
    """A scenario grid with a folder for each case."""
    grid.write.mode("overwrite").partitionBy("case_id").parquet(path)


def combined_files(spark: SparkSession, paths: list[str], key: str, order: str, value: str, sections: list[tuple[list[float], list[float]]]) -> DataFrame:
    """Series of several folders as one, high-passed key by key."""
    out = None
    for path in paths:
        part = spark.read.parquet(path)
        out = part if out is None else out.unionByName(part)
    return high_passed(out, key, order, value, sections)
