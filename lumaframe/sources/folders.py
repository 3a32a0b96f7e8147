"""Readers of image folders and datasets, as joins of Spark's own sources."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumaframe.errors import FormatError, require
from lumaframe.operators.running import running_sums
from lumaframe.operators.views import positions
from lumaframe.schema import BBOX

SUFFIXES = ("jpg", "jpeg", "png")


def fmt_of() -> Column:
    """The format of a file's image: gray, BGR or BGRA."""
    mode = F.col("image.mode")
    return F.when(mode == 0, "Gray").when(mode == 16, "BGR").when(mode == 24, "BGRA")


def suffixed(path: Column, suffixes: tuple[str, ...]) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*[s.lower().lstrip(".") for s in suffixes])


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def from_dir(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES, recursive: bool = False) -> DataFrame:
    """path, image of the files whose suffix, in any case, is given; what can't be decoded is left out.

    ``path`` is the order: sort by it, or make a view over it. The listing is Spark's, so any file system will do.
    """
    reader = spark.read.format("image").option("dropInvalid", True)
    df = reader.option("recursiveFileLookup", recursive).load(path)
    return df.where(suffixed(F.col("image.origin"), suffixes)).select(F.col("image.origin").alias("path"), F.col("image").withField("fmt", fmt_of()).alias("image"))


def load_images(spark: SparkSession, path: str) -> DataFrame:
    """from_dir; raises if there is no image."""
    df = from_dir(spark, path)
    require(not df.isEmpty(), f"no images in {path}")
    return df


def imread(spark: SparkSession, path: str, fmt: str = "BGR") -> DataFrame:
    """One file or a pattern, in a format that files can hold."""
    from lumaframe.operators.images import apply
    from lumaframe.operators.kernels import convert

    if fmt in ("HSV", "LAB", "YCrCb"):
        raise FormatError(f"a file is never {fmt}: read BGR and convert")
    df = spark.read.format("image").option("dropInvalid", True).load(path).select(F.col("image.origin").alias("path"), F.col("image").withField("fmt", fmt_of()).alias("image"))

    def to(img):
        found = "Gray" if img.ndim == 2 else "BGRA" if img.shape[2] == 4 else "BGR"
        base = fmt.replace("Float32C3", "BGR").replace("Float32", "Gray")
        if found == "BGRA" and base != "BGRA":
            img, found = img[..., :3], "BGR"
        return convert(convert(img, found, base), base, fmt)

    return apply(df, to, fmt=fmt)


def png(img) -> bytes:
    """The bytes of a PNG file of a gray, BGR or BGRA image; floats from 0 to 1 are scaled to 255."""
    import numpy as np

    if img.dtype.kind == "f":
        img = np.clip(np.rint(img * 255), 0, 255).astype(np.uint8)
    channels = 1 if img.ndim == 2 else img.shape[2]
    rows = img[..., None] if img.ndim == 2 else img[..., [2, 1, 0, 3][:channels]]
    raw = np.concatenate([np.zeros((img.shape[0], 1), np.uint8), rows.reshape(img.shape[0], -1)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", img.shape[1], img.shape[0], 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def imwrite(df: DataFrame, folder: str, name: str = "name") -> DataFrame:
    """Writes a PNG file for each row (name, image) into a folder all executors can write to; name and bytes of each, or why not.

    The files are written when the result is forced, under their final names by a rename, so a task that runs twice writes the same.
    """
    from pyarrow import fs

    from lumaframe.operators.images import decode

    target = folder if "://" in folder else f"file://{folder}"

    def run(parts: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        store, path = fs.FileSystem.from_uri(target)
        store.create_dir(path, recursive=True)
        for names, images in parts:
            out = []
            for n, row in zip(names, images.to_dict("records"), strict=True):
                try:
                    if row["fmt"] in ("HSV", "LAB", "YCrCb"):
                        raise FormatError(f"a file is never {row['fmt']}: convert to BGR")
                    data = png(decode(row))
                    with store.open_output_stream(f"{path}/.{n}.part") as f:
                        f.write(data)
                    store.move(f"{path}/.{n}.part", f"{path}/{n}.png")
                    out.append((len(data), None))
                except (OSError, ValueError, KeyError) as e:
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["bytes", "error"])

    done = F.pandas_udf(run, "bytes long, error string")
    return df.withColumn("_w", done(F.col(name), F.col("image"))).select(name, "_w.bytes", "_w.error")


def split_by_rank(df: DataFrame, by: list[str], key: str, test: float, val: float, seed: int, order: tuple[str, str, str], most: int | None = None) -> DataFrame:
    """df with ``split``: within each group, rows in a seeded order are cut at the floors of the ratios. key: unique in its group.

    order: the names of the first, second and last cut; the last takes what is left if it is train. Only the keys are put in
    order, by range partitions and their sums, so that neither images move nor one group, or all rows, is one task.
    """
    require(test >= 0 and val >= 0 and test + val < 1, "ratios must be 0 or more, and together under 1")
    keys = df.select(*by, key)
    if most is not None:
        require(most > 0, "the most a class may have is over 0")
        keys = running_sums(keys, [key], {"_k": F.lit(1).cast("long")}, tuple(by)).where(F.col("_k") <= most).drop("_k")
    ranked = running_sums(keys.withColumn("_o", F.xxhash64(key, F.lit(seed))), ["_o", key], {"_r": F.lit(1).cast("long")}, tuple(by))
    totals = ranked.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]).agg(F.count("*").alias("_n"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    ranked, n = ranked.join(totals, same) if by else ranked.join(F.broadcast(totals)), F.col("_n")  # without groups, totals is one row
    sizes = {"val": F.floor(n * val), "test": F.floor(n * test)}
    sizes["train"] = n - sizes["val"] - sizes["test"]
    cut = F.when(F.col("_r") <= sizes[order[0]], order[0]).when(F.col("_r") <= sizes[order[0]] + sizes[order[1]], order[1]).otherwise(order[2])
    cuts = ranked.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col(key).alias("_key"), cut.alias("split"))
    met = F.col(key) == F.col("_key")
    for i, c in enumerate(by):
        met = met & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    return df.join(cuts, met).select(*[df[c] for c in df.columns], "split")


def load_dataset(spark: SparkSession, root: str, test_ratio: float = 0.2, val_ratio: float = 0.1, max_per_class: int | None = None, seed: int = 0) -> DataFrame:
    """path, image, label, class_id, split of a folder with a subfolder for each class; ids by the sorted names."""
    df = from_dir(spark, f"{root}/*")
    df = df.withColumn("label", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    names = df.select("label").distinct().groupBy().agg(F.sort_array(F.collect_set("label")).alias("names"))
    df = split_by_rank(df, ["label"], "path", test_ratio, val_ratio, seed, ("val", "test", "train"), max_per_class)
    return df.join(F.broadcast(names)).withColumn("class_id", (F.array_position("names", F.col("label")) - 1).cast("int")).drop("names")  # one row of class names


COCO = T.StructType([
    T.StructField("images", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("file_name", T.StringType())]))),
    T.StructField("annotations", T.ArrayType(T.StructType([T.StructField("image_id", T.LongType()), T.StructField("category_id", T.LongType()), T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("iscrowd", T.IntegerType())]))),
    T.StructField("categories", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())]))),
])


def boxes_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, boxes: the rows' boxes gathered; a row of null x adds none."""
    box = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in BBOX.fields])
    gathered = F.sort_array(F.collect_list(F.when(F.col("x").isNotNull(), F.struct(*order, box.alias("b")))))
    return rows.groupBy(*keys).agg(F.transform(gathered, lambda s: s["b"]).alias("boxes"))


def parse_coco(spark: SparkSession, json: str, classes: list[str] | None = None, skip_crowd: bool = True, filter_unknown: bool = False) -> DataFrame:
    """image_id, file_name, boxes of a COCO file. Images without annotations stay; annotations of unknown categories go.

    With classes, ids follow that list; names outside it go if filter_unknown, otherwise they get ids after it.
    """
    doc = spark.read.schema(COCO).json(json, multiLine=True)
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name")
    found = doc.select(F.posexplode("annotations").alias("k", "a")).select("k", "a.*").where(F.lit(not skip_crowd) | (F.coalesce("iscrowd", F.lit(0)) == 0))
    names = doc.select(F.posexplode("categories").alias("_n", "c")).select("_n", F.col("c.id").alias("category_id"), F.col("c.name").alias("label"))
    if classes:
        listed = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
        names = names.where(listed >= 0) if filter_unknown else names
        names = names.withColumn("class_id", F.when(listed >= 0, listed).otherwise(len(classes) + F.col("_n")))
    else:
        names = names.withColumn("class_id", F.col("_n"))
    boxes = found.join(names, "category_id").select("image_id", "k", F.get("bbox", 0).alias("x"), F.get("bbox", 1).alias("y"), F.get("bbox", 2).alias("w"), F.get("bbox", 3).alias("h"), "class_id", "label")
    return boxes_of(images.join(boxes, "image_id", "left"), ["image_id", "file_name"], ["k"])


def load_coco(spark: SparkSession, json: str, images_dir: str, **how) -> DataFrame:
    """image_id, image, boxes: annotations joined to the files by name, or by the stem as .png."""
    files = from_dir(spark, images_dir).withColumn("file", F.regexp_extract("path", r"([^/]+)$", 1))
    rows = parse_coco(spark, json, **how)
    exact = rows.join(files.select("file", "image"), rows["file_name"] == F.col("file"), "left")
    other = files.where(F.col("file").endswith(".png")).select(stem(F.col("file")).alias("_stem"), F.col("image").alias("_png"))
    both = exact.join(other, stem(F.col("file_name")) == F.col("_stem"), "left")
    return both.select("image_id", F.coalesce("image", "_png").alias("image"), "boxes").where("image is not null")


def parse_voc(spark: SparkSession, pattern: str, classes: list[str] | None = None, skip_difficult: bool = True, filter_unknown: bool = False) -> DataFrame:
    """stem, file_name, boxes of Pascal VOC files: corners become x, y and sizes, w = xmax - xmin."""
    text = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("xml"))
    field = lambda p: F.xpath("xml", F.lit(f"/annotation/object/{p}/text()"))
    cols = {"label": field("name"), "x1": field("bndbox/xmin"), "y1": field("bndbox/ymin"), "x2": field("bndbox/xmax"), "y2": field("bndbox/ymax")}
    rows = text.select(stem(F.col("path")).alias("stem"), F.xpath_string("xml", F.lit("/annotation/filename")).alias("file_name"), F.arrays_zip(*[c.alias(n) for n, c in cols.items()]).alias("o"), "xml")
    flags = F.xpath("xml", F.lit("/annotation/object/difficult/text()"))
    whole = rows.select("stem", "file_name", F.posexplode_outer("o").alias("k", "b"), flags.alias("flags"))
    hard_one = (F.size("flags") > F.col("k")) & (F.get("flags", F.col("k")) == "1")
    listed = F.array_position(F.array(*[F.lit(c) for c in classes or []]).cast("array<string>"), F.col("b.label")) - 1
    keep = ~(F.lit(skip_difficult) & F.coalesce(hard_one, F.lit(False))) & (F.lit(not (classes and filter_unknown)) | (listed >= 0))
    num = lambda n: F.when(keep, F.col(f"b.{n}").cast("double"))
    rows = whole.select("stem", "file_name", "k", num("x1").alias("x"), num("y1").alias("y"), (num("x2") - num("x1")).alias("w"), (num("y2") - num("y1")).alias("h"), F.col("b.label").alias("label"), F.when(listed >= 0, listed).otherwise(-1).cast("int").alias("class_id"))
    return boxes_of(rows, ["stem", "file_name"], ["k"])


def load_voc(spark: SparkSession, root: str, test_ratio: float = 0.2, val_ratio: float = 0.1, seed: int = 0, **how) -> DataFrame:
    """stem, image, boxes, split: by the lists in ImageSets/Main where train.txt is there, otherwise in a seeded order."""
    rows = parse_voc(spark, f"{root}/Annotations/*.xml", **how)
    files = from_dir(spark, f"{root}/JPEGImages").withColumn("stem", stem(F.col("path")))
    both = rows.join(files.select("stem", "image"), "stem")
    return with_lists(spark, both, f"{root}/ImageSets/Main", lambda df: split_by_rank(df, [], "stem", test_ratio, val_ratio, seed, ("train", "val", "test")))


def with_lists(spark: SparkSession, rows: DataFrame, folder: str, otherwise) -> DataFrame:
    lists = spark.read.format("binaryFile").option("pathGlobFilter", "{train,val,test}.txt").option("ignoreMissingFiles", True)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/train.txt")
    if not path.getFileSystem(conf).exists(path):
        return otherwise(rows)
    named = lists.load(folder).select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("split"), F.explode(F.split(F.col("content").cast("string"), r"\s+")).alias("stem")).where("stem <> ''")
    return rows.join(named.where("split in ('train', 'val', 'test')").distinct(), "stem")


def voc_palette() -> list[tuple[int, int, int]]:
    """RGB of the class ids: their bits, dealt from the top of each channel in turn."""
    out = []
    for k in range(256):
        rgb = [0, 0, 0]
        for bit in range(8):
            for c in range(3):
                rgb[c] |= (k >> (3 * bit + c) & 1) << (7 - bit)
        out.append(tuple(rgb))
    return out


def class_ids(img):
    """Class ids of a mask whose file was decoded to palette colours, by the nearest entry's exact colour; 255 where there is none."""
    import numpy as np

    if img.ndim == 2:
        return img
    code = (img[..., 2].astype(int) << 16) | (img[..., 1].astype(int) << 8) | img[..., 0]
    table = {(r << 16) | (g << 8) | b: k for k, (r, g, b) in reversed(list(enumerate(voc_palette())))}
    found, back = np.unique(code, return_inverse=True)
    return np.array([table.get(int(c), 255) for c in found], np.uint8)[back].reshape(code.shape)


def load_voc_seg(spark: SparkSession, root: str, instance_masks: bool = False) -> DataFrame:
    """stem, image, class_mask, instance_mask, split. A missing class mask drops the row; a missing instance mask is null.

    Without lists the sorted stems end in a tenth (one at least) for test and a tenth for val; neither if that leaves no train.
    """
    from lumaframe.operators.images import apply

    files = from_dir(spark, f"{root}/JPEGImages").withColumn("stem", stem(F.col("path")))
    first = files.withColumn("_r", F.row_number().over(Window.partitionBy("stem").orderBy(F.lower("path")))).where("_r = 1").drop("_r", "path")

    def masks(folder: str, name: str) -> DataFrame:
        found = from_dir(spark, f"{root}/{folder}", ("png",)).withColumn("stem", stem(F.col("path"))).select("stem", "image")
        return apply(found, class_ids).select("stem", F.col("image").alias(name))

    rows = first.join(masks("SegmentationClass", "class_mask"), "stem")
    rows = rows.join(masks("SegmentationObject", "instance_mask"), "stem", "left") if instance_masks else rows.withColumn("instance_mask", F.lit(None).cast(first.schema["image"].dataType))

    def tails(df: DataFrame) -> DataFrame:
        ranked = positions(df.select("stem"), ("stem",), "_r")
        n = F.lit(ranked.count())
        test, val = F.greatest(F.lit(1), F.floor(n / 10)), F.floor(n / 10)
        none = test + val >= n
        return df.join(ranked.withColumns({"_t": F.when(none, 0).otherwise(test), "_v": F.when(none, 0).otherwise(val), "_n": n}), "stem").withColumn("split", F.when(F.col("_r") >= F.col("_n") - F.col("_t"), "test").when(F.col("_r") >= F.col("_n") - F.col("_t") - F.col("_v"), "val").otherwise("train")).drop("_r", "_t", "_v", "_n")

    return with_lists(spark, rows, f"{root}/ImageSets/Segmentation", tails)
