"""Tables of object detection: label lines, dataset integrity, class balance, detections, conditions, training logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import percentiles
from ..functions.scalars import category


def parse_label_lines(df: DataFrame, line: str, classes: int) -> DataFrame:
    """class_id, x_center, y_center, width, height and an error code ('ok' if none) of each line."""
    f = F.split(F.trim(F.col(line)), r"\s+")
    at = lambda i: F.get(f, F.lit(i))
    number = at(0).try_cast("double")
    cls = F.when(number == F.floor(number), number).try_cast("int")  # whole numbers, written as 1 or 1.0
    x, y, w, h = (at(i).try_cast("double") for i in range(1, 5))
    inf = F.lit(float("inf"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == inf)
    error = category(
        f,
        [
            (F.size(f) != 5, "fields"),
            (cls.isNull(), "class_text"),
            (~cls.between(0, classes - 1), "class_range"),  # of whole numbers
            (bad(x) | bad(y) | bad(w) | bad(h), "not_finite"),
            (~x.between(0, 1) | ~y.between(0, 1), "centre"),
            ((w <= 0) | (w > 1) | (h <= 0) | (h > 1), "size"),
        ],
        "ok",
    )
    return df.select("*", cls.alias("class_id"), x.alias("x_center"), y.alias("y_center"), w.alias("width"), h.alias("height"), error.alias("error"))


def class_balance(boxes: DataFrame, cls: str, image: str, ratio: float = 1.5) -> DataFrame:
    """Boxes, images and share of each class, and whether the largest is `ratio` times the smallest."""
    t = boxes.groupBy(cls).agg(F.count("*").alias("boxes"), F.count_distinct(image).alias("images"))
    total = t.agg(F.sum("boxes").alias("_sum"), (F.max("boxes") / F.min("boxes") >= ratio).alias("imbalanced"))
    return t.crossJoin(F.broadcast(total)).select(cls, "boxes", "images", (F.col("boxes") * 100.0 / F.col("_sum")).alias("share"), "imbalanced")


def condition(detections: Column, defects: Column) -> Column:
    return category(detections, [(detections == 0, "NO_DETECTION"), (defects == 0, "CLEAN")], "ATTENTION")


def clip_boxes(df: DataFrame, width: str, height: str) -> DataFrame:
    """Corners sorted and clipped to the frame, confidence to [0, 1]."""
    clip = lambda c, top: F.greatest(F.lit(0.0), F.least(c, top.cast("double")))
    w, h = F.col(width), F.col(height)
    x = (F.least("x1", "x2"), F.greatest("x1", "x2"))
    y = (F.least("y1", "y2"), F.greatest("y1", "y2"))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl("confidence", F.lit(0.0))))
    return df.withColumns({"x1": clip(x[0], w), "x2": clip(x[1], w), "y1": clip(y[0], h), "y2": clip(y[1], h), "confidence": confidence})


def key_of(path: Column) -> Column:
    """File name without suffix, lower case: what pairs an image with its label."""
    return F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", ""))


def label_path(image: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(image, "/images/", "/labels/"), r"\.[^.]*$", ".txt")


def label_lines(labels: DataFrame, classes: int) -> DataFrame:
    """split, key, line_no, parsed fields and error of each line that is not blank; labels: split, path, text."""
    lines = labels.select("split", key_of(F.col("path")).alias("key"), F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line")).where(F.trim("line") != "")
    return parse_label_lines(lines.withColumn("line_no", F.col("line_no") + 1), "line", classes)


def paired_files(images: DataFrame, labels: DataFrame) -> DataFrame:
    """split, key, image, label, problem: image_without_label, label_without_image, empty_label or null."""
    a = images.select("split", key_of(F.col("path")).alias("key"), F.col("path").alias("image"))
    b = labels.select("split", key_of(F.col("path")).alias("key"), F.col("path").alias("label"), (F.trim(F.regexp_replace("text", r"\s+", " ")) == "").alias("_blank"))
    j = a.join(b, ["split", "key"], "full")
    problem = F.when(F.col("label").isNull(), "image_without_label").when(F.col("image").isNull(), "label_without_image").when(F.col("_blank"), "empty_label")
    return j.select("split", "key", "image", "label", problem.alias("problem"))


def empty_label_images(pairs: DataFrame) -> DataFrame:
    """Empty labels with exactly one image."""
    one = pairs.where("problem = 'empty_label'").groupBy("split", "label").agg(F.count("image").alias("_n"), F.first("image").alias("image"))
    return one.where("_n = 1").select("split", "image", "label")


def cross_split_duplicates(files: DataFrame, column: str) -> DataFrame:
    """Values of a column (a digest, a file name) that more than one split holds, with their splits and number."""
    return files.groupBy(column).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)  # a handful of splits


def class_coverage(lines: DataFrame, classes: Sequence[str], splits: Sequence[str]) -> DataFrame:
    """split, class_id, class_name, boxes, images: every declared class in every split, zeros included."""
    spark = lines.sparkSession
    every = spark.createDataFrame([(s, i, c) for s in splits for i, c in enumerate(classes)], "split string, class_id int, class_name string")
    n = lines.where("error = 'ok'").groupBy("split", "class_id").agg(F.count("*").alias("boxes"), F.count_distinct("key").alias("images"))
    return every.join(n, ["split", "class_id"], "left").fillna(0, ["boxes", "images"])


def quality_gate(pairs: DataFrame, lines: DataFrame, images: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row: eight issue counts and whether training is blocked; images: split, path, sha256, readable."""
    count = lambda name: F.count_if(F.coalesce(F.col("problem") == name, F.lit(False)))
    files = pairs.agg(count("empty_label").alias("empty_label_files"), count("image_without_label").alias("images_without_labels"), count("label_without_image").alias("labels_without_images"))
    bad = images.agg(F.count_if(~F.coalesce(F.col("readable"), F.lit(False))).alias("unreadable_images"))
    wrong = lines.agg(F.count_if(F.col("error") != "ok").alias("invalid_label_lines"))
    names = images.withColumn("name", F.lower(F.regexp_extract("path", r"([^/]+)$", 1)))
    hashes = cross_split_duplicates(images, "sha256").agg(F.count("*").alias("cross_split_duplicate_hashes"))
    repeated = cross_split_duplicates(names, "name").agg(F.count("*").alias("cross_split_duplicate_names"))
    lacking = coverage.groupBy("split").agg(F.count_if(F.col("boxes") == 0).alias("_none")).agg(F.count_if(F.col("_none") > 0).alias("splits_missing_classes"))
    out = files
    for one in (bad, wrong, hashes, repeated, lacking):  # one row each
        out = out.crossJoin(F.broadcast(one))
    total = F.lit(0)
    for c in out.columns:
        total = total + F.col(c)
    return out.withColumn("blocked", total > 0)


def resolution_statistics(images: DataFrame) -> DataFrame:
    """One row: smallest, median, largest width and height, and how many different sizes."""
    facts = images.agg(*(f(c).alias(f"{c}_{n}") for c in ("width", "height") for n, f in (("min", F.min), ("max", F.max))))
    sizes = images.groupBy("width", "height").agg(F.count("*").alias("n")).agg(F.count("*").alias("sizes"))
    medians = percentiles(images, "width", {"width_median": 0.5}).crossJoin(percentiles(images, "height", {"height_median": 0.5}))
    return facts.crossJoin(sizes).crossJoin(medians)  # one row each


def images_per_directory(files: DataFrame) -> DataFrame:
    return files.groupBy(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("directory")).agg(F.count("*").alias("images"))


def to_pixels(df: DataFrame, width: Column, height: Column) -> DataFrame:
    """x1, y1, x2, y2 of normalised centre boxes, inside the frame."""
    edge = lambda c, size, sign, top: F.greatest(F.lit(0.0), F.least(top.cast("double"), (F.col(c) + sign * F.col(size) / 2) * top))
    return df.withColumns({"x1": edge("x_center", "width", -1, width), "x2": edge("x_center", "width", 1, width), "y1": edge("y_center", "height", -1, height), "y2": edge("y_center", "height", 1, height)})


def named_classes(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    names = F.array(*(F.lit(c) for c in classes))
    return df.withColumn("class_name", F.get(names, F.col("class_id")))


def condition_summary(detections: DataFrame, classes: Sequence[str], by: str = "image", clean: str = "clean") -> DataFrame:
    """by, condition, and the count and highest confidence of every declared class."""
    cells = []
    for c in classes:
        own = F.col("class_name") == c
        cells += [F.count_if(own).alias(f"n_{c}"), F.max(F.when(own, F.col("confidence"))).alias(f"max_{c}")]
    found = F.count("class_name")
    return detections.groupBy(by).agg(condition(found, F.count_if(F.col("class_name") != clean)).alias("condition"), *cells)


def detection_table(detections: DataFrame, by: str = "image", ties: Sequence[str] = ()) -> DataFrame:
    """Detections of each image numbered by falling confidence, then class and corner; ties: columns that settle what is left equal."""
    w = Window.partitionBy(by).orderBy(F.desc("confidence"), "class_name", "x1", "y1", *ties)
    return detections.withColumn("number", F.row_number().over(w))


def prediction_summary(detections: DataFrame, by: str = "image") -> DataFrame:
    """by, detections, highest, mean, in_bounds: do all boxes lie inside their image (width, height)?"""
    inside = (F.col("x1") >= 0) & (F.col("y1") >= 0) & (F.col("x2") <= F.col("width")) & (F.col("y2") <= F.col("height")) & (F.col("x1") <= F.col("x2")) & (F.col("y1") <= F.col("y2"))
    return detections.groupBy(by).agg(F.count("*").alias("detections"), F.max("confidence").alias("highest"), F.avg("confidence").alias("mean"), F.min(inside).alias("in_bounds"))


def frame_log(frames: DataFrame, stride: int, fps: float, by: str = "video") -> DataFrame:
    """frames (by, frame_index, detections: array) with analysed, video_time and the running number of analysed frames; skipped frames stay."""
    hit = F.col("frame_index") % stride == 0
    w = Window.partitionBy(by).orderBy("frame_index")
    return frames.select("*", hit.alias("analysed"), (F.col("frame_index") / F.lit(float(fps if fps > 0 else 30))).alias("video_time"), F.sum(hit.cast("int")).over(w).alias("analysed_so_far"))


def video_summary(log: DataFrame, classes: Sequence[str], by: str = "video", clean: str = "clean") -> DataFrame:
    """by, frames, analysed, condition, and for every declared class detections, frames with it and highest confidence."""
    facts = log.groupBy(by).agg(F.count("*").alias("frames"), F.count_if("analysed").alias("analysed"))
    each = log.select(by, "frame_index", F.explode("detections").alias("d")).select(by, "frame_index", "d.class_name", "d.confidence")
    cells = []
    for c in classes:
        own = F.col("class_name") == c
        cells += [F.count_if(own).alias(f"n_{c}"), F.count_distinct(F.when(own, F.col("frame_index"))).alias(f"frames_{c}"), F.max(F.when(own, F.col("confidence"))).alias(f"max_{c}")]
    found = each.groupBy(by).agg(*cells, F.count("*").alias("_all"), F.count_if(F.col("class_name") != clean).alias("_odd"))
    out = facts.join(found, by, "left").fillna(0, ["_all", "_odd", *(f"n_{c}" for c in classes), *(f"frames_{c}" for c in classes)])
    return out.withColumn("condition", condition(F.col("_all"), F.col("_odd"))).drop("_all", "_odd")


def training_summary(log: DataFrame, map50: str = "map50", map95: str = "map50_95", losses: Sequence[str] = ()) -> DataFrame:
    """One row: epochs, last and best epoch by fitness 0.1 mAP50 + 0.9 mAP50-95, the best fitness, lowest losses with their epochs."""
    fitness = 0.1 * F.col(map50) + 0.9 * F.col(map95)
    low = [x for c in losses for x in (F.min(c).alias(f"lowest_{c}"), F.min_by("epoch", c).alias(f"epoch_lowest_{c}"))]
    return log.agg(F.count("*").alias("epochs"), F.max("epoch").alias("last_epoch"), F.max_by("epoch", F.struct(fitness, -F.col("epoch"))).alias("best_epoch"), F.max(fitness).alias("best_fitness"), *low)


def class_metrics(metrics: DataFrame, classes: Sequence[str]) -> DataFrame:
    """class_id, class_name, precision, recall, map50, map50_95 from one row of arrays, best class first."""
    names = ("recall", "map50", "map50_95")
    cells = F.transform("precision", lambda x, i: F.struct(x.cast("double").alias("precision"), *(F.get(F.col(c), i).cast("double").alias(c) for c in names)))
    rows = metrics.select(F.posexplode(cells).alias("class_id", "m")).select("class_id", "m.*")
    return named_classes(rows, classes).orderBy(F.desc_nulls_last("map50_95"), "class_id")


def pick_examples(class_sets: DataFrame, most: int, image: str = "image", classes: str = "classes", most_sets: int = 1 << 16) -> list[str]:
    """Images that show as many classes as they can: each pick adds the most classes not shown yet, ties to the first image.

    One job: of the images that show the same classes only the first can be picked, so the choice is among as many as
    there are sets of classes (at most 2^k of k classes; more than `most_sets` is an error). A null set shows nothing.
    """
    shows = F.sort_array(F.array_distinct(F.coalesce(F.col(classes), F.array().cast("array<string>"))))
    firsts = class_sets.select(shows.alias("_set"), F.col(image).alias("_image")).groupBy("_set").agg(F.min("_image").alias("_image"))
    sets = firsts.limit(most_sets + 1).collect()
    if len(sets) > most_sets:
        raise ValueError(f"more than {most_sets} sets of classes")
    bit = {c: 1 << i for i, c in enumerate(sorted({c for r in sets for c in r["_set"]}))}
    masks = {r["_image"]: sum(bit[c] for c in r["_set"]) for r in sets}
    picked, shown = [], 0
    while masks and len(picked) < most:
        best = min(masks, key=lambda x: (-(masks[x] & ~shown).bit_count(), x))
        if picked and not masks[best] & ~shown:
            break
        picked.append(best)
        shown |= masks.pop(best)
    return picked


def predictions_of(images: DataFrame, detections: DataFrame, image: str = "image") -> DataFrame:
    """Every image with the list of its detections, empty where there are none."""
    lists = detections.groupBy(image).agg(F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("_c"), "class_name", "confidence", "x1", "y1", "x2", "y2"))).alias("_l"))  # those of one image
    clean = F.transform("_l", lambda d: F.struct(*(d[c].alias(c) for c in ("class_name", "confidence", "x1", "y1", "x2", "y2"))))
    return images.join(lists, image, "left").withColumn("detections", F.coalesce(clean, F.array().cast("array<struct<class_name:string,confidence:double,x1:double,y1:double,x2:double,y2:double>>"))).drop("_l")
