"""Queries of the detection tables: documents and labels stand in for image and label files, events for boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vision
from ..sources import detections
from .catalogue import query, r6, table

CLASSES = ("view", "click", "purchase", "cart", "search")
_CLASS_LIST = ", ".join(f"'{c}'" for c in CLASSES)


def _images(spark, d):
    docs = table(spark, d, "documents")
    path = F.concat(F.lit("/set/images/D"), F.col("doc_id").cast("string"), F.lit(".JPG"))
    return docs.select(F.col("lang").alias("split"), path.alias("path"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), (F.col("doc_id") % 97 != 0).alias("readable"), (F.length("text") % 640 + 1).alias("width"), (F.col("doc_id") % 480 + 1).alias("height"))


def _labels(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    line = F.concat((F.col("doc_id") % 7).cast("string"), F.lit(" .5 0.25 .1 .2\n\n"), F.when(F.col("doc_id") % 5 == 0, "1.0 0 1 0.5 1").otherwise("x"))
    return j.select(F.col("lang").alias("split"), F.concat(F.lit("/set/labels/d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.when(F.col("quality") == 1, line).otherwise(F.lit(" \n ")).alias("text"))


_LINES = "SELECT l.doc_id, d.lang AS split, l.quality FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


@query(f"""SELECT split, problem, count(*) AS n FROM (SELECT d.lang AS split, CASE WHEN l.doc_id IS NULL THEN 'image_without_label' WHEN l.quality <> 1 THEN 'empty_label' END AS problem FROM documents d LEFT JOIN ({_LINES}) l ON d.doc_id = l.doc_id) GROUP BY 1, 2""")
def file_pairs(spark, d):
    return vision.paired_files(_images(spark, d), _labels(spark, d)).groupBy("split", "problem").agg(F.count("*").alias("n"))


@query(f"""WITH l AS (SELECT * FROM ({_LINES}) WHERE quality = 1), p AS (SELECT split, CASE WHEN doc_id % 7 > 4 THEN 'class_range' ELSE 'ok' END AS error, 1 AS line_no FROM l UNION ALL SELECT split, CASE WHEN doc_id % 5 = 0 THEN 'ok' ELSE 'fields' END, 3 FROM l)
SELECT split, CAST(line_no AS INTEGER) AS line_no, error, count(*) AS n FROM p GROUP BY 1, 2, 3""")
def label_errors(spark, d):
    return vision.label_lines(_labels(spark, d), len(CLASSES)).groupBy("split", "line_no", "error").agg(F.count("*").alias("n"))


@query(f"""WITH l AS (SELECT * FROM ({_LINES}) WHERE quality = 1), b AS (SELECT split, doc_id, doc_id % 7 AS class_id FROM l WHERE doc_id % 7 < 5 UNION ALL SELECT split, doc_id, 1 FROM l WHERE doc_id % 5 = 0),
e AS (SELECT s.split, c.i AS class_id, c.name AS class_name FROM (SELECT DISTINCT lang AS split FROM documents) s, (SELECT unnest([{_CLASS_LIST}]) AS name, unnest([0, 1, 2, 3, 4]) AS i) c)
SELECT e.split, CAST(e.class_id AS INTEGER) AS class_id, e.class_name, count(b.doc_id) AS boxes, count(DISTINCT b.doc_id) AS images FROM e LEFT JOIN b ON e.split = b.split AND e.class_id = b.class_id GROUP BY 1, 2, 3""")
def class_coverage(spark, d):
    splits = [r.lang for r in table(spark, d, "documents").select("lang").distinct().collect()]  # a handful
    return vision.class_coverage(vision.label_lines(_labels(spark, d), len(CLASSES)), CLASSES, splits)


@query(f"""WITH l AS ({_LINES}), i AS (SELECT lang AS split, doc_id, text FROM documents UNION ALL SELECT 'other', doc_id, text FROM documents WHERE doc_id % 250 = 1),
b AS (SELECT split, doc_id % 7 AS c FROM l WHERE quality = 1 AND doc_id % 7 < 5 UNION ALL SELECT split, 1 FROM l WHERE quality = 1 AND doc_id % 5 = 0),
m AS (SELECT s.split, (SELECT count(DISTINCT c) FROM b WHERE b.split = s.split) AS held FROM (SELECT DISTINCT split FROM i) s),
q AS (SELECT (SELECT count(*) FROM l WHERE quality <> 1) AS empty_label_files, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l)) AS images_without_labels, CAST(0 AS BIGINT) AS labels_without_images, (SELECT count(*) FROM i WHERE doc_id % 97 = 0) AS unreadable_images,
 (SELECT count(CASE WHEN doc_id % 7 > 4 THEN 1 END) + count(CASE WHEN doc_id % 5 <> 0 THEN 1 END) FROM l WHERE quality = 1) AS invalid_label_lines, (SELECT count(*) FROM (SELECT text FROM i GROUP BY text HAVING count(DISTINCT split) > 1)) AS cross_split_duplicate_hashes,
 (SELECT count(*) FROM (SELECT doc_id FROM i GROUP BY doc_id HAVING count(DISTINCT split) > 1)) AS cross_split_duplicate_names, (SELECT count(*) FROM m WHERE held < 5) AS splits_missing_classes)
SELECT *, empty_label_files + images_without_labels + labels_without_images + unreadable_images + invalid_label_lines + cross_split_duplicate_hashes + cross_split_duplicate_names + splits_missing_classes > 0 AS blocked FROM q""")
def quality_gate(spark, d):
    """All eight counts; some images stand in a further split too, which has no labels."""
    images = _images(spark, d)
    again = images.where(F.regexp_extract("path", r"D(\d+)", 1).cast("long") % 250 == 1).withColumn("split", F.lit("other"))
    splits = [*(r.lang for r in table(spark, d, "documents").select("lang").distinct().limit(1000).collect()), "other"]  # a handful
    lines = vision.label_lines(_labels(spark, d), len(CLASSES))
    return vision.quality_gate(vision.paired_files(images, _labels(spark, d)), lines, images.unionByName(again), vision.class_coverage(lines, CLASSES, splits))


@query("SELECT CAST(min(length(text) % 640 + 1) AS INTEGER) AS width_min, round(quantile_cont(length(text) % 640 + 1, 0.5), 4) AS width_median, CAST(max(length(text) % 640 + 1) AS INTEGER) AS width_max, min(doc_id % 480 + 1) AS height_min, round(quantile_cont(doc_id % 480 + 1, 0.5), 4) AS height_median, max(doc_id % 480 + 1) AS height_max, count(DISTINCT (length(text) % 640, doc_id % 480)) AS sizes FROM documents")
def image_sizes(spark, d):
    found = vision.resolution_statistics(_images(spark, d))
    return found.select("width_min", F.round("width_median", 4).alias("width_median"), "width_max", "height_min", F.round("height_median", 4).alias("height_median"), "height_max", "sizes")


def _boxes(spark, d):
    e = table(spark, d, "events")
    i = F.col("event_id")
    return e.select(F.col("user_id").alias("image"), i.alias("frame_index"), F.col("event_type").alias("class_name"), (F.col("value") / 500).alias("confidence"), (i % 100 - 5).cast("double").alias("x1"), (i % 70).cast("double").alias("y1"), (i % 100 + 20).cast("double").alias("x2"), (i % 70 + 30).cast("double").alias("y2"), F.lit(110).alias("width"), F.lit(90).alias("height"))


@query("SELECT image, CASE WHEN bool_or(class_name <> 'view') THEN 'ATTENTION' ELSE 'CLEAN' END AS condition, " + ", ".join(f"count(CASE WHEN class_name = '{c}' THEN 1 END) AS n_{c}, round(max(CASE WHEN class_name = '{c}' THEN confidence END), 6) AS max_{c}" for c in CLASSES) + " FROM (SELECT user_id AS image, event_type AS class_name, value / 500 AS confidence FROM events) GROUP BY image")
def image_conditions(spark, d):
    found = vision.condition_summary(_boxes(spark, d), CLASSES, clean="view")
    return found.select("image", "condition", *(f"n_{c}" for c in CLASSES), *(r6(f"max_{c}").alias(f"max_{c}") for c in CLASSES))


@query("SELECT image, detections, highest, in_bounds FROM (SELECT user_id AS image, count(*) AS detections, round(max(value / 500), 6) AS highest, bool_and(event_id % 100 >= 5 AND event_id % 100 + 20 <= 110 AND event_id % 70 + 30 <= 90) AS in_bounds FROM events GROUP BY user_id)")
def prediction_summary(spark, d):
    return vision.prediction_summary(_boxes(spark, d)).select("image", "detections", r6("highest").alias("highest"), "in_bounds")


@query("SELECT user_id AS image, event_id AS frame_index, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value / 500 DESC, event_type, event_id % 100, event_id % 70, event_id) AS INTEGER) AS number FROM events")
def detection_table(spark, d):
    return vision.detection_table(_boxes(spark, d), ties=["frame_index"]).select("image", "frame_index", "number")


@query("SELECT user_id AS image, event_id AS frame_index, " + ", ".join(f"round(greatest(0, least({t}, ({c} {s} {w} / 2) * {t})), 4) AS {n}" for n, c, w, s, t in (("x1", "(event_id % 11 / 10.0)", "0.3", "-", "640"), ("x2", "(event_id % 11 / 10.0)", "0.3", "+", "640"), ("y1", "(event_id % 9 / 8.0)", "0.5", "-", "480"), ("y2", "(event_id % 9 / 8.0)", "0.5", "+", "480"))) + " FROM events")
def box_pixels(spark, d):
    i = F.col("event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("image"), i.alias("frame_index"), (i % 11 / 10).alias("x_center"), (i % 9 / 8).alias("y_center"), F.lit(0.3).alias("width"), F.lit(0.5).alias("height"))
    return vision.to_pixels(rows, F.lit(640), F.lit(480)).select("image", "frame_index", *(F.round(c, 4).alias(c) for c in ("x1", "x2", "y1", "y2")))


def _frames(spark, d):
    b = _boxes(spark, d)
    found = F.when((F.col("frame_index") % 3 == 0) & (F.col("confidence") > 0.2), F.array(F.struct("class_name", "confidence"))).otherwise(F.array().cast("array<struct<class_name:string,confidence:double>>"))
    return b.select(F.col("image").alias("video"), "frame_index", found.alias("detections"))


@query("SELECT user_id AS video, count(*) AS frames, count(CASE WHEN event_id % 3 = 0 THEN 1 END) AS analysed, CASE WHEN count(CASE WHEN h THEN 1 END) = 0 THEN 'NO_DETECTION' WHEN bool_or(h AND event_type <> 'view') THEN 'ATTENTION' ELSE 'CLEAN' END AS condition, count(CASE WHEN h AND event_type = 'view' THEN 1 END) AS n_view, count(CASE WHEN h AND event_type = 'view' THEN 1 END) AS frames_view, round(max(CASE WHEN h AND event_type = 'view' THEN value / 500 END), 6) AS max_view FROM (SELECT *, event_id % 3 = 0 AND value / 500 > 0.2 AS h FROM events) GROUP BY user_id")
def video_summary(spark, d):
    log = vision.frame_log(_frames(spark, d), 3, 5.0)
    return vision.video_summary(log, CLASSES, clean="view").select("video", "frames", "analysed", "condition", "n_view", "frames_view", r6("max_view").alias("max_view"))


@query("SELECT user_id AS video, event_id AS frame_index, event_id % 3 = 0 AS analysed, round(event_id / 5.0, 6) AS video_time, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS analysed_so_far FROM events")
def frame_log(spark, d):
    return vision.frame_log(_frames(spark, d), 3, 5.0).select("video", "frame_index", "analysed", r6("video_time").alias("video_time"), "analysed_so_far")


@query("SELECT user_id AS video, event_id AS frame_index, round(event_id / 5.0, 6) AS video_time, 1 AS number, event_type AS class_name, round(value / 500, 6) AS confidence FROM events WHERE event_id % 3 = 0 AND value / 500 > 0.2")
def detection_rows(spark, d):
    return detections.detection_rows(vision.frame_log(_frames(spark, d), 3, 5.0)).select("video", "frame_index", r6("video_time").alias("video_time"), "number", "class_name", r6("confidence").alias("confidence"))


@query("WITH e AS (SELECT *, event_id % 3 = 0 AND value / 500 > 0.2 AS h FROM events) SELECT user_id AS video, count(*) AS frames, round(count(*) / 5.0, 6) AS duration_seconds, count(CASE WHEN h THEN 1 END) AS total_detections, count(CASE WHEN h AND event_type = 'view' THEN 1 END) AS n_view, round(max(CASE WHEN h AND event_type = 'view' THEN value / 500 END), 6) AS highest_view FROM e GROUP BY user_id")
def video_records(spark, d):
    """The nested summary of each video, with the entries of one class."""
    got = detections.summary_records(vision.frame_log(_frames(spark, d), 3, 5.0), CLASSES, 3, 5.0, clean="view")
    return got.select("video", "frames", r6("duration_seconds").alias("duration_seconds"), "total_detections", F.col("detections_by_class")["view"].alias("n_view"), F.round(F.col("highest_by_class")["view"], 6).alias("highest_view"))


@query("WITH e AS (SELECT CAST(o_orderkey AS BIGINT) AS epoch, (o_orderkey * 37 % 1009) / 2000.0 AS a, (o_orderkey * 53 % 1013) / 3000.0 AS b, (o_orderkey * 71 % 1019) / 100.0 AS loss FROM orders) SELECT count(*) AS epochs, max(epoch) AS last_epoch, (SELECT epoch FROM e ORDER BY CAST(0.1 * a + 0.9 * b AS DOUBLE) DESC, epoch LIMIT 1) AS best_epoch, round(max(CAST(0.1 * a + 0.9 * b AS DOUBLE)), 6) AS best_fitness, round(min(loss), 4) AS lowest_loss FROM e")
def training_summary(spark, d):
    k = F.col("o_orderkey").cast("long")
    log = table(spark, d, "orders").select(k.alias("epoch"), (k * 37 % 1009 / 2000).alias("map50"), (k * 53 % 1013 / 3000).alias("map50_95"), (k * 71 % 1019 / 100).alias("loss"))
    found = vision.training_summary(log, losses=["loss"])
    return found.select("epochs", "last_epoch", "best_epoch", r6("best_fitness").alias("best_fitness"), F.round("lowest_loss", 4).alias("lowest_loss"))


@query("SELECT '/set/' || lang || '/' || source AS directory, count(*) AS images FROM documents GROUP BY 1")
def image_folders(spark, d):
    files = table(spark, d, "documents").select(F.concat(F.lit("/set/"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"))
    return vision.images_per_directory(files)


@query("SELECT source, approx FROM (SELECT source, count(DISTINCT lang) AS approx FROM documents GROUP BY source)")
def approx_distinct_ext(spark, d):
    """Few values: the sketch is exact there."""
    return table(spark, d, "documents").groupBy("source").agg(F.approx_count_distinct("lang", 0.01).alias("approx"))
