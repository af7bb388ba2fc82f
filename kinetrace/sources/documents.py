"""Document sources and sinks: observation logs, versioned documents, session files, overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYPOINTS = "array<array<double>>"
RAW = (
    "camera_id string, frame long, t_local double, local_track_id long, bbox array<double>, det_conf double, "
    f"keypoints {KEYPOINTS}, floor_point_px array<double>, floor_method string, floor_sigma_px double, appearance array<double>, "
    "appearance_quality double, crop string, quality_flags array<string>"
)
TRACKS = f"video string, width int, height int, fps double, frames array<struct<i:int,t:double,people:array<struct<id:int,box:array<double>,score:double,kp:{KEYPOINTS}>>>>"
CALIBRATION = (
    "schema_version int, cameras array<struct<camera_id:string,image_size:array<int>,homography:array<array<double>>,"
    "coverage_polygon:array<array<double>>,time_offset_s:double>>, floor_landmarks array<struct<id:string,name:string,world:array<double>>>"
)
SCHEMA_VERSION = 1


def raw_observations(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (gzip or not), one detection a row; malformed lines fail.  The stored floor point is kept under its own name."""
    df = spark.read.schema(RAW).option("mode", "FAILFAST").json(path)
    return df.withColumn("floor_point_px_raw", F.col("floor_point_px"))


def pose_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Pose-track documents as one row per detection: video, fps, track, i, t, box, score, kp."""
    return explode_tracks(spark.read.schema(TRACKS).option("multiLine", True).option("mode", "FAILFAST").json(path))


def explode_tracks(documents: DataFrame) -> DataFrame:
    frames = documents.select("video", "width", "height", "fps", F.explode("frames").alias("f"))
    people = frames.select("video", "width", "height", "fps", F.col("f.i").alias("i"), F.col("f.t").alias("t"), F.explode("f.people").alias("p"))
    return people.select("video", "width", "height", "fps", F.col("p.id").alias("track"), "i", "t", F.col("p.box").alias("box"), F.col("p.score").alias("score"), F.col("p.kp").alias("kp"))


def calibrations(spark: SparkSession, path: str, version: int = SCHEMA_VERSION) -> DataFrame:
    """Calibration documents, a row per camera; another schema version fails when it is read."""
    df = spark.read.schema(CALIBRATION).option("multiLine", True).option("mode", "FAILFAST").json(path)
    known = F.when(F.col("schema_version") == version, F.col("cameras")).otherwise(F.raise_error(F.format_string("unsupported schema_version %s", F.col("schema_version"))))
    return df.select(F.explode(known).alias("c"), "floor_landmarks").select("c.*", "floor_landmarks")


def first_videos(spark: SparkSession, folder: str, patterns: dict[str, str]) -> DataFrame:
    """camera_id and path of the first file, by name, for each camera's glob; other types go before .mov."""
    found = None
    for camera, pattern in patterns.items():
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(F.lit(camera).alias("camera_id"), "path")
        found = files if found is None else found.unionByName(files)
    rank = F.struct(F.lower("path").endswith(".mov"), F.col("path"))
    return found.groupBy("camera_id").agg(F.min_by("path", rank).alias("path"))


def write_by_camera(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("camera_id").parquet(path)


def session_document(sets: DataFrame) -> DataFrame:
    """One JSON document per video from sets (video, person, exercise, start_s, end_s, reps): people with their sets and totals."""
    one = F.struct("start_s", "end_s", "exercise", "reps")
    by_exercise = sets.groupBy("video", "person", "exercise").agg(F.sum("reps").alias("n"), F.collect_list(one).alias("sets"))
    exercises, own = F.array_sort(F.collect_list(F.struct("exercise", "n"))), F.array_sort(F.flatten(F.collect_list("sets")))
    rows = by_exercise.groupBy("video", "person").agg(F.sum("n").alias("total_reps"), F.map_from_entries(exercises).alias("exercises"), own.alias("sets"))
    person = F.struct("person", "total_reps", F.map_entries("exercises").alias("exercises"), "sets")  # maps have no order
    people = F.transform(F.array_sort(F.collect_list(person)), lambda p: F.struct(p["person"].alias("person"), p["total_reps"].alias("total_reps"), F.map_from_entries(p["exercises"]).alias("exercises"), p["sets"].alias("sets")))
    return rows.groupBy("video").agg(F.to_json(F.struct(people.alias("people"))).alias("document"))


def run_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One document per camera: model, stride, frames a second, counts."""
    schema = "camera_id string, model string, stride int, fps double, width int, height int, n_frames long, n_detections long"
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def homographies(calibrations: DataFrame) -> DataFrame:
    """camera_id, time_offset_s and the matrix as columns h0 to h8, row by row: the small side of a projection join."""
    flat = F.flatten("homography")
    return calibrations.select("camera_id", "time_offset_s", *[F.get(flat, i).alias(f"h{i}") for i in range(9)])


def camera_homography(calibrations: DataFrame, camera_id: str) -> list[list[float]]:
    row = calibrations.where(F.col("camera_id") == camera_id).select("homography").first()
    if row is None:
        raise KeyError(camera_id)
    return row.homography


def landmark_pairs(clicks: DataFrame, floor_landmarks: DataFrame) -> DataFrame:
    """Clicked landmarks (landmark_id, pixel) with their floor positions (id, world); unknown ones drop out."""
    return clicks.join(floor_landmarks, F.col("landmark_id") == F.col("id")).select("landmark_id", "pixel", "world")


def frame_subset(frames: DataFrame, stride: int, end_s: float | None = None) -> DataFrame:
    """Every stride-th frame up to a time."""
    kept = frames.where(F.col("frame") % stride == 0)
    return kept if end_s is None else kept.where(F.col("t_local") <= end_s)


def export_segments(frames: DataFrame, segments: dict[str, tuple[float, float]], folder: str, tick: float = 0.2) -> None:
    """Closed ranges of frames as JSON files, a folder for each of a few named segments."""
    for name, (t0, t1) in segments.items():
        frames.where((F.col("tick") * tick).between(t0 - 1e-9, t1 + 1e-9)).write.mode("overwrite").json(f"{folder}/{name}")


def overlay_rows(detections: DataFrame, confidence: float = 0.3) -> DataFrame:
    """Packed integer rows [person, x1, y1, x2, y2, x and y of each keypoint], -1 for what is missing."""
    box = F.transform("box", lambda v: F.round(v).cast("int"))
    seen = lambda p, i: F.when(p[2] >= confidence, F.round(p[i]).cast("int")).otherwise(-1)
    points = F.flatten(F.transform("kp", lambda p: F.array(seen(p, 0), seen(p, 1))))
    return detections.select("video", "t", F.concat(F.array(F.col("track").cast("int")), box, points).alias("row"))
