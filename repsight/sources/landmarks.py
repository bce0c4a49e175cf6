"""Landmark dimension (index, side, name) and pose validation.

The dimension has 33 rows (a fixed size), so joining it by ``broadcast`` is
safe at any data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import LANDMARK_DIMENSION, N_LANDMARKS
from ..schemas import LANDMARK_DIM, POSE


def landmark_dimension(spark: SparkSession) -> DataFrame:
    """The dimension from the fixed values (33 rows)."""
    return spark.createDataFrame(LANDMARK_DIMENSION, LANDMARK_DIM)


def read_landmark_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read a landmark CSV: header, blanks around values, empty side -> null (S3)."""
    return (
        spark.read.option("header", True)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .schema(LANDMARK_DIM)
        .csv(path)
    )


def read_damaged_landmark_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """``read_landmark_csv`` with every line kept: a line that is none of the dimension comes out as its text in
    ``damaged_line``, with nulls for what cannot be read (an index that is no number, missing or surplus values)."""
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in LANDMARK_DIM.fields], T.StructField("damaged_line", T.StringType())])
    return (
        spark.read.option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "damaged_line")
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("enforceSchema", True)
        .schema(schema).csv(path)
    )


def valid_landmark(lm: Column) -> Column:
    """A landmark is valid when x and y are present numbers."""
    return lm.isNotNull() & lm["x"].isNotNull() & lm["y"].isNotNull() & ~F.isnan(lm["x"]) & ~F.isnan(lm["y"])


def normalize_pose(pose: Column) -> Column:
    """Keep x, y and default visibility 0 for every landmark."""
    return F.transform(
        pose,
        lambda lm: F.struct(
            lm["x"].cast("double").alias("x"),
            lm["y"].cast("double").alias("y"),
            F.coalesce(lm["visibility"].cast("double"), F.lit(0.0)).alias("visibility"),
        ),
    )


def pose_is_complete(pose: Column, n: int = N_LANDMARKS) -> Column:
    """A usable pose: all ``n`` landmarks present and valid (else the row is rejected)."""
    return (F.size(pose) >= n) & F.forall(pose, valid_landmark)


def split_valid_poses(df: DataFrame, pose_col: str = "landmarks") -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with a reason) — bad input goes to a rejects table."""
    pose = F.col(pose_col)
    ok = pose.isNotNull() & pose_is_complete(pose)
    reason = (
        F.when(pose.isNull(), F.lit("no pose"))
        .when(F.size(pose) < N_LANDMARKS, F.lit("too few landmarks"))
        .otherwise(F.lit("invalid landmark"))
    )
    return df.where(ok), df.where(~ok | ok.isNull()).withColumn("reject_reason", reason)


def parse_pose_json(df: DataFrame, text_col: str = "pose_json", pose_col: str = "landmarks") -> tuple[DataFrame, DataFrame]:
    """Poses given as JSON text (a list of ``{x, y, visibility}``) -> typed pose + rejects.

    A landmark whose ``x`` or ``y`` is not a number (text, null, list, object)
    makes the pose invalid; ``visibility`` defaults to 0 (P15).
    """
    parsed = df.withColumn(pose_col, normalize_pose(F.from_json(F.col(text_col), POSE)))
    return split_valid_poses(parsed.drop(text_col), pose_col)
