"""What a media probe says of a file, as columns, and the rules on it. The probe itself runs outside; its answer comes as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelode.functions import coerce
from framelode.functions import numbers as N
from framelode.functions import text as T
from framelode.functions import variants as V

#: From which height and rate a video is made smaller; how far two lengths of one video may be apart, in seconds or as a share.
MOST_HEIGHT, MOST_FPS = 480, 10.0
OFF_SECONDS, OFF_SHARE = 5.0, 0.01


def info(probes: DataFrame, column: str = "probe") -> DataFrame:
    """``probes`` with duration, width, height, fps, codec and file_size of the first video stream of ``column``; rows without one are left out."""
    value = T.json_value(F.col(column))
    rows = probes.withColumn("_v", value).withColumn("_streams", V.objects(F.col("_v"), "streams"))
    video = F.get(F.filter("_streams", lambda s: V.raw_text(s["item"], "codec_type") == "video"), F.lit(0))["item"]
    rows = rows.withColumn("_video", video).where("_video is not null")
    s, v = F.col("_video"), F.col("_v")
    whole = lambda c, path: F.coalesce(F.try_variant_get(c, f"$.{path}", "long"), F.lit(0))
    return rows.select(
        *probes.columns, V.number(v, "format.duration").alias("duration"), whole(s, "width").cast("int").alias("width"), whole(s, "height").cast("int").alias("height"),
        N.half_even(coerce.frame_rate(F.coalesce(V.raw_text(s, "r_frame_rate"), F.lit("30/1"))), 2).alias("fps"), F.coalesce(V.raw_text(s, "codec_name"), F.lit("unknown")).alias("codec"), whole(v, "format.size").alias("file_size"),
    )


def needs_compression(height: Column, fps: Column) -> Column:
    return (height > MOST_HEIGHT) | (fps > MOST_FPS)


def duration_matches(expected: Column, actual: Column) -> Column:
    """Whether two lengths are those of one video: five seconds or a hundredth apart at most, and neither is none."""
    return (expected > 0) & (actual > 0) & (F.abs(expected - actual) <= F.greatest(F.lit(OFF_SECONDS), expected * OFF_SHARE))
