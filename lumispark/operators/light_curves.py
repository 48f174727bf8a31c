"""Light-curve revisions: exact lookup, mechanical checks, order, and model vectors. Flat and nested tables both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumispark.functions import vectors as V
from lumispark.functions.columns import computed_once
from lumispark.schemas import MAX_EPOCHS, MIN_EPOCHS

KEY = ["object_id", "light_curve_revision"]


def _bad_field() -> Column:
    """What is wrong with an epoch: its time, then its magnitude, then its error; null if nothing is."""
    sound = V.finite(F.col("magnitude_error")) & (F.col("magnitude_error") > 0)
    return F.when(~V.finite(F.col("observation_time")), "BAD_TIME").when(~V.finite(F.col("magnitude")), "BAD_MAGNITUDE").when(~F.coalesce(sound, F.lit(False)), "BAD_MAGNITUDE_ERROR")


def summaries(epochs: DataFrame) -> DataFrame:
    """Of flat epochs (KEY, epoch_index, ...): actual count, distinct times, and the first bad epoch with its reason.

    All are partial aggregates but the distinct times, for which Spark groups by time as well first: a revision of
    millions of epochs is dealt out, and no array of them is ever made. -0.0 and 0.0 are one time."""
    bad = _bad_field()
    return epochs.groupBy(*KEY).agg(
        F.count("*").alias("actual_count"),
        F.countDistinct(F.col("observation_time") + F.lit(0.0)).alias("distinct_times"),
        F.min(F.when(bad.isNotNull(), F.struct(F.col("epoch_index").alias("index"), bad.alias("reason")))).alias("first_bad"),
    )


def status(declared: Column, metadata: Column, actual: Column, first_bad: Column, distinct: Column) -> Column:
    """The first failing check by name, null if the revision is sound: counts, limits, first bad epoch, duplicate times."""
    counts = F.coalesce((declared == metadata) & (metadata == actual), F.lit(False))
    return (
        F.when(~counts, "EPOCH_COUNT_MISMATCH")
        .when(actual < MIN_EPOCHS, "TOO_FEW_EPOCHS")
        .when(actual > MAX_EPOCHS, "TOO_MANY_EPOCHS")
        .when(first_bad.isNotNull(), first_bad["reason"])
        .when(distinct < actual, "DUPLICATE_TIME")
    )


def check_revisions(requests: DataFrame, revisions: DataFrame, epochs: DataFrame) -> DataFrame:
    """requests (KEY, declared_eligible_epoch_count, ...) with actual_count and ``cause``: REVISION_NOT_FOUND or a failed check.

    A request meets exactly the revision it names, never the latest. Epochs of revisions that nobody asks for are left
    out before they are counted; a request may come twice, so its keys are made distinct first."""
    asked = requests.select(*KEY).distinct()
    found = summaries(epochs.join(asked, KEY, "left_semi"))
    meta = revisions.join(asked, KEY, "left_semi").select(*KEY, F.col("eligible_epoch_count").alias("metadata_count"))
    known = meta.join(found, KEY, "left").withColumn("actual_count", F.coalesce("actual_count", F.lit(0)))
    out = requests.join(known, KEY, "left")
    cause = F.when(F.col("metadata_count").isNull(), "REVISION_NOT_FOUND").otherwise(
        status(F.col("declared_eligible_epoch_count"), F.col("metadata_count"), F.col("actual_count"), F.col("first_bad"), F.col("distinct_times"))
    )
    return computed_once(out, "cause", cause).drop("metadata_count", "first_bad", "distinct_times")


def nested(epochs: DataFrame, sound: DataFrame) -> DataFrame:
    """Sorted epochs of the revisions in ``sound`` (KEY): they have passed the checks, so an array has 1024 at most."""
    own = epochs.join(sound.select(*KEY).distinct(), KEY, "left_semi")
    return own.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("observation_time", "magnitude", "magnitude_error"))).alias("epochs"))


def flat(revisions: DataFrame) -> DataFrame:
    """Nested revisions as flat epochs with their place in the input."""
    return revisions.select(*KEY, F.posexplode("epochs").alias("epoch_index", "e")).select(*KEY, "epoch_index", "e.*")


def adjacent_duplicates(epochs: DataFrame) -> DataFrame:
    """Epochs whose time is that of the one before in their revision."""
    order = Window.partitionBy(*KEY).orderBy("observation_time", "epoch_index")
    return epochs.withColumn("place", F.row_number().over(order)).withColumn("before", F.lag("observation_time").over(order)).where("before = observation_time").drop("before")


def sorted_epochs(epochs: DataFrame) -> DataFrame:
    return epochs.withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy("observation_time", "epoch_index")))


def model_vectors(prepared: DataFrame) -> DataFrame:
    """Vectors of prepared revisions (epochs sorted): plain ones, and normalised times, centred magnitudes, bucket, mask.

    Padding is left to the scorer's edge (``functions.vectors.padded``), so that no zeros are shuffled."""
    of = lambda c: F.transform("epochs", lambda e: e[c])
    out = prepared.withColumn("times", of("observation_time")).withColumn("magnitudes", of("magnitude")).withColumn("errors", of("magnitude_error"))
    return (
        out.withColumn("n", F.size("epochs").cast("long"))
        .withColumn("normalised_times", V.normalised_times(F.col("times")))
        .withColumn("centred_magnitudes", V.centred(F.col("magnitudes")))
        .withColumn("length_bucket", V.length_bucket(F.col("n")))
        .withColumn("mask", V.mask(F.col("n"), F.col("length_bucket")))
    )
