"""Stage 3: features + flags -> split -> scaling -> weighted heads -> prediction table and its metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import FLAGS
from ..operators import clean, models, sampling, scale, split
from ..session import materialize


def prepare_dataset(wide: DataFrame, flags: DataFrame, method: str = "robust", seed: int = split.DEFAULT_SEED, winsorize: bool = True) -> DataFrame:
    """Wide features with flags, pattern, split and the scaled feature array `x_struct` (leaking columns left out)."""
    rows = materialize(wide.join(flags.select("subject_id", *FLAGS, "pattern_code"), "subject_id"), "dataset")
    stratum = split.stratum_of(models.TASK_LABELS["mortality"], models.TASK_LABELS["readmission"], "pattern_code")
    # reads four columns of the stored table; the boundaries of the at most nine strata stay in the plan
    rows = split.assign_split(rows, stratum, seed=seed, few_strata=9)
    rows = clean.impute_mean(rows)
    if winsorize:
        rows = clean.winsorize(rows)
    scalers = scale.fit_scaler(rows, method=method, train=F.col("split") == "train")
    return scale.struct_vector(rows, scalers)


def with_flag_features(dataset: DataFrame, out: str = "features") -> DataFrame:
    return dataset.withColumn(out, F.concat("x_struct", F.array(*[F.col(f).cast("double") for f in FLAGS])))


def train_and_predict(dataset: DataFrame, focus: str = "mortality", target_split: str = "test") -> DataFrame:
    """Fit the three heads on weighted training rows and score the rows of `target_split`."""
    data = materialize(
        with_flag_features(dataset).select("subject_id", *FLAGS, "pattern_code", "split", *models.TASK_LABELS.values(), "features"), "training"
    )
    train = sampling.sample_weights(data.filter(F.col("split") == "train"), models.TASK_LABELS[focus])
    fitted = models.fit_outcome_models(train, "features", weight="weight")
    return models.predict_outcomes(data.filter(F.col("split") == target_split), fitted, "features")
