"""Run and model catalogues: the small literal tables that drive the comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values.
BACKGROUND_SIZES = (64, 128, 256, 512)
BACKGROUND_DRAWS = (1, 2, 3)
REFERENCE_SEED, OTHER_SEEDS = 42, (2024, 3407)
REFERENCE_BACKGROUND = "BG256_D1"
MODELS = [
    ("Full canonical", True, "Reference model"),
    ("No Attention", True, "Controlled structural ablation"),
    ("No CNN", True, "Controlled structural ablation"),
    ("No BiLSTM", True, "Controlled structural ablation"),
    ("No RIME", True, "Optimization-strategy comparison"),
    ("CNN", True, "Deep-learning baseline"),
    ("LSTM", True, "Deep-learning baseline"),
    ("BiLSTM", True, "Deep-learning baseline"),
    ("CNN-LSTM", True, "Deep-learning baseline"),
    ("Random Forest", False, "Traditional nonlinear baseline"),
    ("Ridge W36", False, "Traditional linear baseline"),
    ("Monthly climatology", False, "Seasonal climatology baseline"),
    ("point-month climatology", False, "Site-season climatology baseline"),
]


def run_rows() -> list[tuple[str, int, str, int, str]]:
    """(run_id, model_seed, background_draw, background_n, explained_draw), 17 rows by rule."""
    size = int(REFERENCE_BACKGROUND[2:].split("_")[0])
    rows = [
        (f"background_BG{n}_D{d}", REFERENCE_SEED, f"BG{n}_D{d}", n, "EXPLAINED_E0") for n in BACKGROUND_SIZES for d in BACKGROUND_DRAWS
    ]
    rows += [(f"seed_{s}", s, REFERENCE_BACKGROUND, size, "EXPLAINED_E0") for s in OTHER_SEEDS]
    rows += [(f"explained_E{e}", REFERENCE_SEED, REFERENCE_BACKGROUND, size, f"EXPLAINED_E{e}") for e in (1, 2, 3)]
    return rows


def run_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(run_rows(), "run_id string, model_seed int, background_draw string, background_n int, explained_draw string")


def model_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "model string, stochastic boolean, role string")


def comparison_pairs() -> list[tuple[str, str, str]]:
    """(family, reference run, other run) of every run against the reference run."""
    reference = f"background_{REFERENCE_BACKGROUND}"
    family = {"b": "background", "s": "model_seed", "e": "explained_sample"}
    return [(family[r[0][0]], reference, r[0]) for r in run_rows() if r[0] != reference]
