"""Verdicts with their stage and category, and the models' label tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INPUT, OUTPUT = "input", "output"
MESSAGE_LENGTH, PROMPT_INJECTION, PERSONAL_DATA = "message_length", "prompt_injection", "personal_data"
OFFENSIVE_INPUT, OUTPUT_PERSONAL_DATA = "offensive_input", "output_personal_data"

STAGES = ("input", "retrieval", "output", "tool")
CATEGORIES = ("limits", "security", "privacy", "tone")
#: Categories that count as uncovered when nothing of theirs is on; tone ships off.
COVERED_BY_DEFAULT = ("limits", "security", "privacy")

STAGE_OF = {MESSAGE_LENGTH: INPUT, PROMPT_INJECTION: INPUT, PERSONAL_DATA: INPUT, OFFENSIVE_INPUT: INPUT, OUTPUT_PERSONAL_DATA: OUTPUT}
CATEGORY_OF = {MESSAGE_LENGTH: "limits", PROMPT_INJECTION: "security", PERSONAL_DATA: "privacy", OFFENSIVE_INPUT: "tone", OUTPUT_PERSONAL_DATA: "privacy"}
UNKNOWN_STAGE, UNCATEGORIZED = "unknown", "uncategorized"

#: Fixed values: (guard, model, raw label, meaning, whether it blocks).
LABELS = (
    ("injection", "meta-llama/Llama-Prompt-Guard-2-86M", "LABEL_0", "BENIGN", False),
    ("injection", "meta-llama/Llama-Prompt-Guard-2-86M", "LABEL_1", "MALICIOUS", True),
    ("injection", "meta-llama/Llama-Prompt-Guard-2-22M", "LABEL_0", "BENIGN", False),
    ("injection", "meta-llama/Llama-Prompt-Guard-2-22M", "LABEL_1", "MALICIOUS", True),
    ("injection", "deepset/deberta-v3-base-injection", "LEGIT", "BENIGN", False),
    ("injection", "deepset/deberta-v3-base-injection", "INJECTION", "MALICIOUS", True),
    ("offensive", "IMSyPP/hate_speech_multilingual", "LABEL_0", "appropriate", False),
    ("offensive", "IMSyPP/hate_speech_multilingual", "LABEL_1", "inappropriate", False),
    ("offensive", "IMSyPP/hate_speech_multilingual", "LABEL_2", "offensive", True),
    ("offensive", "IMSyPP/hate_speech_multilingual", "LABEL_3", "violent", True),
    ("offensive", "patriciacarla/HS-multilingual-DNR", "LABEL_0", "acceptable", False),
    ("offensive", "patriciacarla/HS-multilingual-DNR", "LABEL_1", "inappropriate", False),
    ("offensive", "patriciacarla/HS-multilingual-DNR", "LABEL_2", "offensive", True),
    ("offensive", "patriciacarla/HS-multilingual-DNR", "LABEL_3", "violent", True),
    ("offensive", "textdetox/bert-multilingual-toxicity-classifier", "LABEL_0", "neutral", False),
    ("offensive", "textdetox/bert-multilingual-toxicity-classifier", "LABEL_1", "toxic", True),
)


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def category_of(verdict: Column) -> Column:
    return F.when(verdict.isNull(), UNCATEGORIZED).otherwise(_lookup(CATEGORY_OF, verdict, UNCATEGORIZED))


def stage_of(verdict: Column) -> Column:
    return F.when(verdict.isNull(), UNKNOWN_STAGE).otherwise(_lookup(STAGE_OF, verdict, UNKNOWN_STAGE))


def label_map(spark: SparkSession) -> DataFrame:
    """(guard, model, raw_label, semantic, blocks); a table of fixed size."""
    return spark.createDataFrame(LABELS, "guard string, model string, raw_label string, semantic string, blocks boolean")


def models(guard: str) -> tuple[str, ...]:
    """The supported models of a guard, in order."""
    return tuple(dict.fromkeys(x[1] for x in LABELS if x[0] == guard))


def blocking_labels(guard: str, model: str) -> tuple[str, ...]:
    """Upper-cased meanings that block; none for an unknown model."""
    return tuple(x[3].upper() for x in LABELS if x[0] == guard and x[1] == model and x[4])
