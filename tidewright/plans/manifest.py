"""Lineage: dictionaries and manifests of features, labels, datasets and models, and the telemetry of a run."""

from __future__ import annotations

import hashlib
import resource
import time
from typing import Any

from pyspark.sql import DataFrame

from ..operators.checks import assert_no_leakage, validate_names
from ..operators.dataset import Fold
from ..operators.features import FEATURES
from ..operators.models import canonical_json
from ..schema import ValidationError


def names_sha256(names: list[str]) -> str:
    return hashlib.sha256("\n".join(names).encode()).hexdigest()


def family(name: str) -> str:
    """The group of a feature by its name."""
    kinds = {
        "return": ("log_return", "momentum"), "trend": ("efficiency", "ema", "normalized_slope", "up_candle"), "volatility": ("realized", "volatility", "normalized_atr", "semivariance"),
        "position": ("range_position", "support", "resistance", "vwap"), "candle": ("signed_body", "absolute_body", "upper", "lower", "close_location"),
        "calendar": ("time", "weekday", "is_weekend"),
    }
    return next((k for k, starts in kinds.items() if name.startswith(starts)), "volume_and_flow")


def window_of(name: str) -> int:
    """The bars that a feature looks back on, by the numbers in its name; 1 without any."""
    numbers = [int(x) for x in name.replace("m", "").split("_") if x.isdigit()]
    return max(numbers, default=1)


def feature_dictionary(names: list[str] = FEATURES) -> list[dict]:
    return [{"position": k, "name": n, "family": family(n), "window_bars": window_of(n), "type": "float", "uses_future": False} for k, n in enumerate(names)]


def feature_manifest(names: list[str] = FEATURES, version: str = "v1") -> dict:
    validate_names(names, len(names))
    assert_no_leakage(names)
    return {"version": version, "count": len(names), "names": names, "names_sha256": names_sha256(names)}


def check_manifest(manifest: dict, columns: list[str]) -> list[str]:
    """The manifest's names, when they are whole, unchanged and all there."""
    names, errors = manifest["names"], []
    if manifest["names_sha256"] != names_sha256(names):
        errors.append("the names do not match their digest")
    errors += [f"feature {n} is missing" for n in names if n not in columns]
    if errors:
        raise ValidationError(errors)
    return names


def label_dictionary(labels: DataFrame) -> list[dict]:
    inputs = {"decision_time", "open_time", "continuity_segment_id"}
    return [{"name": f.name, "type": f.dataType.simpleString(), "known_at_decision": f.name in inputs} for f in labels.schema]


def dataset_manifest(data: DataFrame, folds: list[Fold], names: list[str], test_start: int) -> dict:
    row = data.selectExpr("count(*) AS rows", "min(decision_time) AS first_time", "max(decision_time) AS last_time", "avg(CAST(label_up_60m AS DOUBLE)) AS up_ratio").first()
    return row.asDict() | {"features": feature_manifest(names), "folds": [f.__dict__ for f in folds], "final_test_start": test_start}


def model_manifest(name: str, parameters: dict[str, Any], names: list[str], metrics: dict, hashes: dict[str, str]) -> dict:
    return {
        "model": name, "parameters": parameters, "parameters_sha256": hashlib.sha256(canonical_json(parameters).encode()).hexdigest(), "features": feature_manifest(names),
        "metrics": metrics, "input_sha256": hashes,
    }


def inference_manifest(names: list[str], model: str, calibrator: str, method: str, threshold: float, lock: str) -> dict:
    """What a scorer needs: inputs in order, files, and how a probability becomes a class."""
    return {
        "features": feature_manifest(names), "feature_type": "float", "model_path": model, "calibrator_path": calibrator, "calibration": method,
        "prediction_threshold": threshold, "class_rule": "1 if the calibrated probability is at least the threshold", "protocol_lock": lock,
    }


class Telemetry:
    """Wall time of the steps and the largest memory of this process."""

    def __init__(self):
        self.began, self.steps = time.perf_counter(), {}

    def step(self, name: str) -> None:
        now = time.perf_counter()
        self.steps[name] = round(now - self.began - sum(self.steps.values()), 3)

    def report(self) -> dict:
        return {"seconds": self.steps, "total_seconds": round(sum(self.steps.values()), 3), "peak_rss_bytes": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024}
