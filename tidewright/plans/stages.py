"""The batch pipeline in stages: each reads tables and a configuration and writes tables, a manifest and a report.

Every stage is restartable: it reads what earlier stages wrote below the run's folder and overwrites its own outputs.
"""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import checks as K
from ..operators import clean as C
from ..operators import dataset as D
from ..operators import features as FE
from ..operators import gates as G
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import models as E
from ..operators import profile as P
from ..operators import selection as SE
from ..schema import ValidationError
from ..sources import io as IO
from . import manifest as MF


@dataclass
class Config:
    """What a run needs; times are epoch milliseconds, windows count bars."""

    interval: int = 60_000
    horizon: int = 3_600_000
    history: tuple[int, ...] = (5, 15, 30, 60, 120, 240)
    future: tuple[int, ...] = (1, 60, 61)
    sample: int = 5
    test_start: int = 0
    folds: list[D.Fold] = field(default_factory=list)
    features: list[str] = field(default_factory=lambda: list(FE.FEATURES))
    trees: E.TreeParams = field(default_factory=E.TreeParams)
    early_stop_window: int = 90 * 86_400_000
    patience: int = 20

    def check(self) -> Config:
        errors = []
        if self.interval <= 0 or self.horizon % self.interval:
            errors.append("the horizon must be a multiple of a positive interval")
        if max(self.future) * self.interval < self.horizon:
            errors.append("the longest future flag must cover the horizon")
        if sorted(self.folds, key=lambda f: f.start) != self.folds or any(f.start >= f.end for f in self.folds):
            errors.append("folds must be ranges in order")
        if any(f.end > self.test_start for f in self.folds):
            errors.append("folds must end before the final test")
        if errors:
            raise ValidationError(errors)
        return self


class Run:
    def __init__(self, spark: SparkSession, folder: str, config: Config):
        self.spark, self.folder, self.config = spark, folder, config.check()
        self.telemetry = MF.Telemetry()

    def at(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.at(name))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        IO.write_parquet(df, self.at(name))
        return self.table(name)

    def report(self, stage: str, facts: dict, sections: dict[str, str | DataFrame]) -> None:
        self.telemetry.step(stage)
        IO.write_json(self.at(f"reports/{stage}.json"), {"stage": stage, "facts": facts, "telemetry": self.telemetry.report(), "config": asdict(self.config)})
        IO.write_markdown(self.at(f"reports/{stage}.md"), stage, sections)

    def audit(self, trades_csv: str, bars_csv: str) -> None:
        """Stage 0: types, missing values, mapping of columns and time units of the raw files."""
        sections, facts = {}, {}
        for name, path in (("trades", trades_csv), ("bars", bars_csv)):
            raw = IO.text_csv(self.spark, path)
            profiled = self.save(P.profile(raw), f"audit/{name}")
            facts[name] = {"mapping": P.role_mapping(name, raw.columns), "meaning": {c: P.meaning(c) for c in raw.columns}}
            sections |= {f"{name}: columns": profiled, f"{name}: times": P.time_fields(profiled)}
        self.report("stage0", facts, sections)

    def clean(self, raw_trades: DataFrame, raw_bars: DataFrame) -> None:
        """Stage 1: clean trades and segmented bars, with the counts of what went."""
        c = self.config
        trades, bars = C.clean_trades(C.with_file_order(raw_trades)), C.clean_bars(C.with_file_order(raw_bars), c.interval)
        self.save(trades.rows, "trades")
        clean = self.save(bars.rows, "bars")
        self.save(bars.side["repairs"], "repairs")
        self.report("stage1", {}, {"trades": trades.counts, "bars": bars.counts, "gaps": C.gap_report(clean, c.interval), "longest segment": C.longest_segment(clean)})

    def model_base(self) -> None:
        """Stage 2A: positions, history and future flags, candidates."""
        c = self.config
        bars = self.table("bars")
        K.require(bars, K.bar_suite(c.interval), "bars")
        base = self.save(C.with_positions(bars, c.interval, c.history, c.future, c.sample), "model_base")
        self.report("stage2a", {}, {"segments": C.segment_sizes(base)})

    def overlap(self) -> None:
        """Stage 2B: bars from trades and their reconciliation."""
        trades = self.table("trades")
        K.require(trades, K.trade_suite(), "trades")
        agg = self.save(B.boundary_flags(B.aggregate_trades(trades, self.config.interval)), "agg_bars")
        K.require(agg, K.aggregate_suite(), "trade bars")
        plain = self.table("bars").select("open_time", "open", "high", "low", "close", "volume", "quote_volume", "number_of_trades", "taker_buy_base_volume", "taker_buy_quote_volume")
        o = self.save(B.reconcile(agg, plain), "overlap")
        self.report("stage2b", {}, {"status": P.frequencies(o, "join_status"), "gaps": B.bucketed_gaps(o.join(agg.select("open_time", "internal_missing_agg_trade_id_count"), "open_time"), F.col("internal_missing_agg_trade_id_count"), F.col("base_volume_relative_error")), "largest errors": o.orderBy(F.desc("max_abs_price_error_bps"), "open_time").limit(100)})

    def labels(self) -> None:
        """Stages 3A and 3B: the proxy's validation on the overlap, and labels of the whole history."""
        base, o, c = self.table("model_base"), self.table("overlap"), self.config
        minutes = o.join(self.table("agg_bars").select("open_time", "vwap_first_2s"), "open_time", "left")
        proxy = self.save(L.label_proxy(L.prediction_rows(base), minutes, c.horizon), "label_proxy")
        y = self.save(L.full_labels(base, c.horizon, f"has_future_{max(c.future)}m"), "labels")
        K.require(y, K.label_suite(), "labels")
        agree = L.agreement_by(proxy, "label_kline_open", "label_vwap_first_5s", [])
        self.report("stage3", {"dictionary": MF.label_dictionary(y)}, {"agreement": agree, "distributions": L.label_distributions(y), "invalid": L.invalid_details(y), "extremes": L.extreme_returns(y)})

    def features(self) -> None:
        """Stage 4: the feature table, its summary and its neutral values."""
        names = self.config.features
        computed = FE.features(self.table("model_base"))
        table = self.save(FE.feature_table(computed, names), "features")
        IO.write_json(self.at("feature_manifest.json"), MF.feature_manifest(names))
        self.report("stage4", {"dictionary": MF.feature_dictionary(names)}, {"summary": FE.feature_summary(table, names), "incomplete": FE.incomplete_samples(table)})

    def dataset(self) -> None:
        """Stage 5: the audited join, row ids, splits and the fold manifest."""
        c = self.config
        features, y = self.table("features"), self.table("labels")
        names = MF.check_manifest(IO.read_json(self.at("feature_manifest.json")), features.columns)
        audit = self.save(D.join_audit(features, y, names, c.interval, c.horizon), "join_audit")
        data = self.save(D.dataset(audit, features, names), "dataset")
        K.require(data, K.dataset_suite(), "dataset")
        split = self.save(D.splits(data, c.test_start, c.folds, c.interval, c.horizon), "splits")
        errors = [e for f in c.folds for e in D.fold_errors(data, split, f)]
        if errors:
            raise ValidationError(errors)
        IO.write_json(self.at("dataset_manifest.json"), MF.dataset_manifest(data, c.folds, names, c.test_start))
        self.report("stage5", {}, {"folds": D.fold_manifest(data, split, c.folds), "summary": D.split_summary(data, split, c.folds), "excluded": D.exclusion_histogram(audit)})

    def _fold(self, fold: D.Fold) -> tuple[DataFrame, DataFrame]:
        rows = D.joined(self.table("dataset"), self.table("splits")).withColumn("y_true", F.col("label_up_60m").cast("int"))
        role = F.col(f"{fold.name}_role")
        keep = ["dataset_row_id", "decision_time", "settlement_minute_open_time", "y_true", "abs_future_return_bps_60m", "evaluation_offset_minutes", "is_primary_nonoverlap_evaluation", *self.config.features]
        return rows.where(role == "TRAIN").select(*keep), rows.where(role == "VALIDATION").select(*keep)

    def baselines(self, signal: str = "log_return_60m") -> None:
        """Stage 6: prior, momentum and logistic predictions of every fold, with all subset metrics."""
        names = self.config.features
        parts = []
        for fold in self.config.folds:
            train, validation = self._fold(fold)
            model = E.fit_logistic(train, names)
            for scored in (E.prior_baseline(train, validation), E.momentum_baseline(train, validation, signal), E.scored(validation, model.probability(), "logistic")):
                parts.append(scored.withColumn("fold_name", F.lit(fold.name)))
        self._evaluate("stage6", "baseline_predictions", parts)

    def trees(self) -> None:
        """Stage 7: boosted trees, whose number an inner split chooses, for every fold."""
        parts = [self._fit_trees(fold, self.config.trees) for fold in self.config.folds]
        self._evaluate("stage7", "tree_predictions", parts)

    def _fit_trees(self, fold: D.Fold, params: E.TreeParams) -> DataFrame:
        train, validation = self._fold(fold)
        inner = D.inner_split(train, fold.start, self.config.early_stop_window)
        fit = E.fit_trees(inner.where("inner_role = 'INNER_TRAIN'"), inner.where("inner_role = 'EARLY_STOP'"), train, self.config.features, params, self.config.patience)
        return fit.score(validation, params.name).withColumn("fold_name", F.lit(fold.name))

    def tune(self, candidates: list[E.TreeParams]) -> DataFrame:
        """Stage 8: every frozen candidate on every fold; the ranked summary, and the gains over the logistic baseline and the fixed trees."""
        _, digest = E.frozen([asdict(c) for c in candidates])
        self._evaluate("stage8", "candidate_predictions", [self._fit_trees(f, c) for c in candidates for f in self.config.folds])
        rows = self.table("candidate_predictions")
        ranked = self.save(G.rank_candidates(SE.candidate_keys(rows, {c.name: c.max_depth * c.rounds for c in candidates})), "candidate_ranking")
        columns = ["model_name", "fold_name", "y_true", "p_up", "y_pred", "abs_future_return_bps_60m", "evaluation_offset_minutes", "is_primary_nonoverlap_evaluation"]
        for name, reference in (("baseline_predictions", "logistic"), ("tree_predictions", self.config.trees.name)):
            base = self.table(name).where(F.col("model_name") == reference).withColumn("model_name", F.lit(f"reference:{reference}"))
            gains = SE.gains_over(rows.select(*columns).unionByName(base.select(*columns)), f"reference:{reference}")
            gains = gains.withColumns({"auc_gain": F.col("delta_roc_auc"), "gates_passed": F.lit(True)})
            self.save(G.recommendation(G.material_gain(gains, 0.002, 0.0005, 3), 0.002, 3), f"candidate_gains_{reference}")
        IO.write_json(self.at("candidates.json"), {"sha256": digest, "candidates": [asdict(c) for c in candidates]})
        return ranked

    def _evaluate(self, stage: str, name: str, parts: list[DataFrame]) -> None:
        columns = ["model_name", "fold_name", "dataset_row_id", "decision_time", "y_true", "p_up", "y_pred", "abs_future_return_bps_60m", "evaluation_offset_minutes", "is_primary_nonoverlap_evaluation"]
        rows = parts[0].select(*columns)
        for p in parts[1:]:
            rows = rows.unionByName(p.select(*columns))
        rows = self.save(rows, name)
        table = self.save(M.subset_metrics(rows), f"{name}_metrics")
        self.report(stage, {}, {"metrics": table.where("subset_name = 'DENSE'"), "calibration": M.calibration_table(M.with_bins(rows, 10), ("model_name",))})

    def final(self, params: E.TreeParams, methods: tuple[str, ...] = ("UNCALIBRATED", "PLATT", "ISOTONIC")) -> dict:
        """Stage 9: calibration chosen on out-of-fold rows, one fit on the development rows, one reading of the test.

        The test rows are scored by the model, with and without calibration, and by the three baselines, all fitted on the
        development rows. Inputs are hashed when the protocol is locked and again before the test is read.
        """
        guard, names, signal = G.OneShotTest(), self.config.features, "log_return_60m" if "log_return_60m" in self.config.features else self.config.features[0]
        oof = self.table("tree_predictions")
        calibrations = self.save(SE.calibration_metrics(E.forward_calibrated(oof, methods)), "calibration_metrics")
        choice = self.save(SE.choose_calibration(calibrations, years=min(3, max(1, len(self.config.folds) - 1))), "calibration_choice")
        chosen = choice.where("selected").first()["method"]
        guard.done("calibration_selected")
        guard.done("configuration_frozen")
        rows = D.joined(self.table("dataset"), self.table("splits")).withColumn("y_true", F.col("label_up_60m").cast("int"))
        development = rows.where("final_split_role = 'DEVELOPMENT'")
        inner = D.inner_split(development, self.config.test_start, self.config.early_stop_window)
        fit = E.fit_trees(inner.where("inner_role = 'INNER_TRAIN'"), inner.where("inner_role = 'EARLY_STOP'"), development, names, params, self.config.patience)
        calibrator, logistic = E.fit_calibrator(chosen, oof), E.fit_logistic(development, names)
        guard.done("final_model_fitted")
        E.save_model(fit.model, self.at("models/trees"))
        digest = E.save_calibrator(calibrator, self.at("models/calibrator.json"))
        difference = E.reload_difference(development, fit, calibrator, self.at("models/trees"), self.at("models/calibrator.json"))
        if difference > 1e-12:
            raise ValidationError([f"the model read back differs by {difference}"])
        guard.done("model_saved")
        lock = guard.lock_with(E.canonical_json(asdict(params)) + chosen + digest, self.input_hashes())
        test = guard.read_test(rows.where("final_split_role = 'FINAL_TEST'"), self.input_hashes())
        raw = fit.score(test, "trees_raw")
        parts = [
            raw, E.scored(raw.drop("model_name", "y_pred").withColumnRenamed("p_up", "_raw"), calibrator.apply(F.col("_raw")), "trees_calibrated"),
            E.prior_baseline(development, test), E.momentum_baseline(development, test, signal), E.scored(test, logistic.probability(), "logistic"),
        ]
        columns = ["model_name", "dataset_row_id", "decision_time", "y_true", "p_up", "y_pred", "abs_future_return_bps_60m", "evaluation_offset_minutes", "is_primary_nonoverlap_evaluation"]
        long = parts[0].select(*columns)
        for p in parts[1:]:
            long = long.unionByName(p.select(*columns))
        scored = self.save(long, "final_predictions")
        table = self.save(M.subset_metrics(scored, ("model_name",)), "final_metrics")
        faults = M.prediction_faults(scored, self.table("splits").where("final_split_role = 'FINAL_TEST'")).first().asDict()
        gates = G.engineering_gates({"test_rows_complete": faults["missing_rows"] + faults["foreign_rows"] + faults["repeated_rows"] == 0, "probabilities_valid": faults["bad_probabilities"] == 0, "model_reloads": difference <= 1e-12})
        drift = SE.against_development(table, M.subset_metrics(oof, ("model_name",)), "trees_calibrated", self.config.trees.name)
        assessment = SE.assess_test(table, "trees_calibrated", "logistic", "prior", gates["all_passed"]).first()["assessment"]
        result = table.where("model_name = 'trees_calibrated' AND subset_name = 'DENSE'").drop("subset_name").first().asDict()
        guard.done("evaluated")
        facts = {"metrics": result, "calibration": chosen, "assessment": assessment, "gates": gates}
        IO.write_json(self.at("model_manifest.json"), MF.model_manifest("trees", asdict(params) | {"trees": fit.rounds, "calibration": chosen}, names, result, guard.hashes) | {"lock": lock, "calibrator_sha256": digest, "assessment": assessment})
        IO.write_json(self.at("inference_manifest.json"), MF.inference_manifest(names, "models/trees", "models/calibrator.json", calibrator.method, E.THRESHOLD, lock))
        IO.write_json(self.at("one_shot.json"), {"steps": guard.steps, "lock": lock, "hashes": guard.hashes})
        importance = IO.markdown_table([{"feature": f, "gain": g, "rank": r} for f, g, r in fit.importances()])
        self.report("stage9", facts, {"importance": importance, "calibration": choice, "test against development": drift, "test": table.where("subset_name IN ('DENSE', 'NONOVERLAP_OFFSET_00')")})
        return result

    def input_hashes(self) -> dict[str, str]:
        """Digests of what the final test depends on, computed anew from the tables themselves: order-free sums of row hashes."""
        out = {}
        for name in ("dataset", "splits", "tree_predictions"):
            t = self.table(name)
            row = t.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*t.columns).cast("decimal(38,0)"))).first()
            out[name] = IO.text_sha256(f"{row[0]}:{row[1]}:{t.schema.simpleString()}")
        return out


def metric_differences(again: DataFrame, stored: DataFrame, keys: list[str], names: list[str], tolerance: float = 1e-12) -> int:
    """Rows on one side only, or with a metric that is missing on one side or differs by more than the tolerance."""
    a = again.select(*keys, *[F.col(n).alias(f"_{n}") for n in names], F.lit(True).alias("_a"))
    j = a.join(stored.select(*keys, *names, F.lit(True).alias("_b")), keys, "full_outer")
    off = F.col("_a").isNull() | F.col("_b").isNull()
    for n in names:
        x, y = F.col(f"_{n}"), F.col(n)
        off = off | (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tolerance, F.lit(False))
    return j.where(off).count()


def revalidate(run: Run) -> list[str]:
    """Checks a finished run from its outputs: prediction contracts, all metrics recomputed, selections replayed, manifests. Returns what fails."""
    errors = []
    split = run.table("splits")
    keys = ["model_name", "fold_name", "subset_name"]
    test_ids = split.where("final_split_role = 'FINAL_TEST'").select("dataset_row_id")
    for name in ("baseline_predictions", "tree_predictions"):
        rows = run.table(name)
        for fold in run.config.folds:
            expected = split.where(F.col(f"{fold.name}_role") == "VALIDATION")
            faults = M.prediction_faults(rows.where(F.col("fold_name") == fold.name), expected).first().asDict()
            errors += [f"{name} {fold.name}: {k} {v}" for k, v in faults.items() if v]
        if leaked := rows.join(test_ids, "dataset_row_id", "left_semi").count():
            errors.append(f"{name}: {leaked} rows of the final test")
        if off := rows.where((F.col("y_pred") != (F.col("p_up") >= E.THRESHOLD).cast("int")) & (F.col("model_name") != "momentum")).count():
            errors.append(f"{name}: {off} classes disagree with the threshold")
        if off := metric_differences(M.subset_metrics(rows), run.table(f"{name}_metrics"), keys, M.METRICS):
            errors.append(f"{name}: {off} metric rows differ")
    if IO.path_exists(run.spark, run.at("candidate_ranking")):
        definitions = IO.read_json(run.at("candidates.json"))
        if E.frozen(definitions["candidates"])[1] != definitions["sha256"]:
            errors.append("the candidates do not match their digest")
        sizes = {c["name"]: c["max_depth"] * c["rounds"] for c in definitions["candidates"]}
        again = G.rank_candidates(SE.candidate_keys(run.table("candidate_predictions"), sizes))
        if off := metric_differences(again, run.table("candidate_ranking"), ["model_name"], ["rank", "roc_auc", "nonoverlap_auc", "offset_auc_range", "log_loss"]):
            errors.append(f"candidate ranking: {off} rows differ")
    if IO.path_exists(run.spark, run.at("final_predictions")):
        again = M.subset_metrics(run.table("final_predictions"), ("model_name",))
        if off := metric_differences(again, run.table("final_metrics"), ["model_name", "subset_name"], M.METRICS):
            errors.append(f"final metrics: {off} rows differ")
        choice = SE.choose_calibration(run.table("calibration_metrics"), years=min(3, max(1, len(run.config.folds) - 1))).where("selected").first()["method"]
        manifest = IO.read_json(run.at("model_manifest.json"))
        if choice != manifest["parameters"]["calibration"]:
            errors.append("the calibration does not follow from its metrics")
        calibrator = E.load_calibrator(run.at("models/calibrator.json"))
        if hashlib.sha256(E.canonical_json(calibrator.to_dict()).encode()).hexdigest() != manifest["calibrator_sha256"]:
            errors.append("the calibrator does not match its digest")
        changed = [k for k, v in run.input_hashes().items() if IO.read_json(run.at("one_shot.json"))["hashes"].get(k) != v]
        errors += [f"{k} changed after the lock" for k in changed]
    try:
        MF.check_manifest(IO.read_json(run.at("feature_manifest.json")), run.table("features").columns)
    except ValidationError as e:
        errors += e.errors
    return errors
