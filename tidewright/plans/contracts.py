"""Queries of the remaining inventory: contracts of schemas and parameters, batch forms of the streams, and model inputs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import checks as K
from ..operators import gates as G
from ..operators import metrics as M
from ..operators import models as E
from ..operators import profile as P
from ..schema import CLEAN_TRADE, ValidationError, schema_errors
from ..sources import adapt as A
from ..streaming import bars as S
from . import manifest as MF
from .evaluation import ROWS, learning_rows
from .market import BASE15, HORIZON15, bars15
from .registry import chain, query


@query("p01_field_mapping", "SELECT * FROM (VALUES ('price', 'value'), ('time', 'ts'), ('trade_id', 'event_id'), ('user', 'user_id')) t(logical, physical)")
def p01(spark, sf):
    aliases = {"time": ("time", "ts"), "trade_id": ("trade_id", "event_id"), "price": ("price", "value"), "user": ("user",)}
    found = P.field_mapping(A.table(spark, sf, "events").columns, aliases)
    return spark.createDataFrame(sorted(found.items()), "logical string, physical string")


@query("p15_leakage_scan", "SELECT * FROM (VALUES ('entry_price_proxy'), ('future_return'), ('label_x')) t(forbidden)")
def p15(spark, sf):
    bad = K.forbidden_fields(["close", "future_return", "has_future_61m", "label_x", "log_return_1m", "entry_price_proxy"])
    return spark.createDataFrame([(c,) for c in bad], "forbidden string")


@query("p36_s05_schema_contract", "SELECT * FROM (VALUES ('CLEAN_TRADE', 0), ('missing', 1)) t(contract, errors)")
def p36(spark, sf):
    trades = A.trades(spark, sf).withColumn("id_gap_before", F.col("id_gap_before").cast("long"))
    return spark.createDataFrame([("CLEAN_TRADE", len(schema_errors(trades, CLEAN_TRADE))), ("missing", len(schema_errors(trades.drop("price"), CLEAN_TRADE)))], "contract string, errors int")


@query("feature_dictionary_and_manifest", "SELECT 63 AS features, 64 AS digest_length, 120 AS longest_window, false AS uses_future")
def dictionary(spark, sf):
    m, d = MF.feature_manifest(), MF.feature_dictionary()
    return spark.createDataFrame([(m["count"], len(m["names_sha256"]), max(x["window_bars"] for x in d), any(x["uses_future"] for x in d))], "features int, digest_length int, longest_window int, uses_future boolean")


@query("p21_feature_matrix", chain(ROWS, then="SELECT dataset_row_id, max(p_up) FILTER (WHERE model_name = 'logistic') AS f0, max(p_up) FILTER (WHERE model_name = 'trees') AS f1, 2 AS width FROM rows GROUP BY 1"), "f0 f1")
def p21(spark, sf):
    v = vector_to_array("features")
    return E.assembled(learning_rows(spark, sf), ["x1", "x3"]).select("dataset_row_id", v[0].alias("f0"), v[1].alias("f1"), F.size(v).alias("width"))


@query("e07_parameter_contract", "SELECT * FROM (VALUES ('as frozen', true), ('rate above 1', false), ('no rounds', false)) t(candidate, accepted)")
def e07(spark, sf):
    def accepted(p: E.TreeParams) -> bool:
        try:
            p.check()
        except ValidationError:
            return False
        return True

    base = E.TreeParams()
    return spark.createDataFrame([("as frozen", accepted(base)), ("rate above 1", accepted(replace(base, step_size=2.0))), ("no rounds", accepted(replace(base, rounds=0)))], "candidate string, accepted boolean")


@query("e11_e14_final_calibrators")
def e14(spark, sf):
    rows = A.model_rows(spark, sf).where("model_name = 'trees'")
    out = None
    for method in ("UNCALIBRATED", "PLATT", "ISOTONIC"):
        fit = E.fit_calibrator(method, rows)
        part = rows.select("dataset_row_id", F.lit(method).alias("method"), fit.apply(F.col("p_up")).alias("p_up"))
        out = part if out is None else out.unionByName(part)
    return out


@query("g12_engineering_gates", chain(ROWS, then="SELECT true AS ids_complete, true AS probabilities_valid, count(DISTINCT model_name) = 3 AS models_complete, true AS all_passed FROM rows"))
def g12(spark, sf):
    rows = A.model_rows(spark, sf)
    faults = M.prediction_faults(rows, rows.select("dataset_row_id")).first()
    gates = G.engineering_gates({
        "ids_complete": faults["missing_rows"] + faults["foreign_rows"] + faults["repeated_rows"] == 0, "probabilities_valid": faults["bad_probabilities"] == 0,
        "models_complete": rows.select("model_name").distinct().count() == 3,
    })
    return spark.createDataFrame([tuple(gates.values())], ", ".join(f"{k} boolean" for k in gates))


@query("g13_one_shot_protocol", "SELECT * FROM (VALUES ('in order', true), ('before the lock', false), ('changed input', false)) t(attempt, allowed)")
def g13(spark, sf):
    rows = A.table(spark, sf, "labels")

    def allowed(steps: int, lock: bool, hashes: dict) -> bool:
        guard = G.OneShotTest()
        try:
            for s in guard.ORDER[:steps]:
                guard.done(s)
            if lock:
                guard.lock_with("{}", {"labels": "a"})
            guard.read_test(rows, hashes)
        except ValidationError:
            return False
        return True

    return spark.createDataFrame([("in order", allowed(4, True, {"labels": "a"})), ("before the lock", allowed(2, False, {})), ("changed input", allowed(4, True, {"labels": "b"}))], "attempt string, allowed boolean")


@query("x02_gap_sessions", chain(*BASE15[:4], then="SELECT count(*) AS bars, min(open_time) AS start_time, max(open_time) AS end_time FROM segmented GROUP BY continuity_segment_id"))
def x02(spark, sf):
    return S.live_sessions(bars15(spark, sf).select("open_time"), "20 minutes")


@query("x06_keep_first_in_stream_order", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1")
def x06(spark, sf):
    from ..operators.clean import keep_first

    e = A.table(spark, sf, "events").select("user_id", "event_id", F.col("event_id").alias("_o"))
    return keep_first(e, ["user_id"], "_o").drop("_o")


@query("x08_matured_labels", chain(*BASE15, then=f"SELECT p.decision_time, p.close AS entry_price, s.open AS settlement_price, CAST(s.open > p.close AS INTEGER) AS label_up_60m FROM positioned p JOIN segmented s ON s.open_time = p.decision_time + {HORIZON15} AND s.continuity_segment_id = p.continuity_segment_id WHERE p.is_prediction_time_5m"), "entry_price settlement_price")
def x08(spark, sf):
    bars = bars15(spark, sf)
    decisions = bars.where("is_prediction_time_5m").select("decision_time", F.col("close").alias("entry_price"), "continuity_segment_id")
    out = S.matured_labels(decisions, bars.select("open_time", "open", "continuity_segment_id"), horizon_minutes=HORIZON15 // 60_000)
    return out.select("decision_time", "entry_price", "settlement_price", "label_up_60m")


@query("x03_running_profile", "SELECT count(*) AS rows, min(epoch_us(ts) // 1000) AS first_time, max(epoch_us(ts) // 1000) AS last_time FROM events")
def x03(spark, sf):
    return S.running_profile(A.trades(spark, sf)).drop("ids")
