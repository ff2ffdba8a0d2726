"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from ledgerwatch.plans import modelling, registry  # noqa: F401
from ledgerwatch.session import build_session

HEADLINE = [
    "a1_column_profile", "a7_meta_features", "a12_fraud_rate_by_amount_bin", "a13_correlation_matrix", "a16_prediction_report",
    "a20_confusion", "a21_auc_average_precision", "a24_threshold_sweep", "a30_importance_statistics", "f4_equal_width_bin", "f6_high_low_flags",
    "f9_time_parts", "f13_pair_comparison", "f23_flag_engineering", "f24_rule_engineering", "j5_users_licences_history", "k2_top_configs_per_metric",
    "k7_intelligent_selection", "l6_apply_pipeline", "l8_isolation_forest", "l12_tiered_output", "m2_semantic_groups", "m4_semantic_similarity",
    "st2_streaming_alert_counts", "t1_hybrid_target", "t12_label_encoding", "t16_stratified_split", "w1_customer_stats", "w6_smurfing", "w7_dormant_wakeup",
    "w8_unusual_amount", "w9_beneficiary_concentration", "w11_high_velocity"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus), spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        t = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_wall_clock", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
