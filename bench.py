"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "frg_all_documents",
    "frg_4_braces_in_web_pages",
    "frg_6_html_blocks_of_web_pages",
    "frg_13_paragraphs_of_documents",
    "frg_16_document_order",
    "nrm_10_records",
    "nrm_11_flatten",
    "ent_2_emails_of_documents",
    "ent_9_normalised_entities",
    "res_4_canonical_entities",
    "mrg_7_conflicts",
    "mrg_10_scores",
    "typ_2_string_subtypes",
    "typ_8_consensus",
    "sch_9_headers",
    "exp_1_postgresql",
    "evo_8_renames",
    "evo_11_forward_migrations",
    "evo_17_rewritten_queries",
    "agg_2_repeated_entities",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from fragloom.plans.queries import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    for name in HEADLINE:
        for folder in (small, sf):  # the run over the small tables compiles; the other counts
            begin = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - begin, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
