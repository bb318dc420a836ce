"""Headline queries, timed one after the other; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the cores, BENCH_QUERIES (comma-separated) other queries or "all".
`prepare_corpus` is the making of the annotated corpus from raw text that the other queries read.
"""

import json
import os
import time

from checks.queries import registry
from checks.views import Views
from spanloom.session import local_session

HEADLINE = [
    "unpivot_sections",
    "mask_html",
    "span_valid",
    "span_repair",
    "span_snap_tokens",
    "span_resolve_overlap",
    "training_records",
    "preprocess_corpus",
    "link_dictionary",
    "link_substring",
    "link_cosine_top1",
    "link_trigram_top1",
    "kb_surface_index",
    "build_kb",
    "concept_relations_pred",
    "concept_relation_report",
    "schema_pairs",
    "triple_frequency",
    "relation_matrix_filled",
    "re_examples",
    "class_weights",
    "bootstrap_tiers",
    "split_by_doc",
    "score_models",
    "sub_entities_json",
    "sub_concept_json",
    "tag_gazetteer_sections",
    "ner_training_set",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    queries = registry()
    names = list(queries) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    seconds = {}

    def timed(name, run) -> None:
        began = time.time()
        run()
        seconds[name] = round(time.time() - began, 3)

    views = Views(spark, sf_dir)
    timed("prepare_corpus", lambda: (views.articles, views.entities, views.noisy, views.relations))
    for name in names:
        timed(name, lambda: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
