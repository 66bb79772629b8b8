"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

HEADLINE = [
    "document_blocks", "hocr_line_words", "interval_clusters", "word_rows", "reading_order", "table_recovered", "table_stream", "table_lattice", "table_cells", "line_paragraphs", "line_word_boxes",
    "greedy_decode", "scan_quality", "quad_corners", "stable_frames", "paginated_lines", "text_layer", "session_edits",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from pagewright import registry

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        each = []
        for _ in range(runs + 1):  # the first run warms up
            began = time.time()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            each.append(time.time() - began)
        took[name] = round(statistics.median(each[1:]), 3)
    print(json.dumps({"metric": "median wall seconds of the headline queries, summed", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
