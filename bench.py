"""Time the headline queries and print one JSON line.

Every query is run once to warm up and then timed with all its rows produced
(``noop`` sink, so nothing is pulled to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from uuid import uuid4

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from pyspark.sql import functions as F  # noqa: E402

from bindings import registry, table  # noqa: E402
from bindings.derived import markup_pages  # noqa: E402
from entitylake.operators.entities import extract_entities  # noqa: E402
from entitylake.plans import jobs  # noqa: E402
from entitylake.session import session  # noqa: E402
from entitylake.sources.stage import shared_folder  # noqa: E402

HEADLINE = (
    "wiki_entities",
    "page_decode",
    "abstracts",
    "html_profile",
    "html_rows",
    "entity_join",
    "join_stats",
    "dedupe_filter",
    "release_rollup",
    "assemble_nested",
    "postings",
    "idf_table",
    "tfidf_smooth",
    "bm25",
    "batch_search",
    "phrase_search",
    "fuzzy_search",
    "eval_names_summary",
    "missing_parts",
    "tag_top_artists",
)


COPIES = 8


def timed(df_of) -> float:
    started = time.perf_counter()
    df_of().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.entitylake.spread": cpus,  # the tables are single small files
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = registry()
    seconds = {}
    for name in HEADLINE:
        run = queries[name]
        timed(lambda: run(spark, sf_dir))
        seconds[name] = round(timed(lambda: run(spark, sf_dir)), 3)
    n_docs = table(spark, sf_dir, "documents").count()
    # The same extraction over eight copies of each page: the rate without the start-up of a job.
    copies = F.explode(F.sequence(F.lit(1), F.lit(COPIES)))
    pages = markup_pages(spark, sf_dir).select("title", "text", copies.alias("copy"))
    scaled = min(timed(lambda: extract_entities(pages)) for _ in range(2))
    # End to end: the same pages as an XML dump on disk, read, decoded, extracted and written.
    folder = f"{shared_folder(spark)}/bench-{uuid4().hex}"
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    chunk = F.concat(F.lit("<page><title>"), "title", F.lit("</title><revision><text>"), escaped, F.lit("</text></revision>"))
    pages.select(chunk).write.option("lineSep", "</page>").text(f"{folder}/dump")
    started = time.perf_counter()
    entities = jobs.extract(spark, f"{folder}/dump", f"{folder}/entities")["entities"]
    dump_seconds = time.perf_counter() - started
    report = {
        "metric": "total_seconds_headline_queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "cores": int(cpus),
        "pages": n_docs,
        "extraction_pages_per_sec": round(n_docs * COPIES / scaled),
        "dump_pages_per_sec": round(n_docs * COPIES / dump_seconds),
        "dump_entities": entities,
        "extraction_pages_per_sec_one_small_job": round(n_docs / seconds["wiki_entities"]),
        "indexing_docs_per_sec": round(n_docs / seconds["postings"]),
        "extraction_baseline_pages_per_sec": 11630,
    }
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
