"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the data and the cores. Before a query its INPUTS are
made, and everything else that an earlier query has left is forgotten, so a time is that of all the query's own work and does
not depend on the order.
"""

import json
import os
import sys
import time

from millrace.plans.catalog import prepare, queries, table
from millrace.session import build_session

HEADLINE = (
    "pretok_word_counts", "bpe_train", "bpe_encode", "bpe_encode_counts", "bpe_decode", "char_encode",
    "shard_manifest", "doc_offsets", "corpus_blocks", "binary_shards", "chat_convert", "sft_labels",
    "corpus_take", "mixture_draws", "windows_pretrain", "windows_sft", "resume_topup", "stream_encode",
)

_CODED = ("tokenizer",)
_TOKENS = ("tokenizer", "tokens")

# What a query starts from: vocabularies, token tables and datasets that other queries are for.
INPUTS = {
    "bpe_encode": _CODED, "bpe_encode_counts": _CODED, "bpe_decode": _CODED, "shard_manifest": _CODED, "sft_labels": _CODED, "stream_encode": _CODED,
    "doc_offsets": _TOKENS, "corpus_blocks": (*_TOKENS, "plan"), "binary_shards": (*_TOKENS, "plan"), "mixture_draws": (*_TOKENS, "mixture"),
    "windows_pretrain": (*_TOKENS, "stored-mixture"), "windows_sft": ("tokenizer", "chat-dataset"),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR",
    })
    table(spark, sf_dir, "documents").selectExpr("sum(length(text))").collect()  # start the executor threads
    known = queries()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        prepare(spark, sf_dir, INPUTS.get(name, ()))
        began = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
