"""Times the headline audits and prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from labelscope.functions import text  # noqa: E402
from labelscope.operators import boundary, preprocess, sweep, topology  # noqa: E402
from labelscope.plans import corpus, queries as Q  # noqa: E402
from labelscope.session import local_session  # noqa: E402


def workloads(spark, folder):
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    # The test file is one row group, hence one task; spread its whole texts first.
    documents = spark.read.parquet(f"{folder}/documents.parquet").repartition(spark.sparkContext.defaultParallelism)
    pairs = corpus.reply_pairs(turns, 512)
    return {
        "quarantine_split": lambda: Q.quarantine_counts(spark, folder),
        "trace_audit": lambda: topology.audit_report_json(topology.audit_traces(corpus.valid_traces(turns))),
        "label_audit": lambda: topology.policy_audits(topology.with_policies(corpus.valid_traces(turns))).drop("messages", "trace"),
        "boundary_report": lambda: boundary.boundary_report(pairs, Q.TOKENIZER),
        "boundary_classes": lambda: boundary.boundary_report(pairs, Q.TOKENIZER).select("case_id", "classifications"),
        "truncation_sweep": lambda: sweep.sweep_table(sweep.truncation_sweep(pairs, Q.TOKENIZER, Q.SWEEP)),
        "batch_collate": lambda: preprocess.pad_collate(preprocess.assign_batches(
            preprocess.preprocess_pairs(pairs, Q.TOKENIZER, keep=("case_id", "conv_id", "turn")),
            ("conv_id", "turn"), 32, shard=Q.batch_shard()), 0),
        "document_tokens": lambda: preprocess.token_lengths(
            preprocess.tokenize(documents, {"text": "ids"}, Q.TOKENIZER, 1 << 30), {"ids": "tokens"}).select("doc_id", "tokens"),
        "document_strip": lambda: documents.select("doc_id", text.right_strip(F.col("text")).alias("text")),
        "file_identities": lambda: Q.file_identities(spark, folder),
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "labelscope-bench")
    spark.range(1000).select(F.sum("id")).collect()
    seconds = {}
    for name, build in workloads(spark, folder).items():
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total wall time of the headline audits", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
