import json
import os
import tempfile

from thinkframe.streaming.filter_stream import start_filter_stream

BODY = " ".join(f"w{i}" for i in range(20))


def test_filter_stream_available_now(spark):
    d = tempfile.mkdtemp(prefix="tf-stream-")
    os.makedirs(f"{d}/in")
    with open(f"{d}/in/part1.jsonl", "w") as f:
        for i in range(3):
            rec = {"id": str(i), "question": "q", "gold": "#### 4",
                   "traces": [f"{BODY}\nAnswer: 4", f"{BODY}\nAnswer: 5", "Answer: 4"],
                   "meta": {"dataset": "d", "split": "train", "teacher": "t"}}
            f.write(json.dumps(rec) + "\n")
    q = start_filter_stream(spark, f"{d}/in", f"{d}/out", f"{d}/ckpt", task="gsm8k", available_now=True)
    q.awaitTermination(120)
    out = spark.read.parquet(f"{d}/out")
    rows = out.collect()
    assert len(rows) == 3 and all(r.answer == "4" and r.meta["task"] == "gsm8k" for r in rows)


def test_keep_rate_stream_accumulates(spark):
    import time

    from thinkframe.streaming.filter_stream import start_keep_rate_stream

    d = tempfile.mkdtemp(prefix="tf-stream-")
    os.makedirs(f"{d}/in")

    def add(name, n):
        with open(f"{d}/in/{name}.jsonl", "w") as f:
            for i in range(n):
                f.write(json.dumps({"id": f"{name}{i}", "question": "q", "gold": "#### 4",
                                    "traces": [f"{BODY}\nAnswer: 4", f"{BODY}\nAnswer: 5"]}) + "\n")

    add("a", 2)
    q = start_keep_rate_stream(spark, f"{d}/in", f"{d}/rate", f"{d}/ckpt", "gsm8k", available_now=True)
    q.awaitTermination(120)
    r = spark.read.parquet(f"{d}/rate").first()
    assert (r.task, r.seen, r.kept, r.pct) == ("gsm8k", 4, 2, 50.0)
    add("b", 3)   # a restart from the checkpoint continues the running totals
    q = start_keep_rate_stream(spark, f"{d}/in", f"{d}/rate", f"{d}/ckpt", "gsm8k", available_now=True)
    q.awaitTermination(120)
    r = spark.read.parquet(f"{d}/rate").first()
    assert (r.seen, r.kept) == (10, 5)
