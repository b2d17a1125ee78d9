from pyspark.sql import functions as F

from thinkframe.operators import encode as E


def test_byte_ids(spark):
    df = spark.createDataFrame([("abc",), ("",), ("é\x01",)], "t string")
    got = [r[0] for r in df.select(E.byte_ids("t")).collect()]
    assert got == [[99, 100, 101], [], [0xC3 + 2, 0xA9 + 2, 3]]


def test_encode_masks_prompt(spark):
    df = spark.createDataFrame([("abc", "12")], "prompt string, response string")
    r = E.encode_examples(df).first()
    assert r.input_ids == [99, 100, 101, 51, 52, 3]
    assert r.labels[:3] == [-100] * 3 and all(x != -100 for x in r.labels[3:])
    assert len(r.labels) == len(r.input_ids) == len(r.attention_mask) and set(r.attention_mask) == {1}
    t = E.encode_examples(df, max_seq_len=4).first()
    assert len(t.input_ids) == 4 and t.labels == [-100, -100, -100, 51]
    t2 = E.encode_examples(df, max_seq_len=2).first()
    assert t2.labels == [-100, -100]


def test_pad_batches(spark):
    df = spark.createDataFrame([("k1", "abc", "1"), ("k2", "a", "123456")], "key string, prompt string, response string")
    enc = E.encode_examples(df).withColumn("width", F.lit(8))
    out = {r.key: r for r in E.pad_batches(enc).collect()}
    assert len(out["k1"].input_ids) == len(out["k2"].input_ids) == 8
    assert sum(out["k1"].attention_mask) < sum(out["k2"].attention_mask)
    assert out["k1"].labels[-1] == -100 and out["k1"].input_ids[-1] == 0
    ratio = E.supervised_ratio(E.pad_batches(enc)).first()
    assert ratio.cells == 16 and ratio.supervised == 2 + 7


def test_batches_and_sample(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("key"), (F.col("id") % 7).cast("int").alias("n"))
    batches = E.assign_batches(df, "key", F.col("n"), batch_size=4, bucket_rows=16)
    b = batches.groupBy("bucket", "batch_no").agg(F.count("*").alias("rows"), F.max("n").alias("longest"), F.max("width").alias("width")).collect()
    assert all(r["rows"] <= 4 and r["longest"] == r["width"] for r in b) and sum(r["rows"] for r in b) == 100
    assert len({r["bucket"] for r in b}) > 3
    again = E.assign_batches(df.repartition(5), "key", F.col("n"), batch_size=4, bucket_rows=16)
    assert sorted(map(tuple, batches.collect())) == sorted(map(tuple, again.collect()))
    s1 = [r.key for r in E.batch_sample(df, "key", 5).collect()]
    s2 = [r.key for r in E.batch_sample(df, "key", 5).collect()]
    assert s1 == s2 and len(s1) == 5


def test_length_is_known_before_encoding(spark):
    df = spark.createDataFrame([("é" * n, "r" * m) for n in (0, 3, 30) for m in (0, 2, 50)], "prompt string, response string")
    for most in (4, 20, 2048):
        out = E.encode_examples(df.withColumn("n", E.encoded_length(max_seq_len=most)), max_seq_len=most).collect()
        assert all(len(r.input_ids) == r.n == len(r.labels) for r in out)
