import pytest
from pyspark.sql import functions as F

from thinkframe.operators.vote import (
    distribution_table,
    distribution_text,
    majority_vote,
    sample_keys,
    vote,
    weighted_vote,
)


def samples(spark, per_item, task="arc", weights=None):
    data = []
    for item, texts in per_item.items():
        for pos, t in enumerate(texts):
            w = weights[item][pos] if weights else 1.0
            data.append((item, pos, task, t, w))
    return spark.createDataFrame(data, "id string, pos int, task string, trace string, w double")


def one(df):
    if "distribution" not in df.columns:
        df = df.withColumn("distribution", F.lit(None).cast("map<string,bigint>"))
    r = df.select("answer", "support", "total", "confidence",
                  F.coalesce(distribution_text("distribution"), F.lit("")).alias("d")).collect()
    assert len(r) == 1
    return tuple(r[0])


def test_majority_letters(spark):
    s = samples(spark, {"q": [f"Answer: {x}" for x in "ABAAC"]})
    assert one(majority_vote(s, distribution=True)) == ("A", 3, 5, 0.6, "A:3,B:1,C:1")
    dist = {(r.key, r["count"]) for r in distribution_table(sample_keys(s)).collect()}
    assert dist == {("A", 3), ("B", 1), ("C", 1)}


def test_majority_numeric_forms(spark):
    s = samples(spark, {"q": ["Answer: 42", "Answer: 42.0", "Answer: $42", "Answer: 0"]}, task="gsm8k")
    assert one(majority_vote(s))[:3] == ("42", 3, 4)


def test_no_answer_counts_in_total(spark):
    s = samples(spark, {"q": ["nothing", "Answer: A", "none here", "Answer: A"]})
    assert one(majority_vote(s))[:3] == ("A", 2, 4)
    s2 = samples(spark, {"q": ["nothing", "none"]})
    assert one(majority_vote(s2, distribution=True)) == (None, 0, 2, 0.0, "")


def test_tie_goes_to_first_seen(spark):
    s = samples(spark, {"q": ["Answer: B", "Answer: A", "Answer: A", "Answer: B"]})
    assert one(majority_vote(s))[0] == "B"


def test_weighted_vote(spark):
    s = samples(spark, {"q": ["Answer: A", "Answer: A", "Answer: B"]}, weights={"q": [0.1, 0.1, 5.0]})
    res = one(weighted_vote(s, weight=F.col("w")))
    assert res[:2] == ("B", 1)


def test_sample_and_vote_k(spark):
    s = samples(spark, {"q": ["Answer: C"] * 8 + ["Answer: A"] * 4})
    assert one(vote(s, k=8))[:3] == ("C", 8, 8)


def test_uniform_weighted_equals_majority_and_partition_invariance(spark):
    import random

    rnd = random.Random(3)
    per = {f"q{i}": [f"Answer: {rnd.choice('ABCDE')}" if rnd.random() > 0.1 else "x" for _ in range(8)]
           for i in range(60)}
    s = samples(spark, per)
    a = sorted(tuple(r) for r in majority_vote(s).select("id", "answer", "support", "total").collect())
    b = sorted(tuple(r) for r in weighted_vote(s).select("id", "answer", "support", "total").collect())
    assert a == b
    assert all(sup <= tot for _, _, sup, tot in a)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        c = sorted(tuple(r) for r in majority_vote(s.repartition(5)).select("id", "answer", "support", "total").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == c


def test_tiny_and_mixed_weights(spark):
    s = samples(spark, {"q": ["Answer: A", "Answer: B"], "r": ["Answer: A", "Answer: B", "Answer: B"]},
                weights={"q": [1e-25, 9e-20], "r": [1e300, 1.0, 1e-300]})
    got = {r.id: (r.answer, r.support) for r in weighted_vote(s, weight=F.col("w")).collect()}
    assert got == {"q": ("B", 1), "r": ("A", 1)}


def test_weights_add_up_exactly(spark):
    s = samples(spark, {"q": ["Answer: A", "Answer: B", "Answer: B"]}, weights={"q": [0.3, 0.1, 0.2]})
    assert weighted_vote(s.repartition(3), weight=F.col("w")).first().answer == "B"  # 0.1 + 0.2 > 0.3 in doubles
    s = samples(spark, {"q": ["Answer: A"] * 3 + ["Answer: B"]}, weights={"q": [1e16, 1.0, 1.0, 1e16 + 2]})
    assert weighted_vote(s, weight=F.col("w")).first().answer == "A"  # a tie, exactly; in doubles one by one A falls behind


def test_exact_sums_against_fsum(spark):
    import math
    import random
    from fractions import Fraction

    from thinkframe.functions import sums

    rng, groups = random.Random(1), []
    for g in range(240):
        n = rng.randint(1, 60)
        v = [
            lambda: rng.random(), lambda: rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300), lambda: rng.choice([1e16, 1.0, -1e16, 2**-60, -1.0, 0.0]),
            lambda: rng.choice([5e-324, -5e-324, 1e-310, 2.2250738585072014e-308]), lambda: rng.gauss(0, 1), lambda: rng.choice([1.7e308, -1.7e308, 1e292]),
        ][g % 6]
        values = [v() for _ in range(n)]
        groups.append(values + [-x for x in values] + [2**-1074] if g % 18 == 4 else values)
    special = {1000: [float("inf"), 1.0], 1001: [float("inf"), float("-inf")], 1002: [float("nan"), 1.0], 1003: [0.0, -0.0]}
    rows = [(g, x) for g, v in [*enumerate(groups), *special.items()] for x in v]
    rng.shuffle(rows)
    x = F.col("x")
    per_bin = spark.createDataFrame(rows, "g int, x double").repartition(7).groupBy("g", sums.bin_of(x).alias("bin")).agg(F.sum(sums.amount(x)).alias("amount"), F.sum(sums.odd(x)).alias("odd"))
    pairs = per_bin.groupBy("g").agg(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "amount"))).alias("pairs"), F.sum("odd").alias("odd"))
    got = {r["g"]: r["s"] for r in pairs.select("g", sums.rounded("pairs", "odd").alias("s")).collect()}
    assert got[1000] == float("inf") and math.isnan(got[1001]) and math.isnan(got[1002]) and got[1003] == 0
    for g, v in enumerate(groups):
        try:
            want = math.fsum(v)
        except OverflowError:
            total = sum(map(Fraction, v))
            want = float(total) if abs(total) < Fraction(2) ** 1023 * 2 else math.inf if total > 0 else -math.inf
        assert got[g] == want


def test_weights_are_not_gathered(spark):
    """A hot item needs constant state: what is listed is a row per bin, not per sample."""
    import math

    from thinkframe.operators.vote import key_counts

    keys = spark.range(200_000).selectExpr("concat('q', id div 200000) id", "'math' task", "id pos", "'1' key", "id % 1000 / 7.0D w")
    counts = key_counts(keys, weighted=F.lit(True))
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    lists = [line for line in plan.splitlines() if "collect_list(" in line]
    assert len(lists) == 1 and "struct(bin, bin" in lists[0] and " w#" not in lists[0]
    row = counts.first()
    assert row["wsum"] == math.fsum(i % 1000 / 7.0 for i in range(200_000)) and row["cnt"] == 200_000


@pytest.mark.parametrize("size", [4096, 3])
def test_votes_over_prefixes_equal_votes_over_the_first_samples(spark, monkeypatch, size):
    import random

    from thinkframe.operators import prefix
    from thinkframe.operators.vote import leader_changes, leaders_at

    monkeypatch.setattr(prefix, "RANGE", size)
    rnd = random.Random(4)
    rows = [(f"q{i}", p, ["arc", "gsm8k"][i % 2], f"Answer: {rnd.choice('ABC12')}" if rnd.random() < 0.8 else "none", rnd.choice([rnd.random(), 0.25, 0.0, 2.0**-40]))
            for i in range(40) for p in range(i % 17) if rnd.random() < 0.9]
    s = spark.createDataFrame(rows, "id string, pos int, task string, trace string, w double")
    for strategy in ("majority", "weighted", {"arc": "majority", "gsm8k": "weighted"}):
        changes = leader_changes(sample_keys(s, weight="w"), strategy=strategy)
        at_once = leaders_at(changes, [1, 2, 5, 9, 16])
        for k in (1, 2, 5, 9, 16):
            one_by_one = vote(s, strategy=strategy, weight="w", k=k).where("answer IS NOT NULL")
            assert sorted(map(tuple, at_once.where(F.col("k") == k).select("id", "task", "answer").collect())) == sorted(map(tuple, one_by_one.select("id", "task", "answer").collect()))
        order = [(r["id"], r["pos"], r["answer"]) for r in changes.orderBy("id", "pos").collect()]
        assert all(a[2] != b[2] for a, b in zip(order, order[1:]) if a[0] == b[0])  # a row only where the winner changes


def test_prefixes_refuse_negative_weights(spark):
    from thinkframe.operators.vote import leader_changes

    s = samples(spark, {"q": ["Answer: A", "Answer: B"]}, weights={"q": [1.0, -1.0]})
    with pytest.raises(Exception, match="not negative"):
        leader_changes(sample_keys(s, weight="w"), strategy="weighted").collect()


@pytest.mark.parametrize("size", [4096, 2])
def test_running_values_over_ranges(spark, monkeypatch, size):
    from thinkframe.operators import prefix

    monkeypatch.setattr(prefix, "RANGE", size)
    rows = [("a", 0, 3), ("a", 1, None), ("a", 5, 1), ("a", 9, 7), (None, 2, 4), (None, 3, 5), ("b", 7, None)]
    df = spark.createDataFrame(rows, "g string, pos long, v int")
    got = prefix.running(df, ["g"], "pos", {"s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")})
    assert {(r["g"], r["pos"]): (r["s"], r["lo"], r["hi"]) for r in got.collect()} == {
        ("a", 0): (3, 3, 3), ("a", 1): (3, 3, 3), ("a", 5): (4, 1, 3), ("a", 9): (11, 1, 7), (None, 2): (4, 4, 4), (None, 3): (9, 4, 5), ("b", 7): (None, None, None),
    }
    before = prefix.running(df, ["g"], "pos", {"hi": ("max", "v")}, own=False)
    assert {(r["g"], r["pos"]): r["hi"] for r in before.collect()}[("a", 9)] == 3
