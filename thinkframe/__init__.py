"""thinkframe: Spark-native operators for reasoning-trace data.

Answer extraction and normalisation, the verified-trace filter, dataset
build (dedupe, cap, chat rendering, seeded split), rule-based rewards and
group-relative advantages, self-consistency votes, evaluation reports and
training-array encoding, all as DataFrame / Column functions.
"""

__version__ = "0.1.0"
