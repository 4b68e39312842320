"""Line dedup where ids say nothing: texts of one id are told apart however much their short hashes agree."""

from pyspark.sql import functions as F

from echolith.llm import line_dedup


def test_texts_of_one_id_with_equal_short_hashes(spark):
    repeated, own = (" ".join(f"{c}{k}" for k in range(30)) for c in "ab")
    family = lambda text, name: spark.range(300_000).select(F.concat(F.lit(f"{text} z"), "id").alias(name)).withColumn("s", F.hash(name))
    pair = family(repeated, "x").join(family(own, "y"), "s").first()
    for shared in (5, None):
        rows = [(1, repeated), (shared, pair.x), (shared, pair.y)] if shared else [(1, repeated), (None, pair.x), (None, pair.y), (2, repeated)]
        got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.text: r.n_words_removed for r in got}[pair.y] == 0
        assert sorted(r.n_words_removed for r in got) == ([0, 0, 30] if shared else [0, 0, 30, 30])
