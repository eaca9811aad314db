"""Tables that queries share are built once, and anew when the input changes."""

from causeway.plans import runs


def test_kept_until_the_input_changes(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(len(made))

    spark.range(3).write.parquet(str(tmp_path / "events.parquet"))
    one = lambda name: runs.kept(spark, str(tmp_path), name, build).count()
    assert (one("a"), one("a"), len(made)) == (1, 1, 1)
    assert one("b") == 2
    spark.range(4).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    assert one("a") == 3 and len(made) == 3
