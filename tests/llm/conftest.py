import pytest


@pytest.fixture
def frame(spark):
    """A documents-like frame from (doc_id, text[, source]) rows, in two partitions, with an extra column."""
    def build(rows, parts=2):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", "extra") for r in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, source string, h string").repartition(parts)

    return build


@pytest.fixture
def messy():
    """Nulls, empty, very long, repeated rows."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(30000))
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one two three"), (4, "one two three"), (5, long), (None, "lonely text"),
            (6, "żółć é 日本 \x00 end"), (7, "aaaa " * 300)]
