"""Where scratch tables go, and that they go away."""

import pytest

from tallyloom import session


def exists(path):
    import os

    return os.path.isdir(path.removeprefix("file:").replace("//", "/"))


def paths_of(df):
    return {p.rsplit("/", 1)[0] for p in df.inputFiles()}


def test_scratch_tables_end_with_their_block(spark):
    session.release(spark)
    outer = session.materialise(spark.range(5), "outer")
    with session.scratch(spark):
        inner = session.materialise(spark.range(7), "inner")
        with session.scratch(spark):
            deepest = paths_of(session.materialise(spark.range(3), "deepest"))
        assert inner.count() == 7 and not any(map(exists, deepest))
        held = paths_of(inner)
    assert outer.count() == 5 and not any(map(exists, held))
    with pytest.raises(Exception, match="FAILED_READ_FILE|does not exist|PATH_NOT_FOUND"):
        inner.count()
    kept = paths_of(outer)
    assert all(map(exists, kept)) and session.release(spark) == 1 and not any(map(exists, kept)) and session.release(spark) == 0


def test_a_failing_block_is_cleaned_too(spark):
    with pytest.raises(ValueError, match="stop"), session.scratch(spark):
        held = paths_of(session.materialise(spark.range(2), "torn"))
        raise ValueError("stop")
    assert not any(map(exists, held))
