import pytest

from mailspark.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("mailspark-tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *keys):
    """Rows as dicts, sorted by keys, for comparisons of small results."""
    out = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(out, key=lambda r: tuple(r[k] for k in keys)) if keys else out
