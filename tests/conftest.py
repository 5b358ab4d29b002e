import os
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]
SMALL = os.environ.get("SMALL_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from loomspan.session import local_session

    session = local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def empty_folder(tmp_path_factory):
    """All test tables without rows."""
    import pyarrow.parquet as pq

    to = tmp_path_factory.mktemp("empty")
    for f in Path(SMALL).glob("*.parquet"):
        pq.write_table(pq.read_schema(f).empty_table(), to / f.name)
    return str(to)


@pytest.fixture(scope="session")
def dirty_folder(tmp_path_factory):
    """All test tables with rows of nulls, every row twice, another order, and further columns of names the operators use."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    clash = ["node", "path", "kind", "target", "period", "tokens", "rank", "bucket", "n", "class", "label", "doc", "attr", "value", "held_at", "_k", "_row", "steps", "block", "ordinal", "previous", "fields", "part"]
    to = tmp_path_factory.mktemp("dirty")
    for f in Path(SMALL).glob("*.parquet"):
        t = pq.read_table(f)
        if f.name not in ("person.parquet", "field_profile.parquet", "mix_target.parquet", "documents.parquet"):
            t = pa.concat_tables([t, t])
        if f.name != "field_profile.parquet":
            t = pa.concat_tables([t, pa.table({c.name: pa.nulls(2, c.type) for c in t.schema}, t.schema)])
        t = t.take(list(range(len(t) - 1, -1, -1)))
        for c in clash:
            if c not in t.column_names:
                t = t.append_column(c, pa.array([f"x{i}" for i in range(len(t))]))
        pq.write_table(t, to / f.name)
    return str(to)
