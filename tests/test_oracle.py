"""Every registered query against its SQL counterpart."""

import __spark_entry__ as contract
import oracle
import pytest

from voltpoint import plans

QUERIES = plans.queries()
SQL = plans.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, sf_dir, name):
    ours = QUERIES[name](spark, sf_dir).toArrow()
    theirs = con.sql(SQL[name]).to_arrow_table()
    assert theirs.num_rows > 0
    assert oracle.differences(ours, theirs) == []


def test_entry(spark):
    result = contract.entry(spark)
    assert result.count() == 748
    assert {"epoch_ns", "rel_ns", "t", "color"} <= set(result.columns)


def test_files_are_written_once_per_application(spark, sf_dir):
    from voltpoint.plans import adapter

    assert adapter.event_files(spark, sf_dir) == adapter.event_files(spark, sf_dir)


class Session:
    """As much of a session as choosing a folder needs."""

    def __init__(self, master="local[2]", **options):
        self.conf = self.sparkContext = self
        self.master, self.get = master, options.get
        self._jsc = None


def test_scratch_folder_is_the_shared_one():
    from voltpoint.sources import scratch_folder

    cluster = Session("yarn", **{"spark.checkpoint.dir": "/shared/checkpoints/"})
    folder = scratch_folder(cluster)
    assert folder.startswith("/shared/checkpoints/voltpoint-")
    assert folder != scratch_folder(cluster)
    assert scratch_folder(Session()) != scratch_folder(Session())
    with pytest.raises(ValueError, match="checkpoint"):
        scratch_folder(Session("yarn"))


def test_scratch_is_removed(spark):
    from voltpoint.sources import remove_scratch, scratch_folder

    session = spark.newSession()
    folder = scratch_folder(session)
    session.range(3).write.parquet(folder)
    remove_scratch(session)
    with pytest.raises(Exception, match="(?i)path"):
        session.read.parquet(folder)


def test_the_session_time_zone_has_no_part(spark, con, sf_dir, conf):
    for zone in ("America/Chicago", "Asia/Kathmandu"):
        conf("spark.sql.session.timeZone", zone)
        for name in ("epoch_ns_of_ts", "parse_lylout", "filter_points"):
            ours = QUERIES[name](spark, sf_dir).toArrow()
            assert oracle.differences(ours, con.sql(SQL[name]).to_arrow_table()) == []
