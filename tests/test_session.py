"""The folder for intermediate tables on a session that names a cluster as its master."""

import pytest
from pyspark.sql import DataFrameReader

from helpers import table
from ladderline import session
from ladderline.config import RatingConfig
from ladderline.operators import fold, merge
from test_fold import random_rows


@pytest.fixture()
def cluster(spark, monkeypatch):
    """The local session under a cluster's name: starting one would be a server."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(session, "_known_shared", set(), raising=False)
    return spark


def test_mounted_folder_on_a_cluster(cluster):
    rows = random_rows(3, n=40)
    m = table(cluster, rows)
    assert merge.numbered(m, "n").count() == 40
    done = fold.final_states(fold.rating_fold(m, RatingConfig(), with_events=False))
    assert {r.team for r in done.collect()} == {t for r in rows for t in r[3:5]}


def test_warehouse_where_no_folder_is_named(cluster, monkeypatch):
    monkeypatch.setattr(session, "_CHECKPOINT_KEY", "spark.ladderline.test.unset")
    monkeypatch.setattr(session, "_require_shared", lambda *_: None, raising=False)
    assert session.shared_folder(cluster).endswith("/ladderline-intermediate")


def test_folder_of_each_machine_is_refused(cluster, monkeypatch):
    """Files written elsewhere are missing from the driver's listing."""
    whole = DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *p: whole(self, *p).where("false"))
    with pytest.raises(RuntimeError, match="not one folder for all machines"):
        session.shared_folder(cluster)
