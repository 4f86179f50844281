"""Appends into filled tables, retried batch times, malformed bodies."""
import datetime as dt

import pytest

from bodega.operators import migration as M
from bodega.plans.q_migration import DST, _src
from bodega.sources import tables as T
from bodega.streaming.intake import batch_time


def test_append_refuses_clashes_and_repeats(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda *r: spark.createDataFrame(list(r), "Id_Marca int, Mrc_Descripcion string")
    with pytest.raises(FileNotFoundError):
        T.append_batch(rows((1, "a")), root, "marca", "b1", ["Id_Marca"])
    T.ensure_table(spark, root, "marca")
    assert T.append_batch(rows((1, "a"), (2, "b")), root, "marca", "b1", ["Id_Marca"])[0] == 2
    for _ in range(2):
        n, refused = T.append_batch(rows((2, "x"), (3, "c"), (4, "d"), (4, "e"), (None, "f")), root, "marca", "b2", ["Id_Marca"])
        assert n == 1
        assert sorted(r.Mrc_Descripcion for r in refused.collect()) == ["d", "e", "f", "x"]
    held = T.read_appended(spark, root, "marca", rows((1, "a")).schema).collect()
    assert sorted(map(tuple, held)) == [(1, "a", "b1"), (2, "b", "b1"), (3, "c", "b2")]


def test_second_migration_adds_nothing(spark, fx, tmp_path):
    root = str(tmp_path)
    first, _ = M.migrate_into(_src(fx), fx.tables(*DST), root, "one", 50)
    assert first.where("rows_loaded > 0").count() == 5
    again, _ = M.migrate_into(_src(fx), fx.tables(*DST), root, "one", 50)
    assert again.collect() == first.collect()
    second, refused = M.migrate_into(_src(fx), fx.tables(*DST), root, "two", 50)
    assert {r.rows_loaded for r in second.collect()} == {0}
    assert refused["pedidos"].count() == 50


def test_a_retried_batch_keeps_its_time(spark, tmp_path):
    moments = iter([dt.datetime(2020, 1, 1, 10), dt.datetime(2020, 1, 1, 11)])
    got = [batch_time(spark, str(tmp_path), n, lambda: next(moments)) for n in (1, 1, 2, 1)]
    assert [m.hour for m in got] == [10, 10, 11, 10]
