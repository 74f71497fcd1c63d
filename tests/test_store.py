"""Snapshots of tables, and datasets on them: appends, crashes between steps, features that updates keep."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith import dataset
from sonolith.operators import fragment, registry
from sonolith.store import Conflict, Store
from tests.test_engine import write_wav

TONE = np.sin(np.arange(4000) * 0.17) * 0.5


def rows(spark, low, high, *more):
    return spark.range(low, high).select("id", *more)


def test_columns_of_any_write_are_kept(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    first = store.change("build")
    first.append("t", rows(spark, 0, 5, F.lit(1).alias("a")))
    first.commit({"n": 1})
    for k in range(20):
        change = store.change("append")
        change.append("t", rows(spark, 5 + k, 6 + k, F.lit(k).alias(f"only_{k % 3}")))
        change.commit({"n": 2 + k})
    got = store.read("t")
    assert got.count() == 25 and got.columns == ["id", "a", "only_0", "only_1", "only_2"]
    assert got.agg(*(F.count(c) for c in got.columns)).first()[:] == (25, 5, 7, 7, 6)
    change = store.change("compact")
    change.replace("t", store.read("t", change.base).coalesce(1))
    change.commit({"n": 99})
    assert store.read("t").exceptAll(got).count() == 0 and store.read("t").count() == 25
    assert store.read("t", store.snapshot(1)).count() == 5 and store.snapshot(4)["meta"] == {"n": 4}
    gone = store.vacuum()
    assert len(gone) == 21 and store.read("t").count() == 25 and store.versions() == [22]
    with pytest.raises(FileNotFoundError):
        store.snapshot(1)


def test_changes_are_seen_whole_or_not_at_all(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    with pytest.raises(FileNotFoundError):
        store.snapshot()
    first = store.change("build")
    first.append("t", rows(spark, 0, 5))
    first.commit({})
    crashed = store.change("append")
    crashed.append("t", rows(spark, 5, 9))  # and no commit
    assert store.read("t").count() == 5
    one, other = store.change("append"), store.change("append")
    one.append("t", rows(spark, 10, 12))
    other.append("t", rows(spark, 12, 19))
    one.commit({})
    with pytest.raises(Conflict):
        other.commit({})
    assert store.read("t").count() == 7 and len(store.vacuum()) == 2 and store.read("t").count() == 7
    with pytest.raises(ValueError, match="id is bigint"):
        store.change("append").append("t", spark.createDataFrame([("x",)], "id string"))
    empty = store.change("clear")
    empty.replace("t", rows(spark, 0, 0))
    empty.commit({})
    assert store.read("t").count() == 0 and store.read("t").columns == ["id"]


def built(spark, tmp_path, features, **options):
    for k in range(2):
        write_wav(tmp_path / "ds" / f"T{k}" / "a.wav", TONE * (k + 1) / 2)
    return dataset.preprocess(spark, [str(tmp_path / "ds")], str(tmp_path / "out"), fragment.Windows(2000, hop=2000, sr=8000), sr=8000, features=features, patterns=["{{track}}/*.wav"], **options)


def test_appends_and_a_compaction_lose_nothing(spark, tmp_path):
    made = built(spark, tmp_path, [registry.sql_feature("peak", "array_max(element_at(waveform, 1))", hash_expression="peak > 0.3")])
    out = str(tmp_path / "out")
    for k in range(2, 7):
        write_wav(tmp_path / "ds" / f"T{k}" / "a.wav", TONE)
        made = dataset.update(spark, out, [str(tmp_path / "ds")])
    whole = made.rows.select("frag_key", "file_path", "peak", "track").collect()
    assert len(whole) == 14 and all(r.peak is not None and r.track for r in whole)
    small = dataset.compact(spark, out)
    assert sorted(small.rows.select("frag_key", "file_path", "peak", "track").collect()) == sorted(whole)
    assert made.query(peak="true").count() == small.query(peak="true").count() == 12
    assert small.metadata["n_chunks"] == 14 and small.metadata["n_seconds"] == 3.5
    dataset.vacuum(spark, out)
    assert len(dataset.Dataset(spark, out)) == 14
    assert [dataset.Dataset(spark, out).at(k).first().frag_key for k in (0, 13)] == ["000000000", "000000013"]


def test_updates_keep_features_and_keys(spark, tmp_path):
    """Built with a registry entry; another session has nothing but the stored names and options."""
    made = built(spark, tmp_path, [registry.feature("pitch", sr=8000), registry.feature("loudness", sr=8000)])
    name = made.index.where("feature = 'pitch'").first().value
    n = made.query(pitch=name).count()
    assert n == 4
    registry.SESSION.clear()
    write_wav(tmp_path / "ds" / "T7" / "a.wav", TONE)
    grown = dataset.update(spark, str(tmp_path / "out"), [str(tmp_path / "ds")])
    assert grown.query(pitch=name).count() == 6 and grown.rows.where("loudness is null or pitch is null").count() == 0
    other = dataset.update(spark, str(tmp_path / "out"), features={"size": "size(element_at(waveform, 1))"}, hashed=["size"])
    assert other.query(pitch=name).count() == 6 and other.query(size=2000, pitch=name).count() == 6
    write_wav(tmp_path / "ds" / "T8" / "a.wav", TONE)
    last = dataset.update(spark, str(tmp_path / "out"), [str(tmp_path / "ds")])
    assert last.query(size=2000, pitch=name, track="T8").count() == 2 and last.query(pitch=name).count() == 8
    changed = dataset.update(spark, str(tmp_path / "out"), features=[registry.sql_feature("pitch", "0.0D", hash_expression="'none'")], overwrite=True)
    assert changed.query(pitch="none").count() == 8
    with pytest.raises(KeyError):
        changed.query(pitch=name)


def test_features_given_as_code(spark, tmp_path):
    hook = lambda audio: audio.withColumn("whole", F.size(F.element_at("waveform", 1)))
    built(spark, tmp_path, [registry.Feature("twice", lambda x: F.array_max(x) * 2, hash_from=lambda v: F.round(v, 0), pre_chunk=hook)])
    write_wav(tmp_path / "ds" / "T7" / "a.wav", TONE)
    grown = dataset.update(spark, str(tmp_path / "out"), [str(tmp_path / "ds")])
    assert grown.query(twice=1.0).count() == 4 and grown.rows.where("whole = 4000").count() == 6
    other = dataset.update(spark, str(tmp_path / "out"), features={"size": F.lit(1)})
    assert other.query(twice=1.0).count() == 4
    registry.SESSION.clear()
    write_wav(tmp_path / "ds" / "T8" / "a.wav", TONE)
    with pytest.raises(KeyError, match="given as code"):
        dataset.update(spark, str(tmp_path / "out"), [str(tmp_path / "ds")])
    assert len(dataset.Dataset(spark, str(tmp_path / "out"))) == 6
    left = dataset.update(spark, str(tmp_path / "out"), [str(tmp_path / "ds")], without=["twice", "size"])
    assert len(left) == 8 and left.rows.where("twice is null").count() == 2


def test_parsers_and_writers_by_name(spark, tmp_path):
    def loud_only(spark, roots, include, exclude):
        return registry.PARSERS["files"](spark, roots, include, exclude).where("file_path like '%T1%' or file_path like '%T9%'")

    made = built(spark, tmp_path, None, dir_parser=loud_only, writer="orc")
    assert len(made) == 2 and made.metadata["parser"] == "loud_only" and list((tmp_path / "out" / "fragments").rglob("*.orc"))
    for k in (8, 9):
        write_wav(tmp_path / "ds" / f"T{k}" / "a.wav", TONE)
    assert len(dataset.update(spark, str(tmp_path / "out"), [str(tmp_path / "ds")])) == 4
    for bad in ({"dir_parser": "nope"}, {"writer": "nope"}):
        with pytest.raises(KeyError):
            built(spark, tmp_path, None, force=True, **bad)
    with pytest.raises(FileExistsError):
        built(spark, tmp_path, None)
    assert len(built(spark, tmp_path, None, force=True)) == 8
    assert len(dataset.Dataset(spark, str(tmp_path / "out"), version=1)) == 2
    assert json.dumps(made.metadata)


def test_keys_of_more_digits(spark, tmp_path):
    store = Store(spark, str(tmp_path / "out"))
    change = store.change("build")
    change.append("fragments", spark.createDataFrame([("999999998",), ("999999999",), ("1000000000",), ("1000000001",)], "frag_key string"))
    change.append("feature_index", spark.createDataFrame([], "feature string, value string, key string"))
    change.commit({})
    made = dataset.Dataset(spark, str(tmp_path / "out"))
    assert [r.frag_key for r in made.scan("999999999", "1000000001").collect()] == ["999999999", "1000000000"]
    assert made.at(2).first().frag_key == "1000000000"
    assert {r.frag_key for r in dataset.Dataset(spark, str(tmp_path / "out"), max_samples=3).rows.collect()} == {"999999998", "999999999", "1000000000"}
