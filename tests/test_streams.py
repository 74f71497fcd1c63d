"""Streams into datasets, and windows of signals that arrive in pieces, against the same work in one batch."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith import dataset
from sonolith.operators import fragment, registry
from sonolith.streaming import ingest
from tests.test_engine import write_wav


def test_stream_into_a_dataset_equals_batches(spark, tmp_path):
    def build(name):
        write_wav(tmp_path / name / "ds" / "T0" / "a.wav", np.sin(np.arange(4000) * 0.1) * 0.5)
        dataset.preprocess(spark, [str(tmp_path / name / "ds")], str(tmp_path / name / "out"), fragment.Windows(1000, hop=500, sr=8000), sr=8000, patterns=["{{track}}/*.wav"], features=[registry.sql_feature("peak", "array_max(element_at(waveform, 1))", hash_expression="peak > 0.3")], exclude=["*skip*"])
        return str(tmp_path / name / "ds"), str(tmp_path / name / "out")

    (root, out), (batch_root, batch_out) = build("stream"), build("batch")
    for k in range(1, 4):
        for r in (root, batch_root):
            write_wav(tmp_path / r / f"T{k}" / "a.wav", np.sin(np.arange(4000) * 0.1) * 0.2 * k)
            write_wav(tmp_path / r / f"T{k}" / "skip.wav", np.zeros(4000))
        ingest.into_dataset(ingest.audio_stream(spark, root), root, out, str(tmp_path / "check")).awaitTermination()
        dataset.update(spark, batch_out, [batch_root])
    one, other = dataset.Dataset(spark, out), dataset.Dataset(spark, batch_out)
    columns = ["frag_key", "file_path", "start_pos", "waveform", "track", "peak"]
    assert len(one) == 28 and sorted(map(repr, one.rows.select(columns).collect())) == sorted(map(repr, other.rows.select(columns).collect()))
    assert sorted(map(repr, one.index.select("feature", "value", "key").collect())) == sorted(map(repr, other.index.select("feature", "value", "key").collect()))
    ingest.into_dataset(ingest.audio_stream(spark, root), root, out, str(tmp_path / "again")).awaitTermination()
    assert len(dataset.Dataset(spark, out)) == 28 and dataset.Dataset(spark, out).query(track="T3", peak="true").count() == 7


@pytest.mark.parametrize("cutting", [fragment.Windows(64, hop=48), fragment.Windows(50, hop=80, pad="zero", least=7), fragment.Windows(40, hop=10, pad="reflect", least=15)])
def test_pieces_give_the_windows_of_whole_signals(spark, tmp_path, cutting):
    rng = random.Random(3)
    whole = {f"f{k}": [float(np.float32(rng.gauss(0, 1))) for _ in range(n)] for k, n in enumerate((0, 30, 64, 65, 300, 777))}
    pieces = []
    for name, x in whole.items():
        cuts = sorted(rng.sample(range(len(x) + 1), min(5, len(x) + 1)))
        parts = [x[a:b] for a, b in zip([0, *cuts], [*cuts, len(x)])]
        pieces += [(name, i, i == len(parts) - 1, p) for i, p in enumerate(parts)]
    rng.shuffle(pieces)
    pieces += rng.sample(pieces, 4)  # and some come again
    folder = tmp_path / "in"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(0, len(pieces), 9):
            spark.createDataFrame(pieces[k : k + 9], ingest.PIECES).coalesce(1).write.mode("append").parquet(str(folder))
            stream = spark.readStream.schema(ingest.PIECES).parquet(str(folder))
            ingest.windows_of_pieces(stream, cutting).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {(r.file_path, r.start): (r.number, r.waveform) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    signals = spark.createDataFrame(list(whole.items()), "file_path string, waveform array<float>")
    want = {(r.file_path, r.start): r.waveform for r in fragment.fragments(signals, cutting).collect()}
    assert {k: v[1] for k, v in got.items()} == want
    hop = cutting.samples()[1]
    assert all(number * hop == start for (_, start), (number, _) in got.items()) and F
