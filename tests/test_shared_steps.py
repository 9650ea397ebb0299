"""Steps that several readers or cores share are done once and by all."""

import pytest
from conftest import FOLDER

from mnemoframe.plans import views as V
from mnemoframe.plans.catalog import load
from mnemoframe.streaming import ingest


@pytest.mark.parametrize("name", ["memory_status", "memory_status_with_requests", "policy_differences"])
def test_memories_are_numbered_once(spark, name):
    found = load()[name].run(spark, FOLDER)
    assert "o_orderkey" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("view", [V.order_observations, V.shipment_observations])
def test_texts_are_made_after_numbering(spark, view, monkeypatch):
    numbered, number = [], V.number_in_group

    def watched(rows, *args):
        numbered.append(rows.columns)
        return number(rows, *args)

    monkeypatch.setattr(V, "number_in_group", watched)
    assert "content" in view(spark, FOLDER).columns
    assert numbered and not any("content" in columns for columns in numbered)


def test_micro_batches_keep_every_core_busy(spark, monkeypatch):
    files, take = [], ingest.IngestSink.take

    def watched(self, batch, batch_id):
        files.append(batch._jdf.rdd().getNumPartitions())
        take(self, batch, batch_id)

    monkeypatch.setattr(ingest.IngestSink, "take", watched)
    load()["streamed_extraction"].run(spark, FOLDER)
    assert len(files) > 1 and files[0] >= spark.sparkContext.defaultParallelism
