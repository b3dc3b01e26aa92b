import pyarrow as pa

from gleaner.llm import decontamination, license_scan, simhash_dedup
from gleaner.llm.common import sliced


def test_sliced_batches_hold_all_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"a": list(range(2500)), "t": [None if i % 7 == 0 else "é" * (i % 5) for i in range(2500)]})
    parts = list(sliced([batch.slice(3), batch.slice(0, 2), batch.slice(0, 0)], 1000))
    assert [p.num_rows for p in parts] == [1000, 1000, 497, 2]
    assert pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([batch.slice(3), batch.slice(0, 2)]).to_pydict()


def test_operators_leave_the_session_as_it_is(spark, docs):
    before = {r[0]: r[1] for r in spark.sql("set").collect()}
    items = spark.createDataFrame([(1, "some words of an item")], "item_id long, text string")
    decontamination.pairs(docs, items).count()
    license_scan.scanned(docs).count()
    simhash_dedup.fingerprints(docs).count()
    assert {r[0]: r[1] for r in spark.sql("set").collect()} == before
