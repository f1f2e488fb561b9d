"""What a worker keeps between the tasks of different stages."""

import pyarrow as pa

from larkspur.llm import common, packing


def test_a_stage_starts_without_the_tables_of_another_and_leaves_none():
    packing.word_ids(None)
    seen = []

    def run(batches):
        seen.append(packing.word_ids.cache_info().currsize)
        common._powers(1 << 20)
        yield from batches

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["x"])
    assert list(common.lean(run)(iter([batch]))) == [batch]
    assert seen == [0] and common._powers.cache_info().currsize == 0
