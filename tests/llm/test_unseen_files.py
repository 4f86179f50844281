"""Operator 2: a file of the first pass that a worker does not see is an error."""
import numpy as np
import pytest

from bodega.llm import substring_dedup
from bodega.llm.common import local_path, scratch


def test_missing_files_raise(spark, tmp_path):
    folder, k = local_path(scratch(spark, "unseen")), substring_dedup.BLOCK_BITS
    partials = spark.createDataFrame([(r, 0, 0, substring_dedup._pack_cells(np.arange(9), np.zeros(9))) for r in range(substring_dedup.ROWS)],
                                     "row int, block long, salt int, payload binary")
    written = substring_dedup._write_sketch(partials, folder)
    written |= substring_dedup._write_copies(spark.createDataFrame([(5,), (69,)], "key long"), folder)
    assert written == {"sketch-0-0", "sketch-1-0", "copies-5"}
    values = np.arange(50, dtype=np.uint64)
    seen = substring_dedup._Prefilter(folder, k, written)
    assert seen.is_copy(69) and not seen.is_copy(133) and not seen.is_copy(6)
    assert not seen.repeated(values).any()
    unseen = substring_dedup._Prefilter(str(tmp_path), k, written)
    with pytest.raises(FileNotFoundError):
        unseen.repeated(values)
    with pytest.raises(FileNotFoundError):
        unseen.is_copy(5)
    assert not substring_dedup._Prefilter(str(tmp_path), k, set()).repeated(values).any()  # no cells in the block
