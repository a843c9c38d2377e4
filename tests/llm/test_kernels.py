import numpy as np
import pyarrow as pa
import pytest

from attesta.llm.kernels import chunks, span_hashes, texts
from attesta.llm.linededup import drop_common_lines


def regular(n):
    """Two strings of n letters, each the other with its two letters changed over, that a
    polynomial hash modulo a power of two does not tell apart from 1,024 letters on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [128, 256, 512, 1024, 2048, 4096])
def test_regular_strings_have_hashes_of_their_own(n):
    x, y = regular(n)
    data, at = texts(pa.array([x, y, x]))
    found = span_hashes(data, at[:-1], at[1:])
    assert found[0] != found[1] and found[0] == found[2]


def test_regular_lines_are_not_one_line(spark, docs_of):
    x, y = regular(2048)
    docs = docs_of([(i, f"{x}\nown {i}") for i in range(10)] + [(50, f"{y}\nlast")])
    kept = {r["doc_id"]: r["text"] for r in drop_common_lines(docs, least=10).collect()}
    assert kept[0] == "own 0" and kept[50] == f"{y}\nlast"


def test_chunks_hold_whole_rows():
    column = pa.array(["a" * 10, None, "", "b" * 100, "é"])
    rows = [bytes(d[i:j]).decode() for d, at in chunks(column, 16) for i, j in zip(at, at[1:])]
    assert rows == ["a" * 10, "", "", "b" * 100, "é"] and np.all(texts(column)[1] == [0, 10, 10, 10, 110, 112])
