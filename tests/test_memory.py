"""What Python holds at once does not grow with the batch."""

import tracemalloc

import pandas as pd
import pyarrow as pa

from attesta.functions import memory as M
from attesta.functions import sentences as TX
from attesta.functions import vectors as V
from attesta.operators import chunks as CH


def test_sentences_are_cut_in_steps():
    texts = pa.array(["One word. Two words. " * 20, None, ""] * 1000)
    tracemalloc.start()
    out = TX._sentences.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == len(texts) and [len(x) for x in out[:3].to_pylist()] == [40, 0, 0]
    assert out[0].as_py()[1] == {"start": 10, "end": 20, "text": "Two words."}
    assert peak < 2_000_000


def test_texts_are_encoded_in_pieces():
    frame = pd.DataFrame({"item_id": range(1000), "text": [f"word{i} other" for i in range(999)] + [None]})
    pieces = list(V.encoded([frame], V.hashing_encoder(), "text", 16))
    assert max(map(len, pieces)) <= 256 and [i for p in pieces for i in p["item_id"]] == list(range(1000))
    assert [len(s) for s in pieces[-1]["sparse"]][-2:] == [2, 0]


def test_rows_of_several_columns_go_by_steps(monkeypatch):
    held, most = [], []
    monkeypatch.setattr(M, "STEP", 4)
    plain = pa.array

    def array(rows, kind=None):
        most.append(len(rows))
        return plain(rows, kind)
    a, b = plain(range(10)), plain([[i] for i in range(10)])
    monkeypatch.setattr(M.pa, "array", array)
    out = M.by_steps(lambda x, y: (held.append(x), [x, *y])[1], pa.list_(pa.int64()), a, b)
    assert out.to_pylist() == [[i, i] for i in range(10)] and most == [4, 4, 2] and held == list(range(10))


def test_chunking_hands_its_columns_to_steps(monkeypatch):
    seen = []
    monkeypatch.setattr(CH, "by_steps", lambda fn, kind, *columns: seen.append(len(columns)) or M.by_steps(fn, kind, *columns))
    lists = lambda *rows: pa.array(rows, pa.list_(pa.int32()))
    walk = CH._walker(10, 2, False).func
    out = walk(lists([CH.TEXT] * 3), lists([4, 4, 4]), pa.array([[None] * 3], pa.list_(pa.int32())), lists([0, 3]), lists([0, 0]), lists([]))
    assert seen == [6] and [(c["a"], c["b"]) for c in out[0].as_py()] == [(0, 2), (1, 3)]
