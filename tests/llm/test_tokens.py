import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from pyspark.sql import functions as F

from attesta.llm import records
from attesta.llm.binpack import bins, intervals, pack
from attesta.llm.scratch import new_path
from attesta.llm.tokens import Encoder, encoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ENCODERS = {f: Encoder(public_tokenizers.path(f), 2) for f in FILES}
UNTOUCHED = {f: Tokenizer.from_file(public_tokenizers.path(f)) for f in FILES}


def plain(file, text):
    ids = UNTOUCHED[file].encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, 2], "<u4").tobytes()


@pytest.mark.parametrize("file", FILES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from([
    *"ab 'sΣéÉİßǅ́\n\t\x01\x1c\x85\u3000\u2028  日1.,;!?-<|>", "<|endoftext|>", "<|startoftext|>", "'s", "Word", "\r\n", "Ǆ"]),
    max_size=60).map("".join), max_size=4))
def test_pieces_encode_like_whole_texts(file, texts):
    assert list(ENCODERS[file].encode(texts)) == [plain(file, t) for t in texts]


@pytest.mark.parametrize("file", FILES)
def test_special_tokens_in_a_text_are_what_the_library_makes_of_them(file):
    texts = ["a <|endoftext|> b", "<|startoftext|>", None, "x<|endoftext|><|endoftext|>", "plain, words.\nNext", ""]
    assert list(ENCODERS[file].encode(texts)) == [plain(file, t) for t in texts]
    assert all(e.letters for e in ENCODERS.values())


def test_memo_starts_anew(monkeypatch):
    monkeypatch.setattr("attesta.llm.tokens.MEMO", 3)
    own = Encoder(public_tokenizers.path(FILES[0]), 2)
    texts = ["one two three four five", "two nine ten", "one eleven", "q" * 200 + " " + "r" * 200]
    assert list(own.encode(texts * 2)) == [plain(FILES[0], t) for t in texts * 2]
    for t in texts:
        assert list(own.encode([t])) == [plain(FILES[0], t)]


def test_full_memo_keeps_the_pieces_in_use(monkeypatch):
    monkeypatch.setattr("attesta.llm.tokens.MEMO", 3)
    own, texts, asked = Encoder(public_tokenizers.path(FILES[0]), 2), ["one two three four five"], []
    want = [plain(FILES[0], t) for t in texts]
    assert list(own.encode(texts)) == want
    words = own._words
    monkeypatch.setattr(own, "_words", lambda pieces: asked.extend(pieces) or words(pieces))
    assert list(own.encode(texts)) == want and not asked
    assert list(own.encode(["six two"])) == [plain(FILES[0], "six two")] and asked == ["six"]
    assert set(own.known) == {"six", " two"}


def test_encoder_stays_with_its_process():
    path = public_tokenizers.path(FILES[0])
    assert encoder(path, 2) is encoder(path, 2)
    assert encoder(path, 3).end.tolist() == [3]


def test_bins_use_every_piece_and_fit():
    rng = random.Random(3)
    for _ in range(20):
        counts = {rng.randint(1, 64): rng.randint(1, 30) for _ in range(25)}
        plan = bins(counts, 64)
        used = defaultdict(int)
        for times, chosen in plan:
            assert sum(length * k for length, k in chosen) <= 64
            for length, k in chosen:
                used[length] += times * k
        assert used == counts
        # long pieces can't share a bin, so compare with first fit, longest first
        first_fit: list[int] = []
        for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
            at = next((i for i, room in enumerate(first_fit) if room >= length), None)
            if at is None:
                first_fit.append(64 - length)
            else:
                first_fit[at] -= length
        assert sum(times for times, _ in plan) <= len(first_fit) * 1.02 + 1
    assert len(intervals([])["length"]) == 0


def test_the_first_bin_is_as_full_as_any():
    assert bins({7: 1, 5: 2, 3: 1, 2: 1}, 10)[0] == (1, [(7, 1), (3, 1)])


def test_packing_is_gapless_and_whole(docs_of, odd):
    rows = odd + [(100 + i, "word " * i) for i in range(60)]
    got = pack(docs_of(rows), public_tokenizers.path(FILES[0]), 2, 64).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for own in by_sequence.values():
        end = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == end and len(r.ids) == 4 * r.length
            end += r.length
        assert end <= 64
    for i, text in rows:
        if i == 7:
            continue
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and all(r.length == 64 for r in own[1:])
        assert b"".join(bytes(r.ids) for r in own) == plain(FILES[0], text)
    assert len(by_doc[7]) == 2
    assert pack(docs_of([]), public_tokenizers.path(FILES[0]), 2, 64).count() == 0


def test_records_survive_the_round_trip(spark, docs_of, odd):
    folder = new_path(spark, "records")
    index = records.write_records(docs_of(odd), folder, public_tokenizers.path(FILES[1]), 2)
    got = records.read_records(index).collect()
    want = sorted(odd, key=lambda r: (r[0] is not None, r[0]))
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        i, text = want.pop(0)
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (i, start, len(plain(FILES[1], text)) // 4, plain(FILES[1], text))
        start += r.n_tokens
    assert not want
    shuffled = records.read_records(index.orderBy(F.rand(1)))
    assert {(r.start, zlib.crc32(r.ids)) for r in shuffled.collect()} == {(r.start, zlib.crc32(r.ids)) for r in got}
    empty = records.write_records(docs_of([]), new_path(spark, "records"), public_tokenizers.path(FILES[1]), 2)
    assert records.read_records(empty).count() == 0


def test_records_notice_damage():
    data = bytearray(records.frame(records.serialise(np.array([1, 2, 70_000], "<u4").tobytes())))
    assert list(records.deserialise(records.unframe(memoryview(bytes(data))))) == [1, 2, 70_000]
    for at in (3, 9, 14, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises((ValueError, Exception)):
            records.unframe(memoryview(bytes(bad)))
