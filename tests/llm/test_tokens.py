"""Token records and packing against the tokenizers library and plain packing."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import documents, odd_documents
from tidewatch.llm.packing import best_fit_decreasing, pack
from tidewatch.llm.queries import QUERIES
from tidewatch.llm.records import frame as framed
from tidewatch.llm.records import read_digests, read_records, unframe, write_records
from tidewatch.llm.tokens import Encoder, text_slices
from tidewatch.session import run_folder

WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def plain(path, texts, end):
    tokenizer = Tokenizer.from_file(path)
    found = tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array([*e.ids, end], "<u4") for e in found]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encoder_equals_the_library(path):
    random.seed(1)
    signs = [*"abAB é'\n\n  .,!?$-_019²ßΣσİ̇\t\x1c\x85 中文", "<|endoftext|>", "  ", "\r\n", " x", "'s", " hello", " World.", "...", "<|startoftext|>", "<|endof", "'re", "Don't", "12", " ÀÉ", "÷×", "ɏ", "&&&", "\u200b", "\x00"]
    texts = ["".join(random.choices(signs, k=random.randint(0, 30))) for _ in range(3000)] + ["", "x" * 5000]
    encoder = Encoder(path)
    for at in range(0, len(texts), 400):
        part = texts[at : at + 400]
        for got, ids in zip(encoder.encode(part), plain(path, part, 0), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == ids[:-1].tolist()


@pytest.mark.parametrize("path, ids", [(WORDS, [320, 49407, 321]), (BYTES, [64, 220, 50256, 275])])
def test_added_tokens_are_told_as_the_library_does(path, ids):
    assert np.frombuffer(Encoder(path).encode(["a <|endoftext|> b"])[0], "<u4").tolist() == ids


def test_forgotten_words_are_encoded_alike(monkeypatch):
    monkeypatch.setattr("tidewatch.llm.tokens.REMEMBERED", 8)
    random.seed(2)
    texts = [" ".join(random.choices(["aa", "bb,", "cc", "Dd", "é&&&", "ff\ngg", "hh", "ii...", "jj", "kk"], k=12)) for _ in range(200)]
    encoder = Encoder(BYTES)
    for text, ids in zip(texts, plain(BYTES, texts, 0), strict=True):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == ids[:-1].tolist()


def test_slices_follow_the_texts(monkeypatch):
    monkeypatch.setattr("tidewatch.llm.tokens.BATCH_BYTES", 10)
    texts = ["", "a" * 9, "b", "c" * 30, None, "é" * 5, "d"]
    found = [b.column("text").to_pylist() for b in text_slices(iter([pa.record_batch({"text": texts}), pa.record_batch({"text": pa.array([], pa.string())})]))]
    assert found == [["", "a" * 9, "b"], ["c" * 30], [None, "é" * 5], ["d"]]


def test_records_query(spark, sf_dir):
    docs = documents(sf_dir).sort_values("doc_id")
    got = QUERIES["op5_token_records"](spark, sf_dir).toPandas().set_index("doc_id")
    start = 0
    for doc_id, ids in zip(docs.doc_id, plain(WORDS, docs.text, 2), strict=True):
        row = got.loc[doc_id]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


def test_records_of_odd_rows(spark):
    docs = odd_documents(spark)
    folder = run_folder(spark, "records")
    index = write_records(docs, folder, BYTES, end_id=7)
    rows = read_records(index.orderBy("doc_id", ascending=False), folder).toPandas()  # in another order
    assert len(rows) == docs.count() and all(list(x)[-1] == 7 for x in rows.ids)
    digests = read_digests(index, folder).orderBy("start").toPandas()
    assert digests.start.tolist() == [0, *np.cumsum(digests.n_tokens)[:-1]]
    assert digests.doc_id.isna().tolist()[0] and digests.doc_id.dropna().is_monotonic_increasing
    nothing = run_folder(spark, "records")
    assert read_records(write_records(docs.limit(0), nothing, BYTES, 7), nothing).count() == 0


def test_damage_is_found(tmp_path):
    path = tmp_path / "x"
    good = framed(b"some ids")
    for at in range(len(good)):
        path.write_bytes(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :])
        with path.open("rb") as f, pytest.raises((ValueError, MemoryError, OverflowError)):
            unframe(f, 0)
    path.write_bytes(good)
    with path.open("rb") as f:
        assert unframe(f, 0) == b"some ids"


def one_by_one(lengths, capacity):
    """Best-fit decreasing as it is written in books."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            best = min(fit, key=lambda i: rooms[i])
            rooms[best] -= n
        else:
            rooms.append(capacity - n)
    return Counter(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_packing_by_counts_equals_one_by_one(seed):
    random.seed(seed)
    capacity = random.choice([7, 64, 100])
    lengths = [random.randint(1, capacity) for _ in range(random.randint(1, 400))]
    runs = best_fit_decreasing(Counter(lengths), capacity)
    used, places = Counter(), set()
    for length, _, pieces, each, first, offset in runs:
        for i in range(pieces):
            sequence, at = first + i // each, offset + i % each * length
            used[sequence] += length
            cells = {(sequence, at + k) for k in range(length)}
            assert not cells & places and at + length <= capacity
            places |= cells
    assert Counter(capacity - n for n in used.values()) == one_by_one(lengths, capacity)
    assert sorted(used) == list(range(len(used))) and len(places) == sum(lengths)


def check_pieces(got, ids_of):
    got = got.sort_values(["sequence_id", "offset"])
    ends = got.groupby("sequence_id").length.cumsum()
    assert (got.offset == ends - got.length).all() and ends.max() <= 2048
    assert sorted(got.sequence_id.unique()) == list(range(got.sequence_id.nunique()))
    for x in got.itertuples():
        ids = ids_of[x.doc_id]
        piece = ids[x.start : x.start + x.length]
        assert (x.doc_tokens, x.length, x.ids_crc32) == (len(ids), len(piece), zlib.crc32(piece.tobytes()))
    assert got.groupby("doc_id").length.sum().to_dict() == {k: len(v) for k, v in ids_of.items()}


def test_packing_query(spark, sf_dir):
    docs = documents(sf_dir)
    got = QUERIES["op9_packing"](spark, sf_dir).toPandas()
    check_pieces(got, dict(zip(docs.doc_id, plain(BYTES, docs.text, 1), strict=True)))
    assert got.sequence_id.nunique() <= 1.02 * got.length.sum() / 2048 + 1


def test_packing_of_odd_rows(spark):
    docs = odd_documents(spark)
    got = pack(docs, BYTES, 1).toPandas()
    tokens = sum(len(x) for x in plain(BYTES, [r.text for r in docs.collect()], 1))
    assert got.length.sum() == tokens and (got.length <= 2048).all()
    assert pack(docs.limit(0), BYTES, 1).count() == 0
