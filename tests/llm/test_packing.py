import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from daytide.llm import packing
from daytide.llm.queries import op6_best_fit_packing, tokenizer_path
from tests.llm.helpers import documents, random_texts

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


ODD = [
    "", " ", "a  b\n\n c", "it's  \t\tfine   ok x ", "<|endoftext|> hi", "café\n naïve  " + " " * 40 + "z ", None, "\n\n\nq",
    "🙂 🙂🙂 x\r\n y", "'s 'll x's", " 1234 5678,,, ...", "a \n\nb", " x 　 y", "x" * 3000,
]


def test_ids_are_those_of_the_whole_text(tokenizer):
    rng = random.Random(1)
    letters = list("ab Zé1.,'\n\t   \x1c🙂") + ["the ", " of", "'re", "  "]
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    own = packing.Encoder(PATH)
    for part in (texts[:50], texts):  # the second call meets a filled cache
        for text, ids in zip(part, own.encode(pa.array(part))):
            assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_a_full_cache_starts_anew(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 20)
    own = packing.Encoder(PATH)
    for seed in range(3):
        texts = random_texts(seed, 20)
        for text, ids in zip(texts, own.encode(pa.array(texts))):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


ADDED = [
    "<|endoftext|> hi", "a<|endoftext|>b", "<|endoftext|>", "x \n<|endoftext|><|endoftext|> y ", "<|endoftext|", "é\xa0<|endoftext|> ",
    "it's " * 3000 + "<|endoftext|>",
]


def test_ids_are_those_of_the_unmodified_tokenizer():
    plain = Tokenizer.from_file(PATH)
    assert plain.encode(ADDED[0], add_special_tokens=False).ids == [50256, 23105]
    own = packing.Encoder(PATH, added=True)
    for texts in (ODD, ADDED + ODD + random_texts(9, 50)):
        for text, ids in zip(texts, own.encode(pa.array(texts))):
            assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_the_query_and_the_pipeline_use_the_unmodified_tokenizer(spark, tmp_path):
    plain = Tokenizer.from_file(PATH)
    rows = list(enumerate(ADDED))
    docs = documents(spark, rows, clash=False)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for out in (op6_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, str(tmp_path))):
        got = {(r.doc_id, r.start): r.ids_crc32 for r in out.collect()}
        for doc, text in rows:
            ids = np.array(plain.encode(text, add_special_tokens=False).ids + [0], "<u4")
            for (d, start), crc in got.items():
                end = min([s for o, s in got if o == d and s > start], default=len(ids))
                assert d != doc or crc == zlib.crc32(ids[start:end].tobytes()), repr(text[:40])


def placements(rows, size):
    """Check that the pieces of each sequence follow each other; number of sequences."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


@pytest.mark.parametrize("size", [16, 64, 2048])
def test_pack(spark, tokenizer, size):
    rows = list(enumerate(random_texts(6, 120) + ODD)) + [(5, "twice"), (5, "twice"), (None, None)]
    got = packing.pack(documents(spark, rows), PATH, size).collect()
    made = sorted((r.doc_id is not None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    want = []
    for doc, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        lengths = [len(ids)] if len(ids) <= size else [len(ids) % size] * (len(ids) % size > 0) + [size] * (len(ids) // size)
        at = 0
        for piece, n in enumerate(lengths):
            want.append((doc is not None, doc or 0, piece, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at += n
    assert made == sorted(want)
    total = sum(r.length for r in got)
    used = placements(got, size)
    assert used <= -(-total // size) * 1.1 + 1


def test_sequences_hold_every_token(spark):
    rows = list(enumerate(random_texts(8, 40)))
    pieces = packing.pack(documents(spark, rows), PATH, 32)
    full = {r.sequence_id: r.ids for r in packing.sequences(documents(spark, rows), PATH, 32).collect()}
    for r in pieces.collect():
        part = np.array(full[r.sequence_id][r.offset : r.offset + r.length], "<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32


def test_a_length_that_many_pieces_have(spark):
    rows = [(i, 7) for i in range(3000)] + [(5000 + i, 5) for i in range(1500)] + [(9000, 16)]
    cut = spark.createDataFrame(rows, "doc_id long, length long").selectExpr(
        "doc_id", "0 AS piece", "0L AS start", "length", "doc_id AS ids_crc32"
    )
    got = packing.place(cut, 16, rows_a_salt=100).collect()
    assert len(got) == len(rows)
    assert placements(got, 16) <= -(-(3000 * 7 + 1500 * 5 + 16) // 16) * 1.25


@pytest.mark.parametrize("seed", [1, 2])
def test_plan_uses_each_piece_once(seed):
    rng = np.random.default_rng(seed)
    size = 512
    counts = np.bincount(rng.integers(1, size + 1, 4000), minlength=size + 1)
    planned = packing.plan(counts, size)
    used = np.zeros(size + 1, int)
    for pattern, times in planned:
        assert sum(pattern) <= size
        for n in pattern:
            used[n] += times
    assert (used == counts).all()
    total = (np.arange(size + 1) * counts).sum()
    assert sum(t for _, t in planned) <= 1.01 * -(-total // size)


def test_empty_table(spark):
    assert packing.pack(documents(spark, []), PATH).collect() == []
