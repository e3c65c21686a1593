import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from chronolith.llm import bpe, packing

from .fixtures import documents


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_and_text_of_odd_strings(library):
    model, rnd = bpe.loaded(bpe.default_path()), random.Random(5)
    letters = "aA'sStTdD'lLrRe 19\t\n\x1c\x85 éÉΣσςİıßẞÀ漢字🙂#$%&<|>ﬁⅣ²½̀ 　ŉŸ"
    odd = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(600)]
    odd += ["<|endoftext|>", "a<|endoftext|>b <|startoftext|> x<|", "aaaaaaa", "", "   ", "'S 'll I'll've", "x" * 3000]
    odd += ["".join(chr(rnd.choice([rnd.randint(32, 0x2FFF), rnd.randint(0x3000, 0xD7FF), rnd.randint(0xE000, 0x1FFFF)])) for _ in range(40)) for _ in range(200)]
    got = model.encode(odd)
    for text, ids in zip(odd, got, strict=True):
        want = ids_of(library, text)
        assert ids.tolist() == want, ascii(text)
        assert model.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_cache_may_start_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    model = bpe.Bpe(bpe.default_path())
    for text in ["several words are here now", "and several others, too", "several words"] * 2:
        assert model.encode([text])[0].tolist() == ids_of(library, text)


def test_digests(spark, library):
    docs = documents(spark)
    want = sorted((str(r.doc_id), len(i := ids_of(library, r.text)), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(i, skip_special_tokens=False).encode()).hexdigest()) for r in docs.collect())
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.token_digests(docs).collect())
    assert got == want
    assert bpe.token_digests(docs.limit(0)).collect() == []


def held(rows, tokens):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= tokens
    return len(by)


@pytest.mark.parametrize("tokens", [4096, 40])
def test_packed_documents(spark, library, tokens):
    docs = documents(spark)
    got = packing.packed_documents(docs, tokens).collect()
    want = []
    for r in docs.collect():
        ids = [*ids_of(library, r.text), 1]
        want += [(str(r.doc_id), k, at, len(p := ids[at : at + tokens]), zlib.crc32(np.array(p, "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), tokens))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert held(got, tokens) <= -(-sum(w[3] for w in want) // tokens) * 1.03 + 1
    assert packing.packed_documents(docs.limit(0)).collect() == []


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rnd = np.random.default_rng(4)
    lengths = rnd.integers(1, 100, 500)
    bins, offsets = packing.pack(lengths, 200, 5, 12_000.0, rule)
    for b in np.unique(bins):
        x = lengths[bins == b]
        assert x.sum() <= 200 and len(x) <= 5 and (x.astype(float) ** 2).sum() <= 12_000
        assert sorted(offsets[bins == b].tolist()) == sorted((np.cumsum(np.sort(x)[::-1]) - np.sort(x)[::-1]).tolist())
    with pytest.raises(ValueError):
        packing.pack(np.array([300]), 200, 5, 1e9)


def test_many_groups_have_numbers_of_their_own(spark):
    rows = spark.createDataFrame([(i, 0, 0, i % 90 + 1, i) for i in range(2000)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.best_fit(rows, 100, group=20).collect()
    assert len(got) == 2000 and held(got, 100) <= 1.1 * sum(i % 90 + 1 for i in range(2000)) / 100


def test_equal_pieces_share_no_group(spark):
    rows = [(7, 0, 0, 100, 5)] * 6000 + [(i, 0, 0, 50 + i % 90, i) for i in range(6000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(7)
    got = packing.best_fit(pieces, group=16).collect()
    per_group = {}
    for r in got:
        per_group[r.sequence_id >> 32] = per_group.get(r.sequence_id >> 32, 0) + 1
    assert len(got) == 12_000 and len(per_group) > 8 and max(per_group.values()) <= 2 * 12_000 / len(per_group)
