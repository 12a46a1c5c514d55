import io
import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyquilt.llm import packing, pfor
from skyquilt.llm.queries import op3_packing, op5_token_ids
from skyquilt.llm.tokens import default_vocabulary, encoder, library, sentence_ends

from .conftest import ODD

PATH = default_vocabulary()
LIBRARY = library(PATH)


def truth(text, end):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, end], "<u4")


def test_ids_are_the_librarys(docs):
    texts = [r.text for r in docs.select("text").collect()]
    random.seed(3)
    bits = ["a", "b", "'s", "don't", " ", "\n", "\t", " ", "é", "1", ".", "  ", "\0", "#", "Hello", "\r\n", "漢", "😀", "<|endoftext|>", "́", "\x1f"]
    texts += ["".join(random.choices(bits, k=random.randint(0, 30))) for _ in range(3000)]
    own = encoder(PATH)
    assert own.fast, "the fast path is the one to test"
    for text, found in zip(texts, LIBRARY.encode_batch_fast(texts, add_special_tokens=False)):
        assert own.ids(text).tolist() == found.ids
    assert own.ids(None).tolist() == own.ids("").tolist() == []


def test_white_space_runs_and_added_tokens_are_the_unaltered_librarys():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(PATH), encoder(PATH)
    for text in ("x" + " " * 2_000_000 + "y", "\n" * 2_000_000, "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|"):
        assert own.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert 50256 in own.ids("a <|endoftext|> b")


def padding(n):
    return 0 if n & (n - 1) == 0 else 2048 - n


def check_pieces(rows, rows_in):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    want = {}
    for doc, text in rows_in:
        want.setdefault(doc, []).append(truth(text, 1))
    assert by_doc.keys() == want.keys()
    for doc, ids in want.items():
        pieces = sorted(by_doc[doc], key=lambda r: r.start)
        assert sum(p.length for p in pieces) == sum(map(len, ids))
        for p in pieces:
            assert p.doc_tokens == len(ids[0])
            assert p.ids_crc32 == zlib.crc32(ids[0][p.start : p.start + p.length].tobytes())
        assert sorted(i for p in pieces for i in range(p.start, p.start + p.length)) == sorted(i for x in ids for i in range(len(x)))
    total = pad = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 2048
        total, pad = total + at, pad + padding(at)
    return pad / max(total, 1)


def test_packing_whole_table_little_padding(spark, sf, docs):
    rows = op3_packing(spark, sf).collect()
    assert check_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()]) < 0.01


def test_packing_odd_rows(spark, odd, clashing, empty):
    for table in (odd, clashing):
        check_pieces(packing.pack(table).collect(), [(r[0], r[1]) for r in ODD])
    assert packing.pack(empty).count() == 0
    kept = packing.pack(odd, keep_ids=True).where("doc_id = 5").collect()
    assert kept[0]["ids"] == truth("word", 1).tolist()


def brute(at, penalty, window, cost):
    best = (float("inf"), None)
    inner = range(1, len(at) - 1)
    for k in range(len(at)):
        for mid in itertools.combinations(inner, k):
            chain = [0, *mid, len(at) - 1]
            lengths = [at[b] - at[a] for a, b in zip(chain, chain[1:])]
            if max(lengths) <= window:
                c = sum((0 if n & (n - 1) == 0 else window - n) + cost for n in lengths) + sum(penalty[j] for j in chain[1:])
                best = min(best, (c, chain))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=8), st.lists(st.sampled_from([0, 2, 5]), min_size=9, max_size=9), st.integers(0, 3))
def test_cuts_cost_the_least(steps, penalties, cost):
    at = np.concatenate([[0], np.cumsum(steps)])
    penalty = np.array(penalties[: len(at)])
    chain = packing.best_cuts(at, penalty, window=16, window_cost=cost)
    lengths = [at[b] - at[a] for a, b in zip(chain, chain[1:])]
    got = sum((0 if n & (n - 1) == 0 else 16 - n) + cost for n in lengths) + sum(penalty[j] for j in chain[1:])
    assert max(lengths) <= 16 and got == brute(at, penalty, 16, cost)[0]


def test_chunks_lose_nothing():
    ends = sentence_ends(PATH)
    for chunk in (1, 100, 5000):
        packer, generator = packing.Packer(ends, window=64, chunk=chunk), np.random.default_rng(1)
        streams = {k: generator.integers(0, 50000, n).astype("<u4") for k, n in enumerate((1, 700, 3, 64, 128, 5, 999))}
        pieces = [p for k, x in streams.items() for p in packer.add(k, x)] + packer.finish()
        for k, x in streams.items():
            assert np.concatenate([p[7] for p in sorted((p for p in pieces if p[0] == k), key=lambda p: p[1])]).tolist() == x.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=0, max_size=900), st.floats(0.1, 1.0))
def test_blocks_round_trip(values, percentile):
    ids = np.array(values + [7] * (-len(values) % pfor.BLOCK), "<u4")
    data, start = pfor.encode_blocks(ids, percentile) if len(ids) else (b"", np.empty(0, int))
    if len(ids):
        assert pfor.decode_blocks(data, start).tolist() == ids.tolist()


def test_file_reads_any_range_and_rejects_damage():
    generator = np.random.default_rng(0)
    docs = [(k if k != 3 else None, np.minimum(generator.geometric(0.001, n), 50256).astype("<u4")) for k, n in enumerate((5, 0, 1000, 256, 70000, 1))]
    out = io.BytesIO()
    writer = pfor.Writer(out, chunk=pfor.BLOCK * 4)
    for doc, ids in docs:
        writer.add(doc, ids)
    writer.close()
    data = out.getvalue()
    reader = pfor.Reader(io.BytesIO(data), len(data))
    whole = np.concatenate([ids for _, ids in docs])
    assert len(data) < 2.2 * len(whole)
    found = list(reader.documents(chunk=300))
    assert [(d, ids.tolist()) for d, _, ids in found] == [(d, ids.tolist()) for d, ids in docs]
    for a, b in ((0, 1), (255, 257), (1000, 60000), (len(whole) - 1, len(whole)), (4, 4)):
        assert reader.ids(a, b).tolist() == whole[a:b].tolist()
    with pytest.raises(ValueError):
        pfor.Reader(io.BytesIO(data[:-1]), len(data) - 1)
    with pytest.raises(ValueError):
        pfor.Reader(io.BytesIO(data[:9] + data[17:]), len(data) - 8)


def expect_ids(rows):
    at, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = truth(text, 0)
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files_whole_table(spark, sf, docs):
    rows = sorted(map(tuple, op5_token_ids(spark, sf).collect()))
    assert rows == expect_ids([(r.doc_id, r.text) for r in docs.collect()])


def test_token_files_odd_rows(spark, odd, clashing, empty):
    for table in (odd, clashing):
        rows = sorted(map(tuple, pfor.read_ids(pfor.write_ids(table)).collect()), key=lambda r: r[1])
        assert rows == expect_ids([(r[0], r[1]) for r in ODD])
    assert pfor.read_ids(pfor.write_ids(empty)).count() == 0
    kept = pfor.read_ids(pfor.write_ids(odd), keep_ids=True).where("doc_id = 5").collect()
    assert kept[0]["ids"] == truth("word", 0).tolist()
