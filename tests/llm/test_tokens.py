"""Token counts and packing against the tokenizer library."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corvane.llm.packing import Layout, pack
from corvane.llm.token_counts import count_tokens
from tests.llm.test_rows import edge_docs

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["Hello  world, it's\n\n 12 ½ cats!", "a<|endoftext|> b <|endoftext|>", "<|endoftext|>", "<|endoftext", "日本語 テスト x  y \x85z", "   ", "aaaa" * 300, "we'll we’ll\t\tx ", "é" * 30_000, "w " * 20_000, "\x1c\x1dq\x1f w"]


def docs_of(spark):
    return edge_docs(spark, [(i, t, f"s{i % 3}") for i, t in enumerate(TEXTS)] + [(50, None, None), (50, None, None), (None, "x y z", "s0"), (52, "", "s9")])


def library(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_equal_the_library(spark):
    docs = docs_of(spark)
    rows = docs.collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(ids)) for r, ids in zip(rows, library([r.text for r in rows]), strict=True))
    got = count_tokens(docs, PATH).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


@pytest.mark.parametrize("weights", [None, lambda keys: [5.0, 1.0, 0.0, 2.0, 3.0][: len(keys)]])
def test_packing_round_trip(spark, weights):
    docs = docs_of(spark)
    rows = docs.collect()
    want = defaultdict(list)
    for r, ids in zip(rows, library([r.text for r in rows]), strict=True):
        want[r.doc_id].append([*ids, 1])
    got = pack(docs, PATH, weights, epoch_windows=4, with_ids=True).toPandas()
    pieces = defaultdict(list)
    for r in got.itertuples(index=False):
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        pieces[None if r.doc_id != r.doc_id else int(r.doc_id)].append((r.start, ids.tolist()))
    assert pieces.pop(50) == [(0, [1]), (0, [1])] and want.pop(50) == [[1], [1]]
    assert {k: [x for _, p in sorted(v) for x in p] for k, v in pieces.items()} == {k: v[0] for k, v in want.items()}
    check_sequences(got)


def check_sequences(got, window=2048):
    last = got.sequence_id.max()
    for sequence, own in got.sort_values("offset").groupby("sequence_id"):
        assert (own.offset == own.length.cumsum() - own.length).all()
        assert own.length.sum() == window or sequence == last
    assert sorted(set(got.sequence_id)) == list(range(last + 1))


def test_empty_pack(spark):
    assert pack(edge_docs(spark, []), PATH).count() == 0
    assert count_tokens(edge_docs(spark, []), PATH).count() == 0


def test_layout_holds_the_proportions_and_carries_deficits():
    totals = [700_000, 200_000, 90_000, 10_000, 7]
    layout = Layout(totals)
    served = [0] * 5
    windows = defaultdict(int)
    for e in range(-(-sum(totals) // (2048 * 64))):
        for s, own in enumerate(layout.epoch(e)):
            for at, n, window, _ in own:
                assert at == served[s]
                served[s] += n
                windows[window, s] += n
        for s, t in enumerate(totals):
            assert abs(served[s] - min(sum(totals), (e + 1) * 2048 * 64) * t / sum(totals)) <= len(totals)
    assert served == totals
    for s in range(3):  # over any eight windows a source is within a few pieces of its share
        for w in range(0, 480, 8):
            assert abs(sum(windows[w + i, s] for i in range(8)) - 8 * 2048 * totals[s] / sum(totals)) <= 1024


def test_layout_with_weights_goes_on_when_a_queue_ends():
    layout = Layout([5000, 100_000], [1.0, 1.0], epoch_windows=2)
    assert layout.upto(8192) == [4096, 4096] and layout.upto(105_000) == [5000, 100_000]
    assert Layout([], None).pieces is not None and Layout([0, 0]).upto(10) == [0, 0]
