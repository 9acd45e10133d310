import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirelake.llm import bpe, packing, splitting
from quirelake.llm.segments import Segments, without_markup
from quirelake.llm.textkernel import Block, HashIndex, blocks

RANKS = f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.parse_ranks(bpe.read_ranks(RANKS)))


@pytest.fixture(scope="module")
def public(encoder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def encoded(encoder, texts):
    out = []
    for block in blocks(texts, 200):
        offsets, ids = encoder.encode(block)
        out += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab'stremvlld  \n\t\r.,’éß中०９½　\x1c\x85‍😀#1\xa0", max_size=40), max_size=5))
def test_encoding_is_that_of_the_public_tokenizer(encoder, public, texts):
    assert encoded(encoder, texts) == [public.encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoding_of_any_text(encoder, public, text):
    assert encoded(encoder, [text]) == [public.encode_ordinary(text)]


def test_encoding_edges(encoder, public):
    texts = [None, "", "<|endoftext|>", "x" * 20000, "0" * 3000, " " * 5000, "don't 'll'", "'s"]
    assert encoded(encoder, texts) == [public.encode_ordinary(t) if t else [] for t in texts]
    assert [int(n) for b in blocks(texts, 100) for n in encoder.count(b)] == [len(public.encode_ordinary(t)) if t else 0 for t in texts]


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_collide_modulo_powers_of_two_keep_their_ids(public, n):
    bits = [bin(i).count("1") & 1 for i in range(n)]
    texts = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    block = Block(texts)
    assert len(set(block.hashes(block.bounds[:-1], block.bounds[1:]).tolist())) == 2
    fresh = bpe.Encoder(bpe.parse_ranks(bpe.read_ranks(RANKS)))
    assert encoded(fresh, [" ".join(texts)]) == [public.encode_ordinary(" ".join(texts))]


@pytest.mark.parametrize("texts", [["one two three", "four five six one"], ["abc abd abe", "abd abc xyz abe"]])
def test_no_id_rests_on_a_hash(public, texts, monkeypatch):
    monkeypatch.setattr(Block, "hashes", lambda self, starts, ends, cps=None: (ends - starts).astype("uint64"))
    fresh = bpe.Encoder(bpe.parse_ranks(bpe.read_ranks(RANKS)))
    for _ in range(2):
        assert encoded(fresh, texts) == [public.encode_ordinary(t) for t in texts]
    assert [int(c) for b in blocks(texts) for c in fresh.count(b)] == [len(public.encode_ordinary(t)) for t in texts]


def test_encode_column(spark, public):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z")], "doc_id bigint, text string, ids string")
    assert sorted((r.doc_id, r.ids) for r in bpe.encode_column(df, "doc_id", "text", RANKS).collect()) == [(1, public.encode_ordinary("a b")), (2, []), (3, []), (3, [])]
    assert bpe.encode_column(df.limit(0), "doc_id", "text", RANKS).count() == 0
    assert {r.doc_id: r.n_tokens for r in bpe.count_column(df, "doc_id", "text", RANKS).collect()} == {1: 2, 2: 0, 3: 0}


def test_hash_index():
    index, block = HashIndex(4), Block(["abcabc"])
    import numpy as np

    hashes = block.hashes(np.array([0, 3, 1]), np.array([3, 6, 3]))
    assert hashes[0] == hashes[1] != hashes[2]
    index.add(np.unique(hashes))
    assert (index.find(hashes) >= 0).all() and index.find(np.array([5], np.uint64))[0] == -1


# -- splitting


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n#\r\t", max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_pieces_tile_the_text(text, limit, overlap):
    pieces = splitting.cut(text, limit, overlap)
    assert all(e - b <= limit for b, e, _ in pieces)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b == e - overlap for (_, e, _), (b, _, _) in zip(pieces, pieces[1:]))
    assert text[: pieces[0][1]] + "".join(text[b + overlap : e] for b, e, _ in pieces[1:]) == text


def test_cuts_are_as_high_as_they_can_be():
    text = "# A\n" + "one two. " * 15 + "\n\n" + "# B\n" + "three four. " * 15
    pieces = splitting.cut(text, 200, 20)
    assert splitting.LEVELS[pieces[0][2]] in ("section", "paragraph", "sentence") and splitting.cut("x" * 50, 20, 5)[0] == (0, 15, 4)


def test_split_oversized(spark):
    schema = "chunk_id bigint, content string, lines struct<start_line:int,end_line:int>, piece string"
    rows = [(1, "a. " * 20 + "\r\n" + "b " * 20, (10, 11), "x"), (2, "short", (1, 1), "x"), (3, None, None, "x"), (4, "y" * 100, None, "x"), (5, "", None, "x"), (4, "y" * 100, None, "x")]
    out = splitting.split_oversized(spark.createDataFrame(rows, schema), 50, 10).collect()
    assert {(r.chunk_id, r.cut_kind) for r in out} == {(1, "natural"), (4, "forced")}
    first = sorted((r for r in out if r.chunk_id == 1), key=lambda r: r.piece_no)
    assert first[0].start_line == 10 and first[-1].end_line == 11 and all(len(r.piece) <= 50 for r in out)
    assert all(r.start_line is None for r in out if r.chunk_id == 4) and len([r for r in out if r.chunk_id == 4 and r.piece_no == 1]) == 2
    assert splitting.split_oversized(spark.createDataFrame([], schema), 50, 10).count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(spark.createDataFrame([], schema), 50, 50)


# -- packing


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 40), max_size=12))
def test_histogram_packing_is_valid_and_tight(counts):
    capacity = 30
    steps, opened = packing.pack_histogram(counts, capacity)
    load, ranks = [0] * opened, {}
    for size, rank, items, container, each in steps:
        for k in range(items):
            load[container + k // each] += size
            ranks.setdefault(size, set()).add(rank + k)
    assert all(n <= capacity for n in load) and all(load)
    assert {s: len(r) for s, r in ranks.items()} == {s: n for s, n in counts.items() if n}
    assert all(r == set(range(len(r))) for r in ranks.values())
    total = sum(s * n for s, n in counts.items())
    # no two containers that are at most half full can be left
    assert sum(2 * n <= capacity for n in load) <= 1 and opened <= 2 * total / capacity + 1


def test_pack(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 0, 300, 700, 701, 1500, 2048, 5000, rng.randrange(1, 2049)]), "x") for i in range(600)] + [(9000, None, "x"), (9001, 4096, "x"), (9001, 4096, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, n bigint, container_id string")
    out = packing.pack(df, "doc_id", "n", 2048, ranked=200).collect()
    load, tokens = {}, {}
    for r in out:
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
    assert max(load.values()) <= 2048
    expected = {}
    for i, n, _ in rows:
        expected[i] = expected.get(i, 0) + (n or 0)
    assert tokens == expected
    pieces = {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
    assert all(len(pieces[i]) == 1 for i, n, _ in rows if (n or 0) <= 2048 and i < 9000)
    full = sum(load.values()) / (2048 * len([v for v in load.values() if v]))
    assert full > 0.9
    assert packing.pack(df.limit(0), "doc_id", "n", 2048).count() == 0
    only_empty = packing.pack(df.where("n = 0"), "doc_id", "n", 2048).collect()
    assert {r.container_id for r in only_empty} == {1}
    report = packing.fill_report(packing.pack(df, "doc_id", "n", 2048), 2048).first()
    assert report.fullest <= 2048 and 0.9 < report.fill <= 1


# -- segments


def plain_sentences(text):
    import re

    return [s for s in re.split(r"(?<=\n)|(?<=[.!?])(?=\s)", text) if s.strip()]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab. !?\n\r\t", max_size=40), max_size=4))
def test_sentences_are_those_of_the_rule(texts):
    block = Block(texts)
    seg = Segments(block)
    got = [[block.joined[seg.begins[i] : seg.ends[i]].strip() for i in range(seg.first[k], seg.first[k + 1])] for k in range(len(texts))]
    assert got == [[s.strip() for s in plain_sentences(t)] for t in texts]


def test_paragraph_numbers():
    seg = Segments(Block(["\n\na\nb\n \t\nc. d", "e"]))
    assert seg.paragraph_number[seg.paragraph].tolist() == [1, 1, 2, 2, 1]


def test_markup_is_blanked_out_at_equal_length():
    text = "---\na: b\n---\nWord $x$ `c`\n```\ncode here\n```\n\\ref{r} <tag> @eq\n\nx = 1\n# comment\nEnd"
    bare = without_markup(text)
    assert len(bare) == len(text) and bare.split() == ["Word", "End"] and bare.count("\n") == text.count("\n")
    assert F is not None
