"""Packing and token alignment against plain encoders and brute force."""

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from needscope.llm import alignment, packing, tokens
from needscope.sources.scratch import settle
from tests.llm.test_operators import docs, folder, passage  # noqa: F401

WORD, BYTE, PIECE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    "plain words here", "  two  spaces ", "tab\tand\nline\r\n\r\nends  \n x", "a b  c \x85d", "\x1c\x1d control \x00", "é é ﬁ Å", "日本 語 🙂 🙂🙂",
    "<|endoftext|> <|startoftext|> <s></s><unk> <0x41>", "don't can't they're 'S", "  ", "\n", "a▁b", "x" * 300 + " " + "0" * 40, "ẞ İ ς Σ", " lead", "trail ",
]
TEXTS = st.text(st.sampled_from(list("ab .'\n\t\r  é▁🙂0A")), max_size=30)


@pytest.fixture(scope="module")
def plain():
    word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    byte.encode_special_tokens = True
    piece = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    return (
        lambda text: word.encode(text, add_special_tokens=False).ids,
        lambda text: byte.encode(" " + text, add_special_tokens=False).ids,
        lambda text: piece.encode(text),
    )


@pytest.fixture(scope="module")
def encoders():
    return tokens.word_bpe(WORD), tokens.byte_bpe(BYTE), tokens.piece_bpe(PIECE)


def test_parts_encode_like_whole_texts(plain, encoders):
    for whole, parts in zip(plain, encoders):
        for _ in range(2):  # the second time from memory
            assert [x.tolist() for x in parts.ids(ODD)] == [whole(x) for x in ODD]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_any_text_encodes_like_whole(plain, encoders, text):
    for whole, parts in zip(plain, encoders):
        assert parts.ids([text])[0].tolist() == whole(text)


def brute_best_fit(lengths, capacity):
    left = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, x in enumerate(left) if x >= length]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= length
        else:
            left.append(capacity - length)
    return len(left)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_plan_is_best_fit_decreasing(case):
    capacity, lengths = case
    histogram = Counter(lengths)
    plan = packing.plan_slots(histogram, capacity)
    slots = set()
    sequences = defaultdict(int)
    for length, n in histogram.items():
        mine = plan[plan[:, 0] == length]
        for rank in range(n):
            _, first, sequence, each, offset = mine[mine[:, 1] <= rank][-1]
            at = int(sequence + (rank - first) // each), int(offset + (rank - first) % each * length)
            assert at[1] + length <= capacity
            taken = {(at[0], at[1] + i) for i in range(length)}
            assert not taken & slots
            slots |= taken
            sequences[at[0]] += length
    assert all((sequence, i) in slots for sequence, n in sequences.items() for i in range(n))  # gapless
    assert len(sequences) == brute_best_fit(lengths, capacity)


def test_packing_round_trip(spark, plain):
    texts = [passage(i, int(n)) for i, n in enumerate(np.random.default_rng(4).integers(1, 400, 120))] + ODD
    texts += ["long words " * 4_000, "x" * 20_000, None, None, "", texts[0], texts[0]]
    ids = [*range(len(texts) - 2), 0, None]  # a repeated row and a null id
    frame = docs(spark, texts, ids=ids)
    cut = packing.pieces(frame, WORD)
    cut = cut.select("*", F.lit("clash").alias("offset"), F.monotonically_increasing_id().alias("row"))
    placed = packing.place(settle(cut, "cut"))
    rows = placed.collect()
    expected = Counter()
    for doc, text in zip(ids, texts):
        whole = [*plain[0](text or ""), 1]
        for piece, start in enumerate(range(0, len(whole), 4096)):
            expected[doc, piece, start, tuple(whole[start : start + 4096])] += 1
    decode = lambda x: tuple(np.frombuffer(x, "<u4").tolist())
    assert Counter((r["doc_id"], r["piece"], r["start"], decode(r["ids"])) for r in rows) == expected
    packed = {r["sequence_id"]: decode(r["ids"]) for r in packing.sequences(placed).collect()}
    for r in rows:
        assert r["length"] == len(decode(r["ids"])) and packed[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == decode(r["ids"])
    assert all(len(x) <= 4096 for x in packed.values()) and sum(map(len, packed.values())) == sum(r["length"] for r in rows)
    assert len(packed) == brute_best_fit([r["length"] for r in rows], 4096)
    assert packing.place(packing.pieces(frame.limit(0), WORD)).count() == 0


def test_ranks_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 50)
    rows = [(i % 300, i // 300, 3 if i % 3 else 1 + i % 7) for i in range(900)]
    cut = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    slots = [(r["sequence_id"], r["offset"] + i) for r in packing.place(cut, 10).collect() for i in range(r["length"])]
    assert len(slots) == len(set(slots)) == sum(n for _, _, n in rows) and max(at for _, at in slots) < 10
    assert len({s for s, _ in slots}) == brute_best_fit([n for _, _, n in rows], 10)


def brute_groups(a, b):
    """Groups of two lists of token bytes, as lists of places."""
    starts = [np.cumsum([0, *map(len, x)]) for x in (a, b)]
    cuts = sorted(set(starts[0].tolist()) & set(starts[1].tolist()))
    out = []
    for low, high in zip(cuts, cuts[1:]):
        out.append(tuple(list(range(bisect_left(s, low), bisect_left(s, high))) for s in starts))
    return out


def brute_alignment(texts, plain):
    tables = tokens.byte_bpe_bytes(BYTE), tokens.piece_bpe_bytes(PIECE)
    found, counts = [], Counter()
    for text in texts:
        a, b = (plain[1](text), plain[2](text)) if text else ([], [])
        cut = [[table[i] for i in ids] for table, ids in zip(tables, (a, b))]
        if any(b"".join(x) != (" " + text).encode() for x in cut if text):
            a, b, cut = [], [], [[], []]
        groups = [([a[i] for i in x], [b[i] for i in y]) for x, y in brute_groups(*cut)]
        links = [(x, y) for left, right in groups for x in left for y in right]
        counts.update(set(links))
        found.append((a, b, groups, links))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for a, b, groups, links in found:
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), told))
    return out


def test_pointer_jumping_equals_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(200):
        total = int(rng.integers(1, 40))
        cuts = [np.diff([0, *sorted(rng.choice(np.arange(1, total), rng.integers(0, total), replace=True).tolist() if total > 1 else []), total]) for _ in range(2)]
        a, b = (c[c > 0] for c in cuts)
        left, right = alignment.groups_of(a, b)
        expected = brute_groups([b"x" * n for n in a], [b"x" * n for n in b])
        assert [(np.flatnonzero(left == g).tolist(), np.flatnonzero(right == g).tolist()) for g in range(len(expected))] == expected
        assert list(zip(*alignment.links_of(left, right))) == [(x, y) for xs, ys in expected for x in xs for y in ys]


@pytest.mark.parametrize("links", [alignment.BLOCK_LINKS, 40])
def test_alignment_equals_brute_force(spark, plain, monkeypatch, links):
    monkeypatch.setattr(alignment, "BLOCK_LINKS", links)
    texts = [passage(i, int(n)) for i, n in enumerate(np.random.default_rng(6).integers(1, 60, 40))] + ODD
    texts += ["the same words again"] * 12 + [None, "", "🙂é" * 2_000, "word " * 5_000]
    ids = [*range(len(texts) - 2), 3, None]
    frame = docs(spark, texts, ids=ids).repartition(3)
    found = alignment.align_tokens(frame, BYTE, PIECE)
    told = sorted((tuple(r) for r in found.collect()), key=repr)
    assert told == sorted(((doc, *x) for doc, x in zip(ids, brute_alignment(texts, plain))), key=repr)
    digest = {"groups_sha256": F.sha2(F.col("groups").cast("binary"), 256)}
    hashed = alignment.align_tokens(frame, BYTE, PIECE, of_groups=digest)
    assert hashed.columns[-1] == "groups_sha256" and "groups" not in hashed.columns
    told = {(r["doc_id"], r["groups_sha256"]) for r in hashed.collect()}
    assert told == {(r["doc_id"], hashlib.sha256(r["groups"].encode()).hexdigest()) for r in found.collect()}
    assert alignment.align_tokens(frame.limit(0), BYTE, PIECE).count() == 0


def test_a_part_is_looked_up_once_where_it_stands():
    """New parts are found by the distinct parts of all texts, not by the places of each."""

    class Counted(dict):
        looked = 0

        def get(self, part, default=None):
            self.looked += 1
            return super().get(part, default)

        def __getitem__(self, part):
            self.looked += 1
            return super().__getitem__(part)

    encoder = tokens.PartEncoder(lambda parts: [[len(x)] for x in parts], lambda text: text.split(" "), np.ones(100, bool))
    encoder.known = Counted()
    found = encoder.ids(["a1 bb2 a1 ccc3", "", "bb2 a1"])
    assert [x.tolist() for x in found] == [[2, 3, 2, 4], [0], [3, 2]]
    assert encoder.known.looked == 7
