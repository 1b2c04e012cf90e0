"""Sharding, packing, chat formatting: exact properties and edge cases."""

import random
import zlib
from collections import Counter

import pytest

from lexmill.llm import chat_format, packing, sharding


def test_table_is_fair_and_stable():
    shards = [f"s{k}" for k in range(7)]
    full, less = sharding.build_table(shards, size=10_007), sharding.build_table(shards[:-1], size=10_007)
    share = Counter(full)
    assert max(share.values()) - min(share.values()) <= 1
    moved = sum(a != b for a, b in zip(full, less, strict=True) if a != 6)
    assert moved < 0.2 * len(full)
    heavy = Counter(sharding.build_table(shards, [3, 1, 1, 1, 1, 1, 1], 10_007))
    assert 2.9 < heavy[0] / heavy[1] < 3.1


def test_table_by_turns():
    """The definition, told slowly: each turn takes the first free slot of the shard's own order."""
    shards, size = ["a", "b", "c"], 31
    orders = [[(sharding._hash(s, "start") + j * (sharding._hash(s, "stride") % (size - 1) + 1)) % size for j in range(size)] for s in shards]
    slots = [-1] * size
    turn = 0
    while -1 in slots:
        k = turn % 3
        slots[next(x for x in orders[k] if slots[x] < 0)] = k
        turn += 1
    assert list(sharding.build_table(shards, size=size)) == slots


@pytest.mark.parametrize("bad", [dict(shards=[]), dict(shards=["a", "a"]), dict(shards=["a"], size=10), dict(shards=["a"], weights=[0])])
def test_table_refuses(bad):
    with pytest.raises(ValueError):
        sharding.build_table(**bad)


def test_placement_frame(spark):
    df = spark.createDataFrame([(1, 9, "x"), (1, 9, "x"), (None, 9, "y"), (2, 9, None)], "doc_id bigint, slot int, text string")
    rows = sharding.place(df, "doc_id", sharding.SHARDS).collect()
    assert len(rows) == 4 and len({(r.doc_id, r.slot, r.shard_id) for r in rows}) == 3
    assert sharding.place(df.limit(0), "doc_id", sharding.SHARDS).count() == 0


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 5, 40, 3), packing.Limits(32, 1, 32, 2), packing.Limits(16, 3, 1, 1)])
def test_packer_keeps_every_token_and_limit(limits):
    rng = random.Random(5)
    for _ in range(60):
        packer, done = packing.Packer(limits), []
        items = [(k, rng.choice([0, 1, 2, 7, 30, 300, 5000]), rng.choice([0, 0, 3, 10**6])) for k in range(rng.randint(0, 40))]
        for k, n, start in items:
            done += packer.add(k, n, start)
        done += packer.finish()
        seen: dict = {}
        for pieces in done:
            size = sum(p.length for p in pieces)
            assert 0 < size <= limits.tokens and len(pieces) <= limits.segments and sum(p.loss for p in pieces) <= limits.loss
            assert size == limits.tokens or size & (size - 1) == 0
            for p in pieces:
                assert p.length > 0
                seen.setdefault(p.ref, []).append((p.start, p.length))
        for k, n, _ in items:
            at = 0
            for s, size in sorted(seen.get(k, [])):
                assert s == at
                at += size
            assert at == n


def test_word_tokenizer_is_exact():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary())
    whole.encode_special_tokens = True
    mine = packing.WordTokenizer(packing.vocabulary(), most_chunks=50, most_pieces=30)
    rng = random.Random(6)
    bits = ["Hello", "wörld", "it's", " ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "é", "é", "١٢", "42", "!!", "<|endoftext|>", "日本", "😀", "Σς", "́", "​", "''s", "İ", "Word", ",", "ÉTÉ", "!!", "###", "-", "_", "ªº", "ÿÿ", "´"]
    for _ in range(2000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert mine(text) == packing.ids_bytes(whole.encode(text, add_special_tokens=False).ids), repr(text)


def test_packing_frame(spark):
    rows = [(1, "some words " * 3000, 7), (2, "", 7), (3, None, 7), (3, None, 7), (None, "x", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, offset int").repartition(2)
    got = packing.pack_texts(df, packing.vocabulary()).collect()
    mine = packing.WordTokenizer(packing.vocabulary())
    ids = mine(rows[0][1]) + packing.ids_bytes([1])
    parts = sorted((r.start, r.ids, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == 1)
    assert b"".join(packing.ids_bytes(p[1]) for p in parts) == ids and {p[3] for p in parts} == {len(ids) // 4}
    assert all(zlib.crc32(packing.ids_bytes(p[1])) == p[2] for p in parts)
    assert [(r.length, r.ids) for r in got if r.doc_id in (2, 3)] == [(1, [1])] * 3
    by_sequence: dict = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
    assert packing.pack_texts(df.limit(0), packing.vocabulary()).count() == 0


TURNS = f"pair_id bigint, chosen array<{chat_format.TURN}>, rejected array<{chat_format.TURN}>, prompt string"


def test_pairs_share_their_beginning_once(spark):
    ask, good, bad = (0, "user", "q?"), (1, "assistant", "yes"), (5, "assistant", "noo")
    rows = [(1, [ask, good], [ask, bad], "p"), (2, [ask, good], [ask, good], "p"), (3, None, [ask], "p"), (4, [], [], None), (5, [good], [bad], "p"), (1, [ask, good], [ask, bad], "p")]
    got = chat_format.format_pairs(spark.createDataFrame(rows, TURNS)).orderBy("pair_id").collect()
    one = got[0]
    assert got[0] == got[1] and one.n_common == 1 and one.prompt == "<|turn|>user\nq?<|end|>\n"
    start, end = map(int, one.chosen_mask.split("-"))
    assert one.chosen_text[start:end] == "yes<|end|>" and one.informative
    assert [(r.pair_id, r.n_common, r.informative) for r in got[2:]] == [(2, 2, False), (3, 0, False), (4, 0, False), (5, 0, True)]


def test_conversations_in_order(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", "a", 0), (1, 0, "user", "a", 0), (1, None, "user", "z", 0), (None, 0, "user", "z", 0), (2, 0, None, None, 0)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, turns int")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat_format.conversations(df).collect()}
    assert got == {1: [("user", "a"), ("assistant", "b")], 2: [("", "")]}
    assert chat_format.conversations(df.limit(0)).count() == 0


def test_pairs_of_whole_conversations(spark, tmp_path):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "first"), (1, 2, "user", "r"), (1, 3, "assistant", "last"), (1, 4, "user", "bye"), (2, 0, "user", "alone"), (3, 0, "assistant", "a"), (3, 1, "user", "b"), (4, 0, "assistant", "x" * 300_000), (4, 1, "assistant", "y")]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.pair_id: r for r in chat_format.query(spark, str(tmp_path)).collect()}
    turn = lambda role, text: f"<|turn|>{role}\n{text}<|end|>\n"
    assert got[1].n_common == 3 and got[1].chosen_text == turn("assistant", "last") + turn("user", "bye") and got[1].rejected_text == turn("assistant", "first") and got[1].informative
    assert got[2].n_common == 1 and not got[2].informative and got[2].chosen_text == got[2].rejected_text == ""
    assert got[3].n_common == 1 and got[3].chosen_text == turn("user", "b") and got[3].rejected_text == "" and not got[3].informative
    assert got[4].n_common == 1 and got[4].rejected_text == turn("assistant", "x" * 300_000) and got[4].prompt == turn("assistant", "x" * 300_000)


def test_slots_of_keys_by_definition(spark):
    import hashlib

    shards, size = [f"s{k}" for k in range(5)], 101
    slots = sharding.build_table(shards, None, size)
    df = spark.createDataFrame([(k, 1) for k in range(200)] + [(None, 1)], "doc_id bigint, slot int")
    got = {(r.doc_id, r.slot, r.shard_id) for r in sharding.place(df, "doc_id", shards, size=size).collect()}
    at = lambda k: int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:15], 16) % size
    assert got == {(k, at(k), slots[at(k)]) for k in [*range(200), None]}


def test_dot_product_choice_against_brute_force():
    limits = packing.Limits(tokens=100, segments=4, loss=60, open_bins=6)
    checked = []

    class Watched(packing.Packer):
        def _put(self, b, piece, todo):
            fit = [x for x in self.bins if x[0] + piece.length <= 100 and x[1] + piece.loss <= 60 and len(x[2]) < 4]
            dot = lambda x: piece.length / 100 * (1 - x[0] / 100) + 1 / 4 * (1 - len(x[2]) / 4) + piece.loss / 60 * (1 - x[1] / 60)
            if len(fit) > 1 and any(x is b for x in fit):
                checked.append(dot(b) == pytest.approx(max(map(dot, fit))))
            return super()._put(b, piece, todo)

    rng, packer, done = random.Random(31), Watched(limits), []
    for ref in range(600):
        length = rng.randint(1, 40)
        done += packer.add(ref, length, rng.randint(0, length))
    done += packer.finish()
    assert len(checked) > 100 and all(checked)
    for pieces in done:
        assert sum(p.length for p in pieces) <= 100 and sum(p.loss for p in pieces) <= 60 and len(pieces) <= 4
