"""Token files, unigram counts and packing: round trips and brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_frames import EMPTY, ROWS, frame


from corpusloom.llm import packing, simple8b, unigram_counts
from corpusloom.llm.token_ids import default_path, encoder


def plain_ids(text):
    return [*encoder(default_path()).tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=3000))
@settings(max_examples=60, deadline=None)
def test_pack_round_trip(values):
    ids = np.array(values, np.uint64)
    words, offsets, n_raw = simple8b.pack(ids)
    assert (simple8b.unpack(words, offsets, n_raw, len(ids)) == ids).all()
    assert offsets[-1] == len(words)


def test_escapes_take_a_raw_word():
    ids = np.array([1, 2**60 - 1, 2**60, 2**64 - 1, 5], np.uint64)
    words, offsets, n_raw = simple8b.pack(ids)
    assert n_raw.tolist() == [2]
    assert (simple8b.unpack(words, offsets, n_raw, 5) == ids).all()


def test_small_ids_share_a_word():
    assert len(simple8b.pack(np.ones(60, np.uint64))[0]) == 1


@given(st.text(alphabet=st.sampled_from("ab 1,'sé\n\t  \x1c\x85 !日"), max_size=30))
@settings(max_examples=300, deadline=None)
def test_encoder_agrees_with_the_tokenizer(text):
    assert encoder(default_path()).ids(text).tolist() == plain_ids(text)


@pytest.mark.parametrize("text", ["", " ", "  ", "a  b", " a", "a ", "a\n b", "<|endoftext|> a", "x<|endoftext|>", "don't 'll", "　 x"])
def test_encoder_on_edges(text):
    assert encoder(default_path()).ids(text).tolist() == plain_ids(text)


@given(st.lists(st.one_of(st.text(max_size=25), st.text(alphabet=st.sampled_from("abé1,'._-s\n\t  \x1c\u2003 !日ªʰ़٣Ġ"), max_size=40)), max_size=8))
@settings(max_examples=400, deadline=None)
def test_batches_agree_with_the_tokenizer(texts):
    ids, sizes = encoder(default_path()).batch(pa.array(texts, pa.string()))
    assert ids.tolist() == [i for text in texts for i in plain_ids(text)]
    assert sizes.tolist() == [len(plain_ids(text)) for text in texts]


def test_batches_on_edges_and_long_words():
    texts = ["", " ", "a  b", "<|endoftext|> a", "x " * 500, "y" * 100_000, "z" * 30_000 + " z", "word, word. word!? (word)", "Ġ Ġa", "'s 's don't", "a\nb c\n d"]
    ids, sizes = encoder(default_path()).batch(pa.array(texts))
    assert ids.tolist() == [i for text in texts for i in plain_ids(text)]
    assert sizes.sum() == len(ids)
    assert encoder(default_path()).batch(pa.array([], pa.string()))[0].tolist() == []


def test_pre_tokens_are_encoded_many_in_a_call(monkeypatch):
    """Also those behind a line end, which were called one by one."""
    coder, calls = encoder(default_path()), []
    model = coder.model

    class Counted:
        def tokenize(self, text):
            calls.append(text)
            return model.tokenize(text)

    monkeypatch.setattr(coder, "model", Counted())
    texts = ["".join(f"qz{chr(97 + i // 26)}{chr(97 + i % 26)}{k}.\nWx{k}vé{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)) for k in "kjy"]
    ids, _ = coder.batch(pa.array(texts))
    assert ids.tolist() == [i for text in texts for i in plain_ids(text)]
    assert len(calls) < 100


def test_words_are_forgotten_when_they_are_too_many(monkeypatch):
    from corpusloom.llm import token_ids

    monkeypatch.setattr(token_ids, "WORDS", 50)
    coder = token_ids.Encoder(default_path())
    for k in range(6):
        texts = [" ".join(f"often{i % 5} w{k}x{i}" for i in range(40)), "", " a\n\n b"]
        ids, sizes = coder.batch(pa.array(texts))
        assert ids.tolist() == [i for text in texts for i in plain_ids(text)]
        assert len(coder.kept) == len(coder.sizes) == len(coder.uses) <= 50


def test_pieces_leave_a_task_in_small_batches():
    ids = np.arange(100_000, dtype="<u4").tobytes()
    pieces = [[{"start": 0, "length": 60_000, "sequence_id": 0, "offset": 0}, {"start": 60_000, "length": 40_000, "sequence_id": 1, "offset": 0}]] * 60
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "sequence_id", "offset")]))
    whole = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array([100_000] * 60), pa.array([ids] * 60), pa.array(pieces, kind)], ["doc_id", "n_tokens", "ids", "pieces"])
    found = list(packing._cut(iter([whole])))
    assert max(part.nbytes for part in found) < 11_000_000
    rows = [row for part in found for row in part.to_pylist()]
    assert [(r["doc_id"], r["start"]) for r in rows] == [(i, start) for i in range(60) for start in (0, 60_000)]
    assert all(r["ids"] == ids[4 * r["start"] : 4 * (r["start"] + r["length"])] for r in rows)


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers

    other = encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Ein Wort, noch eins", "", "  x"]
    want = [[*other.tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert other.batch(pa.array(texts))[0].tolist() == [i for ids in want for i in ids]


def test_token_files(spark):
    got = [tuple(r) for r in simple8b.round_trip(frame(spark)).orderBy("start").collect()]
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for doc_id, text, *_ in rows:
        ids = np.array(plain_ids(text), "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_token_files_of_nothing(spark):
    assert simple8b.round_trip(frame(spark, EMPTY)).count() == 0


def test_pieces_cover_every_document(spark):
    pieces = packing.pack(frame(spark), window=64, sequence=16).collect()
    assert sum(p["length"] for p in pieces) == sum(len(plain_ids(r[1])) for r in ROWS)
    by_sequence = {}
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] > 0
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for number, parts in by_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 16 or number == max(by_sequence)
    texts = {}
    for r in ROWS:
        texts.setdefault(r[0], []).append(plain_ids(r[1]))
    for doc_id, lists in texts.items():
        if len(lists) == 1:
            mine = sorted((p["start"], np.frombuffer(p["ids"], "<u4").tolist()) for p in pieces if p["doc_id"] == doc_id)
            assert [i for _, part in mine for i in part] == lists[0]


def test_packing_of_nothing(spark):
    assert packing.pack(frame(spark, EMPTY)).count() == 0


def test_windows_keep_the_proportions(spark):
    # A third queue with six times the tokens of the others, and documents of very different lengths.
    pick = random.Random(3)
    queue = [(i, i, "abc"[i % 3], pick.choice([1, 40, 700]) * (6 if i % 3 == 2 else 1)) for i in range(900)]
    rows = spark.createDataFrame(queue, "row long, doc_id long, source string, n_tokens long")
    source = {row: s for row, _, s, _ in queue}
    share = {s: sum(n for _, _, x, n in queue if x == s) / sum(n for *_, n in queue) for s in "abc"}
    window = 16 * 128
    held = {}
    total = 0
    for p in packing.served(rows, window=window, sequence=128).collect():
        key = (p["sequence_id"] * 128 + p["offset"]) // window, source[p["row"]]
        held[key] = held.get(key, 0) + p["length"]
        total += p["length"]
    for w in range(total // window - 1):
        for s in "abc":
            served = sum(held.get((v, s), 0) for v in range(w + 1))
            assert abs(served - share[s] * window * (w + 1)) <= 6 * 128


def test_targets_change_the_order_not_the_content(spark):
    rows = spark.createDataFrame([(i, i, "ab"[i % 2], 50) for i in range(200)], "row long, doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.9), ("b", 0.1)], "source string, share double")
    got = packing.served(rows, targets, window=1000, sequence=100).collect()
    assert sum(p["length"] for p in got) == 200 * 50
    early = [p["row"] % 2 for p in got if p["sequence_id"] < 20]
    assert early.count(0) > 6 * early.count(1)


def best_tokens(scores, word):
    best = [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            if word[start:end] in scores:
                found = best[start][0] + scores[word[start:end]], best[start][1] + 1
                if best[end] is None or found[0] > best[end][0] or found[0] == best[end][0] and found[1] < best[end][1]:
                    best[end] = found
    return best[-1][1]


def test_unigram_counts(spark):
    counter = unigram_counts.Counter(unigram_counts.default_path())
    got = unigram_counts.count_tokens(frame(spark)).collect()
    want = []
    for doc_id, text, *_ in ROWS:
        words = counter.pattern.findall(text or "")
        want.append((doc_id, len(words), sum(best_tokens(counter.trie.scores, w.encode()) for w in words)))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert unigram_counts.count_tokens(frame(spark, EMPTY)).count() == 0


def test_shared_prefixes_are_scored_once():
    trie = unigram_counts.Trie({b"a": -1.0, b"b": -1.0, b"ab": -1.5, b"c": -3.0})
    assert [trie.insert(w) for w in (b"abc", b"abb", b"ab", b"")] == [2, 2, 1, 0]
    assert len(trie.best) == 1 + 4  # root, a, ab, abc, abb
