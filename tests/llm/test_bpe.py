"""The backtracking encoder against merges replayed one by one and against the tokenizers library."""

import json
import random
from hashlib import sha256

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemill.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return Tokenizer.from_file(PATH), bpe.Encoder(bpe.Vocabulary(bpe.load(PATH)))


def same(both, text):
    want, got = both[0].encode(text, add_special_tokens=False).ids, both[1].encode(text)
    return want == got.tolist() and both[0].decode(want, skip_special_tokens=False) == both[1].v.texts.join(got).decode()


def test_every_character(both):
    """Also those that Python's Unicode tables do not know yet."""
    assert all(same(both, f"a{chr(c)}b{chr(c)}") for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0 or 0x1E000 <= c < 0x1F000))


def test_random_texts(both):
    rng = random.Random(7)
    pools = ["abcdefghijklmnopqrstuvwxyz", "ab", "thein ", "'s't're'll 've<|endoftext|>", "éèÀÅÅ̊ ΑΣσς İ", "!?.,-_=~", "0123456789", "\x1c\x1f\x85 　 \n"]
    for _ in range(4000):
        pool = rng.choice(pools) + rng.choice(pools)
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(50)))
        assert same(both, text + rng.choice(["", "<|endoftext|>", "<|startoftext|><|x", "</w>"]) + text), text


def test_every_token_and_long_words(both):
    assert all(same(both, t) for t in both[0].get_vocab())
    for text in ("a" * 30_001, "ab" * 20_000, "!" * 5_000 + "?" * 4_001, "theing" * 9_000, "", " \n "):
        assert same(both, text)


def replay(word, merges):
    """The lowest merge, leftmost of equal ones, until there is none."""
    parts = list(word)
    while True:
        ranked = [(merges.get((a, b), 1e9), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
        rank, i = min(ranked, default=(1e9, 0))
        if rank == 1e9:
            return parts
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(6))
def test_small_vocabularies(seed):
    """Random vocabularies whose tokens overlap, some of which nothing is encoded as, over all words of up to eight letters of two."""
    rng = random.Random(seed)
    strings = {c: b for c, b in bpe.symbols().items()}
    vocab = {c: i for i, c in enumerate(sorted(strings))} | {c + "</w>": 256 + i for i, c in enumerate(sorted(strings))}
    merges, tokens = [], ["a", "b"]
    while len(merges) < 14:
        made = (rng.choice(tokens), rng.choice([*tokens, "a</w>", "b</w>"] if rng.random() < 0.4 else tokens))
        if made[0].endswith("</w>") or "".join(made) in vocab:
            continue
        merges.append(list(made))
        vocab["".join(made)] = len(vocab)
        if not made[1].endswith("</w>"):
            tokens.append("".join(made))
    file = {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace"}, {"type": "Lowercase"}]}, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "[\\p{L}]+"}}, {"type": "ByteLevel"}]}, "decoder": None, "added_tokens": [], "model": {"type": "BPE", "end_of_word_suffix": "</w>", "vocab": vocab, "merges": merges}}
    encoder = bpe.Encoder(bpe.Vocabulary(json.dumps(file)))
    ranks = {tuple(m): i for i, m in enumerate(merges)}
    for n in range(1, 9):
        for bits in range(1 << n):
            word = "".join("ab"[bits >> i & 1] for i in range(n))
            want = [vocab[p] for p in replay([*word[:-1], word[-1] + "</w>"], ranks)]
            assert encoder.encode(word).tolist() == want, (word, merges)


def test_frames(spark, both):
    rows = [(1, "The tide mill, 1800 — ÉTÉ!"), (2, None), (3, ""), (1, "The tide mill, 1800 — ÉTÉ!"), (None, "x<|endoftext|>y"), (4, "wave " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "9 as n_tokens", "'x' as decoded_sha256").repartition(2)

    def want(text):
        ids = both[0].encode(text or "", add_special_tokens=False).ids
        return ids, both[0].decode(ids, skip_special_tokens=False)

    expected = sorted((str(i), len(want(t)[0]), sha256(" ".join(map(str, want(t)[0])).encode()).hexdigest(), sha256(want(t)[1].encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r[0]), *r[1:]) for r in bpe.digests(df, PATH).collect()) == expected
    encoded = bpe.encode(df, PATH, keep=("doc_id", "n_tokens"))
    got = bpe.decode(encoded, PATH).collect()
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in got) == sorted((str(i), *want(t)) for i, t in rows) and got[0]["n_tokens"] == 9
    empty = df.limit(0)
    assert bpe.digests(empty, PATH).count() == 0 and bpe.decode(bpe.encode(empty, PATH), PATH).count() == 0
    odd = spark.createDataFrame([(None,), ([320, None, -1, 10**6],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(odd, PATH).orderBy("decoded").collect()] == [None, both[1].v.texts.join(both[1].encode("a")).decode()]


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="word ends"):
        bpe.Vocabulary(bpe.load(public_tokenizers.path("byte_bpe_50k.json")))


def test_forgetting(both, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    few = bpe.Encoder(both[1].v)
    text = " ".join(f"w{i}" for i in range(50)) + "long" * 40
    assert few.encode(text).tolist() == both[1].encode(text).tolist() == few.encode(text).tolist()


def test_each_word_is_encoded_once(both, monkeypatch):
    """Whatever stands beside it, in capitals or not; text by text."""
    met = []
    encode_word = bpe.Vocabulary.encode_word
    monkeypatch.setattr(bpe.Vocabulary, "encode_word", lambda v, word: met.append(word) or encode_word(v, word))
    few = bpe.Encoder(both[1].v)
    for text in ("tide, (tide) Tide! TIDE; mill", "mill. \x1cmill tide?", ""):
        assert few.encode(text).tolist() == both[0].encode(text, add_special_tokens=False).ids
    assert len(met) == len(set(met)) and met.count("tide") == met.count("mill") == 1


@pytest.mark.parametrize("stretch", [1, 3, 1000])
def test_stretches(both, monkeypatch, stretch):
    monkeypatch.setattr(bpe, "STRETCH", stretch)
    assert all(same((both[0], bpe.Encoder(both[1].v)), t) for t in ("ΑΣ ΑΣ. \u0301a \u3000\u3099か\u3099 <|endoftext|>x y", "a\u2000\u0301 A\u030a \U0001c89b\x85 don't  stop\n\n'LL", "e" * 50 + " \u0308u\u0308 ", " ", ""))
