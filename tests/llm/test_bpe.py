import hashlib
import random

import numpy as np
import pytest

from canopy.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

PATH = public.path("word_bpe_49k.json")
ALPHABET = [
    "a", "b", "th", "ing", "e", "'s", "'S", "'ll", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "\xa0", "é", "é", "ß", "İ", "Σ", "ΑΣ",
    "1", "23", "½", "²", "!", "!!", "'", "<|endoftext|>", "<|startoftext|>", "<|", "中", "한", "ᄒ", "ᅡ", "ᆫ", "😀", "‍", "́", "̧",
    "ǅ", "ﬁ", "\x00", "﻿", "᠎", "Ⅷ", "א", "क", "्",
]


@pytest.fixture(scope="module")
def spec():
    return bpe.read_spec(PATH)


@pytest.fixture(scope="module")
def library():
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


@pytest.mark.parametrize("window", [1 << 16, 7])
def test_equals_the_library_on_odd_texts(spec, library, window):
    encoder, rng = bpe.Encoder(spec, window), random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50)))
        assert ids(encoder, text) == library.encode(text, add_special_tokens=False).ids, text


def test_code_points_are_normalised_and_split_as_by_the_library(spec, library):
    """Inside a word, beside a digit, a sign, a capital, and between marks that move and join."""
    scan, byte = bpe.Encoder(spec)._scan, bpe.byte_alphabet()
    normalised, split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str

    def same(text):
        own = bpe.normal(text)
        words = ["".join(byte[b] for b in word.encode()) for word in scan.findall(own)]
        return own == normalised(text) and words == [piece for piece, _ in split(own)]

    # Without the inside of the large blocks of ideographs and syllables, and without planes that hold no characters.
    ranges = [(0, 0x3500), (0x9F00, 0xAD00), (0xD700, 0xD800), (0xF900, 0x17000), (0x18700, 0x20100), (0x2B700, 0x2B900), (0x32300, 0x33500)]
    points = [chr(c) for low, high in ranges for c in range(low, high) if not chr(c).isspace()]
    for at in range(0, len(points), 256):
        part = points[at : at + 256]
        if not same(" ".join(f"a{c}b1{c}1!{c}?{c}A a{c}\u0323 e\u0323{c}\u0301" for c in part)):
            assert not [hex(ord(c)) for c in part if not same(f"a{c}b1{c}1!{c}?{c}A a{c}\u0323 e\u0323{c}\u0301")]


@pytest.mark.parametrize("letters", [["a"], ["a", "b"], list("etaoin"), ["ha"], ["!", "?"], ["é", "a"], ["th", "e", "in"]])
def test_long_runs_stream_and_equal_the_library(spec, library, letters):
    encoder, rng = bpe.Encoder(spec), random.Random(5)
    for n in (600, 5_000, 90_000):
        text = "".join(rng.choice(letters) for _ in range(n))
        for t in (text, f"x {text}'s 12 {text[:100]}"):
            assert ids(encoder, t) == library.encode(t, add_special_tokens=False).ids


def small_spec(merges):
    alphabet = bpe.byte_alphabet()
    vocab = {c: i for i, c in enumerate(alphabet)} | {c + "</w>": 256 + i for i, c in enumerate(alphabet)}
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    model = {"vocab": vocab, "merges": [list(m) for m in merges], "end_of_word_suffix": "</w>"}
    return {"model": model, "added_tokens": []}


def test_lookahead_is_sufficient_for_random_merge_lists():
    """Whatever follows, a boundary with the lookahead behind it stays: streams equal whole words."""
    rng = random.Random(11)
    for _ in range(60):
        tokens, merges = ["a", "b", "c"], []
        for _ in range(rng.randint(1, 25)):
            pair = (rng.choice(tokens), rng.choice(tokens))
            if len(pair[0] + pair[1]) < 9 and pair[0] + pair[1] not in tokens:
                merges.append(pair)
                tokens.append(pair[0] + pair[1])
        made = bpe.Merges(small_spec(merges))
        assert made.lookahead is not None
        for _ in range(20):
            word = "".join(rng.choice("abc") for _ in range(2000)).encode()
            whole = [made.inner[b] for b in word]
            whole[-1] = made.final[word[-1]]
            stream, out = bpe.WordStream(made), []
            for at in range(0, len(word), 100):
                out += stream.feed(word[at : at + 100])
            assert out + stream.finish() == made.encode_symbols(whole)
            assert stream.most <= 2 * (made.lookahead + bpe.SHORT) + made.lookahead + 200


def test_a_list_whose_parts_come_later_claims_no_bound():
    assert bpe.Merges(small_spec([("ab", "c"), ("a", "b")])).lookahead is None


def test_digests_and_decoding(spark, spec, library, documents, odd_rows):
    got = sorted(bpe.digests(documents(odd_rows), spec, keep=("doc_id", "text")).collect(), key=str)
    assert len(got) == len(odd_rows)
    for r in got:
        found = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(found, skip_special_tokens=False)
        assert r.n_tokens == len(found)
        assert r.ids_sha256 == hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.digests(documents(odd_rows).limit(0), spec).count() == 0


def test_round_trip_to_text(spark, spec, documents):
    texts = ["hello brave new world", "größe 漢字 😀 naïve", "", None]
    tokens = bpe.tokenize(documents([(i, t, "en", "a") for i, t in enumerate(texts)]), spec)
    back = {r.doc_id: r.text for r in bpe.decode(tokens, spec).collect()}
    assert back == {0: "hello brave new world ", 1: "größe 漢字 😀 naïve ", 2: "", 3: ""}


def test_decoder_waits_for_whole_characters(spec):
    merges = bpe.Merges(spec)
    data = "aé漢😀".encode()
    packed = np.array([merges.inner[b] for b in data], "<u4").tobytes()
    machine = bpe.Decoder(merges, spaced=False)
    pieces = [machine.feed(packed[i : i + 4]) for i in range(0, len(packed), 4)]
    assert [p for p in pieces if p] == ["a", "é", "漢", "😀"] and machine.finish() == ""


def test_remembered_words_are_few_and_short_and_forgetting_changes_nothing(spec, library, monkeypatch):
    """In the pipeline, workers that remembered hundreds of thousands of words broke the limit of an executor's memory."""
    assert bpe.REMEMBERED <= 100_000
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    encoder, rng = bpe.Encoder(bpe.Merges(spec)), random.Random(2)
    for _ in range(300):
        words = [rng.choice(("the", "of", f"w{rng.randrange(400)}", "!" * 300 + "x")) for _ in range(20)]
        assert ids(encoder, " ".join(words)) == library.encode(" ".join(words), add_special_tokens=False).ids
        for known in (encoder._words, encoder._parts):
            assert len(known) <= 50 and len(known.older) <= 50 and all(len(w) <= bpe.SHORT for w in known)


def test_other_tokenizers_are_refused(spec):
    with pytest.raises(ValueError):
        bpe.check_spec(spec | {"decoder": {"type": "ByteLevel"}})
