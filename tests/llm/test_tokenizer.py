import hashlib
import random

import pytest

from gradeline.llm import sentencepiece_bpe as P

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.default_model_path())


@pytest.fixture(scope="module")
def model():
    with open(P.default_model_path(), "rb") as f:
        return P.model(f.read())


def texts():
    r = random.Random(4)
    parts = ["a", "e", "th", "the", " ", "  ", "\n", "é", "日", "😀", "▁", "1", "!", "$$", "ing", "\t", "ß", "İ", "\x00", "�", "<s>", "</s>", "<0x41>", "ab"]
    out = ["", " ", "a", "  a  b\n\tc ", "=" * 300, "a" * 4000, "x  \n\n  y   ", "1234567", " q", "日本語" * 50]
    return out + ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)]


def test_encode_and_decode_match_the_library(model, library):
    t = texts()
    got = model.encode(t)
    assert got == library.encode(t, num_threads=1)
    assert [model.decode(x) for x in got] == [library.decode(x) for x in got]


def test_decode_of_any_ids(model, library):
    r = random.Random(5)
    for _ in range(400):
        ids = [r.choice([r.randrange(3, 259), r.randrange(259, 32_000)]) for _ in range(r.randint(1, 12))]
        assert model.decode(ids) == library.decode(ids)


def test_long_runs_of_one_sign(model, library):
    for c in "=a-中":
        assert model.encode([c * 1_000_000])[0] == library.encode(c * 1_000_000)


def test_few_letters_in_one_segment(model, library):
    r = random.Random(6)
    for letters in ("ab", "=-", "aaab", "abcdefghij", "中文字日本", "人在不的一是了我", "éèaeiou", "ab c"):
        for size in (5, 50, 700, 5000):
            t = ["".join(r.choice(letters) for _ in range(size)) for _ in range(12)]
            assert model.encode(t) == library.encode(t, num_threads=1)


def test_rows(make_docs, empty_docs, library):
    rows = [*enumerate(texts()[:200]), (None, None), (3, None), (3, "long " * 30_000), (3, "a")]
    got = P.encode_decode(make_docs(rows), with_ids=True).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted([(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got], key=repr) == sorted(want, key=repr)
    assert P.encode_decode(empty_docs).count() == 0
