import numpy as np

from gradeline.llm.textops import SpanHash, word_spans


def colliding_words(size=2048):
    """Two words that a polynomial hash modulo a power of two with an odd base can't tell apart."""
    a, b = b"a", b"b"
    while len(a) < size:
        a, b = a + b, b + a
    return a.decode(), b.decode()


def test_patterns_do_not_collide():
    for size in (16, 256, 512, 1024, 2048, 8192):
        one, two = colliding_words(size)
        data = np.frombuffer((one + two).encode(), np.uint8)
        for seed in range(40, 62):
            h = SpanHash(seed).words(data, np.array([0, size]), np.array([size, 2 * size]))
            assert h[0] != h[1]


def test_equal_spans_have_equal_hashes_wherever_they_stand():
    words = ["a", "b", "abcdefg", "abcdefgh", "abcdefghi", "abcdefgh" * 2, "x" * 511, "x" * 512, "x" * 513, "x" * 2000, "", "é", "abcdefg\x00"]
    h, seen = SpanHash(7), {}
    for lead in range(9):
        data = np.frombuffer((" " * lead + "".join(words)).encode(), np.uint8)
        sizes = [len(w.encode()) for w in words]
        ends = lead + np.cumsum(sizes)
        for w, x in zip(words, h.words(data, ends - sizes, ends).tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(words)


def test_runs_match_a_plain_loop_over_pairs_of_positions():
    r = np.random.default_rng(1)
    values = r.integers(0, 3, 400).astype(np.uint64)
    h = SpanHash(9)
    for size in (1, 2, 3, 4, 5, 7, 13):
        at = np.arange(len(values) - size + 1)
        got = h.runs(values, at, size)
        want = {}
        for i, x in zip(at, got.tolist(), strict=True):
            assert want.setdefault(tuple(values[i : i + size].tolist()), x) == x
        assert len(set(want.values())) == len(want)
    assert len(h.runs(values, np.zeros(0, np.int64), 5)) == 0


def test_word_spans_stop_at_rows():
    data = np.frombuffer(b"ab cde  f", np.uint8)
    starts, ends, first = word_spans(data, np.array([0, 4, 6, 6, 9]))
    assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [b"ab", b"c", b"de", b"f"] and first.tolist() == [0, 2, 3, 3, 4]
