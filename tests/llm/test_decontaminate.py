import random

from gradeline.llm import decontaminate as D


def distance_within(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    r = random.Random(1)
    for _ in range(300):
        p = "".join(r.choice("abé") for _ in range(r.randint(1, 70)))
        t = "".join(r.choice("abé") for _ in range(r.randint(0, 100)))
        assert D.Myers(p).best(t)[0] == distance_within(p, t)


def fixture():
    r = random.Random(2)
    word = lambda: "".join(r.choice(["an", "er", "Ti", "lo", "é"]) for _ in range(r.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(r.randint(8, 30)))) for i in range(12)] + [(50, None), (51, "short one"), (52, ""), (53, "TI"), (54, "an er lo")]
    items.append((60, items[0][1]))
    docs = []
    for k in range(60):
        body = [word() for _ in range(30)]
        if k % 2:
            leak = list(items[k % 12][1])
            for _ in range(r.randint(0, 14)):
                at = r.randrange(len(leak))
                leak[at : at + 1] = r.choice([[], [r.choice("xyz")], [leak[at], "q"]])
            body.insert(r.randrange(len(body)), "".join(leak).replace(" ", r.choice([" ", "\n", "  "])))
        docs.append((k, " ".join(body)))
    docs += [(200, "a SHORT\tone"), (201, "a short ones"), (202, "lo an er lo"), (203, "short one")]
    return items, [*docs, (None, None), (100, ""), (101, "w " * 50_000 + items[3][1]), (101, items[4][1])]


def test_against_brute_force(spark, make_docs, empty_docs):
    items, docs = fixture()
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    want = []
    for d, t in docs:
        text = D.canonical(t).decode()
        for i, item in items:
            p = D.canonical(item).decode()
            if len(p) < D.SHORT:
                if p and f" {p} " in f" {text} ":
                    want.append((d, i, 0))
                continue
            k = int(len(p) * D.ERROR_SHARE)
            best = 0 if p in text else distance_within(p, text) if len(text) < 5000 else len(p)
            if best <= k:
                want.append((d, i, best))
    got = sorted([(r["doc_id"], r["item_id"], r["distance"]) for r in D.find_leaks(make_docs(docs), benchmark).collect()], key=repr)
    assert got == sorted(want, key=repr) and any(x[2] > 0 for x in got)
    kept = D.drop_leaks(make_docs(docs), benchmark)
    leaking = [(d, t) for d, t in docs if any(x[0] == d for x in want)]
    assert kept.columns == make_docs(docs[:1]).columns and kept.count() == len(docs) - len(leaking)
    assert D.find_leaks(empty_docs, benchmark).count() == 0
    assert D.find_leaks(make_docs(docs), benchmark.limit(0)).count() == 0 and D.drop_leaks(make_docs(docs), benchmark.limit(0)).count() == len(docs)


def test_blocks_of_items(spark, make_docs):
    items, docs = fixture()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(D.item_blocks(benchmark, most=300))) > 3
    assert sum(len(b) for b in D.item_blocks(benchmark, most=300)) == 16
    whole = {(r["doc_id"], r["item_id"], r["distance"]) for r in D.find_leaks(make_docs(docs), benchmark).collect()}
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in D.find_leaks(make_docs(docs), benchmark, block_bytes=300).collect()} == whole
    assert sorted(r["doc_id"] or 0 for r in D.drop_leaks(make_docs(docs), benchmark, block_bytes=300).collect()) == sorted(d or 0 for d, _ in docs if d not in {x[0] for x in whole})


def test_ends_and_ties():
    item = "the quick brown fox jumps over the lazy dog near the river"
    one = item.replace("quick", "quack")
    m = D.Matcher([(1, item.encode()), (2, b"\xc3\xa9t\xc3\xa9"), (3, item.encode())], D.ERROR_SHARE)
    text = f"é {one} and {one} été"
    assert m.matches([D.canonical(text)]) == [(0, 0, 1, 2 + len(item)), (0, 1, 0, len(text)), (0, 2, 1, 2 + len(item))]
    assert m.matches([D.canonical(f"{one} {item}")])[0] == (0, 0, 0, 2 * len(item) + 1)
    assert m.matches([b"", b"x"]) == [] and D.Matcher([], D.ERROR_SHARE).matches([b"x"]) == []


def test_pieces_have_eight_bytes():
    for n in range(D.SHORT, 3000):
        assert n // (int(n * D.ERROR_SHARE) + 1) >= 8
