import random
import re

from gradeline.operators import compare, ordinals, pairing


def parts(key):
    if key is None:
        return None
    plain = re.sub(r"\(.*?\)", "", key).strip().lower()
    bare = re.sub("[^a-z0-9]", "", plain)
    return plain, bare, re.sub("[^0-9]", "", bare)


def alike(a, b):
    if a is None or b is None:
        return False
    return a[0] == b[0] or a[1] == b[1] or ((a[1] in b[1] or b[1] in a[1]) and a[2] == b[2])


def by_hand(truth, found):
    """The fold: true rows in order take the first free match."""
    out = {}
    for g in {r[0] for r in truth}:
        free = sorted((o, parts(k)) for gg, o, k in found if gg == g and g is not None)
        for _, o, k in sorted(r for r in truth if r[0] == g):
            p = parts(k)
            at = next((i for i, (_, q) in enumerate(free) if alike(p, q)), None)
            out[g, o] = None if at is None else free.pop(at)[0]
    return out


def sides(spark, truth, found):
    schema = "g long, ord long, key string"
    return spark.createDataFrame(truth, schema), spark.createDataFrame(found, schema)


def test_rounds_give_what_the_fold_gives(spark):
    r = random.Random(6)
    words = ["MH 1", "MH 1A", "mh-1", "CB MH 1", "MH 11", "MH", "(note)", "A", "AB", "B 1", "XA", "CB", "CB 1 (old)", "", "é", None]
    truth, found = [], []
    for g in range(6):
        some = r.sample(words, r.randint(3, len(words)))
        truth += [(g, o, r.choice(some)) for o in range(r.randint(0, 25))]
        found += [(g, o, r.choice(some)) for o in range(r.randint(0, 25))]
    t, f = sides(spark, truth, found)
    for fold_rows in (0, 20, 400):
        got = {(x["g"], x["ord"]): x["match"] for x in compare.greedy_match(t, f, ["g"], fold_rows=fold_rows).collect()}
        assert got == by_hand(truth, found), fold_rows


def test_rows_without_a_group_stay_apart(spark):
    truth, found = [(None, 1, "A"), (None, 2, "A"), (1, 1, "A")], [(None, 1, "A"), (1, 5, "a")]
    for fold_rows in (0, 400):
        got = {(x["g"], x["ord"]): x["match"] for x in compare.greedy_match(*sides(spark, truth, found), ["g"], fold_rows=fold_rows).collect()}
        assert got == {(None, 1): None, (None, 2): None, (1, 1): 5}


def test_one_large_group(spark):
    """20,000 rows of one group: distinct keys, a key of a third of all rows, and rivals."""
    n = 20_000
    key = lambda i: "hot key 7" if i % 3 == 0 else f"Run {i}" if i % 3 == 1 else f"line {i % 500} part {i // 500}"
    truth = [(1, i, key(i)) for i in range(n)]
    found = [(1, i, key((i * 7) % n).upper() + (" (built)" if i % 2 else " x")) for i in range(n) if i % 5]
    t, f = sides(spark, truth, found)
    got = {x["ord"]: x["match"] for x in compare.greedy_match(t, f, ["g"]).collect()}
    # The fold, with the choices of each true row looked up by digits.
    by_digits = {}
    for _, o, k in found:
        by_digits.setdefault(parts(k)[2], {}).setdefault(parts(k)[1], []).append(o)
    for _, i, k in truth:
        p = parts(k)
        queues = [q for bare, q in by_digits.get(p[2], {}).items() if q and (p[1] in bare or bare in p[1])]
        best = min(queues, key=lambda q: q[0], default=None)
        assert got[i] == (best.pop(0) if best else None)


def test_plan_holds_no_group_in_a_row(spark):
    t, f = sides(spark, [(1, i, f"k {i}") for i in range(5)], [(1, i, f"K-{i}") for i in range(5)])
    plan = pairing.paired(t, f, ["g"])._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_linked_keys_against_all_pairs(spark):
    r = random.Random(3)
    keys = ["".join(r.choice("ab1 -") for _ in range(r.randint(0, 7))) for _ in range(150)] + [None, "(x)"]
    left, right = keys[:80], keys[60:]
    make = lambda ks: spark.createDataFrame([(k,) for k in ks], "key string")
    got = {(x["bare"], x["other"]) for x in pairing.linked_keys(make(left), make(right), []).collect()}
    assert got == {(parts(a)[1], parts(b)[1]) for a in left for b in right if alike(parts(a), parts(b))}


def test_numbered_over_many_tasks(spark):
    rows = [(i % 2, (i * 37) % 1000) for i in range(1000)]
    got = ordinals.numbered(spark.createDataFrame(rows, "g long, o long"), ["g"], "o", "n").collect()
    for g in (0, 1):
        mine = sorted((x["o"], x["n"]) for x in got if x["g"] == g)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))
