"""Texts for the tests."""

import random


def word_soup(seed=3, documents=60):
    """Documents with shared passages, near and exact copies, odd white space, nulls and a long text."""
    r = random.Random(seed)
    vocabulary = [a + b for a in ("th", "on", "er", "an", "É", "lo") for b in ("ing", "ed", "re", "st", "a", "ön")]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = [text(r.randint(14, 40)) for _ in range(6)]
    out = []
    for i in range(documents):
        kind = r.random()
        if kind < 0.3 and out:
            words = (out[r.randrange(len(out))][1] or "a b").split()
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            body = " ".join(words)
        elif kind < 0.45 and out:
            body = (out[r.randrange(len(out))][1] or "").replace(" ", r.choice([" ", "\n", "\t  "]))
        else:
            body = " ".join([text(r.randint(0, 40)), r.choice(passage), text(r.randint(0, 40))])
        out.append((100 - i if i % 2 else 100 + i, body))
    out += [(7, None), (8, ""), (9, " \n\t "), (10, "one"), (11, "ONE"), (12, "one two three"), (13, text(20_000)), (14, passage[0] + " " + passage[1])]
    return out
