"""A crowded group at similarities around the threshold: components must be those of all pairs."""

import random

from wardenry.llm import near_dedup


def test_crowds_lose_no_link(spark, monkeypatch):
    rng, paired = random.Random(5), []
    rare = near_dedup.sharing_rare
    monkeypatch.setattr(near_dedup, "sharing_rare", lambda *a: paired.append(1) or rare(*a))
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(90):
        words = list(base)
        for at in rng.sample(range(120), rng.randint(3, 18)):
            words[at] = f"x{rng.randint(0, 40)}"
        texts.append(" ".join(words))
    sets = [set(zip(w, w[1:], strict=False)) for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            shared = len(sets[x] & sets[y])
            if 100 * shared >= 80 * (len(sets[x]) + len(sets[y]) - shared):
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, shingle=2).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    assert len(set(got.values())) > 1 and paired
