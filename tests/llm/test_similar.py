import random

import corpus_pipeline
from chronolith.llm import similar, simhash

from .fixtures import prose


def five(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def alike(a, b):
    return not (a | b) or 5 * len(a & b) >= 4 * len(a | b)


def groups(texts):
    """The number of each text's component, by comparing all pairs."""
    root, sets = list(range(len(texts))), [five(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and alike(sets[i], sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    return root


def near_texts():
    rnd = random.Random(5)
    line = prose(rnd, 12)
    texts = [None, "", "one", "two words"]
    for _ in range(15):
        base = prose(rnd, rnd.randint(40, 160)).split()
        texts.append(" ".join(base))
        for changes in (1, 1, 2, 3, 4, 6):
            w = list(base)
            for at in rnd.sample(range(len(w)), min(changes, len(w))):
                w[at] = "changed"
            texts.append(" ".join(w))
    return texts + [f"{prose(rnd, 30)} {line}" for _ in range(80)]


def test_stage_as_brute_force(spark):
    texts = near_texts()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    root, least = groups(texts), {}
    for i, r in enumerate(root):
        least.setdefault(r, i)
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == sorted(least.values())
    assert len(got) < simhash.near_duplicates(docs).where("doc_id = component_id").count()


def test_repeated_and_null_ids(spark):
    rnd = random.Random(9)
    a, b, c = (prose(rnd, 60) for _ in range(3))
    rows = [(1, a), (1, b), (1, b), (2, a), (None, b), (None, c), (None, c)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, a), (1, b), (None, c)]))


def test_keys_in_parts_as_whole_keys(spark, monkeypatch):
    rnd = random.Random(17)
    line = prose(rnd, 30).split()
    texts = []
    for _ in range(30):  # one key for all, of many components
        base = line + prose(rnd, rnd.randint(60, 70)).split()
        for changes in (0, 1, 2, 5):
            w = list(base)
            for at in rnd.sample(range(len(line), len(w)), changes):
                w[at] = "changed"
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    each = similar.described(docs).where("wide is not null").select("c", "n", *similar.BITS)
    met = each.selectExpr("7L as key", "c", "c as comp", "n", *similar.BITS, f"{len(texts)}L as classes").checkpoint()
    whole = {tuple(r) for r in similar.across(met).collect()}
    monkeypatch.setattr(similar, "BLOCK", 9)
    assert whole and {tuple(r) for r in similar.across(met).collect()} == whole
    root, least = groups(texts), {}
    for i, r in enumerate(root):
        least.setdefault(r, i)
    assert sorted(r.doc_id for r in similar.keep_one(docs).collect()) == sorted(least.values())


def test_keys_of_long_texts_give_no_pair_that_whole_fingerprints_rule_out(spark, monkeypatch):
    rnd = random.Random(23)
    line, across, found = prose(rnd, 40), similar.across, []
    texts = [f"{line} {' '.join(str(rnd.randrange(1 << 40)) for _ in range(1200))}" for _ in range(24)]  # keys of many components, past what folds tell apart
    texts += [texts[3] + " more words"]

    def kept(met):
        found.append((met.select("c").distinct().count(), across(met).checkpoint()))
        return found[-1][1]

    monkeypatch.setattr(similar, "across", kept)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in similar.keep_one(docs).collect()) == list(range(24))
    assert found[0][0] >= 24 and found[0][1].count() <= 1


def test_links_of_a_group_of_near_copies_are_few_a_class(spark, monkeypatch):
    rnd = random.Random(31)
    base, verified, made = prose(rnd, 120).split(), similar.verified, []
    parts = [" ".join(base[a : a + n]) for a in range(41) for n in range(78, 83) if a + n <= 120]
    least = [t for t in parts if similar.class_of(t.encode()) < 0]  # first in every key, alike to no copy

    def of(n):
        texts = [*least[:3], *least[-3:]]
        while len(texts) < n:
            w = list(base)
            w[rnd.randrange(len(w))] = f"changed{rnd.randrange(1 << 40)}"
            if similar.class_of(" ".join(w).encode()) > 0:
                texts.append(" ".join(w))
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        made.clear()
        root, first = groups(texts), {}
        for i, r in enumerate(root):
            first.setdefault(r, i)
        assert sorted(r.doc_id for r in similar.keep_one(docs).collect()) == sorted(first.values())
        return sum(made)

    def counted(pairs, found):
        out = verified(pairs, found)
        made.append(out.count())
        return out

    monkeypatch.setattr(similar, "verified", counted)
    assert of(240) <= 8 * 240  # so many a class at most; before, 2735
