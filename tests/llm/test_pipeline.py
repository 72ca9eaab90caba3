"""The pipeline, stage by stage, against plain versions of each stage's decision; and run() against the stages."""

from collections import Counter

import numpy as np
import pytest
from test_operators import fold, held_back, slow_fingerprint, slow_quality, slow_runs, slow_scores, tokenizer, without

import corpus_pipeline
from tidemark.llm import quality, simhash
from tidemark.llm.common import load


def slow_groups(texts):
    """A number for each text, the same for those that links join: a five-word Jaccard similarity of 0.8 or more, or no words."""

    def shingles(t):
        w = fold(t or "").split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both >= 0.8 * (len(x) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    words = [f"{a}{b}" for a in ("lo", "ka", "mi", "su", "te", "ra") for b in ("n", "re", "tas", "vo", "dil", "pem", "cu", "gho")]
    prose = lambda n: " ".join(rng.choice(words, n))
    lines = lambda n: "\n".join(prose(int(rng.integers(15, 50))) for _ in range(n))
    passage, leak = prose(60), prose(14)
    docs = [lines(int(rng.integers(2, 6))) for _ in range(60)]
    docs += [docs[0], docs[0], docs[1] + " more", docs[2]]  # copies
    docs += [lines(2) + "\n" + passage + "\n" + lines(1) for _ in range(5)]  # a shared passage
    docs += [prose(30) + " " + leak + " " + prose(30), leak.upper()]  # leaks
    docs += ["% % | | " * 40, "short text", "", None, "spam spam spam " * 30]
    path = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(docs)] + [(None, lines(3), None, None, None), (7, docs[7], "en", "s", len(docs[7]))]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 75, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, leak), (1, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, leak, passage


def test_stages(spark, folder):
    sf, rows, leak, passage = folder
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stage = dict(corpus_pipeline.STAGES)
    docs = load(spark, sf, "documents")
    trusted = set(range(0, 60, 2))

    kept = stage["quality_rules"](spark, docs, sf)
    assert kept.columns == docs.columns
    score = slow_scores(rows, trusted, quality.BUCKETS)
    scores = [score(t) for i, t, *_ in rows if i in trusted and held_back(i)]
    least = np.mean(scores) - quality.SPREAD * np.std(scores)
    good = [r for r in rows if not slow_quality(r[1])[-1] and score(r[1]) >= least]
    assert Counter(map(tuple, kept.collect())) == Counter(good) and {None, 7} <= {r[0] for r in good} and len(good) < len(rows)

    clean = stage["line_dedup"](spark, kept, sf)
    assert clean.columns == docs.columns and clean.count() == len(good)
    gone, after = slow_runs(good), {}
    for r in clean.collect():
        after[r.doc_id] = r.text
        assert r.n_chars == (None if r.doc_id is None else len(r.text))
    for (nameless, i, text), own in gone.items():
        assert after[None if nameless else i] == without(text, own)
    assert sum(passage in t for t in after.values()) == 1

    one = stage["simhash_near_dedup"](spark, clean, sf)
    ids = list(after)
    root = slow_groups([after[i] for i in ids])
    expected = set()
    for group in set(root):
        named = [i for i, r in zip(ids, root) if r == group and i is not None]
        expected.add(min(named) if named else None)
    kept_ids = [r.doc_id for r in one.collect()]
    assert one.columns == docs.columns and set(kept_ids) == expected and len(kept_ids) == len(expected)

    safe = stage["decontamination"](spark, one, sf)
    words = lambda t: fold(t).split()  # noqa: E731  plain prose: other separators do not occur
    windows = {tuple(words(leak)[k : k + 10]) for k in range(len(words(leak)) - 9)}
    hit = {i for i in expected if any(tuple(words(after[i])[k : k + 10]) in windows for k in range(len(words(after[i]))))}
    assert hit and {r.doc_id for r in safe.collect()} == expected - hit and safe.columns == docs.columns

    packed = stage["packing"](spark, safe, sf)
    t = tokenizer()
    tokens = {i: len(t.encode(after[i], add_special_tokens=False).ids) + 1 for i in expected - hit}
    got = Counter()
    for p in packed.collect():
        assert p.doc_tokens == tokens[p.doc_id]
        got.update((p.doc_id, k) for k in range(p.start, p.start + p.length))
    assert got == Counter((i, k) for i, n in tokens.items() for k in range(n))

    whole = corpus_pipeline.run(spark, sf)
    digest = lambda df: Counter((r.doc_id, r.doc_tokens) for r in df.collect() if r.start == 0)
    assert digest(whole) == digest(packed)


def test_empty_tables(spark, folder, tmp_path):
    sf = folder[0]
    for name in ("documents", "labels", "benchmark"):
        load(spark, sf, name).limit(0).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_finds_all_similar_pairs(spark):
    """Edited copies with a five-word Jaccard similarity of 0.8 or more go, far though their fingerprints are."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", "a few words", "A  few\nwords", "a few words more"]
    for n in (30, 60, 200, 400):
        for _ in range(12):
            base = rng.choice(words, n).tolist()
            texts.append(" ".join(base))
            for edits in (1, 2, n // 60, n // 45, n // 30):
                copy = list(base)
                for k in rng.choice(n, edits, replace=False):
                    copy[k] = str(rng.choice(words))
                texts.append(" ".join(copy))
    line = " ".join(rng.choice(words, 12))  # a common line joins nothing
    texts += [" ".join(rng.choice(words, 20)) + " " + line for _ in range(120)]
    base = rng.choice(words, 200).tolist()  # a large group
    texts += [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(0, 200, 2)]

    for n in (90, 150):  # large groups of loosely alike texts, without what they were made from
        base = rng.choice(words, n).tolist()
        for edits in rng.integers(2, 8, 70):
            copy = list(base)
            for k in rng.choice(n, edits, replace=False):
                copy[k] = str(rng.choice(words))
            texts.append(" ".join(copy))

    root = slow_groups(texts)
    fps = [slow_fingerprint(t) for t in texts]
    assert sum(bin(fps[i] ^ fps[j]).count("1") > 2 for i in range(len(texts)) for j in range(i) if root[i] == root[j]) > 50
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def test_near_dedup_goes_through_the_trie(spark, monkeypatch):
    """The first links of the stage are those of the trie join on SimHash fingerprints, verified; the rest adds to them."""
    rng = np.random.default_rng(4)
    texts = ["", "few words"]
    for n in (50, 120, 300):
        for _ in range(8):
            base = rng.integers(0, 4000, n)
            texts += [" ".join(f"w{x}" for x in np.where(np.isin(np.arange(n), rng.choice(n, e, replace=False)), 9999, base)) for e in (0, 1, 1, 3, 4, 8)]
    texts = list(dict.fromkeys(texts))
    budget = simhash.NEAR_BUDGET
    key, sim = zip(*[simhash.set_of(t, 5)[:2] for t in texts])
    sets = [set(simhash.set_of(t, 5)[2].tolist()) for t in texts]
    apart = lambda i, j: ((sim[i] ^ sim[j]) % 2**64).bit_count()
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])

    def roots(pairs):
        forest = simhash.Forest()
        for i, j in pairs:
            forest.join(i, j)
        return [forest.root(k) for k in range(len(texts))]

    every = [(i, j) for i in range(len(texts)) for j in range(i)]
    first, components, place = [], simhash.components, {k: i for i, k in enumerate(key)}
    monkeypatch.setattr(simhash, "components", lambda edges: first.append([(place[r.a], place[r.b]) for r in edges.collect()]) or components(edges))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert kept == sorted(set(roots([p for p in every if alike(*p)])))
    assert all(alike(i, j) and apart(i, j) <= budget for i, j in first[0]) and any(apart(i, j) > simhash.BUDGET for i, j in first[0])
    assert len(first[0]) > 5 and not set(range(len(texts))) - set(kept) <= {max(p) for p in first[0]}  # the rest finds others

    named = spark.createDataFrame(list(zip(key, sim)), "fp long, sim long")
    found = [(place[r.a], place[r.b]) for r in simhash.near_pairs(named, budget).collect()]
    assert all(apart(i, j) <= budget for i, j in found) and roots(found) == roots([p for p in every if apart(*p) <= budget])


@pytest.mark.parametrize("budget", [0, 1, 3, 5, 6])
def test_trie_join_with_other_budgets(spark, budget):
    rng = np.random.default_rng(budget)
    base = [int(x) for x in rng.integers(0, 2**64, 60, np.uint64)]
    fps = list(dict.fromkeys(base + [b ^ sum(1 << int(k) for k in rng.choice(64, d, replace=False)) for b in base for d in (1, 3, 5, 6, 7)]))
    signed = [f - (f >> 63 << 64) for f in fps]
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), budget, real=True).collect()}
    near = {(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) % 2**64).bit_count() <= budget}
    names, forests = range(len(fps)), []
    for pairs in (got, near):
        forest = simhash.Forest()
        for a, b in pairs:
            forest.join(signed.index(a), signed.index(b))
        forests.append([forest.root(k) for k in names])
    assert got <= near | {(b, a) for a, b in near} and forests[0] == forests[1]
