import math
import random
import re
from collections import Counter

import numpy as np

from sentigrid.llm.ranked_search import TERM, _Bucket, _Item, _pieces, ranked_search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return re.findall(TERM, (text or "").translate(LOWER))


def brute(docs, items, k=10):
    counts = [(d, Counter(terms_of(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    big_n, big_l = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms_of(text))
    out = set()
    for item, terms in wanted.items():
        found = []
        for doc, c in counts:
            m = 10 + (90 * sum(c.values()) * big_n) // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in terms if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out |= {(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k], 1)}
    return out


def rows(frame):
    return {(r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()}


def test_terms_of_bytes_as_of_characters():
    text = "Ärger-Straße A.B_c 日本語x1\x00y\x7fz ÀB"
    assert [t.decode() for piece in _pieces(text.encode()) for t in piece] == terms_of(text)


def test_ranked_search_equals_brute_force(spark):
    random.seed(3)
    words = [f"w{int(random.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(i, " ".join(random.choices(words, k=random.choice([1, 3, 20, 60, 400])))) for i in range(700)]
    docs += [(1000 + i, "same Text as, others w1 w2") for i in range(40)]  # ties beyond the tenth
    docs += [(2000 + i, docs[i][1]) for i in range(30)]
    items = [(i, " ".join(random.choices(words, k=random.choice([1, 2, 8, 30])))) for i in range(60)]
    items += [(90, "others SAME"), (91, "nowhere"), (92, ""), (93, None), (94, "w1 w1 w1"), (94, "w7")]
    found = ranked_search(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5),
                          spark.createDataFrame(items, "item_id bigint, text string"))
    assert rows(found) == brute(docs, items)


def test_ranked_search_of_messy_rows(spark, frame, messy):
    items = [(1, "one WORD5x5 lonely"), (2, "żółć"), (None, "two aaaa")]
    clash = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id bigint, text string, rank string, score string")
    found = ranked_search(frame(messy), clash)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(found) == brute(messy, items)


def test_ranked_search_of_empty_tables(spark, frame):
    none = spark.createDataFrame([], "item_id bigint, text string")
    one = spark.createDataFrame([(1, "word")], "item_id bigint, text string")
    assert ranked_search(frame([(1, "word")]), none).count() == 0
    assert ranked_search(frame([(1, None)]), one).count() == 0
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert ranked_search(empty, one).count() == 0


def test_no_vector_at_the_threshold_is_pruned():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n, size = 200, 40
        lengths = rng.integers(1, 15, n)
        ids = np.concatenate([np.sort(rng.choice(size, m, replace=False)) for m in lengths])
        impacts = rng.integers(1, 10**6, len(ids))
        ends = np.concatenate(([0], np.cumsum(lengths)))
        norms = np.sqrt(np.add.reduceat(impacts.astype(float) ** 2, ends[:-1]))
        bucket = _Bucket(list(range(n)), norms, ends, ids, impacts)
        chosen = sorted(rng.choice(size, int(rng.integers(1, 20)), replace=False).tolist())
        item = _Item(chosen, rng.integers(1, 9000, len(chosen)).tolist())
        weight = dict(zip(item.ids.tolist(), item.weights.tolist()))
        exact = [sum(weight.get(int(t), 0) * int(x) for t, x in zip(ids[ends[i]:ends[i + 1]], impacts[ends[i]:ends[i + 1]]))
                 for i in bucket.docs]
        threshold = sorted(exact)[-int(rng.integers(1, 30))]
        if not threshold or item.norm * bucket.norms[0] < threshold:
            continue
        kept = bucket.survivors(item, float(threshold))
        assert {i for i, s in enumerate(exact) if s >= threshold} <= set(kept.tolist())
        assert bucket.scores(item, kept, np.zeros(size, np.int64)).tolist() == [exact[i] for i in kept]
