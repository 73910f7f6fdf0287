import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sentigrid.llm import token_alignment as ta

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def files():
    first = tokenizers.Tokenizer.from_file(ta.BYTE_BPE)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=ta.PIECE_BPE)


def brute(rows, files):
    """Token by token, with the files' own libraries."""
    first, second = files
    known_a, known_b = ta.byte_encoder()[1], ta.piece_encoder()[1]
    count, parts = Counter(), []
    for doc, text in rows:
        ids_a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = second.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if b"".join(known_a[i] for i in ids_a) != raw or b"".join(known_b[i] for i in ids_b) != raw:
            parts.append((doc, 0, 0, [], ""))
            continue
        ends_a, ends_b, at = {}, {}, 0
        for i, t in enumerate(ids_a):
            at += len(known_a[t])
            ends_a[at] = i
        at = 0
        for i, t in enumerate(ids_b):
            at += len(known_b[t])
            ends_b[at] = i
        links, groups, a0, b0 = [], [], 0, 0
        for end in sorted(ends_a.keys() & ends_b.keys()):
            a1, b1 = ends_a[end] + 1, ends_b[end] + 1
            links.append((ids_a[a1 - 1], ids_b[b1 - 1]))
            groups.append(",".join(map(str, ids_a[a0:a1])) + "|" + ",".join(map(str, ids_b[b0:b1])))
            a0, b0 = a1, b1
        count.update(links)
        parts.append((doc, len(ids_a), len(ids_b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    docs = sorted((repr(d), na, nb, len(x), len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), h)
                  for d, na, nb, x, h in parts)
    holders = Counter(p for _, _, _, x, _ in parts for p in set(x))
    return docs, {(a, b, n, holders[a, b], n == top[b]) for (a, b), n in count.items()}


def run(spark, rows, parts=3):
    docs = spark.createDataFrame([(d, t, 7, "x") for d, t in rows], "doc_id bigint, text string, pos int, a string").repartition(parts)
    out, pairs = ta.align_corpus(docs)
    found = sorted((repr(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect())
    return found, {(r.a, r.b, r.links, r.documents, r.best) for r in pairs.collect()}


def test_alignment_equals_brute_force(spark, files):
    rng = random.Random(9)
    bits = ["the", " the", "Hund", "  ", "\n", "\t", "żółć", "日本", "😀", "<|endoftext|>", "</s>", "<0x41>", "'s", "1234", ".", "und", " und", "²"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(1, 60)))) for i in range(150)]
    rows += [(500, "a▁b"), (501, "end\x00 of"), (502, " lead"), (503, "the the " * 40)]
    assert run(spark, rows) == brute(rows, files)


def test_messy_rows_and_empty_table(spark, files, messy):
    assert run(spark, messy) == brute(messy, files)
    out, pairs = ta.align_corpus(spark.createDataFrame([], "doc_id bigint, text string"))
    assert out.count() == 0 and pairs.count() == 0
    nothing, _ = ta.align_corpus(spark.createDataFrame([(1, None)], "doc_id bigint, text string"))
    assert tuple(nothing.first()) == (1, 0, 0, 0, 0, 0, 0, "")


def test_many_copies_fill_dense_planes(spark, files):
    rows = [(i, "the cat sat on the mat, the end" if i % 3 else "a dog") for i in range(4000)]
    assert run(spark, rows, 1) == brute(rows, files)


def test_containers_hold_their_positions():
    rng = np.random.default_rng(1)
    sizes = np.array([1, ta.SPARSE, ta.SPARSE + 1, 5000, 3, ta.BLOCK_DOCS])
    runs = [np.sort(rng.choice(ta.BLOCK_DOCS, n, replace=False)) for n in sizes]
    packed = ta._containers(np.concatenate(runs), sizes).to_pylist()
    assert [len(p) for p in packed] == [2 * n if n <= ta.SPARSE else ta.BLOCK_DOCS // 8 for n in sizes]
    which, positions = ta._unfold(sizes, packed)
    assert [positions[which == i].tolist() for i in range(len(sizes))] == [r.tolist() for r in runs]


def test_a_block_is_closed_by_its_bounds():
    block = ta._Block(0)
    block.size = ta.BLOCK_LINKS
    assert block.full()
    block = ta._Block(0)
    block.docs = [None] * ta.BLOCK_DOCS
    assert block.full()
