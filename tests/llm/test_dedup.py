import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sentigrid.llm import simhash, site_lines, suffixes
from sentigrid.llm.components import connected_components
from sentigrid.llm.site_lines import drop_boilerplate, html_lines, url_host


def brute_groups(values, near):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in values:
        for b in values:
            if a < b and near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_components_of_chain_star_and_pairs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(500, 400), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and got[500] == 400
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_fingerprint_by_hand():
    text = "A b C d e é b"
    words = "a b c d e é b".split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(text.encode())[0] % (1 << 64) == want
    assert simhash.fingerprint(b" \n") == [0]
    assert simhash.fingerprint(b"Two words") == simhash.fingerprint(b"two   words")


@pytest.mark.parametrize("heavy", [1, 64])
def test_links_equal_brute_force(frame, monkeypatch, heavy):
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    rng = random.Random(heavy)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(60):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(60)] = "edit"
        rows.append((i, " ".join(words)))
    prints = {i: simhash.fingerprint(t.encode())[0] % (1 << 64) for i, t in rows}
    want = brute_groups(list(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(rows)).collect()}
    assert got == want


def test_simhash_of_messy_rows(frame, messy):
    got = simhash.near_duplicates(frame(messy))
    rows = got.collect()
    assert len(rows) == len(messy)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[1] == by[2] == by[3] == {1} and by[None] == {None} and by[5] == {5}
    assert simhash.near_duplicates(frame([])).count() == 0


def test_keep_first_takes_near_copies(frame, messy):
    rng = random.Random(3)
    words = [rng.choice("abcdefghijklmnop") * rng.randint(1, 4) + str(rng.randrange(90)) for _ in range(300)]
    copies = []
    for i in range(80):
        own = list(words)
        own[rng.randrange(300)] = "changed"
        copies.append((100 + i, " ".join(own)))
    other = [(900 + i, " ".join(rng.choice("qrstuv") + str(rng.randrange(999)) for _ in range(200))) for i in range(20)]
    kept = simhash.keep_first(frame(copies + other))
    assert kept.columns == ["doc_id", "text", "source", "h"]
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {100, *(i for i, _ in other)}
    assert {r.doc_id for r in simhash.keep_first(frame(messy)).collect()} == {1, 4, 5, None, 6, 7}


def brute_repeats(rows):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if raw[k:k + 100] in seen:
                gone[k:k + 100] = b"\1" * 100
            seen.add(raw[k:k + 100])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[doc] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def told(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("heavy,shard", [(4096, 1024), (2, 1024), (4096, 3)])
def test_repeats_equal_brute_force(frame, monkeypatch, heavy, shard):
    monkeypatch.setattr(suffixes, "HEAVY", heavy)
    monkeypatch.setattr(suffixes, "SHARD", shard)
    rng = random.Random(heavy)
    line = "".join(rng.choice("abcdé ") for _ in range(90))
    passage = "".join(rng.choice("abcd\n\x00") for _ in range(260))
    rows = []
    for i in range(40):
        fill = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
        parts = [fill(rng.randint(0, 150)), line, fill(rng.randint(0, 30)), passage[rng.randint(0, 90):rng.randint(150, 260)], fill(40)]
        rows.append((i, "".join(rng.sample(parts, rng.randint(1, 5)))))
    rows += [(50, "x" * 450), (51, "ab" * 300), (52, rows[3][1]), (53, None), (54, ""), (55, "z" * 99), (56, rows[5][1][7:])]
    assert told(suffixes.remove_repeats(frame(rows))) == brute_repeats(rows)


def test_long_text_crosses_blocks(frame, monkeypatch):
    monkeypatch.setattr(suffixes, "_BLOCK", 512)
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh") for _ in range(3000))
    rows = [(1, text), (2, text[300:2700]), (3, text[1000:1090])]
    assert told(suffixes.remove_repeats(frame(rows))) == brute_repeats(rows)


def test_repeats_of_messy_rows(frame, messy):
    got = suffixes.remove_repeats(frame(messy)).collect()
    assert len(got) == len(messy) and {r.n_removed for r in got if r.doc_id != 7} == {0}
    assert suffixes.remove_repeats(frame([])).count() == 0


def common(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("alphabet,size", [(3, 30), (2, 7), (40, 200), (100_000, 64)])
def test_merge_equals_one_sort(monkeypatch, alphabet, size):
    rng = np.random.default_rng(alphabet)
    group, words = rng.integers(0, 3, 200), rng.integers(0, alphabet, (200, 4)).astype(np.uint64)
    monkeypatch.setattr(suffixes, "SHARD", size)
    order, prefix = suffixes.merged_order(group, words)
    row = lambda i: (int(group[i]), *words[i].tolist())
    assert order.tolist() == sorted(range(200), key=lambda i: (row(i), i))
    raw = [words[i].astype(">u8").tobytes() for i in order]
    want = [common(raw[k - 1], raw[k]) if k and group[order[k]] == group[order[k - 1]] else -1 for k in range(200)]
    assert prefix.tolist() == want


def test_transforms_alone_give_the_merged_order_and_prefixes():
    rng = np.random.default_rng(5)
    strings = rng.integers(1, 4, (60, 6))
    strings[30:40] = strings[:10]
    made = [suffixes.shard_transform(strings[a:a + 15]) for a in range(0, 60, 15)]
    suffix_of = np.concatenate([order + a * 7 for a, (order, _) in zip(range(0, 60, 15), made)])
    text = lambda n: (*strings[n // 7, n % 7:].tolist(), 0)
    for a, (order, transform) in zip(range(0, 60, 15), made):
        assert [text(n + a * 7) for n in order] == sorted(text(n + a * 7) for n in order)
        assert len(transform) == 15 * 7 and (transform == 0).sum() == 15
    source, shared = suffixes.merge_transforms([t for _, t in made])
    merged = [text(n) for n in suffix_of[source]]
    assert merged == sorted(text(n) for n in range(60 * 7))
    assert shared[1:].tolist() == [-1 if a == b else common(a, b) for a, b in zip(merged, merged[1:])]
    # the shards' own orders are what is merged: with one of them wrong the result is wrong
    wrong = [t for _, t in made]
    wrong[2] = wrong[2][::-1]
    source, _ = suffixes.merge_transforms(wrong)
    assert [text(n) for n in suffix_of[source]] != merged


def brute_lines(rows, ratio=0.1, least=3):
    """Text of each row without the lines of its host that enough of its pages hold."""
    hosts = {}
    for _, text, host in rows:
        hosts.setdefault(host, []).append({x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")})
    common = {h: {x for x in set().union(*p) if sum(x in q for q in p) >= least and sum(x in q for q in p) > ratio * len(p)}
              for h, p in hosts.items()}
    return sorted((repr(i), None if t is None else "\n".join(x for x in t.split("\n") if x not in common[h])) for i, t, h in rows)


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_site_lines(frame, monkeypatch, broadcast):
    monkeypatch.setattr(site_lines, "BROADCAST_LINES", broadcast)
    rows = [(i, f"menu\nown {i}\n\nfoot" if i % 2 else f"own {i}\nfoot", "a") for i in range(12)]
    rows += [(100 + i, f"menu\nx{i}", "small") for i in range(9)] + [(200 + i, f"menu\nz{i}", None) for i in range(12)] + [(300, None, "a")]
    rows += [(400 + i, f"top\ny{i}", "three") for i in range(3)] + [(410 + i, "top\nx", "two") for i in range(2)]
    got = {r.doc_id: r for r in drop_boilerplate(frame(rows), F.col("text"), F.col("source"), stats=True).collect()}
    assert got[1].text == "own 1\n" and got[1].n_dropped == 2 and got[2].text == "own 2"
    assert got[100].text == "x0" and got[203].text == "z3" and got[300].text is None and len(got) == len(rows)
    assert got[401].text == "y1" and got[410].text == "top\nx"  # three pages are enough, two are not
    assert sorted((repr(i), r.text) for i, r in got.items()) == brute_lines(rows)
    assert drop_boilerplate(frame([]), F.col("text"), F.col("source")).count() == 0


def test_site_lines_of_messy_rows(frame, messy, spark):
    rows = [(i, t, "h") for i, t in messy] + [(50 + i, f"ten\nrow {i}" if i < 3 else f"row {i}", "ratio") for i in range(30)]
    rows += [(90 + i, "eleven\n" * 2 if i < 4 else f"line {i}", "over") for i in range(30)]
    out = drop_boilerplate(frame(rows), F.col("text"), F.col("source"))
    assert sorted((repr(r.doc_id), r.text) for r in out.collect()) == brute_lines(rows)
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[50] == "ten\nrow 0" and kept[90] == ""  # just a tenth of the pages, and more
    clash = spark.createDataFrame([(i, "same\nline", "h", 1, 2, 3) for i in range(5)],
                                  "doc_id bigint, text string, source string, _sitek int, _sitel int, _sites int")
    odd = drop_boilerplate(clash, F.col("text"), F.col("source"))
    assert odd.columns == clash.columns and {r.text for r in odd.collect()} == {""}


def test_hosts_and_html(spark):
    row = spark.createDataFrame([("HTTP://u@A.example:8/x", "<p>a<b>b</b></p><script>x</script>c"), ("nothing", None)], "u string, t string")
    got = row.select(url_host(F.col("u")).alias("h"), html_lines(F.col("t")).alias("l")).collect()
    assert got[0].h == "a.example" and got[0].l.split("\n") == ["", "ab", "", "c"] and got[1].h is None and got[1].l is None
