import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from urllib.parse import quote

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from sentigrid.llm import chat, decontaminate, gru_lm, mixing, quality, secrets, toxicity


def test_mix_meets_targets(frame, spark, messy, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", 16)
    rng = random.Random(0)
    rows = [(i, "w " * rng.randint(0, 90), rng.choice(["a", "b", "c", "d", None])) for i in range(400)]
    rows += [(1000, "w " * 3000, "a"), (1001, "w " * 5, "zz")]
    got = mixing.mix(frame(rows)).collect()
    again = mixing.mix(frame(rows, 5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    total = sum(size.values())
    assert sum(target.values()) == pytest.approx(total)
    # water level by hand: weights 1, 2, 3, 1, 2, 3 over a, b, c, d, zz, null
    weight = dict(zip(["a", "b", "c", "d", "zz", None], [1, 2, 3, 1, 2, 3]))
    want, free, rest = {}, set(weight), total
    while True:
        over = {s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 3 * size[s]}
        if not over:
            break
        for s in over:
            want[s] = 3 * size[s]
            rest -= want[s]
        free -= over
    want |= {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
    for s in weight:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 1
    assert mixing.mix(frame(messy)).count() == len(messy)
    assert mixing.mix(frame([])).count() == 0


def brute_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if a[i] == b[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h))


@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_alignment(a, b):
    assert decontaminate.align(np.array(a), np.array(b))[0] == brute_align(a, b)


def test_leaks(frame, spark, messy):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(30)] for _ in range(8)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, "")], "item_id bigint, text string")
    edited = list(items[2])
    for k in (4, 11, 18, 25):
        edited[k] = "changed"
    rows = [(1, " ".join([word() for _ in range(50)] + items[0] + [word() for _ in range(9)])),
            (2, "X! " + ", ".join(edited).upper()), (3, " ".join(word() for _ in range(200))),
            (4, " ".join(items[5][:8])), (5, " ".join(items[6][:20] + items[7]))] + messy[:3] + messy[5:]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(frame(rows), bench).collect()}
    assert set(got) == {(1, 0), (2, 2), (5, 6), (5, 7)}
    assert (got[1, 0].start_word, got[1, 0].end_word, got[1, 0].score) == (50, 80, 1.0)
    assert decontaminate.leaks(frame([]), bench).count() == 0
    assert decontaminate.leaks(frame(rows), bench.limit(0)).count() == 0
    assert {r.doc_id for r in decontaminate.without_leaks(frame(rows), bench).collect()} == {r[0] for r in rows} - {1, 2, 5}


def test_leaks_equal_brute_force(frame, spark):
    rng = random.Random(5)
    items = [(k, [f"i{k}w{rng.randrange(60)}" for _ in range(n)]) for k, n in enumerate([1, 2, 3, 4, 5, 15, 15, 22, 40])]
    filler = lambda: [rng.choice("abcdefgh") for _ in range(30)]
    rows = []
    for _, words in items:
        for every in (2, 3, 4, 5, 6):
            for at in range(min(every, 3)):
                put = [f"x{i}" if i % every == at else w for i, w in enumerate(words)]
                fill = [x for i, w in enumerate(words) for x in ([w, f"y{i}"] if i % (every - 1) == 0 else [w])]
                cut = [w for i, w in enumerate(words) if i % every != at]
                rows += [filler() + own + filler() for own in (put, fill, cut)]
    rows += [filler() + words + filler() for _, words in items]  # intact copies, whose pairs are more frequent
    rows = list(enumerate(rows))
    want = {(i, k): s for i, row in rows for k, words in items if (s := brute_align(words, row) / (2 * len(words))) >= 0.5}
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id bigint, item_text string")
    got = decontaminate.leaks(frame([(i, " ".join(r)) for i, r in rows]), bench, item_text_col="item_text").collect()
    assert {(r.doc_id, r.item_id): r.score for r in got} == pytest.approx(want)


def test_toxicity(frame, spark, messy):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        bad = rng.random() < 0.3
        if bad:
            text[rng.randrange(len(text))] = rng.choice(["Idiot,", "scum", "moron!"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad), 9))
    table = spark.createDataFrame(labels + [(0, labels[0][1], 9), (None, 1, 9), (5000, None, 9)], "doc_id bigint, toxic int, text int")
    model = toxicity.train(frame(rows), table)
    got = toxicity.score_toxicity(frame(rows + messy), model).collect()
    truth = {i: y for i, y, _ in labels}
    checked = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id > 7]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in checked]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got) and len(got) == len(rows) + len(messy)
    assert toxicity.score_toxicity(frame([]), model).count() == 0
    nothing = toxicity.train(frame(rows), table.limit(0))
    assert toxicity.score_toxicity(frame(messy), nothing).count() == len(messy)


def test_pair_terms_learn_what_weights_cannot():
    rows = [np.array(r) for r in ([1, 2], [1], [2], [3])] * 120
    labels = np.array([1.0, 0, 0, 0] * 120)
    model = toxicity.fit(rows, labels)
    at, row = toxicity._pack(rows[:4])
    score = toxicity.sigmoid(toxicity.margin(model, at, row, 4)[0])
    assert score[0] > 0.5 > max(score[1:])


def test_language_model_base_and_gain(frame, messy, monkeypatch):
    monkeypatch.setattr(gru_lm, "TRAIN_LANES", 8)
    monkeypatch.setattr(gru_lm, "STEP_EVERY", 1)
    monkeypatch.setattr(gru_lm, "STEP_TOKENS", 128)
    rng = random.Random(4)
    chain = {w: rng.sample(range(40), 3) for w in range(40)}
    rows = []
    for i in range(300):
        w, text = rng.randrange(40), []
        for _ in range(80):
            text.append(f"T{w}" if rng.random() > 0.02 else f"rare{rng.randrange(10 ** 6)}")
            w = rng.choice(chain[w])
        rows.append((i, " ".join(text)))
    rows += [(1000 + k, t) for k, (_, t) in enumerate(messy) if k != 5] + [(None, "null id")]
    got = gru_lm.score_texts(frame(rows)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    text = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        own = tokens(text[r.doc_id])
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert r.base_score == pytest.approx(base) and r.train_tokens == n and r.held_out == held(r.doc_id)
        assert (r.n_tokens, r.n_known) == (len(own), sum(c[w] > 0 for w in own)) and math.isfinite(r.score)
    test = [r for r in got if r.held_out and r.doc_id < 300]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)
    assert gru_lm.score_texts(frame([])).count() == 0
    assert [r.n_tokens for r in gru_lm.score_texts(frame(messy[5:6])).collect()] == [30001]


def test_every_window_and_every_small_task_learns(spark, monkeypatch):
    vocabulary = gru_lm.Vocabulary([(f"t{i}".encode(), 9) for i in range(40)] + [(gru_lm.END, 9)], 369, 41)
    seen, gradients = [], gru_lm.gradients
    monkeypatch.setattr(gru_lm, "gradients", lambda m, numbers, start, live, *a: seen.append(int(live.sum())) or gradients(m, numbers, start, live, *a))
    model = gru_lm.initial(vocabulary, 0)
    gru_lm.learn(model, [np.arange(1, 150, dtype=np.int16) % 40], gru_lm._Descent(model))
    assert sum(seen) == 149
    monkeypatch.undo()
    docs = spark.createDataFrame([(i, f"t{i} t{i + 1} t{i + 2}".encode()) for i in range(8)], "doc bigint, t binary").repartition(4)
    trained = gru_lm.train(docs, vocabulary)
    assert any((trained[k] != v).any() for k, v in gru_lm.initial(vocabulary, 0).items())


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    vocabulary = gru_lm.Vocabulary([(b"%d" % i, 2000 - i) for i in range(1100)], sum(range(901, 2001)), 1100)
    model = {k: v.astype(np.float64) + rng.normal(0, 0.05, v.shape) for k, v in gru_lm.initial(vocabulary).items()}
    numbers, start = rng.integers(0, 1024, (6, 5)), rng.random((6, 5)) < 0.2
    start[0] = True
    live = np.ones((6, 5), bool)
    live[4:, 4] = False
    h = np.zeros((5, gru_lm.HIDDEN))

    def loss():
        states, _, trace = gru_lm.run_window(model, numbers, start, h, True)
        return gru_lm.gradients(model, numbers, start, live, states, trace)

    grad, _ = loss()
    for name in model:
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        kept, eps = model[name][at], 1e-2
        model[name][at] = kept + eps
        up = loss()[1]
        model[name][at] = kept - eps
        down = loss()[1]
        model[name][at] = kept
        assert grad[name][at] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=2e-4), name


def test_probabilities_sum_to_one_and_state_is_carried():
    vocabulary = gru_lm.Vocabulary([(b"%d" % i, 2000 - i) for i in range(1100)], sum(range(901, 2001)), 1100)
    model = gru_lm.initial(vocabulary)
    model["cw"] += np.random.default_rng(1).normal(0, 0.3, model["cw"].shape).astype(np.float32)
    state = np.full((gru_lm.KNOWN, gru_lm.HIDDEN), 0.3, np.float32)
    assert np.exp(gru_lm.output(model, state, np.arange(gru_lm.KNOWN))[0]).sum() == pytest.approx(1, abs=1e-4)
    texts = [np.random.default_rng(i).integers(0, 1024, n).astype(np.int16) for i, n in enumerate((1, 70, 33, 5, 200))]
    alone = [gru_lm.log10_probability(model, [t])[0] for t in texts]
    assert gru_lm.log10_probability(model, texts) == pytest.approx(alone, rel=1e-4)


CASE = "</s>[INST] ok [/INST]"
wild = st.lists(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE:", "<</ROLE>>", "\\", "\\l", ">>", "<", "é", "\n", "a"]), max_size=8).map("".join)


@given(wild, wild)
@settings(max_examples=200, deadline=None)
def test_template_round_trip(role, text):
    turns = [("user", text), (role, text), ("assistant", text), ("system", text)]
    assert list(chat.parse("".join(chat.render(*t)[0] for t in turns))) == turns
    assert not re.search(r"</?s>|\[/?INST\]|<</?SYS>>|<</?ROLE", chat.escape(text))


def test_conversations(spark):
    rows = [(1, 2, "assistant", "B"), (1, 0, "system", None), (1, 1, "user", CASE), (1, 3, "user", "after"), (2, 0, "user", "no reply"),
            (3, 0, None, "x"), (3, 1, "assistant", ""), (3, 2, "assistant", "y"), (None, None, "user", "u"), (3, 2, "assistant", "y")]
    turns = spark.createDataFrame([(*r, "e") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string").repartition(3)
    examples = chat.format_conversations(turns)
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    for conv in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    shown = {(r.conv, r.example): r for r in examples.collect()}
    assert got[1].n_examples == 2 and got[3].n_examples == 3 and shown[1, 0].formatted[shown[1, 0].loss_start:shown[1, 0].loss_end] == "B"
    assert shown[1, 1].loss_start == shown[1, 1].loss_end and shown[3, 1].formatted.startswith(shown[3, 0].formatted)
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


SECRET = "password = 'Abcdef123456'"


def spans(text):
    return secrets.told(secrets.scan(text)[1])


def test_base_secrets():
    text = f"é {SECRET} AKIA{'Q' * 14} deadbeefdeadbeef0 token=short API_KEY: abc/def+ghi.jkl="
    want = []
    for kind, pattern in enumerate([r"(?ai)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", r"AKIA[A-Z0-9]+", r"[0-9a-f]+"]):
        for m in re.finditer(pattern, text):
            if len(m[m.lastindex or 0]) >= (12, 18, 16)[kind]:
                want.append((m.start(), kind, m.end()))
    assert secrets.scan(text)[0] == sorted(want) and len(want) == 4
    assert secrets.base_spans("password: token: abcdefghijkl") == [] and secrets.base_spans("ſecret=abcdefghijklmn") == []


@pytest.mark.parametrize("wrap", [
    lambda b: quote(b.decode(), safe=""), lambda b: "".join(f"\\u{ord(c):04x}" for c in b.decode()),
    lambda b: "".join(f"&#{ord(c)};" for c in b.decode()), lambda b: base64.b64encode(b).decode(),
    lambda b: base64.urlsafe_b64encode(gzip.compress(b)).decode(), lambda b: base64.b64encode(zlib.compress(b)).decode(),
    lambda b: base64.b64encode(zstandard.compress(b)).decode(), lambda b: base64.b64encode(zlib.compress(gzip.compress(b))).decode()])
def test_layers(wrap):
    inner = f"say {SECRET} end of it".encode()
    for text in (wrap(inner), quote(wrap(inner), safe=""), base64.b64encode(wrap(inner).encode()).decode(), wrap(wrap(wrap(inner).encode()).encode())):
        found = secrets.scan(f"pré {text} post")[1]
        assert any(k == 0 and 4 <= a < b <= 4 + len(text) for a, k, b in found), text
    exact = base64.b64encode(inner).decode()
    (a, _, b), = [s for s in secrets.scan(f"pré {exact}")[1] if s[1] == 0]
    assert inner.find(b"password") * 4 // 3 + 4 == a and abs(b - a - len(SECRET[:-1]) * 4 / 3) <= 4


@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress, zstandard.compress,
                                  lambda b: gzip.compress(b"first member ") + gzip.compress(b)])
def test_wrapped_and_glued_layers(pack):
    rng = random.Random(8)
    inner = "".join(f"line {i} {rng.random()}\n" for i in range(60)) + SECRET + "\nend of it\n"
    blob = base64.b64encode(pack(inner.encode())).decode()
    has = lambda text: any(k == 0 for _, k, _ in secrets.scan(text)[1])
    for width in (64, 76):
        lines = [blob[i:i + width] for i in range(0, len(blob), width)]
        assert has("pré\n" + "\n".join(lines) + "\npost") and has("\r\n  ".join(lines))
        assert has("-----BEGIN X-----\n" + "\n".join(lines) + "\n-----END X-----")
    for glue in ("key_", "path/to/", "a/b/", "abcde/"):
        assert has(f"pré {glue}{blob} post"), glue


def test_secret_across_a_line_break():
    blob = base64.b64encode(f"{'x' * 40} {SECRET} and more of it, {'y' * 40}".encode()).decode()
    text = "\n".join(blob[i:i + 64] for i in range(0, len(blob), 64))
    (a, _, b), = [s for s in secrets.scan(text)[1] if s[1] == 0]
    assert a < 64 < b and text[a:b].count("\n") == 1


def test_text_beside_other_bytes():
    inner = f"say {SECRET} end of it"
    escaped = quote(inner, safe="").replace("say", "%73%61%79")
    hidden = "".join(f"%{b:02x}" for b in inner.encode())
    plain = [s for s in secrets.scan(f"pré {hidden}")[1] if s[1] == 0]
    for odd in ("%ff", "%c3%28", "%ed%a0%80", "%f0%9f"):
        (a, _, b), = [s for s in secrets.scan(f"pré {odd}{hidden}{odd}")[1] if s[1] == 0]
        assert [(a - len(odd), 0, b - len(odd))] == plain, odd
    assert secrets.scan("%ff%fe" * 9)[2] == 0 and spans(f"%ff{escaped}") != ""
    for code in ("utf-16-le", "utf-16-be", "utf-16"):
        blob = base64.b64encode(inner.encode(code)).decode()
        (a, _, b), = [s for s in secrets.scan(f"pré {blob} post")[1] if s[1] == 0]
        exact = (inner.find("password") * 2 + 2 * (code == "utf-16")) * 4 // 3 + 4
        assert a == exact and abs(b - a - (len(SECRET) - 1) * 8 / 3) <= 6, code
    latin = f"caf\xe9 {inner} na\xefve".encode("latin-1")
    for pack in (gzip.compress, zlib.compress, zstandard.compress, lambda b: gzip.compress(b"\xff\xfe\x00" + zlib.compress(b))):
        blob = base64.b64encode(pack(latin)).decode()
        assert [s for s in secrets.scan(f"pré {blob} post")[1] if s[1] == 0] == [(4, 0, 4 + len(blob))]
    wide = base64.b64encode(gzip.compress(inner.encode("utf-16"))).decode()
    assert [s for s in secrets.scan(wide)[1] if s[1] == 0] == [(0, 0, len(wide))]


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, zstandard.compress])
def test_blobs_beyond_the_bound_are_read_to_the_end(pack, monkeypatch):
    for name, value in (("MAX_LAYER", 5000), ("PIECE", 1000), ("OVERLAP", 100)):
        monkeypatch.setattr(secrets, name, value)
    rng = random.Random(3)
    filler = lambda n: "".join(rng.choice("ghijk lmnop\n") for _ in range(n))
    for before in (100, 990, 4990, 5995, 20000):
        blob = base64.b64encode(pack((filler(before) + " " + SECRET + " " + filler(7000)).encode())).decode()
        _, found, _, oversize = secrets.scan(f"x {blob}")
        assert oversize == 1 and [s for s in found if s[1] == 0] == [(2, 0, 2 + len(blob))], before
    whole = base64.b64encode(pack(filler(30000).encode())).decode()
    assert [s for s in secrets.scan(whole)[1] if s[1] == 0] == [] and secrets.scan(whole)[3] == 1


def test_secrets_of_messy_rows(frame, messy):
    got = secrets.find_secrets(frame([*messy, (9, SECRET), (10, "%41" * 5000), (11, base64.b64encode(zlib.compress(b"0" * (1 << 27))).decode())])).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(messy) + 3 and by[9].n_assign == 1 and by[9].spans == "assign:0:24" and by[1].spans == "" and by[11].n_oversize == 1


def test_quality(frame, messy):
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(n))
    noise = base64.b85encode(bytes(rng.randrange(256) for _ in range(9000))).decode()
    half = words(700) + " " + "same again and again " * 800
    rows = [(10, words(200)), (11, "spam and more " * 90), (12, " ".join(noise[i:i + 9] for i in range(0, 9000, 9))), (13, words(49)),
            (14, "a line\n\n a line\na line\n#$"), (15, half)] + messy
    got = {r.doc_id: r.quality for r in quality.quality_metrics(frame(rows)).collect()}
    assert got[10].kept and not got[10].base_failed and not got[11].kept and got[11].base_failed and not got[12].kept
    assert got[13].base_failed and got[13].n_words == 49 and got[14].n_dup_lines == 1 and got[14].n_symbols == 2 and not got[15].kept
    assert got[1].n_words == 0 and not got[1].kept
    for doc, text in rows[:5]:
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        c = Counter(zip(w, w[1:], w[2:]))
        marked = {i + k for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for k in range(3)}
        assert (got[doc].n_words, got[doc].word_chars, got[doc].n_repeat_words) == (len(w), sum(map(len, w)), len(marked))
    assert quality.quality_metrics(frame([])).count() == 0
    assert {r.doc_id for r in quality.keep_good(frame(rows)).collect()} == {d for d in got if got[d].kept}


def _prose(rng, size):
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    out = ""
    while len(out) < size:
        out += rng.choice(words) + " "
    return out[:size]


def _noise(rng, size):
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    return "".join(rng.choice(letters) for _ in range(size))


@pytest.mark.parametrize("parts, kept", [
    ([("prose", 4096), ("noise", 4095)], False),                      # half noise in the last, partial chunk
    ([("prose", 4096), ("noise", 4096), ("noise", 4088)], False),
    ([("prose", 4096), ("noise", 4096)], False),
    ([("prose", 12288), ("noise", 1000)], True),
    ([("prose", 8191)], True), ([("prose", 4097)], True), ([("prose", 3000)], True),
    ([("noise", 4095), ("prose", 4096)], False),
])
def test_quality_measures_the_whole_text(frame, parts, kept):
    from sentigrid.llm.quality import CHUNK, chunk_starts, quality_metrics

    rng = random.Random(1)
    text = "".join((_prose if kind == "prose" else _noise)(rng, size) for kind, size in parts)
    row = quality_metrics(frame([(1, text)])).first().quality
    starts = chunk_starts(len(text))
    assert row.n_chunks == len(starts) and all(any(s <= i < s + CHUNK for s in starts) for i in range(len(text)) if starts)
    assert row.kept is kept


def test_pairs_of_neutral_terms_are_learned():
    rng = random.Random(3)
    slots, rows, labels = toxicity._Slots(), [], []
    filler = [f"w{i}" for i in range(200)]
    for k in range(1200):  # each insult and each mention is neutral: the label is decided by the pair
        a, b = k % 2, k // 2 % 2
        rows.append(toxicity.features(" ".join(rng.choices(filler, k=20) + [f"insult{a}", f"mention{b}"]).encode(), slots))
        labels.append(float(a == b))
    chi2, size = toxicity.alone(rows, np.array(labels))
    model = toxicity.fit(rows, np.array(labels))
    for a in (0, 1):
        for b in (0, 1):
            text = f"insult{a} mention{b} w1 w2 w3".encode()
            assert chi2[toxicity.features(f"insult{a}".encode(), slots)].max() < toxicity.LEAST_CHI2
            at, row = toxicity._pack([r[model["keep"][r]] for r in [toxicity.features(text, slots)]])
            score = toxicity.sigmoid(toxicity.margin(model, at, row, 1)[0])[0]
            assert score > 0.95 if a == b else score < 0.05
    noise = np.array([float(rng.random() < 0.5) for _ in rows])
    chi2, size = toxicity.alone(rows, noise)
    assert not toxicity.interacting(rows, noise, chi2, size).any()


def test_sampled_classes_are_weighted():
    rng = random.Random(5)
    slots = toxicity._Slots()
    rows = [toxicity.features(("bad " if k < 200 else "fine ").encode() * (rng.random() < 0.7) + b"x", slots) for k in range(400)]
    labels = np.array([1.0] * 200 + [0.0] * 200)
    blank = [toxicity.features(b"x", slots)]

    def score(model):
        at, row = toxicity._pack([r[model["keep"][r]] for r in blank])
        return float(toxicity.sigmoid(toxicity.margin(model, at, row, 1)[0])[0])

    even, rare = score(toxicity.fit(rows, labels)), score(toxicity.fit(rows, labels, toxic_share=0.02))
    assert abs(even - 0.5) < 0.15 and rare < 0.1
