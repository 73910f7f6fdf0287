import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentigrid.config import Preprocess
from sentigrid.functions import stopwords as stoplists
from sentigrid.functions import text as tx
from sentigrid.functions.stemming import porter_stem, stem_tokens



def python_clean(text):
    """The same steps with Python's own Unicode-aware expressions."""
    text = re.sub(r"http\S+|www\S+", "", text)
    text = re.sub(r"[@#]\w+", "", text)
    return re.sub(r"\s+", " ", re.sub(r"[^\x00-\x7F]+", " ", text)).strip()


def test_clean_noise_cases(column):
    rows = ["@żółć hi #caféx", "see http://a.b/c?d now", "www.x.y", "a@b.com", "xhttpfoo bar", "😀😀 ok 😀", "a\t\n b",
            "😀", "", "tail https://z", "x\x1cy", "é1é"]
    assert column(rows, tx.clean_noise(F.col("text"))) == [
        "hi", "see now", "", "a.com", "x bar", "ok", "a b", "", "", "tail", "x y", "1"]
    assert column(rows, tx.clean_noise(F.col("text"))) == [python_clean(r) for r in rows]
    assert column([None], tx.clean_noise(F.col("text"))) == [None]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([*"ab @#ż😀.\n\t\x1c\u00a0\u2003é_9w", "http", "www"]), max_size=25).map("".join),
                min_size=40, max_size=40))
def test_clean_noise_like_python(column, rows):
    assert column(rows, tx.clean_noise(F.col("text"))) == [python_clean(r) for r in rows]


def test_tokenize(column):
    cases = {
        "Don't stop.": ["Do", "n't", "stop", "."],
        "it's fine, isn't it?": ["it", "'s", "fine", ",", "is", "n't", "it", "?"],
        "wait... what": ["wait", "...", "what"],
        "a (b) [c] {d}": ["a", "(", "b", ")", "[", "c", "]", "{", "d", "}"],
        "He said \"hi\" to me": ["He", "said", "``", "hi", "''", "to", "me"],
        "3.14 and 1,000: ok": ["3.14", "and", "1,000", ":", "ok"],
        "one. Two. three.": ["one", ".", "Two", ".", "three", "."],
        "cannot gonna gotta": ["can", "not", "gon", "na", "got", "ta"],
        "x--y": ["x", "--", "y"],
        "100% & #1 @me": ["100", "%", "&", "#", "1", "@", "me"],
        "they'll we've I'd": ["they", "'ll", "we", "'ve", "I", "'d"],
        "": [],
        "   ": [],
        "a b\nc": ["a", "b", "c"],
    }
    assert column(list(cases), tx.tokenize(F.col("text"))) == list(cases.values())


def test_stopwords_and_punctuation_pieces(column):
    rows = ["saya dan kamu , ... '' ` () x"]
    tokens = F.split(F.col("text"), " ")
    assert column(rows, tx.remove_stopwords(tokens)) == [["...", "''", "x"]]
    assert column(rows, tx.drop_words(tokens)) == [[",", "...", "''", "`", "()", "x"]]
    assert column(["a b a c"], tx.drop_words(F.split(F.col("text"), " "), ["b"])) == [["a", "a", "c"]]


def test_pipeline_switches(column):
    rows = ["Running runners @me, the cats!"]
    off = Preprocess(False, False, False)
    assert column(rows, tx.full_pipeline(F.col("text"), off)) == ["running runners @ me , the cats !"]
    assert column(rows, tx.full_pipeline(F.col("text"), Preprocess.extended(), stoplists.ENGLISH)) == ["running runners cats"]
    assert column(rows, tx.full_pipeline(F.col("text"), Preprocess.compact(), stoplists.ENGLISH)) == ["run runner cat"]
    assert column(["not the yang dan x"], tx.full_pipeline(F.col("text"), Preprocess.extended())) == ["not the x"]


def test_trace_ends_with_the_pipeline_result(texts, column):
    rows = ["See the Cats, #now!", "plain"]
    for options in (Preprocess.compact(), Preprocess(False, True, False)):
        steps = tx.trace_steps(texts(rows), options).collect()
        last = {r.doc_id: r.result for r in steps if r.step == "final"}
        assert [last[i] for i in range(2)] == column(rows, tx.full_pipeline(F.col("text"), options))
        numbers = sorted({r.step_no for r in steps})
        assert numbers == list(range(len(numbers)))
        assert {r.result for r in steps if r.step_no == 0} == set(rows)


def test_preprocess_text(column):
    assert column(["Don't @stop, the cats!", None], tx.preprocess_text(F.col("text"), stem=False, words=stoplists.ENGLISH)) == ["dont stop cats", ""]


def test_counts_and_blank(column):
    assert column(["a  b\tc", "", "  ", "x y"], tx.word_count(F.col("text"))) == [3, 0, 0, 2]
    assert column([None, "", " \n ", "x"], tx.is_blank(F.col("text"))) == [True, True, True, False]


def test_decode_bytes(spark):
    cases = [b"plain", "żółć".encode(), b"a\xffb", b"\xc3", "ok � end".encode(), "x�".encode() + b"\xff"]
    frame = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(cases)], "i int, b binary")
    got = {r.i: r.t for r in frame.select("i", tx.decode_bytes(F.col("b")).alias("t")).collect()}
    assert [got[i] for i in range(len(cases))] == [b.decode("utf-8", errors="ignore") for b in cases]


def test_porter_examples():
    pairs = """caresses caress ponies poni ties tie caress caress cats cat feed feed agreed agre plastered plaster
        bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan
        falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat
        conditional condit rational ration valenci valenc digitizer digit conformabli conform radicalli radic
        differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper
        feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit
        sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr
        hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop
        adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend
        adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog
        effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
        dying die news news is is enjoy enjoy""".split()
    words, stems = pairs[::2], pairs[1::2]
    assert [porter_stem(w) for w in words] == stems


def test_stem_column(column):
    assert column(["running cats", "", None], stem_tokens(tx.non_empty(F.split(F.col("text"), " ")))) == [["run", "cat"], [], None]


def test_feature_terms(column):
    assert column(["A ab é1_x, c-de"], tx.feature_terms(F.col("text"))) == [["ab", "é1_x", "de"]]


def test_words_go_through_the_steps_as_whole_texts_do(column):
    rows = ["'tis \"quoted\" cannot. we'll, more'n a.b. x,1 1,000: ''s 'a b' end.) (...) -- $5", "'twas", "", None, "Kİ gonna! \x1c é``x`",
            "see www.a.b @me #tag don't. 'a' ' "]
    steps = tx.tokenize(tx.case_fold(tx.clean_noise(F.col("text"))), plain_spaces=True)
    assert column(rows, tx.cleaned_tokens(F.col("text"))) == column(rows, steps)
    assert column(rows, tx.full_pipeline(F.col("text"), Preprocess.compact())) == column(
        rows, F.array_join(tx.stem_tokens(tx.remove_stopwords(steps)), " "))


def test_preparation_runs_no_tokenizer_regex_over_whole_texts(texts):
    plan = texts(["a"]).select(tx.full_pipeline(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "(can)(not)" not in plan and "\\.{2,}" not in plan


def test_words_with_a_final_mark_are_prepared_in_bulk_as_step_by_step(column):
    rows = ["start. yang. yang! Cannot. a.. 1. gonna? x-y: end,", "b. ! .. (car). don't. A.", "a.\tb, c;", ""]
    by_step = tx.tokenize(tx.case_fold(tx.clean_noise(F.col("text"))))
    assert column(rows, tx.prepare_tokens(F.col("text"))) == column(rows, tx.remove_stopwords(by_step))
    assert column(rows, tx.cleaned_tokens(F.col("text"))) == column(rows, by_step)
    terms = tx.feature_terms(F.array_join(tx.remove_stopwords(by_step), " "))
    assert column(rows, tx.term_text(F.col("text"))) == column(rows, F.array_join(terms, " "))
