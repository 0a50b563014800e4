import itertools
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adjset.llm import encode, mix, overlap, residue, topn

DOCS = "doc_id long, text string, lang string, source string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- problem 1


@pytest.mark.parametrize("block", [2048, 2])
def test_overlaps_equal_brute_force(spark, block):
    r = random.Random(5)
    data = [(1, s, r.choice([0, r.randint(0, 30)])) for s in range(9) for _ in range(r.randint(0, 25))] + [(2, 1, 5), (2, 2, 5), (None, 1, 1), (1, None, 1), (1, 1, None)]
    df = spark.createDataFrame([(*x, "z") for x in data + data[:20]], "graph_id int, source_id long, destination_id long, size string")
    sets = {}
    for g, s, d in data:
        if None not in (g, s, d):
            sets.setdefault((g, s), set()).add(d)
    want = []
    for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2):
        if a[0] == b[0] and x & y and min(len(x), len(y)) >= 2:
            want.append((a[0], a[1], b[1], len(x), len(y), len(x & y)))
    assert rows(overlap.overlap_sizes(df, least=2, block=block)) == sorted(want, key=repr)
    half = [w for w in want if w[5] >= 0.5 * (w[3] + w[4] - w[5])]
    assert rows(overlap.overlap_sizes(df, least=2, share=0.5, block=block)) == sorted(half, key=repr)


def test_overlaps_of_nothing(spark):
    assert overlap.overlap_sizes(spark.createDataFrame([], "graph_id int, source_id long, destination_id long")).count() == 0


def test_counters_are_handed_on_when_many(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HELD", 10)
    monkeypatch.setattr(overlap, "STEP", 7)
    df = spark.range(40).selectExpr("1 graph_id", "id % 8 source_id", "id div 8 destination_id")
    assert rows(overlap.overlap_sizes(df)) == sorted([(1, a, b, 5, 5, 5) for a in range(8) for b in range(a + 1, 8)], key=repr)


# --- problem 3


@pytest.mark.parametrize("n", [0, 1, 3, 1200])
def test_top_n_equals_sorting(spark, n):
    r = random.Random(7)
    data = [(r.choice([1, 1, 1, 2, None]), r.choice([None, 1, 2, 3]), i) for i in range(3000)]
    df = spark.createDataFrame(data, "g int, score int, item long")
    got = Counter(topn.top_n(df, ["g"], ["-score", "-item"], n).collect())
    want = Counter()
    for g in (1, 2, None):
        own = sorted((x for x in data if x[0] == g), key=lambda x: (x[1] is None, -(x[1] or 0), -x[2]))
        want.update(own[:n])
    assert got == want


def test_top_n_ranks_and_empty(spark):
    df = spark.createDataFrame([(1, 5), (1, 7)], "g int, bucket int")
    assert rows(topn.top_n(df, ["g"], ["-bucket"], 1, "k")) == [(1, 7, 1)]
    assert topn.top_n(df.limit(0), ["g"], ["-bucket"], 1).count() == 0


def test_top_n_of_other_types_and_of_many_runs(spark):
    r = random.Random(8)
    data = [(r.choice(["x", "yy", None]), r.choice([None, float("nan"), -0.5, 0.0, 2.5, float("-inf")]), r.choice(["b", "ab", "\u00fc", None]), i) for i in range(400)]
    df = spark.createDataFrame(data, "g string, score double, name string, item long").repartition(9)
    nan = lambda x: x != x
    for order, key in ((["score", "-name", "item"], lambda x: (x[1] is None, nan(x[1]), x[1] if x[1] is not None and not nan(x[1]) else 0, x[2] is None, [-c for c in (x[2] or "").encode()] + [1], x[3])),
                       (["-score", "name", "item"], lambda x: (x[1] is None, not nan(x[1]), -x[1] if x[1] is not None and not nan(x[1]) else 0, x[2] is None, (x[2] or "").encode(), x[3]))):
        want = [x[3] for g in ("x", "yy", None) for x in sorted((x for x in data if x[0] == g), key=key)[:7]]
        assert sorted(x.item for x in topn.top_n(df, ["g"], order, 7, fan_in=2).collect()) == sorted(want)
    with pytest.raises(TypeError):
        topn.top_n(df.selectExpr("g", "array(item) a"), ["g"], ["a"], 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9)), max_size=9), min_size=1, max_size=7), st.integers(1, 4))
def test_loser_tree_equals_sorting(runs, n):
    import numpy as np

    runs = [sorted(x) for x in runs]
    keys, bounds = [k for x in runs for k in x], []
    for x in runs:
        bounds.append(((bounds[-1][1] if bounds else 0), (bounds[-1][1] if bounds else 0) + len(x)))
    after = np.array([next((j for j in range(i, e) if keys[j][0] != keys[i][0]), e) for s, e in bounds for i in range(s, e)], np.int64)
    got = [keys[i] for i, _ in topn.merged(bounds, keys, after, n)]
    want = []
    for g in range(4):
        want += sorted(k for k in keys if k[0] == g)[:n]
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12)), max_size=6))
def test_heap_merge_equals_counting(sets):
    runs = [sorted(x) for x in sets if x]
    ends = list(itertools.accumulate(map(len, runs)))
    got = list(overlap.merged_runs([e - len(x) for x, e in zip(runs, ends)], ends, [i for x in runs for i in x]))
    assert got == [p for i in range(13) if len(p := [k for k, x in enumerate(runs) if i in x]) > 1]


# --- problem 7


def _library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


TEXTS = [None, "", " ", "it's we'll WE'LL 'tis ''s 's's", "a  b \n\n c\t", "x" * 5000, "日本語 テキスト 😀 é ٣ Ⅷ", "<|endoftext|> hi", "same", "same", "　\x85\xa0 end ", "no-break​zero", "'"]


@pytest.mark.parametrize("block", [8 << 20, 40])
def test_ids_equal_the_library(spark, monkeypatch, block):
    monkeypatch.setattr(encode, "BLOCK_BYTES", block)
    monkeypatch.setattr(encode, "STEP_BYTES", 64)
    docs = spark.createDataFrame([(i % 11, t, "x", "y") for i, t in enumerate(TEXTS)], DOCS).repartition(3)
    t = _library()
    want = sorted(((i % 11, t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(TEXTS)), key=repr)
    got = encode.encode_corpus(docs)
    assert got.columns == ["doc_id", "ids"]
    assert rows(got) == want
    assert rows(encode.encode_corpus(docs, lengths_only=True)) == sorted(((i, len(x)) for i, x in want), key=repr)
    back = dict((r.doc_id, r.text) for r in encode.decode_corpus(got).collect())
    assert all(back[i % 11] in [x or "" for j, x in enumerate(TEXTS) if j % 11 == i % 11] for i in range(len(TEXTS)))


def test_ids_of_nothing(spark):
    assert encode.encode_corpus(spark.createDataFrame([], DOCS)).count() == 0
    assert rows(encode.encode_corpus(spark.createDataFrame([(1, None, "", "")], DOCS))) == [(1, [])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("'strevldm  \n\té日5-!😀\xa0_́\x1c٣")), max_size=40), min_size=1, max_size=5))
def test_split_equals_the_pattern(texts):
    import public_tokenizers
    import pyarrow as pa
    import regex

    data, offsets = encode.texts_of(pa.array(texts))
    at = list(encode.split(data, offsets, encode.class_table(encode.class_runs()))) + [len(data)]
    got = [data[a:b].tobytes().decode() for a, b in zip(at, at[1:])]
    assert got == [w for t in texts for w in regex.findall(public_tokenizers.PATTERN, t)]


# --- problem 8


def test_mix_meets_shares_and_caps(spark):
    r = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(r.choice(["tea", "sea", "house"]) for _ in range(r.randint(1, 60))), None, "abc"[min(2, i % 5)]) for i in range(900)] + [(1000, None, None, "a"), (1001, "x", None, None)], DOCS)
    targets = spark.createDataFrame([(1, "a", 0.6, 3), (1, "b", 0.3, 2), (1, "c", 0.1, None), (1, "none", 0.2, 3), (2, "c", 1.0, 2), (3, "none", 1.0, 1), (4, "a", None, 1)], "mix_id int, source string, target_share double, max_repeats int")
    got = mix.mix_sources(docs, targets, shard_tokens=5000).toPandas()
    n = dict((x.doc_id, x.n_tokens) for x in encode.encode_corpus(docs, lengths_only=True).collect())
    assert (got.n_tokens == got.doc_id.map(n)).all()
    assert set(got.mix_id) == {1, 2}
    assert not got.duplicated(["mix_id", "doc_id", "copy"]).any() and not got.duplicated(["mix_id", "shard", "place"]).any()
    one = got[got.mix_id == 1]
    whole = one.n_tokens.sum()
    for s, share, cap in (("a", 0.6, 3), ("b", 0.3, 2), ("c", 0.1, 1)):
        own = one[one.source == s]
        assert abs(own.n_tokens.sum() / whole - share) < 0.001 and abs(own.reached_share.iloc[0] - own.n_tokens.sum() / whole) < 1e-9
        assert own.groupby("doc_id").size().max() <= cap
    sizes = one.groupby("shard").size()
    assert len(sizes) == -(-whole // 5000) > 2 and sizes.max() - sizes.min() <= 2
    assert (one.groupby("shard").place.max() == sizes).all()
    report = {(x.mix_id, x.source): x for x in mix.mix_shares(mix.mix_sources(docs, targets), targets).collect()}
    assert report[1, "none"].reached_share == 0.0 and report[2, "c"].reached_share == 1.0 and report[2, "c"].most_repeats == 2


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([(1, "a", 0.6, 3)], "mix_id int, source string, target_share double, max_repeats int")
    assert mix.mix_sources(spark.createDataFrame([], DOCS), targets).count() == 0
    assert mix.mix_sources(spark.createDataFrame([(1, "x", None, "a")], DOCS), targets.limit(0)).count() == 0


def test_split_counts_is_exact():
    import numpy as np

    counts = np.array([5, 0, 17, 3])
    parts = mix.split_counts(counts, 7, [1, 1])
    assert (parts.sum(0) == counts).all() and parts.min() >= 0 and parts.sum(1).max() - parts.sum(1).min() <= 1


def test_split_counts_of_very_many_items():
    import numpy as np

    counts = np.array([5 * 10**9, 3, 10**9])
    got = mix.drawn(counts, 2 * 10**9, np.random.default_rng(1))
    assert got.sum() == 2 * 10**9 and (got <= counts).all() and abs(int(got[0]) - 1_666_666_666) < 10**6
    whole = np.concatenate([mix.split_counts(c, n, [1, 2], first) for first, n, c in mix._subtrees(np.array([20_000, 9]), 3 * mix.SUBTREE, [1, 2])])
    assert whole.shape == (3 * mix.SUBTREE, 2) and whole.sum(0).tolist() == [20_000, 9]


def test_documents_nearest_to_a_quota():
    import numpy as np

    assert np.array([1000, 700, 400])[mix.nearest(np.array([1000, 700, 400]), 1100.0)].sum() == 1100
    assert not mix.nearest(np.array([5, 6]), 0.0).any() and mix.nearest(np.array([5, 6]), 11.2).all()
    r = random.Random(2)
    for _ in range(50):
        t = np.array([r.randint(1, 99) for _ in range(r.randint(1, 9))])
        goal = r.uniform(0, t.sum())
        in_, off = mix.nearest(t, goal), None
        off = abs(t[in_].sum() - goal)
        for i, j in itertools.product([-1, *np.flatnonzero(in_)], [-1, *np.flatnonzero(~in_)]):
            other = t[in_].sum() - (t[i] if i >= 0 else 0) + (t[j] if j >= 0 else 0)
            assert off < 0.5 or abs(other - goal) >= off - 1e-9


def test_very_large_sources_are_cut_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(mix, "BLOCK_DOCS", 20)
    docs = spark.createDataFrame([(i, "tea " * (1 + i * 7 % 40), None, "a" if i % 3 else "b") for i in range(400)], DOCS)
    targets = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.5, 3)], "mix_id int, source string, target_share double, max_repeats int")
    got = mix.mix_sources(docs, targets, shard_tokens=2000).toPandas()
    assert abs(got[got.source == "a"].n_tokens.sum() / got.n_tokens.sum() - 0.5) < 0.001
    assert not got.duplicated(["doc_id", "copy"]).any() and got.groupby(["source", "doc_id"]).size().max() <= 3


# --- problem 9

SPOKEN = ["Where did you put the lamp?", "We found the page in the old ledger.", "Tell him the error was mine.", "No.", "I sold the wrench.", "It costs $20, or 100% of that."]
RESIDUE = ["Please enable JavaScript to see the captions.", "{{speaker}}", "Lorem ipsum dolor amet elit.", "404 Not Found", "Página no encontrada", "[INSERT NAME HERE]", "Dear %(name)s", "Site under maintenance,\nback soon", "PLEASE  ENABLE  JAVASCRIPT.", "undefined", "Fatal error: uncaught exception in /srv/cues/render.x on line 3"]
KEPT = ["Access denied. You will have to ask Mary.", "[NAME WITHHELD]", "In this lesson, {{name}} gets replaced when we render the page.", "{\\an8}Come here, Ann.", "He said the page was not found in the ledger.", "<i>Nobody knows.</i>"]


def _srt(*cues):
    return "".join(f"{i}\n00:00:0{i % 10},404 --> 00:00:0{i % 10},503\n{c}\n\n" for i, c in enumerate(cues, 1))


def _corpus(spark):
    docs = [(i, _srt(*random.Random(i).sample(SPOKEN, 4)), None, None) for i in range(300)]
    docs += [(1000 + i, _srt(SPOKEN[0], c, SPOKEN[3]), None, None) for i, c in enumerate(RESIDUE)]
    docs += [(2000 + i, _srt(SPOKEN[0], c, SPOKEN[3]), None, None) for i, c in enumerate(KEPT)]
    docs += [(3000, RESIDUE[0], None, None), (3001, _srt(SPOKEN[0]).replace("\n", "\r\n") + "Too many requests. Try again in 30 seconds.", None, None), (3002, "<html><body><h1>502 Bad Gateway</h1></body></html>", None, None)]
    docs += [(4000, None, None, None), (4001, "", None, None), (4002, " \n", None, None), (4003, _srt(*SPOKEN) * 300, None, None), (3000, RESIDUE[0], None, None), (None, RESIDUE[0], None, None)]
    return spark.createDataFrame(docs, DOCS)


def test_residue_is_found_and_speech_is_kept(spark):
    docs = _corpus(spark)
    got = [r.doc_id for r in residue.residue_documents(docs).collect()]
    want = [*range(1000, 1000 + len(RESIDUE)), 3000, 3001, 3002, None]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    left = {r.doc_id for r in residue.without_residue(docs).collect()}
    assert set(range(2000, 2000 + len(KEPT))) <= left and not left & set(range(1000, 1000 + len(RESIDUE)))


def _found(spark, cues):
    """Which of the cues, each within speech, are found among the documents of the corpus."""
    more = spark.createDataFrame([(5000 + i, _srt(SPOKEN[0], c, SPOKEN[3]), None, None) for i, c in enumerate(cues)], DOCS)
    got = {r.doc_id for r in residue.residue_documents(_corpus(spark).union(more)).collect()}
    return [c for i, c in enumerate(cues) if 5000 + i in got]


#: Cues of public wording, most of them first tried when the exemplars stood, and speech that shares words with them.
UNSEEN = """You need JavaScript to run this app.|Connection reset by peer|Segmentation fault (core dumped)|TODO: write subtitles|[ENTER DIALOGUE]|Unable to connect to the server|Exception in thread "main" java.lang.NullPointerException|Bitte JavaScript aktivieren|Error 503 Backend fetch failed
You need to enable JavaScript to run this app.|Please turn JavaScript on and reload the page.|[Your Name Here]|The requested URL /index.html was not found on this server.|504 Gateway Time-out nginx/1.14.0|Habilite JavaScript en su navegador|Hello {first_name}, welcome|[Placeholder text]|Lorem ipsum dolor sit amet|This video is no longer available.|Request ID: 8fe2a01c
An unexpected error occurred. Please try again later.|HTTP ERROR 500|Uncaught TypeError: Cannot read properties of undefined (reading 'text')|This page requires cookies and JavaScript.|Too many connections|[INSERT SONG LYRICS]|Sample caption|Server Error in '/' Application.|Error: ENOENT: no such file or directory, open 'a.srt'|Java heap space: OutOfMemoryError""".replace("\n", "|").split("|")
ALIKE = """He is gone.|The page of the book was gone.|Your session with the doctor has expired.|Access denied, said the guard.|I need scripts for the play tonight.|Something is wrong with the server, boys.|The server brought us soup.|The bridge is under maintenance.|Bad request, my friend.|He wrote his name here.|[name calling]|(text message sound)
I'm out of memory and out of time.|Forbidden fruit.|Not found.|None of them came.|The number you dialed is not available.|Your name here?|The train service is temporarily unavailable, she said.|Something went wrong with the lamp. On our side, I fear.""".replace("\n", "|").split("|")


def test_residue_of_unseen_wording():
    """With the frequencies that words have in a corpus of 10,000 documents, the rarest of them in none."""
    common = {"the": 9900, "you": 9500, "to": 9500, "a": 9500, "i": 9500, "is": 9000, "of": 9000, "and": 9000, "in": 9000, "it": 9000, "that": 9000, "on": 8500, "me": 8000, "my": 8000, "your": 7500, "this": 8000, "be": 8000, "for": 8000, "not": 8000, "with": 7500, "he": 7500, "was": 7500, "no": 7500, "have": 7500, "we": 7500, "our": 5000, "us": 5000,
              "are": 7500, "his": 5000, "has": 5000, "at": 6000, "here": 6000, "out": 6000, "them": 4000, "time": 4000, "by": 4000, "too": 3000, "many": 1500, "need": 3000, "please": 2000, "said": 2000, "she": 5000, "name": 1500, "side": 900, "wrong": 900, "something": 2500, "gone": 900, "found": 1200, "book": 500, "page": 150, "number": 400, "friend": 900, "none": 300, "file": 60, "boys": 300, "play": 400, "night": 900, "message": 90, "text": 120, "an": 4000, "went": 900}
    df = {residue.fold(t): c for t, c in common.items()} | {residue.STATUS_MARK: 180, residue.ID_MARK: 50, residue.SLOT_MARK: 160}
    index, known = residue.Index(df, 10_000), set(residue.vocabulary())

    def found(cue):
        out = set()
        for kind, window in residue._windows(cue):
            w = residue._weights(residue.terms(window))
            if not index.retrieving.isdisjoint(w):
                out.add((kind, index.verdict(kind, Counter({t: c for t, c in w.items() if t in known}), sum(c * index.idf(t) for t, c in w.items() if t not in known))))
        return ("whole", "speech") not in out and any(label not in (None, "speech") for _, label in out)

    assert sum(map(found, UNSEEN)) >= 0.85 * len(UNSEEN)
    assert not [c for c in ALIKE if found(c)]


def test_slots_in_angle_brackets(spark):
    slots = ["<INSERT NAME HERE>", "Narrator: <INSERT NAME HERE>", "- <INSERT SUBTITLE HERE>", "<NAME DER FIGUR>", "<TODO: SPEAKER NAME>", "<i>Wait.</i> <YOUR NAME>"]
    tags = ["<v Mary>Come here.", '<font title="insert name here">Come here.</font>', "<title>Come here.</title>", "<line>Come here."]
    assert _found(spark, slots + tags) == slots


def test_codes_with_punctuation(spark):
    errors = ["404: Not Found", "Error 404: servicio no disponible", "Fehler 403: Dienst nicht verfügbar", '{"status":404,"message":"upstream timed out"}', "503 Service Temporarily Unavailable"]
    speech = ["Gone.", "Forbidden.", "He came at 4:04, not found by us.", "Page 404.5 of the ledger."]
    assert _found(spark, errors + speech) == errors


def test_verdicts_do_not_change_with_the_size_of_the_corpus():
    words = {residue.fold(t): df for t, df in {"error": 50, "servicio": 20, "no": 900, "disponible": 10, "fehler": 10, "dienst": 10, "nicht": 200, "verfügbar": 10, "not": 2500, "found": 900}.items()}
    marks = {residue.STATUS_MARK: 180, residue.ID_MARK: 50, residue.SLOT_MARK: 160}
    for times in (1, 100, 3000):
        index = residue.Index({t: df * times for t, df in (words | marks).items()}, 10_000 * times)
        for text in ("Error 404: servicio no disponible", "Fehler 403: Dienst nicht verfügbar", "404: Not Found"):
            assert index.verdict("whole", residue._weights(residue.terms(text)), 0.0) == "error"
        assert index.verdict("whole", residue._weights(residue.terms("not found")), 0.0) is None


def test_frequencies_of_marks(spark):
    texts = [_srt("Error 404: gone"), "404 {{a}} 404", _srt("It is 5:04 now, or 404.5"), "".join(f"{i}\n00:00:00,404 --> 00:00:01,503\nNo.\n\n" for i in range(398, 405)), "ref 0a1b2c3d, 0a1b2c3d", "status:500", None]
    got = {r.term: r.df for r in residue.document_frequencies(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], DOCS)).collect()}
    assert [got[m] for m in residue.MARKS] == [1, 3, 1]


def test_messages_broken_over_lines(spark):
    twice = ["Página\nno encontrada", "Page\nintrouvable", "Seite\nnicht gefunden", "Página\nno\nencontrada"]
    pages = ["<html><head><title>{0}</title></head>\n<body><h1>{0}</h1><p></p></body></html>".format(x) for x in twice]
    kept = ["Where did you put the lamp?\nOn the page.\nWhere did you put the lamp?\nOn the page."]
    assert _found(spark, pages + kept) == pages


LONG = "a long text that stands for the title, " * 4


def test_long_placeholders(spark):
    bodies = ["{{ title | default: '%s' }}", "[[%s]]", "${title:-%s}", "<%%= title or '%s' %%>", "{%% if %s %%}", "#{%s}", "{{ title\n%s\n}}"]
    cues = [x % LONG for x in bodies]
    assert _found(spark, [*cues, "{{ " + LONG, "<<" + LONG + ">>"]) == cues
    assert not residue._SYNTAX.search("{{ a\n \nb }} [[ a\n\nb ]] ${ a\n\nb }")
    assert [k for k, x in residue._windows("[" + LONG + "]")].count("slot") == 1
    assert not residue._SYNTAX.search("{{ a [[ b ${ c <% d {% e " * 20_000)


def test_document_frequencies_equal_counting(spark):
    docs = _corpus(spark)
    want = Counter()
    for r in docs.collect():
        want.update({t for t in residue._TERM.findall(residue.fold(r.text or ""))})
    got = {r.term: r.df for r in residue.document_frequencies(docs).collect()}
    for t in ("lamp", "page", "javaserlpt", "wreneh", "ledger"):
        assert got[t] == want[t]


def test_residue_of_nothing(spark):
    assert residue.residue_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_queries_name_what_testdata_names():
    from adjset.llm.queries import QUERIES, SQL

    assert {"p1_found", "p3_found", "p7_ids", "p9_found"} <= set(QUERIES) and set(SQL) <= set(QUERIES)
