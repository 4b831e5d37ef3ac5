"""Sentences, leakage, mixing and scan repair against brute force and stated cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import leakage, mixing, scans
from lodestrata.llm import sentences as sent

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PARAS = [
    "The pump restarts by itself... unless the valve is locked. Store at max. 40 percent humidity. Call loadItem() first.",
    "Refer to Dr. Ostrel for questions, e.g. about Fig. 3.5 and No. 7. The log reads \"Link lost. Retry?\" until it is cleared. Parts include seals, etc. Nothing else (see para. 2.1.) applies!",
    "Store the unit dry. Refer to the annex. Call the operator. Parts are listed below.",
]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, p) for i, p in enumerate(PARAS * 20)] + [(1000 + i, f"Store {i} units. Refer to No. {i}.\n\nCall unit {i}. Parts {i} follow.\n\nNothing is lost. The end is near.") for i in range(60)]
    return sent.train(spark.createDataFrame(rows, "doc_id long, text string"))


def cut(text, model):
    return [text[a:b] for a, b in sent.units(text, model)]


def test_abbreviations_and_quotations(model):
    assert cut(PARAS[1], model) == ["Refer to Dr. Ostrel for questions, e.g. about Fig. 3.5 and No. 7.", "The log reads \"Link lost. Retry?\" until it is cleared.", "Parts include seals, etc.", "Nothing else (see para. 2.1.) applies!"]
    assert cut(PARAS[0], model)[0] == "The pump restarts by itself... unless the valve is locked."


def test_lines_lists_and_headings(model):
    t = "## Scope\n\nStore the unit\ndry. Refer to it.\n \nSteps for the operator:\n- Store it. Twice.\n- Call\n\nNOTES"
    assert cut(t, model) == ["## Scope", "Store the unit\ndry.", "Refer to it.", "Steps for the operator:", "- Store it. Twice.", "- Call", "NOTES"]


def test_other_scripts(model):
    assert cut("终端支持配置。屏幕显示“中断。是否重试？”，随后停止。严禁打开！", model) == ["终端支持配置。", "屏幕显示“中断。是否重试？”，随后停止。", "严禁打开！"]
    assert cut("画面に「切れました。再試行しますか？」と表示する。終わり。", model) == ["画面に「切れました。再試行しますか？」と表示する。", "終わり。"]
    assert cut("यह ठीक है। क्या यह जुड़ा है? नहीं!", model)[0] == "यह ठीक है।"


def test_sentence_edge_cases(spark, model):
    long = "Store the unit dry. " * 4000
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (4, long, "x"), (5, "A \"quote that never ends. Store it. Call it.", "x"), (6, "...", "x")]
    out = sent.sentences(spark.createDataFrame(rows, "doc_id long, text string, start_char string"), model=model)
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append((r["start_char"], r["end_char"]))
    assert set(got) == {4, 5, 6} and len(got[4]) == 4000
    for i, t in ((4, long), (5, rows[4][1])):
        spans = sorted(got[i])
        assert all(a < b and t[a:b].strip() == t[a:b] for a, b in spans) and "".join(t[a:b] for a, b in spans).replace(" ", "") == t.replace(" ", "")
    assert sent.sentences(spark.createDataFrame([], "doc_id long, text string"), model=model).count() == 0


def test_empty_model(spark):
    m = sent.train(spark.createDataFrame([], "doc_id long, text string"))
    assert [a for a in cut("One is here. Two is there.", m)] == ["One is here.", "Two is there."]


# ---- leakage


def brute_leaks(docs, items, n=13):
    grams = lambda t: {tuple(w[i : i + n]) for w in [leakage.words(t)] for i in range(len(w) - n + 1)}
    g = {i: grams(t) for i, t in items}
    return {(d, i) for d, t in docs for i in g if grams(t) & g[i]}


def test_leaks_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 13, 30])))) for i in range(12)]
    docs = []
    for d in range(80):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        if d % 3 == 0:
            src = items[d % 12][1].split()
            a = rng.randrange(max(1, len(src) - 13))
            w[len(w) // 2 : len(w) // 2] = src[a : a + rng.choice([12, 13, 20])]
        docs.append((d, " ".join(w).upper() if d % 2 else ",\n".join(w)))
    docs += [(900, None), (901, ""), (902, docs[0][1]), (902, docs[0][1])]
    df = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item_id string").drop("item_id")
    it = spark.createDataFrame([*items, (99, None)], "item_id long, passage string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(df, it).where("n_literal > 0").collect()}
    assert got == brute_leaks([(d, t or "") for d, t in docs], items)
    assert leakage.leaks(df, it.where("false")).count() == 0 and leakage.leaks(df.where("false"), it).count() == 0


def test_templates_need_consistent_slots(spark):
    p = "the clerk copies form 176 onto form 176 and keeps 30 mm of tape near crate 69 for the next 11 days"
    docs = [(1, p), (2, p.replace("176", "555").replace("69", "70")), (3, p.replace("form 176 onto form 176", "form 555 onto form 556"))]
    it = spark.createDataFrame([(7, p)], "item_id long, passage string")
    r = {x["doc_id"]: (x["n_literal"], x["n_template"]) for x in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), it).collect()}
    assert r[1][0] > 0 and r[2][0] == 0 and r[2][1] > 0
    assert r.get(3, (0, 0))[1] < r[2][1]


# ---- mixing


def test_mixture_reaches_shares(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice("aaabbc") if i % 10 else None, " ".join(["word"] * rng.randrange(1, 80))) for i in range(3000)] + [(5000, "a", None), (5001, "a", "")]
    targets = [("a", 0.3, 1), ("b", 0.3, 2), ("c", 0.3, 4), ("none", 0.1, 2), ("a", 0.3, 1)]
    copies, shares = mixing.mixture(spark.createDataFrame(docs, "doc_id long, source string, text string"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), VOCABULARY)
    cap = {"a": 1, "b": 2, "c": 4}
    rows = copies.collect()
    assert {r["doc_id"] for r in rows} == {i for i, s, t in docs if s and t} and all(0 <= r["copies"] <= cap[r["source"]] for r in rows)
    sh = {r["source"]: r for r in shares.collect()}
    assert sh["none"]["actual_share"] == 0 and all(abs(sh[s]["actual_share"] - 1 / 3) < 0.005 for s in "abc")
    used = {s: sum(r["copies"] * r["tokens"] for r in rows if r["source"] == s) for s in "abc"}
    assert used == {s: sh[s]["tokens"] for s in "abc"}
    # the source that limits the mixture is used as often as it may be
    assert any(all(r["copies"] == cap[s] for r in rows if r["source"] == s) for s in "abc")


def test_mixture_empty_and_long(spark):
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    copies, shares = mixing.mixture(spark.createDataFrame([], "doc_id long, source string, text string"), t, VOCABULARY)
    assert copies.count() == 0 and [r["actual_share"] for r in shares.collect()] == [0.0]
    enc = mixing._encoder(VOCABULARY)
    assert mixing._count(enc, "ab cd " * 20_000) == pytest.approx(len(enc.encode_ordinary("ab cd " * 20_000)), abs=10)


def test_slots_are_consistent_throughout(spark):
    """Two questions of which a document holds copies with other numbers: one copy maps 176 to 555 throughout, in the other
    the second mention differs. Windows alone could not tell them apart, as the mentions are further apart than a window."""
    tail = "which the operator of the plant writes down in the log before the end of the shift on every day of the week and then closes"
    q = f"A pump moves 176 litres in one hour through the main pipe of the plant, {tail} the valve behind the 176 litre tank of the yard"
    good, bad = q.replace("176", "555"), q.replace("176", "555", 1).replace("176", "9")
    docs = spark.createDataFrame([(1, "x " + good), (2, bad + " y"), (3, q), (4, None), (5, good + " " + bad)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_literal"] > 0, r["n_template"] > 0) for r in leakage.leaks(docs, spark.createDataFrame([(7, q)], "item_id long, passage string")).collect()}
    # the windows between the mentions are literal in all copies
    assert got == {1: (True, True), 2: (True, False), 3: (True, False), 5: (True, True)}


def test_planted_questions_precision(spark):
    """60 items; 30 re-parameterised copies and 30 texts that only share their words: all copies found, nothing else."""
    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in ("pla", "ten", "mor", "sig", "dal", "vor", "kel", "rup") for b in ("an", "et", "il", "os", "um", "ar", "en", "is")]
    items, docs = [], []
    for i in range(60):
        ws = [rng.choice(vocabulary) for _ in range(30)]
        for k in (4, 11, 19, 25):
            ws[k] = str(rng.randrange(10, 99))
        items.append((i, " ".join(ws)))
        change = {w: str(rng.randrange(100, 999)) for w in ws if w.isdigit()}
        if len(set(change.values())) == len(change) and i % 2:
            docs.append((i, " ".join(rng.choice(vocabulary) for _ in range(20)) + " " + " ".join(change.get(w, w) for w in ws)))
        else:
            docs.append((1000 + i, " ".join(rng.sample(ws, len(ws)))))
    out = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string"))
    got = {(r["doc_id"], r["item_id"]) for r in out.where("n_template > 0").collect()}
    assert got == {(d, d) for d, _ in docs if d < 1000}


def test_spans_by_brute_force(model):
    """The span programme against trying every start, on random texts with quotations, brackets and long runs."""
    rng = random.Random(9)
    words = ["Store", "it", "the", "unit", "Call", "etc.", "No.", "done.", "lost!", "(see", "it.)", '"Link', 'up."', "x.", "„Gut.", "so.“", "valve" * 9]

    def brute(text):
        a, b = 0, len(text)
        cs = sent.candidates(text, a, b)
        if not cs:
            return 0.0
        depth, nest, starts, ends, odds = sent.lattice(text, a, b, cs, model)
        n = len(ends)
        best, back = [0.0] + [-1e18] * n, [0] * (n + 1)
        for j in range(1, n + 1):
            for i in range(j - 1, -1, -1):
                size = ends[j - 1] - starts[i]
                s = best[i] + odds[j - 1] - (3.0 if size < 3 else 0.0) - sent.SLOPE * max(0, size - sent.LONG) - sent.NESTED * sent._apart(nest[i], depth[j - 1])
                if s > best[j] + 1e-9:
                    best[j], back[j] = s, i
        return best[n]

    def worth(text, spans):
        cs = sent.candidates(text, 0, len(text))
        if not cs:
            return 0.0
        depth, nest, starts, ends, odds = sent.lattice(text, 0, len(text), cs, model)
        total = 0.0
        for x, y in spans:
            i, j = starts.index(x), ends.index(y)
            total += odds[j] - (3.0 if y - x < 3 else 0.0) - sent.SLOPE * max(0, y - x - sent.LONG) - sent.NESTED * sent._apart(nest[i], depth[j])
        return total

    for k in range(60):
        t = " ".join(rng.choice(words) for _ in range(rng.choice([5, 40, 300])))
        got = sent.cut(t, 0, len(t), model)
        assert got[0][0] == 0 and got[-1][1] == len(t) and worth(t, got) == pytest.approx(brute(t), abs=1e-6), k


def test_many_places_in_one_sentence(model):
    """1,000 abbreviations in one sentence: one unit, however many places there are."""
    t = "Order " + ", ".join(f"No. {i}" for i in range(1000)) + " today. Call the operator."
    got = cut(t, model)
    assert len(got) == 2 and got[1] == "Call the operator."


# ---- scans


def scan_tables(spark):
    clean = "The message router shall be verified within ten seconds of the change in the timing module."
    blocks = [(1000 + i, 50 + i % 7, i, i % 3 + 1, "text", clean, 14, "") for i in range(60)]
    other = "Store every unit of a dry lot, call your operator and close both valves before another service begins."
    blocks += [(2000 + i, 60 + i % 7, i, i % 3 + 1, "text", other, 17, "") for i in range(60)]
    blocks += [
        (1, 1, 0, 1, "text", "QS-3017F  Timing rules\nThe rnessage router shall be veri-\nfied within ten sec0nds ofthe change in", 9, ""),
        (2, 1, 1, 1, "text", "NOTE Keep this page with the unit.", 7, ""),
        (3, 1, 2, 1, "text", "- 4l -", 1, ""),
        (4, 1, 3, 2, "text", "the timing module.\n5", 3, ""),
        (4, 1, 3, 2, "text", "the timing module.\n5", 3, ""),
        (5, 1, 4, 2, "text", None, 0, ""),
        (6, 1, 5, 2, "table", "TABLE 1\nrn", 2, ""),
        (7, 1, 6, 2, "text", "The message rou-", 3, ""),
        (8, 1, 7, 3, "text", "ter shall be verified.\n- 43 -", 4, ""),
        (9, 9, None, None, None, "", 0, ""),
    ]
    b = spark.createDataFrame(blocks, "block_id long, doc_id long, seq int, page int, kind string, text string, word_count int, title string")
    d = spark.createDataFrame([(1, "Timing rules", "qs-3017f_1.pdf", "QS-3017"), (50, None, None, None)], "doc_id long, title string, filename string, series string")
    return b, d


def test_scan_repairs(spark):
    res = scans.repair(*scan_tables(spark))
    got = {tuple(r) for r in res["found"].collect()}
    want = {
        (1, "line", "QS-3017F  Timing rules", ""), (3, "line", "- 4l -", ""), (4, "line", "5", ""), (8, "line", "- 43 -", ""),
        (1, "word", "rnessage", "message"), (1, "word", "veri-fied", "verified"), (1, "word", "sec0nds", "seconds"), (1, "word", "ofthe", "of the"), (7, "word", "rou-ter", "router"),
        (4, "join", "1", ""), (8, "join", "7", ""),
    }
    assert got == want
    paras = {r["paragraph"]: r["text"] for r in scans.paragraphs(res).where("doc_id = 1").collect()}
    assert re.match(r"The message router shall be verified within ten seconds of the change in the timing module\.$", paras[1])
    assert paras[7] == "The message router shall be verified." and set(paras) == {1, 2, 7}


def test_scan_empty(spark):
    b, d = scan_tables(spark)
    res = scans.repair(b.where("false"), d)
    assert res["found"].count() == 0 and scans.paragraphs(res).count() == 0
    assert scans.repair(b.where("doc_id >= 50"), d.where("false"))["found"].count() == 0


def test_line_rules():
    assert all(scans.NUMBER.match(x) for x in ("- 49 -", "3-l", "iv", "Page 40 of 41", "5O", "2-12"))
    assert not any(scans.NUMBER.match(x) for x in ("the", "287.", "10 mm", "K3.5"))
    h = lambda x: scans.is_header(x, "Torque value of the timing module", "gs-639f_12.pdf", "GS-639")
    assert all(map(h, ("GS-639F Torque value of the timing modiile", "TORQUE VALUE OF THE TIMING MODULE", "66 | GS-639F", "GS-639F (27 June 2015)", "Torque value of the t|ming module | 2 March 2011")))
    assert not h("The torque value of the timing module is pending") and not h("See GS-639F for the rest")
    assert scans.tokens(["two-", "stage a-", "b."]) == [("two-stage", "b"), ("a-b", "b")]
    assert "message" in scans.variants("rnessage") and "module" in scans.variants("modiile")


CONTEXTS = ["Close the {} of the bottle before storage and tighten it well", "Drive the {} to the garage after dark and park it well"]


def context_tables(spark, word):
    """'lemp' (120 times) and 'lamp' (40 times) on clean pages, each with its own surroundings; ``word`` on a scanned page
    where the second one stands."""
    rows = [(1000 + i, 50 + i % 9, i, i % 5 + 1, "text", CONTEXTS[0].format("lemp") + ".") for i in range(120)]
    rows += [(3000 + i, 70 + i % 9, i, i % 5 + 1, "text", CONTEXTS[1].format("lamp") + ".") for i in range(40)]
    rows += [(1, 1, 0, 1, "text", CONTEXTS[1].format(word) + "\n- 4 -")]
    b = spark.createDataFrame(rows, "block_id long, doc_id long, seq int, page int, kind string, text string")
    return b, spark.createDataFrame([(1, None, None, None)], "doc_id long, title string, filename string, series string")


def repaired(res):
    return {(r["damaged"], r["repaired"]) for r in res["found"].where("kind = 'word'").collect()}


def test_context_beats_frequency(spark):
    """'lomp' is one edit of the same cost from both words; the more frequent one is wrong here."""
    got = repaired(scans.repair(*context_tables(spark, "lomp")))
    assert got == {("lomp", "lamp")}


def test_without_vectors_nothing_is_linked(spark, monkeypatch):
    """Neighbours in the vector space nominate links: with zero vectors there are none, with untrained ones far fewer."""
    whole = repaired(scans.repair(*scan_tables(spark)))
    monkeypatch.setattr(scans, "learn_vectors", lambda spark, text, freq, epochs=0: (np.zeros((len(freq), scans.DIM), np.float32),) * 2)
    none = repaired(scans.repair(*scan_tables(spark)))
    assert ("rnessage", "message") in whole and ("ofthe", "of the") in whole
    assert not any(d in ("rnessage", "sec0nds", "ofthe") for d, _ in none)


def test_two_edits_meet_in_the_middle():
    """Every word two edits away is found over a word in between, at the cost of both."""

    def brute(form):
        out = {}
        for m, c in scans._edit(form, scans.FROM).items():
            for w, d in scans._edit(m, scans.FROM).items():
                out[w] = min(out.get(w, 9), c + d)
        return out

    for form, entry in (("rnessagc", "message"), ("niodu1e", "module"), ("x" * 300 + "rn1", "x" * 300 + "ml")):
        back = {m: c for m, t, c in scans.sources(entry) if t == entry}
        met = [c + back[m] for m, c in scans.halfway(form, "").items() if m in back]
        assert min(met) == pytest.approx(brute(form)[entry])
    assert scans.sources("message")[-1][1] == "Message"


def test_furniture_at_any_depth(spark):
    """Five lines of furniture above the text, none of them named, each recurring on every page."""
    head = ["Confidential copy", "Workshop seven", "Printed for the archive", "Volume B", "Sheet of the owner", "x" * 300 + " margin"]
    rows = [(i, 1, i, i, "text", "\n".join([*head, f"The valve number {i} shall be closed.", "It stays closed until the end."])) for i in range(1, 6)]
    b = spark.createDataFrame(rows, "block_id long, doc_id long, seq int, page int, kind string, text string")
    d = spark.createDataFrame([(1, None, None, None)], "doc_id long, title string, filename string, series string")
    got = {(r["block_id"], r["damaged"]) for r in scans.repair(b, d)["found"].where("kind = 'line'").collect()}
    assert got == {(i, h) for i in range(1, 6) for h in head}


def test_long_words(spark):
    """A word of 400 characters is corrected with ``longest=None`` and left alone by default."""
    long = "ab" * 200
    rows = [(1000 + i, 50 + i % 7, i, i % 3 + 1, "text", f"The code {long} opens the gate of the yard.") for i in range(30)]
    rows += [(1, 1, 0, 1, "text", f"The code {long[:-1]}h opens the gate of the yard.\n- 4 -")]
    b = spark.createDataFrame(rows, "block_id long, doc_id long, seq int, page int, kind string, text string")
    d = spark.createDataFrame([(1, None, None, None)], "doc_id long, title string, filename string, series string")
    assert repaired(scans.repair(b, d, longest=None)) == {(long[:-1] + "h", long)} and repaired(scans.repair(b, d)) == set()


def test_skipgram_tells_contexts_apart():
    rng = np.random.default_rng(0)
    v, u = scans.start_tables()
    freq = np.zeros(scans.SLOTS)
    sents = [np.array([10, 11, 12, 13] if rng.random() < 0.5 else [20, 21, 22, 23]) for _ in range(4000)]
    for s in sents:
        freq[s] += 1
    for ep in range(2):
        seen = scans.train_skipgram(iter(sents), v, u, freq, batch=512, seed=ep)
    assert seen.sum() == freq.sum()
    assert v[11] @ u[12] > v[11] @ u[22] + 1
