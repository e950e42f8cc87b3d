import numpy as np
from helpers import SF_DIR, docs, fold, odd_docs, table_rows

from airlattice.llm import language, queries


def brute_grams(text):
    text = "".join(c if c.isalpha() else " " for c in text.lower())
    text = " " + " ".join(text.split()) + " "
    return [text[i : i + 3] for i in range(len(text) - 2)] if text.strip() else []


def decoded(keys):
    return ["".join(chr(int(k) >> s & 0x1FFFFF) for s in (0, 21, 42)) for k in keys]


def test_trigrams_of_each_text():
    texts = ["Hello, World", "", "a", " é è\n\n123 ñandú", "日本 語", "x1y", "--", "end."]
    keys, owner, letters = language.trigrams(texts)
    for n, text in enumerate(texts):
        assert decoded(keys[owner == n]) == brute_grams(text)
    assert letters.tolist() == [any(c.isalpha() for c in t) for t in texts]
    assert len(language.trigrams([])[0]) == 0


def test_filter_holds_all_and_rarely_more():
    rng = np.random.default_rng(1)
    langs = [f"l{i:02}" for i in range(70)]  # more than one mask word
    grams = {lang: rng.integers(0, 1 << 62, 200, dtype=np.uint64) for lang in langs}
    own = language.LanguageFilter(langs, grams)
    for i, lang in enumerate(langs):
        masks = own.languages(grams[lang])
        assert own._bit(masks[i // 64], i).all()
    strangers = own.languages(rng.integers(0, 1 << 62, 20_000, dtype=np.uint64))
    for i in (0, 69):
        assert abs(own._bit(strangers[i // 64], i).mean() - own.false_rate[i]) < 0.005


def test_held_out_accuracy(spark):
    truth = dict(table_rows(columns="doc_id, lang"))
    rows = queries.op9_language(spark, SF_DIR).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_counts_against_brute_force(spark):
    rows = table_rows(columns="doc_id, text, lang, source")[:60]
    want = {}
    for _, text, lang, _ in rows:
        for gram in brute_grams(text or ""):
            want[lang, gram] = want.get((lang, gram), 0) + 1
    found = language.gram_counts(docs(spark, rows).select("lang", "text")).collect()
    assert {(r["lang"], decoded([r["gram"]])[0]): r["n"] for r in found} == want


def test_odd_rows(spark):
    odd = odd_docs(spark)
    rows = language.predicted(odd).collect()
    assert len(rows) == odd.count()
    texts = {r["doc_id"]: r["text"] for r in odd.where("doc_id <> 4 AND doc_id <> 5").collect()}
    for r in rows:
        text = texts.get(r["doc_id"], "letters")
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] is not None:
            assert r["lang_pred"] == "en"
    unlabelled = docs(spark, [(i, "some words") for i in range(5)])
    assert {r["lang_pred"] for r in language.predicted(unlabelled).collect()} == {"und"}
    assert language.predicted(docs(spark, [])).count() == 0


def test_votes_are_corrected_and_ties_go_to_the_larger():
    own = language.LanguageFilter(["big", "small"], {"big": np.array([1], np.uint64), "small": np.array([2], np.uint64)})
    assert own.predict(["zzz", None, "12"]) == (["big", "und", "und"], [0.0, 0.0, 0.0])
