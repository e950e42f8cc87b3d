import random

import numpy as np
from helpers import CLASHING, docs, fold, odd_docs, table_rows

from airlattice.llm import queries, toxicity


def corpus(n=600, seed=1):
    """Documents of sentences; toxic ones hold one to three offending words in one sentence."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    rows, labels = [], []
    for i in range(n):
        text = [[rng.choice(words) for _ in range(rng.randint(3, 12))] for _ in range(rng.randint(1, 15))]
        toxic = i % 5 == 0
        if toxic:
            bad = rng.choice(text)
            bad.insert(rng.randrange(len(bad)), rng.choice(["zbadword", "qvile", "qviler", "kfoul"]))
        rows.append((i, ". ".join(map(" ".join, text)) + "."))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def labelled(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_from_documents_and_locates_sentences(spark):
    rows, labels = corpus()
    truth = {i: t for i, _, t in labels}
    frame, known = docs(spark, rows), labelled(spark, labels)
    for r in toxicity.scored(frame, known).collect():
        assert r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (fold(r["doc_id"], 3) == 1)
        assert r["predicted"] == truth[r["doc_id"]], r
    model = spark.sparkContext.broadcast(toxicity.fit(frame, known))
    places = {r["doc_id"]: r for r in toxicity.offending(frame, model).collect()}
    assert set(places) == {i for i, t in truth.items() if t}
    for i, r in places.items():
        sentence = dict(rows)[i][r["start"] : r["end"]]
        assert any(w in sentence for w in ("zbadword", "qvile", "kfoul")) and "." not in sentence
    clean = toxicity.keep_clean(frame, known)
    assert clean.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHING]
    assert {r["doc_id"] for r in clean.collect()} == {i for i, t in truth.items() if not t}


def test_copies_leave_room_for_other_texts(spark, monkeypatch):
    """A text with many labelled copies is trained on once, and is toxic if one copy is."""
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 150)
    rows, labels = corpus()
    # Copies of one toxic text, the first of them labelled otherwise; a row that is there twice.
    more = [(1000 + i, rows[0][1]) for i in range(900)]
    frame = docs(spark, [*rows, *more, rows[5], rows[5]])
    known = labelled(spark, [*labels, *[(i, 1, int(i > 1000)) for i, _ in more]])
    found = sorted((r["text"], r["toxic"]) for r in toxicity.sample(frame, known).collect())
    trains = {t for (i, t), (_, _, y) in zip(rows, labels) if y and fold(i, 3) != 1} | {rows[0][1]}
    assert len({t for t, _ in found}) == len(found)
    assert {t for t, y in found if y} == trains
    truth = {i: y for i, _, y in labels}
    predicted = {r["doc_id"]: r["predicted"] for r in toxicity.scored(frame, known).where("doc_id < 1000").collect()}
    assert predicted == truth


def test_gradient_is_that_of_the_likelihood():
    """One weight at a time, trained weights are a stationary point."""
    rows, labels = corpus(300, 2)
    bags, y = [toxicity.bags(t) for _, t in rows], [t for _, _, t in labels]
    model = toxicity.train(bags, y)

    def loss(weights):
        own, total = toxicity.Scorer(weights), 0.0
        for (_, text), label in zip(rows, y):
            p = min(max(own.score(text), 1e-12), 1 - 1e-12)
            total -= np.log(p if label else 1 - p)
        penalty = sum(w * w for e, w in weights.items() if e)
        return total + toxicity.PENALTY * penalty * len(rows) / 200

    at = loss(model)
    assert at < 30
    for e in [*list(model)[:4]]:
        for step in (0.5, -0.5):
            assert loss(model | {e: model[e] + step}) > at - 0.5


def test_noisy_or():
    own = toxicity.Scorer({"": -1.0, "bad": 2.0, "wors*": 1.0})
    p = lambda z: 1 / (1 + np.exp(-z))
    assert own.score("bad. fine. BAD bad worst!\nnothing") == 1 - (1 - p(1.0)) * (1 - p(2.0))
    assert own.score(None) == own.score("") == own.score("fine words. more of them.") == 0.0


def test_real_table(spark):
    """Held-out labels of the table at hand: offending words of languages with few examples may be missed."""
    sf_dir = "/root/testdata/sf0.01"
    truth = dict(table_rows("labels", "doc_id, toxic", sf_dir))
    rows = queries.op10_toxicity(spark, sf_dir).collect()
    assert len(rows) == len(table_rows(columns="doc_id", sf_dir=sf_dir))
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p == t for p, t in held]) > 0.9
    assert sum(p and not t for p, t in held) <= 0.02 * len(held)


def test_odd_rows_and_labels(spark):
    odd = odd_docs(spark)
    labels = labelled(spark, [(1, 1, 1), (1, 1, 0), (2, 1, None), (None, 0, 1), (999, 0, 1)])
    rows = toxicity.scored(odd, labels).collect()
    assert len(rows) == odd.count() and {r["score"] for r in rows} == {0.0}
    assert toxicity.keep_clean(odd, labels).count() == odd.count()
    rows, known = corpus(200)
    more = odd.unionByName(docs(spark, [(100 + i, t) for i, t in rows]))
    known = labelled(spark, [(100 + i, q, t) for i, q, t in known])
    found = toxicity.scored(more, known).collect()
    assert len(found) == more.count()
    assert all(r["score"] == 0.0 for r in found if r["doc_id"] is None or r["doc_id"] < 100)
    assert toxicity.scored(docs(spark, []), known).count() == 0
    assert toxicity.scored(odd, labelled(spark, [])).agg({"score": "max"}).first()[0] == 0.0
