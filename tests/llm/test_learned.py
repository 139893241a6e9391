"""Classifiers by held-out accuracy, and the pipeline stage by stage on planted cases."""

import zlib

import pytest

import corpus_pipeline
from driftline.llm import quality_classifier, toxicity
from driftline.llm.common import table

SMALL = "/root/testdata/sf0.01"


def ranks(score, label):
    """Share of (1, 0) pairs that the score orders rightly."""
    ones, zeros = [s for s, y in zip(score, label, strict=True) if y], [s for s, y in zip(score, label, strict=True) if not y]
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))


@pytest.mark.parametrize(("query", "label", "folds", "held", "least"), [(toxicity.op9_toxicity, "toxic", 4, 2, 0.8), (quality_classifier.op8_quality_classifier, "quality", 5, 0, 0.85)], ids=["toxicity", "quality"])
def test_held_out_order(spark, query, label, folds, held, least):
    rows = query(spark, SMALL).collect()
    assert len(rows) == table(spark, SMALL, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    y = {r["doc_id"]: r[label] for r in table(spark, SMALL, "labels").collect()}
    out = [r for r in rows if r["held_out"] and r["doc_id"] in y]
    assert ranks([r["score"] for r in out], [y[r["doc_id"]] for r in out]) >= least


def test_scores_are_the_plain_sum_over_pairs():
    np, rng = toxicity.np, toxicity.np.random.default_rng(2)
    made = [np.unique(rng.integers(0, 60, 12)).astype(np.int32) for _ in range(300)]
    machine = toxicity.fit(made, np.array([int(bool({3, 5} & {*x.tolist()}) or rng.random() < 0.1) for x in made]))
    assert len(machine.weights) > 0
    for doc in made[:40]:
        kept = [int(machine.place[t]) for t in doc if machine.place[t] >= 0]
        z = machine.bias + sum(machine.weights[i] for i in kept)
        z += sum(float(machine.factors[i] @ machine.factors[j]) for n, i in enumerate(kept) for j in kept[:n])
        assert abs(machine.scores([doc])[0] - 1 / (1 + np.exp(-z))) < 1e-9


def test_scores_are_the_plain_forward_pass():
    np, rng = quality_classifier.np, quality_classifier.np.random.default_rng(9)
    net = quality_classifier.fit([b"clean words " * 9, b"*** $$$ ### " * 9] * 20, np.array([1, 0] * 20))
    kernel = np.concatenate([net.first, net.second]).reshape(quality_classifier.WIDTH, quality_classifier.EMBED, -1)
    step = quality_classifier.STRIDE
    for n in (0, 1, 7, 8, 9, 30, 100):
        text = bytes(rng.integers(32, 127, n, dtype=np.uint8))
        # to whole steps, and one step of padding more
        symbols = [*text] + [256] * (max(1, -(-n // step)) * step + step - n)
        windows = [symbols[i : i + 8] for i in range(len(symbols) - 7)]
        hidden = np.array([sum(net.embed[s] @ kernel[k] for k, s in enumerate(w)) + net.bias for w in windows])
        z = float(np.maximum(hidden.max(0), 0) @ net.out + net.shift)
        assert abs(net.scores([text])[0] - 1 / (1 + np.exp(-z))) < 1e-5


def test_samples_are_one_row_an_id_and_drawn_by_hash_alone(spark):
    from driftline.llm.labelled import sample

    docs = spark.createDataFrame([(i, "x" * (10_000 if i % 50 == 0 else 10)) for i in range(1000)] + [(1, "y")] * 5, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)] + [(3, 1)] * 4, "doc_id long, toxic int")
    learn = toxicity.F.lit(True)
    every = sample(docs, labels, "toxic", learn, 10**6, 10**9).collect()
    assert len(every) == len({r["doc_id"] for r in every}) == 1000
    some = sample(docs, labels, "toxic", learn, 300, 10**9).collect()
    assert 230 < len(some) < 370
    few = sample(docs, labels, "toxic", learn, 300, sum(len(r["text"]) for r in some) // 3).collect()
    assert {r["doc_id"] for r in few} < {r["doc_id"] for r in some}
    assert max(len(r["text"]) for r in some + few) == 10_000
    assert sample(docs.where("false"), labels, "toxic", learn, 300, 10).count() == 0


def test_terms_that_tell_only_in_pairs_have_factors():
    np, terms = toxicity.np, toxicity.Terms()
    docs = [(a, b, i) for i in range(200) for a in (0, 1) for b in (0, 1)]
    made = [terms.of(f"{'ins' if a else 'kind'} {'grp' if b else 'none'} filler{i % 7}") for a, b, i in docs]
    y = [int(a != b) for a, b, _ in docs]
    machine = toxicity.fit(made, np.array(y))
    assert ranks(machine.scores(made), y) > 0.9
    # a group word that is neutral alone: 1,000 of 4,000 documents, a share of label 1 near that of all
    rng = np.random.default_rng(3)
    made, y, case = [], [], []
    for i in range(4000):
        group, insult = i % 4 == 0, i % 40 in (0, 1, 2)
        made.append(terms.of(" ".join([*(f"w{rng.integers(900)}" for _ in range(60)), *["grp"] * group, *["ins"] * insult])))
        case.append((group, insult))
        y.append(int(group and insult or rng.random() < (0.03 if group else 0.05)))
    machine = toxicity.fit(made, np.array(y))
    assert (machine.place[terms.of("grp ins")] >= 0).all()
    scores = machine.scores(made)
    mean = lambda g, t: np.mean([s for s, c in zip(scores, case, strict=True) if c == (g, t)])
    assert mean(True, True) > 0.7
    assert max(mean(True, False), mean(False, True), mean(False, False)) < 0.15


def test_no_labels_and_odd_texts(spark, table_of):
    rows = [(1, None), (2, ""), (3, "x" * 200_000), (4, "word " * 30_000), (None, "null id"), (5, "dup"), (5, "dup")]
    d = table_of(rows, labels=([], "doc_id long, quality int, toxic int"))
    for query in (toxicity.op9_toxicity, quality_classifier.op8_quality_classifier):
        got = query(spark, d).collect()
        assert len(got) == len(rows)
        assert len({round(r["score"], 9) for r in got}) == 1
    d = table_of([], labels=([(1, 1, 1)], "doc_id long, quality int, toxic int"))
    assert toxicity.op9_toxicity(spark, d).count() == 0
    assert quality_classifier.op8_quality_classifier(spark, d).count() == 0


def test_scores_do_not_depend_on_chunks():
    rng = quality_classifier.np.random.default_rng(1)
    net = quality_classifier.fit([b"clean words " * 9, b"*** $$$ ### " * 9] * 20, quality_classifier.np.array([1, 0] * 20))
    long = bytes(rng.integers(32, 127, 40_000, dtype=quality_classifier.np.uint8)) + b"*** $$$ ### "
    whole = net.scores([long, b"", long[:5], b"a"])
    quality_classifier.CHUNK, kept = 64, quality_classifier.CHUNK
    try:
        assert abs(net.scores([long, b"", long[:5], b"a"]) - whole).max() < 1e-5
    finally:
        quality_classifier.CHUNK = kept
    assert net.scores([b"clean words " * 9])[0] > net.scores([b"*** $$$ ### " * 9])[0]


def test_a_marker_counts_wherever_it_begins():
    np, rng = quality_classifier.np, quality_classifier.np.random.default_rng(4)
    net = quality_classifier.fit([b"clean words " * 9, b"*** $$$ ### " * 9] * 20, np.array([1, 0] * 20))
    texts = [b"a" * (40 + n) + b"*** $$$ ###" + b"a" * (48 - n) for n in range(8)]
    scores = net.scores(texts)
    assert np.ptp(scores) < 1e-5
    # alone or in a batch, and in both ways of pooling
    texts += [bytes(rng.integers(32, 127, n, dtype=np.uint8)) for n in (0, 1, 4, 5, 9, 8190, 8196, 8200, 20_001)]
    scores = net.scores(texts)
    assert abs(np.concatenate([net.scores([x]) for x in texts]) - scores).max() < 1e-5
    assert np.allclose(quality_classifier.pool(net, texts)[0], quality_classifier.pool(net, texts, True)[0], atol=1e-4)


def test_stages_keep_what_they_should(spark):
    docs = table(spark, SMALL, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert [x for x, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substrings", "mixing", "sentencepieces"]
    y = {r["doc_id"]: r["toxic"] for r in table(spark, SMALL, "labels").collect()}
    left = stages["toxicity"](spark, docs, SMALL)
    assert left.schema.names == docs.schema.names
    ids = {r["doc_id"] for r in left.select("doc_id").collect()}
    clean = [i for i, t in y.items() if not t]
    assert sum(i in ids for i in clean) >= 0.97 * len(clean)
    once = stages["near_duplicates"](spark, docs, SMALL)
    from driftline.llm.near_duplicates import op5_near_duplicates

    kept = {r["doc_id"] for r in op5_near_duplicates(spark, SMALL).where("kept").collect()}
    assert {r["doc_id"] for r in once.select("doc_id").collect()} == kept
    cut = stages["substrings"](spark, docs, SMALL)
    from driftline.llm.substrings import op10_substrings

    gone = {r["doc_id"] for r in op10_substrings(spark, SMALL).where("n_words > 0 AND n_removed = n_words").collect()}
    assert {r["doc_id"] for r in cut.select("doc_id").collect()} == {r["doc_id"] for r in docs.collect()} - gone


ODD = [(1, None), (2, ""), (3, " one\n\nline  two\tx "), (3, "another text of one id"), (None, "null id"), (5, "dup " * 60), (6, "dup " * 60), (7, "long " * 30_000)]


@pytest.mark.parametrize("rows", [ODD, ODD[:1], []], ids=["odd", "one", "empty"])
def test_run_of_odd_tables(spark, tmp_path, rows):
    # null, empty, tied, repeated and very long texts, and columns of names that the stages use themselves
    more = ("_row", "_cut", "_spans", "doc", "tag", "row", "n_words", "kept_text", "label", "node")
    full = [(i, t, "en", None if i == 2 else "s", len(t or ""), *(f"{c}{k}" for c in more)) for k, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in more)
    spark.createDataFrame(full, schema).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.schema.names == docs.schema.names, name
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            assert all(r[c].startswith(c) for r in docs.collect() for c in more)
    # of the two equal texts one is left; texts without words take no part in the mix
    want = {i for i, t in rows if (t or "").split()} - {6}
    assert {r["doc_id"] for r in docs.collect()} <= want
    assert len({(r["doc_id"], r["_row"]) for r in docs.collect()}) >= len(want) * 0.5
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["ids_sha256"]) for r in got) == sorted((r["doc_id"] or 0, r["ids_sha256"]) for r in out.collect())
