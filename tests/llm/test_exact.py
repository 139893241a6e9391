"""Operators with one right result, against plain forms, over nulls, empty, long, tied and repeated texts."""

import hashlib
import random
import re

import numpy as np
import plain
import pytest
import sentencepiece

from driftline.llm import fingerprints, licenses, mixing, near_duplicates, quality_rules, sentencepieces, substrings, token_counts
from driftline.llm.common import written


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = [f"{c}{i}" for c in ("w", "Wé", "日") for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice((0, 1, 3, 12, 13, 40, 200)))] for _ in range(n)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for i, w in enumerate(base):
        w = list(w)
        if i % 5 == 1 and w:
            w[len(w) // 2 : len(w) // 2] = passage
        if i % 7 == 2:
            w = list(base[i - 1])
            for _ in range(rng.randrange(3)):
                if w:
                    w[rng.randrange(len(w))] = "edit"
        if i % 9 == 4:
            w = ["same", "Same"] * 30
        rows.append((1000 - 7 * i, "".join(x + rng.choice((" ", "\n", "  ", "\t")) for x in w)))
    return [*rows, (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (6, "a b c d"), (7, "A b c D"), (8, "x " * 30_000), (9, "no break line word")]


EMPTY = []


@pytest.mark.parametrize("rows", [corpus(), EMPTY], ids=["corpus", "empty"])
def test_near_duplicates_and_repeats(spark, table_of, rows):
    d = table_of(rows)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates.op5_near_duplicates(spark, d).collect()}
    assert found == {i: (n, c, i == c) for i, (n, c) in plain.components(rows).items()}
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.op10_substrings(spark, d).collect()}
    assert found == plain.removed(rows)


def test_repeats_by_two_levels_of_buckets_and_one_partition(spark, table_of, monkeypatch):
    rows = corpus(11)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(substrings, "FAN", 3)
    monkeypatch.setattr(substrings, "MERGED", 500)
    monkeypatch.setattr(substrings, "RANGES", 2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.op10_substrings(spark, table_of(rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == plain.removed(rows)


def test_equal_hashes_of_other_words_remove_nothing(spark):
    words = [" ".join(f"d{i}w{j}" for j in range(40)) for i in range(30)]
    rows = [*enumerate(words), (90, words[0] + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["cut"]["n_removed"] for r in substrings.removals(docs, bits=3).collect()}
    assert {i: n for i, n in got.items() if i < 90} == dict.fromkeys(range(30), 0)
    assert substrings.hits(docs.selectExpr("doc_id AS row", "doc_id AS doc", "text"), bits=3).count() > 200
    assert {r["doc_id"]: r["cut"]["n_removed"] for r in substrings.removals(docs).collect()} == {**dict.fromkeys(range(30), 0), 90: 40}


def test_paths_are_nonbranching_runs(spark):
    # row 5 walks source 1 at 3..6, goes on in source 2 at 0..4; row 6 does so too; row 7 leaves source 3 for source 4, row 8 leaves it for source 2
    walks = [(5, 0, 1, 3, 4), (5, 4, 2, 0, 5), (6, 10, 1, 3, 4), (6, 14, 2, 0, 5), (7, 0, 3, 0, 3), (7, 3, 4, 0, 3), (8, 0, 3, 1, 2), (8, 2, 9, 7, 2)]
    hits = [(row, at + i, source, begin + i) for row, at, source, begin, n in walks for i in range(n)]
    found = spark.createDataFrame(hits, substrings.HITS)
    made = substrings.runs(found)
    got = {(r["row"], r["first"]): (r["last"], r["path"]) for r in substrings.paths(made).collect()}
    assert got == {(5, 0): (3, 0), (5, 4): (8, 0), (6, 10): (13, 10), (6, 14): (18, 10), (7, 0): (2, 0), (7, 3): (5, 3), (8, 0): (1, 0), (8, 2): (3, 2)}


def test_repeats_keep_columns_of_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, 7, "a", "b", "c"), (2, "x " + text, 8, "d", "e", "f"), (3, None, 9, "g", "h", "i")], "doc_id long, text string, _row long, tag string, n_words string, kept_text string")
    got = substrings.removals(docs).orderBy("doc_id").collect()
    assert [tuple(r)[:6] for r in got] == [tuple(r) for r in docs.orderBy("doc_id").collect()]
    assert [(r["cut"]["n_removed"], r["cut"]["n_paths"], r["cut"]["longest_path"]) for r in got] == [(0, 0, 0), (30, 1, 30), (0, 0, 0)]


def test_rows_of_one_id_and_null_ids(spark, table_of):
    text = " ".join(f"t{i}" for i in range(30))
    d = table_of([(3, text), (3, text), (3, "another text of its own"), (None, text), (5, text + " end")])
    rows = near_duplicates.near_duplicates(spark.read.parquet(d + "/documents.parquet")).collect()
    # 25 and 26 shingles each, but for the text of its own
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["stands"]) for r in rows if r["n_shingles"] > 20) == sorted([(3, 3, True), (3, 3, False), (-1, 3, False), (5, 3, False)])
    cut = substrings.op10_substrings(spark, d).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in cut) == [(-1, 30), (3, 0), (3, 0), (3, 0), (5, 30)]


def test_sketches_estimate_and_merge():
    rng = random.Random(1)
    items = [rng.randrange(1 << 64) for _ in range(900)]
    np = near_duplicates.np
    one, other, both = (np.array(x, np.uint64) for x in (items[:600], items[300:], items))
    a, b = near_duplicates.registers(one), near_duplicates.registers(other)
    assert (near_duplicates.merged(a, b) == near_duplicates.registers(both)).all()
    assert abs(near_duplicates.likeliest(a[None], b[None], np.array([600.0]), np.array([600.0]))[0] - 1 / 3) < 0.15
    assert near_duplicates.likeliest(a[None], a[None], np.array([600.0]), np.array([600.0]))[0] > 0.95


def test_a_large_group_of_near_copies_is_one_component(spark, table_of):
    rng = random.Random(2)
    base = [f"b{rng.randrange(400)}" for _ in range(300)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(300)] = f"e{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates.op5_near_duplicates(spark, table_of(rows)).collect()}
    assert found == {i: c for i, (_, c) in plain.components(rows).items()}


@pytest.mark.parametrize("seed", [6, 7])
@pytest.mark.parametrize("turns", [0, 4], ids=["blocks", "stars"])
def test_nested_groups_of_near_copies(spark, table_of, monkeypatch, seed, turns):
    # groups of variants of one text, with copies and edits of every variant
    monkeypatch.setattr(near_duplicates, "PAYS", 0 if turns else 10**9)
    monkeypatch.setattr(near_duplicates, "GROUP", 3)
    monkeypatch.setattr(near_duplicates, "BLOCK", 5)
    rng, rows = random.Random(seed), []

    def edited(w, n):
        w = list(w)
        for at in rng.sample(range(len(w)), n):
            w[at] = f"e{rng.randrange(10**6)}"
        return w

    for _ in range(25):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for variant in [edited(base, rng.randrange(3, 7)) for _ in range(3)]:
            rows += [(rng.randrange(10**12), " ".join(edited(variant, rng.randrange(3)))) for _ in range(rng.randrange(2, 6))]
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates.op5_near_duplicates(spark, table_of(rows)).collect()}
    assert found == {i: c for i, (_, c) in plain.components(rows).items()}


def test_pairs_at_the_threshold_are_recalled(spark, table_of):
    rng, rows = random.Random(12), []
    for i in range(300):
        w = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        # the last words differ: between 0.75 and 0.8 of all shingles stay
        n = rng.randrange(45, 57)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:-n] + [f"x{rng.randrange(10**6)}" for _ in range(n)]))]
    near = [i for i, (_, c) in plain.components(rows).items() if c != i]
    got = [r["doc_id"] for r in near_duplicates.op5_near_duplicates(spark, table_of(rows)).collect() if not r["kept"]]
    assert len(near) > 200
    assert set(got) == set(near)


def test_components_of_one_size_meet_in_a_bucket(spark):
    # a bucket for each pair across two interleaved components of two members: that pair alone agrees
    rest, held, sets, want = [], [], [], set()
    for k, link in enumerate([(0, 1), (0, 3), (1, 2), (2, 3)]):
        items = [np.unique(np.random.default_rng(10 * k + i).integers(0, 1 << 63, 500).astype(np.uint64)) for i in range(4)]
        items[link[1]] = items[link[0]]
        for i, one in enumerate(items):
            r = near_duplicates.registers(one)
            r[: near_duplicates.ROWS] = 7
            rest.append((0, k, 10 * k + i, 10 * k + i % 2))
            held.append((10 * k + i, len(one), bytearray(r.tobytes())))
            sets.append((10 * k + i, bytearray(one.tobytes())))
        want.add((10 * k + link[0], 10 * k + link[1]))
    made = lambda rows, kind: spark.createDataFrame(rows, kind).coalesce(1)
    found = near_duplicates._across(made(rest, "band int, key long, node long, label long"), made(held, "node long, n_shingles long, registers binary"), made(sets, "node long, items binary"), 75)
    assert {(min(r), max(r)) for r in found.collect()} == want


@pytest.mark.parametrize("rows", [corpus(9), EMPTY], ids=["corpus", "empty"])
def test_quality_rules(spark, table_of, rows):
    found = {r["doc_id"]: r for r in quality_rules.op6_quality_rules(spark, table_of(rows)).collect()}
    assert {i: tuple(r)[1:6] for i, r in found.items()} == {i: (q[0], q[1], q[2], q[3], q[4]) for i, q in ((i, plain.quality(t)) for i, t in rows)}
    for r in found.values():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_ablation_counts_by_bits(spark, table_of):
    book = quality_rules.ledger(spark.read.parquet(table_of([(1, "few"), (2, "a b c " * 40), (3, "* " * 8)]) + "/documents.parquet"))
    found = {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality_rules.ablation(book, quality_rules.STANDARD).collect()}
    assert found["too_few_words"] == (2, 1 if book.where("fail_bits = 1").count() == 1 else 0)
    assert found["repeated_words"][0] == 2


@pytest.mark.parametrize("rows", [corpus(3), EMPTY, [(1, "alone in the table")]], ids=["corpus", "empty", "one"])
def test_fingerprints(spark, table_of, rows):
    got = fingerprints.op7_fingerprints(spark, table_of(rows)).collect()
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    want = {}
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        want[i] = (len(text), plain.sha(text[: len(text) - cut] + after[:cut]))
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in got} == want
    texts, seen = {i: t or "" for i, t in rows}, {}
    for r in got:
        assert seen.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1
        assert 0 <= r["near_next"] <= 1


def test_fingerprints_are_the_plain_sketches(spark):
    texts = [t for _, t in corpus(13)] + ["a b", "solo"]
    rows = list(enumerate(texts)) + [(7, "again seven"), (None, "nobody's text here"), (None, "a second one")]
    shingled = lambda w: [tuple(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [(" ".join(w),)] if w else []
    sets = [(k, s) for k, (_, t) in enumerate(rows) for s in set(shingled(plain.words(t)))]
    F = fingerprints.F
    hashed = {}
    for n in (1, 3):
        part = spark.createDataFrame([(k, *s) for k, s in sets if len(s) == n], "k int, " + ", ".join(f"w{i} string" for i in range(n)))
        for r in part.select("k", F.xxhash64(*(f"w{i}" for i in range(n))).alias("h")).collect():
            hashed.setdefault(r["k"], set()).add(r["h"])
    want = {}
    for k in range(len(rows)):
        low = sorted(h for h in hashed.get(k, ()) if h < fingerprints._BOUND)
        want[k] = low if len(low) >= fingerprints.FEW else sorted(hashed.get(k, ()))[: fingerprints.FEW]
    made = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "k int, text string").select("k", fingerprints.sketch(F.col("text")).alias("s"))
    assert {r["k"]: r["s"] for r in made.collect()} == want
    # rows of one id follow by a hash of their texts, null ids come last
    rows += [(500, f"hot {n % 90}") for n in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"], r["next_text"]) for r in fingerprints.followed(docs.withColumn("text", F.coalesce("text", F.lit("")))).collect()]
    marks = {r["t"]: r["h"] for r in docs.select(F.coalesce("text", F.lit("")).alias("t")).select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), -marks[r[1]], r[1]))
    assert sorted(got, key=repr) == sorted(((i, t, order[(n + 1) % len(order)][1]) for n, (i, t) in enumerate(order)), key=repr)


def test_fingerprints_merge_and_contain(spark):
    F = fingerprints.F
    long = " ".join(f"w{i}" for i in range(3000))
    row = spark.createDataFrame([(long, " ".join(f"w{i}" for i in range(100, 400)), "x y")], "a string, b string, c string")
    s = {c: fingerprints.sketch(F.col(c)) for c in "abc"}
    r = row.select(fingerprints.containment(s["b"], s["a"]).alias("in"), fingerprints.likeness(s["a"], s["a"]).alias("same"), fingerprints.likeness(s["a"], s["c"]).alias("other"), (fingerprints.merged(s["a"], s["b"]) == s["a"]).alias("union")).first()
    assert tuple(r) == (1.0, 1.0, 0.0, True)


def test_short_texts_are_compared_where_both_sketches_cover(spark):
    F, rng = fingerprints.F, random.Random(8)
    rows = []
    for i in range(360):
        n = (5, 10, 20, 40, 60, 100)[i % 6]
        w = [f"r{rng.randrange(10**9)}" for _ in range(3000)]
        rows.append((n, " ".join(w[50 : 50 + n]), " ".join(w), " ".join(w[50 : 50 + 3 * (n - 2) + 2]), " ".join(w[1000:1200])))
    s = {c: fingerprints.sketch(F.col(c)) for c in ("part", "whole", "thrice", "other")}
    made = spark.createDataFrame(rows, "n int, part string, whole string, thrice string, other string").select("n", *(x.alias(c) for c, x in s.items()))
    c, like = fingerprints.containment, fingerprints.likeness
    got = made.select("n", c(F.col("part"), F.col("whole")).alias("inside"), c(F.col("part"), F.col("other")).alias("outside"), c(F.col("part"), F.col("thrice")).alias("near"), like(F.col("part"), F.col("thrice")).alias("third"), like(F.col("part"), F.col("other")).alias("none")).collect()
    for n in (5, 10, 20, 40, 60, 100):
        of = [r for r in got if r["n"] == n]
        # a text inside another is so in every range, or has no hash there; from 20 words on that is rare
        assert {r["inside"] for r in of} <= {1.0, None}
        assert {r["outside"] for r in of} <= {0.0, None}
        assert {r["near"] for r in of} <= {1.0, None}
        assert {r["none"] for r in of} == {0.0}
        assert sum(r["inside"] is None for r in of) <= (52, 32, 14, 4, 1, 0)[(5, 10, 20, 40, 60, 100).index(n)]
        assert abs(sum(r["third"] for r in of) / len(of) - 1 / 3) < 0.07


def test_encoding_is_the_library_s(spark, table_of):
    rows = [*corpus(4), (20, "  two  spaces "), (21, "▁ mark"), (22, "tab\tnew\n\nline 🙂 \x00 <s>"), (23, " ")]
    own = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.model_file())
    found = {r["doc_id"]: r for r in sentencepieces.op3_sentencepieces(spark, table_of(rows)).collect()}
    for i, text in rows:
        ids = own.encode(text or "", add_eos=True)
        r = found[i]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), plain.sha(" ".join(map(str, ids))), plain.sha(own.decode(ids)))
        assert r["n_bytes_spanned"] == len((text or "").encode())
        spans = [x[1:] for x in sentencepieces.codec_of(sentencepieces.model_file()).spans(text or "")]
        assert r["spans_sha256"] == hashlib.sha256(np.array([*spans, (len((text or "").encode()),) * 2], "<i4").tobytes()).hexdigest()
    docs = spark.createDataFrame([(1, "Été  à\nla 日本")], "doc_id long, text string")
    r = sentencepieces.encode(docs, sentencepieces.model_file()).first()
    assert r["decoded"] == "Été  à\nla 日本"
    data = "Été  à\nla 日本".encode()
    assert b"".join(data[a:b] for a, b in zip(r["begins"], r["ends"], strict=True)) == data


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc_cf"])
def test_pieces_are_projected_as_the_library_does(spark, table_of, tmp_path, rule):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model, path = proto.ModelProto(), str(tmp_path / "m.model")
    with open(sentencepieces.model_file(), "rb") as f:
        model.ParseFromString(f.read())
    if rule != "identity":
        rules = proto.ModelProto()
        rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True).serialized_model_proto())
        model.normalizer_spec.CopyFrom(rules.normalizer_spec)
        model.normalizer_spec.add_dummy_prefix = model.normalizer_spec.remove_extra_whitespaces = model.normalizer_spec.escape_whitespaces = True
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    own, codec = sentencepiece.SentencePieceProcessor(model_file=path), sentencepieces.Codec(path)
    for text in ["", " ", "plain words here", "  two  spaces ", "ﬁne ①② Ａ ｶﾞ x", "  a　b ", "Été là 日本🙂 ▁x", "tab\tnew\n\nline", *(t for _, t in corpus(6) if t)]:
        want = own.encode(text, return_type="offset_mapping", return_bytes=True)
        got = codec.spans(text)
        assert [x[0] for x in got] == want["ids"]
        # a character of several byte pieces is the library's last one's, here every byte has its own
        assert [x[1:] for x, p in zip(got, want["pieces"], strict=True) if not p.startswith(b"<0x")] == [x for x, p in zip(want["offsets"], want["pieces"], strict=True) if not p.startswith(b"<0x")]
    rows = [(1, "ﬁne  ①② two"), (2, None), (2, ""), (3, "ﬁne  ①② two"), (None, "x")]
    found = sentencepieces.encode(spark.read.parquet(table_of(rows) + "/documents.parquet"), path, ("ids", "decoded")).collect()
    assert sorted((r["doc_id"] or 0, r["ids"], r["decoded"]) for r in found) == sorted((i or 0, own.encode(t or "", add_eos=True), own.decode(own.encode(t or "", add_eos=True))) for i, t in rows)
    assert sentencepieces.op3_sentencepieces(spark, table_of([])).count() == 0


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_character_maps_match_the_library(rule):
    from sentencepiece import sentencepiece_model_pb2 as proto

    own = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    model = proto.ModelProto()
    model.ParseFromString(own.serialized_model_proto())
    spec = model.normalizer_spec
    settings = sentencepieces.Settings(sentencepieces.CharacterMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces)
    for text in ("", "plain", "ﬁne ①②  Ａ ｶﾞ \t x", "  a　b ", "é z­q", "ÀÉß"):
        data, source = sentencepieces.normalise(text.encode(), settings)
        assert data.decode() == own.normalize(text)
        assert len(source) == len(data) + 1
        assert source == sorted(source)


def test_token_counts_are_the_best_segmentation(spark, table_of):
    vocabulary = token_counts.Unigrams({"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "▁a": -2.5, "ba": -4.0, "▁ab": -6.0})
    def best(word):
        table = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            options = []
            for begin in range(end):
                piece = word[begin:end]
                if piece in vocabulary.scores:
                    options.append((table[begin][0] + vocabulary.scores[piece], table[begin][1] + 1))
                elif end - begin == 1:
                    n = len(piece.encode())
                    options.append((table[begin][0] + vocabulary.unknown * n, table[begin][1] + n))
            table.append(max(options, key=lambda x: (x[0], -x[1])))
        return table[-1][1]
    rng = random.Random(6)
    tokens = ["▁" + "".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    counts, nodes = vocabulary.counts(tokens)
    assert counts == {t: best(t) for t in set(tokens)}
    prefixes = {t[:n] for t in tokens for n in range(1, len(t) + 1)}
    assert nodes == len(prefixes)
    rows = corpus(8)
    got = {r["doc_id"]: r for r in token_counts.op4_token_counts(spark, table_of(rows)).collect()}
    real = token_counts.Unigrams.load(sentencepieces.model_file())
    for i, text in rows:
        w = plain.words(text)
        c, _ = real.counts(["▁" + x for x in w])
        assert (got[i]["n_words"], got[i]["n_tokens"]) == (len(w), sum(c["▁" + x] for x in w))


def test_mix_meets_its_targets(spark, table_of):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 300 if i % 3 else 900))), None if i % 8 == 0 else f"s{i % 5}") for i in range(150)] + [(900, None, "s9"), (901, "", "s0"), (902, "w " * 20_000, "s1"), (902, "w w", "s1")]
    d = table_of(rows)
    got = mixing.op2_mixing(spark, d).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.op2_mixing(spark, d).collect()))
    sizes, names = {}, sorted({r[2] for r in rows}, key=lambda x: (x is None, x or ""))
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len(plain.words(r[1]))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    free, target = set(names), {}
    while free:
        level = (1.5 * sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        target |= {s: 2 * sizes[s] if s in over else level * weight[s] for s in (over or free)}
        free = free - over if over else set()
    source, taken = {(i, len(plain.words(t))): s for i, t, s in rows}, {}
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s]
        assert abs(r["target"] - target[s]) < 1e-6
        assert r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in names)
    assert mixing.op2_mixing(spark, table_of([])).count() == 0


def test_permutation_is_a_bijection_and_blocks_fill(spark):
    F = mixing.F
    for n in (1, 2, 7, 100):
        image = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("k"))).collect()]
        assert sorted(image) == list(range(n))
    docs = spark.createDataFrame([(i, " ".join(f"d{i}w{j}" for j in range(70)), "en", "s", 0) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = mixing.mixed_texts(written(docs), block=16).collect()
    assert sum(len(r["text"].split()) for r in mixed) == 2100
    assert all(set(r["text"].split()) <= {f"d{r['doc_id']}w{j}" for j in range(70)} for r in mixed)


def test_the_mix_keeps_layout_and_columns(spark):
    texts = {1: " line one\n\nline  two\tx\n", 2: "a " * 40 + "\n b", 3: "", 4: None, 5: "solo"}
    docs = spark.createDataFrame([(i, t, "s", 99, "row", "spans") for i, t in texts.items()], "doc_id long, text string, source string, n_chars int, _row string, _spans string")
    got = mixing.mixed_texts(docs, block=4).collect()
    assert {r["_row"] for r in got} == {"row"}
    assert {r["_spans"] for r in got} == {"spans"}
    for r in got:
        assert r["n_chars"] == len(r["text"])
        assert len(r["text"].split()) > 0
        assert r["text"] in (texts[r["doc_id"]], r["text"].lstrip())
    # one source takes half of its words twice: a first pass over all texts as they are
    assert {r["text"] for r in got} >= {t for t in texts.values() if (t or "").split()}
    assert mixing.mixed_texts(docs.where("doc_id > 90")).count() == 0


def test_the_mix_is_the_same_from_other_files(spark):
    rows = [(i % 300, " ".join(f"d{i}w{j}" for j in range(i % 40)), f"s{i % 3}", 0) for i in range(900)] + [(7, "same words here", "s1", 0)] * 5 + [(None, None, None, 0)] * 5
    mixed = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(seed + 1)
        mixed.append(sorted(map(str, mixing.mixed_texts(written(docs), block=16).collect())))
    assert mixed[0] == mixed[1]
    assert len(mixed[0]) > 900


def test_a_row_repeated_beyond_a_bucket_is_mixed_whole(spark, table_of):
    rows = [(1, "a b c", "s0")] * 1500 + [(2, "d e", "s1")] * 700 + [(None, None, None)] * 1500 + [(i, f"w{i} x", "s1") for i in range(3, 300)]
    got = mixing.op2_mixing(spark, table_of(rows)).collect()
    assert len(got) == len(rows)
    assert {r["source_size"] for r in got} == {4500, 1994, 0}
    for size in (4500, 1994):
        own = [r for r in got if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.5
        assert all(r["taken"] <= 2 * r["size"] for r in own)


def test_shards_hold_the_mix(spark):
    docs = written(spark.createDataFrame([(i, " ".join(f"d{i}w{j}" for j in range(97)), f"s{i % 3}") for i in range(60)], "doc_id long, text string, source string"))
    made = mixing.blocks(docs, block=8, shard_slots=100).collect()
    mixed = mixing.mix(mixing.sizes(docs), block=8, shard_slots=100)
    slots = {(r["shard"], r["_source"]): (r["n_slots"], r["n_words"]) for r in mixing.counts(mixed).collect()}
    got = {}
    for r in made:
        assert r["n_words"] == len(r["text"].split()) <= 8
        n = got.get(key := (r["shard"], "s:" + r["source"]), (0, 0))
        got[key] = (n[0] + 1, n[1] + r["n_words"])
    assert got == slots
    assert len({k[0] for k in slots}) == 11
    # every source's slots fall on the shards evenly but for chance: a chi-square of 10 degrees of freedom
    for s in ("s:s0", "s:s1", "s:s2"):
        n = [slots.get((k, s), (0, 0))[0] for k in range(11)]
        assert sum((x - sum(n) / 11) ** 2 for x in n) / (sum(n) / 11) < 30


def test_licences(spark):
    files = [
        (1, "p/LICENSE", "Released under the MIT License."),
        (2, "p/a/b/x.py", "code code\nmore code"),
        (3, "p/a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (4, "q/y.py", "Licensed under CC BY-NC 4.0.\n" + "code " * 50),
        (5, "q/z.py", "nothing\nof the licence kind"),
        (6, None, None),
        (7, "p/w.py", ""),
    ]
    found = {r["doc_id"]: (r["header_licence"], r["inherited_from"], r["licence"]) for r in licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert found == {1: ("MIT", "p", "MIT"), 2: (None, "p/a", "Apache-2.0"), 3: ("Apache-2.0", "p/a", "Apache-2.0"), 4: ("CC-BY-NC-4.0", None, "CC-BY-NC-4.0"), 5: (None, None, None), 6: (None, None, None), 7: (None, "p", "MIT")}


MIT = """The MIT License (MIT)

Copyright (c) 2019-2024 Ada Example and the Example contributors

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def test_whole_licence_files_are_found_and_inherited(spark):
    whole = dict(licenses._texts()[::-1])
    files = [("MIT/LICENSE", MIT)]
    files += [(f"{name}/COPYING", "Copyright (c) 2020 Ada Example\n\n" + " ".join(text.split())) for name, text in whole.items() if name != "MIT"]
    files += [(f"{name}/src/deep/x.py", "import os\n") for name in whole]
    found = {r["path"]: (r["file_licence"], r["inherited_from"], r["licence"]) for r in licenses.scan(spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "doc_id long, path string, text string")).collect()}
    assert {"MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "AGPL-3.0", "ISC", "BSD-2-Clause", "BSD-3-Clause"} <= set(whole)
    for name in whole:
        assert found[f"{name}/src/deep/x.py"] == (None, name, name)
    assert found["MIT/LICENSE"][0] == "MIT"


def test_headers_of_several_lines_and_tags(spark):
    code = "\nimport os\n\n" + "x = 1\n" * 30
    notice = "Licensed under the Apache\nLicense, Version 2.0 (the\n\"License\"); you may not\nuse this file except in\ncompliance with the\nLicense."
    headers = [("MIT", "# SPDX-License-Identifier: MIT"), ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-or-later */"), ("Apache-2.0", "# " + notice.replace("\n", "\n# ")), ("Apache-2.0", "/*\n" + notice + "\n*/")]
    headers += [("MIT", "// " + MIT.replace("\n", "\n// ")), (None, "# nothing\n# about a license")]
    files = [(i, f"s/{i}.py", h + code) for i, (_, h) in enumerate(headers)]
    found = {r["doc_id"]: r["header_licence"] for r in licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert found == {i: name for i, (name, _) in enumerate(headers)}


def plain_cosine(text, templates):
    """The best (cosine, licence) of a text among templates, by plain TF-IDF."""
    import math
    import re
    from collections import Counter

    counts = [Counter(re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", t.lower())) for _, t in templates]
    idf = lambda t: 1 + math.log((1 + len(counts)) / (1 + sum(t in c for c in counts)))
    vector = lambda c: {t: n * idf(t) for t, n in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    own = vector(Counter(re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", text.lower())))
    return max(((round(sum(own.get(t, 0) * x for t, x in v.items()) / (norm(own) * norm(v)), 6), name) for (name, _), v in zip(templates, map(vector, counts), strict=True)), key=lambda r: r[0])


def test_cosines_are_the_plain_ones(spark):
    models = (licenses.TEMPLATES, licenses.HEADERS, licenses._texts())
    assert all(re.search(licenses.MENTION.removeprefix("(?i)"), t, re.IGNORECASE) for m in models for _, t in m)
    rng, rows = random.Random(4), []
    for i, (_, text) in enumerate(t for m in models for t in m):
        w = text.split()
        rows.append((i, 0, " ".join(x for x in w if rng.random() < 0.9) + " and some more words" * rng.randrange(4)))
    rows.append((10**6, 0, "license " * 20_000))
    found = {r["_row"]: (r["score"], r["licence"]) for r in licenses.cosines(spark.createDataFrame(rows, "_row long, unit int, text string")).collect()}
    for i, _, text in rows:
        best = max((plain_cosine(text, m) for m in models), key=lambda r: r[0])
        assert abs(found[i][0] - best[0]) < 2e-6
        assert found[i][1] in {n for m in models for n, t in m if abs(plain_cosine(text, [x for x in m])[0] - best[0]) < 2e-6 or n == best[1]}


def test_licences_of_odd_rows(spark, table_of):
    rows = [(1, "Released under the MIT License.", None), (1, "Released under the MIT License.", None), (2, "word " * 30_000 + "\n// SPDX-License-Identifier: ISC\n", "s"), (None, "Licensed under CC BY 4.0.", "s"), (3, None, "s"), (4, "", "s")]
    got = sorted((r["doc_id"] or 0, r["path"], r["licence"]) for r in licenses.op1_licenses(spark, table_of(rows)).collect())
    # a text that is nothing but a notice is a licence file of its folder
    assert got == [(0, "s/en/_.txt", "CC-BY-4.0"), (1, "_/en/1.txt", "MIT"), (1, "_/en/1.txt", "MIT"), (2, "s/en/2.txt", "ISC"), (3, "s/en/3.txt", "CC-BY-4.0"), (4, "s/en/4.txt", "CC-BY-4.0")]


def test_licences_of_documents(spark, table_of):
    notices = {name: text for name, text in licenses.TEMPLATES}
    rows = [(i, f"first line\n{text}\nlast line") for i, text in enumerate(notices.values())] + [(90, None), (91, "")]
    d = table_of(rows)
    found = {r["doc_id"]: r["header_licence"] for r in licenses.op1_licenses(spark, d).collect()}
    assert found == {**dict(enumerate(notices)), 90: None, 91: None}
    assert licenses.op1_licenses(spark, table_of([])).count() == 0
