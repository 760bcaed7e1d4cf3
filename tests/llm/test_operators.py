"""Brute force and edge cases of the training-data operators, on small tables."""

import hashlib
import random
import re
import struct
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from cohortlake.llm import (
    components,
    embedding_near_dedup,
    language_id,
    ngram_join,
    quality,
    queries,
    secret_scan,
    sentencepiece_codec,
    substring_dedup,
    suffix_dedup,
    template_decontamination,
    text,
    toxicity,
    workers,
)
from tests.conftest import SMALL

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, score string, name string, n_chars long"
WORD = r"[^\x20\x09-\x0D]+"


def words(t):
    return re.findall(WORD, t or "")


def make_rows():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    base, passage = prose(120), prose(60)
    near = base.split(" ")
    near[60] = "changed"
    big = 2**60 + 1
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (4, prose(30) + " " + passage + " " + prose(30)),
        (5, prose(40) + "\t\n" + passage + " " + prose(10)), (6, None), (7, ""), (8, " \n\t "), (9, "one"),
        (10, "TWO words"), (11, "12345 !!! 678"), (12, prose(20_000)), (12, prose(5)), (big, base), (None, base),
        (None, None), (13, "x" * 50_000), (14, "é\x00ß 日本 😀 ▁▁ a  b\n"), (15, "Base " + base.upper()), (4, None),
        (16, prose(13)), (17, prose(13)), (18, "a b"), (19, "a b"),
    ]
    return [(i, t, "en" if k % 2 else "de", "s", "n", None) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    workers.prepare(spark)
    return spark.createDataFrame(make_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_hashes_follow_words_and_not_slices(monkeypatch):
    long = " ".join(["aa", "bcd", "é" * 30] * 200)
    whole = text.word_hashes(long.encode())
    monkeypatch.setattr(text, "_SLICE", 64)
    assert (text.word_hashes(long.encode()) == whole).all() and len(set(whole.tolist())) == 3
    many = text.many_word_hashes([b"", b"a b", b" ", b"b\x0ba"])
    assert [len(m) for m in many] == [0, 2, 0, 2] and many[1][0] == many[3][1]
    grams = text.mix(np.arange(60, dtype=np.uint64))
    places, of_run = text.minimisers(grams, 9)
    assert all(places[of_run[i]] == i + int(np.argmin(grams[i:i + 9])) for i in range(52))


def expected_substrings(rows, window=13):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            w = words(t)
            for j in range(len(w) - window + 1):
                k = tuple(w[j:j + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j:j + window])] < i:
                gone[j:j + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup_is_exact(docs, empty):
    got = substring_dedup.deduplicated(docs).withColumn("h", F.sha2(F.col("kept").cast("binary"), 256)).collect()
    found = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["h"]) for r in got), key=str)
    assert found == expected_substrings(make_rows()) and sum(r[2] for r in found) > 300
    assert substring_dedup.deduplicated(empty).count() == 0


def test_substring_shards_can_be_cut(docs, monkeypatch):
    held = [[str(i) for i in range(100)]]
    monkeypatch.setattr(substring_dedup, "SHARD", 30)
    parts = list(substring_dedup._cut(held, 13))
    runs = {tuple(p[j:j + 13]) for part in parts for p in part for j in range(len(p) - 12)}
    assert len(parts) > 2 and runs == {tuple(held[0][j:j + 13]) for j in range(88)}
    automaton = substring_dedup.SuffixAutomaton()
    automaton.add("a b c a b d".split())
    assert list(automaton.statistics("c a b c x a b d".split())) == [1, 2, 3, 3, 0, 1, 2, 3]


def test_suffix_dedup_finds_passages(docs, empty):
    got = suffix_dedup.repeated_passages(docs).collect()
    rows = make_rows()
    # copies, near copies, and the shared passage, but nothing else
    assert {r["doc_id"] for r in got} == {1, 2, 3, 4, 5, 2**60 + 1}
    by_id = defaultdict(set)
    for i, t, *_ in rows:
        w = words(t)
        by_id[i] |= {tuple(w[j:j + 50]) for j in range(len(w) - 49)}
    for r in got:
        t = next(words(t) for i, t, *_ in rows if i == r["doc_id"] and t)
        others = set().union(*[by_id[p] for p in r["partners"]])
        assert tuple(t[r["first_word"]:r["first_word"] + 50]) in others
        assert r["is_copy"] == any(p < r["doc_id"] for p in r["partners"])
    kept = {r["doc_id"]: r["kept"] for r in suffix_dedup.deduplicated(docs).collect()}
    assert len(words(kept[2])) == 0 and len(words(kept[5])) == 50 and len(words(kept[1])) == 120
    assert suffix_dedup.repeated_passages(empty).count() == 0


def test_suffix_dedup_knows_the_first_of_many_holders(spark):
    rng = random.Random(9)

    def prose(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    passage = prose(60)
    rows = [(i, " ".join(prose(30) + passage + prose(30))) for i in range(1, 121)]
    got = suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    copies = {r["doc_id"]: r for r in got if r["is_copy"]}
    assert set(copies) == set(range(2, 121))
    assert all((r["first_word"], r["end_word"]) == (30, 90) and 1 in r["partners"] for r in copies.values())
    assert {r["doc_id"] for r in got if not r["is_copy"]} == set(range(1, 120))


def expected_components(rows, k, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t, *_ in rows:
        w = words((t or "").translate(lower))
        sets.append(frozenset(tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for n, (i, *_) in enumerate(rows):
        ids[find(n)].append(i)
    return sorted(((i, len(sets[n]), min((x for x in ids[find(n)] if x is not None), default=None))
                   for n, (i, *_) in enumerate(rows)), key=str)


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_ngram_join_is_exact(docs, empty, k, percent):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"])
                  for r in ngram_join.join(docs, k, percent).collect()), key=str)
    assert got == expected_components(make_rows(), k, percent)
    assert ngram_join.join(empty, k, percent).count() == 0


def test_sketches_never_exceed_the_distance():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(0, 2**63, 50).astype(np.uint64)]))
        x, y = (np.frombuffer(ngram_join.sketch(s), np.uint8) for s in (a, b))
        while len(x) > len(y):
            x = ngram_join._fold(x)
        while len(y) > len(x):
            y = ngram_join._fold(y)
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_components_of_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


def test_sentencepiece_equals_the_library(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    codec = sentencepiece_codec.Codec(MODEL)
    rng = random.Random(2)
    texts = [t for _, t, *_ in make_rows() if t and len(t) < 5000]
    texts += ["".join(rng.choice("abct hei \n\t.,é日▁<>0123") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for t in texts:
        packed, decoded = codec.encode(t)
        ids = list(struct.unpack(f"<{len(packed) // 4}I", packed))
        want = library.encode(t, add_bos=True, add_eos=True)
        assert ids == want and decoded == library.decode(want) == codec.decode(ids), t
    got = {(r["doc_id"], r["n_tokens"]) for r in sentencepiece_codec.digests(docs, MODEL).collect()}
    assert (6, 2) in got and (2**60 + 1, len(library.encode(make_rows()[0][1])) + 2) in got


def test_language_id_edges(docs, empty):
    model = language_id.fit(docs, F.lit(True))
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.predict(docs, model).collect()}
    assert {(6, "und"), (7, "und"), (11, "und"), (None, "und")} <= got
    kept = language_id.identified(docs, model)
    assert kept.columns == docs.columns and kept.filter("score = 's'").count() == kept.count() > 10
    nothing = language_id.fit(empty, F.lit(True))
    assert {r["lang_pred"] for r in language_id.predict(docs, nothing).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op4_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.filter("held_out and lang = lang_pred").count() >= 0.98 * found.filter("held_out").count()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    for name, label, n in (("op7_toxicity", "toxic", 3), ("op10_quality", "quality", 5)):
        scored = queries.QUERIES[name](spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("held_out")
        good = scored.filter(F.col("predicted") == F.col(label)).count()
        assert good >= 0.9 * scored.count(), name
        assert scored.filter("score < 0 or score > 1 or score is null").count() == 0


def test_classifiers_without_labels(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, label int")
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, label int")
    for module in (toxicity, quality):
        for labels, want in ((none, 0.0), (one, 1.0)):
            scores = {r["score"] for r in module.score(docs, module.fit(docs, labels)).collect()}
            assert scores == {want}
    two = spark.createDataFrame([(1, 1), (9, 0), (10, 0), (3, 1)], "doc_id long, label int")
    model = quality.fit(docs, two)
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)


def test_templates_catch_other_values_and_check_slots(spark):
    item = ("when the train leaves at 9:30 with 120 people on board and 45 leave at the third stop "
            "how many of the 120 people are still on board after 20 km")
    other = item.replace("120", "77").replace("45", "12").replace("9:30", "8:15").replace("20 km", "35 km")
    broken = other.replace("of the 77", "of the 78")
    rows = [(1, "so " + item + " then"), (2, other), (3, broken), (4, None), (5, ""), (6, item[:30]), (None, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (None, item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["same_values"]) for r in template_decontamination.findings(docs, bench).collect()}
    assert got == {(1, 1, True), (2, 1, False), (None, 1, False)}
    assert {r["doc_id"] for r in template_decontamination.clean(docs, bench).collect()} == {3, 4, 5, 6}
    assert template_decontamination.findings(docs, bench.limit(0)).count() == 0


def test_secret_scan(spark, docs, empty):
    folder = "/root/testdata/sf0.01"
    given = spark.read.parquet(f"{folder}/documents.parquet")
    planted = given.filter(F.col("text").rlike(r"AKIA[0-9A-Z]{16}|password=[0-9a-f]{16}|token = \"[0-9a-f]{40}"))
    found = {r["doc_id"] for r in secret_scan.scan(given).select("doc_id").distinct().collect()}
    assert found == {r["doc_id"] for r in planted.select("doc_id").collect()}
    clean = secret_scan.redacted(given)
    assert clean.count() == given.count() and clean.columns == given.columns
    assert clean.filter(F.col("text").rlike(r"AKIA[0-9A-Z]{16}")).count() == 0
    assert secret_scan.redacted(docs).count() == docs.count() and secret_scan.scan(empty).count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 16))
    near = base[:60] + rng.normal(size=(60, 16)) * 0.05
    x = np.vstack([base, near, base[:3], 2 * base[:1]]).astype(np.float32)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] + [1.0] * 15, 0), (903, [None] + [1.0] * 15, 0),
           (904, [], 0), (905, [1.0, 0.0], 0), (906, [1.0, 0.01], 0), (None, [float(v) for v in x[7]], 0)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, recall int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"])
           for r in embedding_near_dedup.near_duplicates(frame).collect()}
    every = np.vstack([x, x[7:8]]).astype(float)
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    reach = linked.copy()
    for _ in range(6):
        reach = reach @ reach
    for i in range(len(x)):
        first = int(np.flatnonzero(reach[i, :len(x)]).min())
        assert got[i] == (int(linked[i].sum()) - 1, first, first == i)
    for i in (900, 901, 902, 903, 904):
        assert got[i] == (0, i, True)
    assert got[905] == (1, 905, True) and got[906] == (1, 905, False) and got[None][1] == 7
    assert embedding_near_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_embeddings_of_closed_clouds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(40, 32)), 75, axis=0) + rng.normal(size=(3000, 32)) * 0.12
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    wanted = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = embedding_near_dedup.near_duplicates(frame).collect()
    assert sum(r["n_links"] for r in got) >= 0.97 * wanted.sum() > 100_000 and min(r["recall"] for r in got) >= 0.97
    # a recall that no search reaches ends in the comparison of all with all
    monkeypatch.setattr(embedding_near_dedup, "RECALL", 2.0)
    part = embedding_near_dedup.near_duplicates(frame.filter("vec_id % 3 = 0")).collect()
    third = (unit[::3] @ unit[::3].T >= 0.95).sum(axis=1) - 1
    assert {r["vec_id"]: r["n_links"] for r in part} == {3 * i: int(n) for i, n in enumerate(third)}


def test_pipeline_keeps_columns_and_takes_effect(spark, tmp_path, docs, empty):
    import corpus_pipeline

    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, empty):
            out = stage(spark, given, str(tmp_path))
            assert out.columns == given.columns, name
            assert out.count() <= given.count()
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).select("doc_id").collect()
    assert {1, 4, 5} <= {r["doc_id"] for r in kept} and not {2, 2**60 + 1} & {r["doc_id"] for r in kept}
    done = corpus_pipeline.run(spark, SMALL)
    assert done.filter("not round_trip").count() == 0 and 100 < done.count() < 200
