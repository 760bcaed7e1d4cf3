"""Cases in which operators once went wrong: repeated ids, very long runs, foreign texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cohortlake.llm import (
    language_id,
    ngram_join,
    quality,
    secret_scan,
    substring_dedup,
    template_decontamination,
    toxicity,
    workers,
)

SCHEMA = "doc_id long, text string, lang string, n_chars long, __row long"


def reduced(rows, window):
    """Brute force: words that no window of an earlier document covers."""
    first = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        for at in range(len(words) - window + 1):
            key = tuple(words[at:at + window])
            first[key] = min(first.get(key, i), i)
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = set()
        for at in range(len(words) - window + 1):
            if first[tuple(words[at:at + window])] < i:
                gone.update(range(at, at + window))
        yield i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_an_id_on_several_texts(spark, seed):
    workers.prepare(spark)
    rng = random.Random(seed)
    passages = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(13, 30))) for _ in range(25)]
    rows = [(i, " ".join([rng.choice(passages), str(rng.random()), rng.choice(passages)])) for i in range(40) for _ in range(3)]
    rows += rows[:4]
    got = substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(tuple(r) for r in got) == sorted(reduced(rows, 13))


def test_templates_of_very_long_runs(spark):
    item = "the farmer sold 12 apples and Maria bought 30 more pears for the whole village market"
    texts = ["in " + "Maria " * 50_000, "1," * 100_000, "see " + "Anna Lee " * 30_000 + item, "5 kg " * 60_000, "é" * 200_000,
             "x" + "1.2:3/" * 50_000, "", None, "A" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r["doc_id"] for r in template_decontamination.findings(docs, bench).collect()] == [2]


@pytest.mark.parametrize("before", ["plain words and", "we wrote the JavaScript code and", "from YouTube or the McDonald farm:",
                                    "he met Maria2 and Paul-Anna, then"])
def test_slots_follow_their_own_match(spark, before):
    item = "yesterday Maria gave 3 apples to Paul and then Maria took 5 pears from the old basket"
    other = item.replace("Maria", "Olga").replace("Paul", "Kim").replace("3", "8").replace("5", "9")
    mixed = item.replace("then Maria", "then Olga")
    docs = spark.createDataFrame([(1, f"{before} {item}"), (2, f"{before} {other}"), (3, f"{before} {mixed}")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r["same_values"] for r in template_decontamination.findings(docs, bench).collect()}
    assert got == {1: True, 2: False}


def test_one_row_of_each_group_stays(spark, tmp_path):
    import corpus_pipeline

    x, y = "one two three four five six seven eight nine ten eleven", "a b c d e f g h i j k l"
    near = " ".join([x] * 4)
    rows = [(5, x), (9, x), (40, x), (3, y), (5, y), (20, y), (7, near), (7, near), (8, near + " zz"), (None, near),
            (None, "p q r s t u v"), (None, "p q r s t u v"), (None, None), (None, None), (6, ""), (6, "")]
    frame = spark.createDataFrame([(i, t, "en", k, 1) for k, (i, t) in enumerate(rows)], SCHEMA.replace("__row", "`group`"))
    got = corpus_pipeline.drop_near_copies(spark, frame, str(tmp_path))
    assert got.columns == frame.columns
    kept = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()), key=str)
    assert kept == sorted([(5, x, 0), (3, y, 3), (7, near, 6), (None, "p q r s t u v", 10), (None, None, 12), (None, None, 13),
                           (6, "", 14), (6, "", 15)], key=str)


def test_foreign_texts_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs, F.lit(True))
    foreign = ["Съешь же ещё этих мягких французских булок, да выпей чаю", "これは日本語の文章です。テストのために書かれています。",
               "qxzkj vwpqx zzkqj xvbqw kjqxz pqzxv wkxjq zvqxk", "123 456", None, ""]
    given = docs.select("doc_id", "text").union(
        spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(foreign)], "doc_id long, text string"))
    kept = {r["doc_id"] for r in language_id.identified(given, model).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.filter("text rlike '[a-zA-Z]'").select("doc_id").collect()}


def test_short_and_punctuated_secrets(spark):
    workers.prepare(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    short = ['password = "S3cr3t!pass#2024" was set', "see https://bob:hunter2xyz@db.example.org/main now",
             "run with password=Xy7kQ29a, then stop", "my_api_secret_password: q8Zt41mmW."]
    plain = ["the password: remember it well", "a secret = nothing", "auth:" * 20_000, "password=" * 20_000,
             "http://host:8080/path and 10:30", "author: Smith2020x", "://a:" * 20_000, "token: 1" + "." * 50_000]
    given = docs.union(spark.createDataFrame(
        [(10_000 + i, t) for i, t in enumerate(short)] + [(20_000 + i, t) for i, t in enumerate(plain)],
        "doc_id long, text string"))
    found = secret_scan.scan(given)
    assert sorted((r["doc_id"], r["finding"]) for r in found.filter("doc_id >= 10000").collect()) == [
        (10_000, "S3cr3t!pass#2024"), (10_001, "hunter2xyz"), (10_002, "Xy7kQ29a"), (10_003, "q8Zt41mmW")]
    before = {(r["doc_id"], r["finding"]) for r in secret_scan.scan(docs).select("doc_id", "finding").collect()}
    assert before <= {(r["doc_id"], r["finding"]) for r in found.select("doc_id", "finding").collect()}
    assert secret_scan.redacted(given).filter("doc_id = 10001").first()["text"] == (
        "see https://bob:<SECRET>@db.example.org/main now")


def test_an_id_on_many_rows_stays_in_the_bound(spark):
    workers.prepare(spark)
    docs = spark.createDataFrame(
        [(i % 4, f"good clean text {i}" if i % 2 else f"bad junk {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, label int")
    seen = []
    kept, quality.train = quality.train, lambda x, y, v: seen.append(len(x)) or kept(x, y, v)
    try:
        quality.fit(docs, labels, rows=2)
        quality.fit(docs, labels)
    finally:
        quality.train = kept
    assert max(seen) <= 4
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 400


def test_linked_rows_without_an_id_or_repeated(spark):
    workers.prepare(spark)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words[:40] + [f"x{i}"]) for i in range(12)]
    rows = [(None, t) for t in texts for _ in range(3)] + [(7, texts[0])] * 5 + [(7, texts[1]), (9, "alone in the world here")]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    assert {r["component_id"] for r in got if r["n_shingles"] > 10} == {7}
    assert [r["component_id"] for r in got if r["doc_id"] == 9] == [9]
    for percent in (50, 0, 101):
        with pytest.raises(ValueError):
            ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent)


def test_words_that_collide_under_any_sum_of_powers_stay_apart(spark):
    workers.prepare(spark)
    one, two = "a", "b"
    for _ in range(10):
        one, two = one + two, two + one
    # a combination of powers of the former base that is 0 modulo 2^64
    zero = [-3, 0, -8, -5, 3, 6, -2, -12, -4, -13, 12, 5, 1, -2]
    short = "n" * 14, "".join(chr(ord("n") + d) for d in zero)
    pairs = [(one, two), short]
    rows = [(10 * k + j, w) for k, p in enumerate(pairs) for j, w in enumerate(p)]
    rows += [(100 + 10 * k + j, f"{w} x{k} y z {w}") for k, p in enumerate(pairs) for j, w in enumerate(p)]
    rows += [(200, f"{one} x y z {two} x y z"), (300, "a\0"), (301, "a")]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got)
    assert {r["doc_id"]: r["n_shingles"] for r in got}[200] == 5


def test_the_join_compares_once_and_shuffles_only_the_texts_that_take_part(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 9) for _ in range(40)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t + " end") for i, t in enumerate(texts[:7])]
    rows += [(200, texts[0]), (200, texts[0]), (None, texts[1]), (300, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plans = []
    kept = ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda links: plans.append(
        links._jdf.queryExecution().toString()) or kept(links))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs).collect()}
    assert got[200] == got[100] == got[0] == 0 and got[None] == got[101] == 1 and got[300] == 300
    assert all(got[100 + i] == i for i in range(7)) and got[50] == 50
    # the components read both directions of a link, and the comparison is not run for each
    assert len(plans) == 1 and "MapInPandas" not in plans[0]
    source = spark.range(-5000, 5000).select(F.col("id"), F.xxhash64("id").alias("key"))
    chosen = source.filter("id % 100 = 0")
    admitted = {r["id"] for r in ngram_join._admitted(source, chosen).collect()}
    assert admitted >= set(range(-5000, 5000, 100)) and len(admitted) < 200
