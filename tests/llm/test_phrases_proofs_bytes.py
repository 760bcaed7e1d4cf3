"""Phrase mining, the Merkle manifest and byte-level BPE against brute force."""

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from cohortlake.llm import byte_bpe_codec, collocations, merkle_manifest, queries, workers
from oracle_check import compare, connect
from tests.conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, phrase int, tree int, n int"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    workers.prepare(spark)
    rng = random.Random(5)
    vocabulary = ["A", "b", "ç", "the", "The", "x-y", "日本", "10", " z", "q\x1cq"]
    # a run of very common words, repeated rows, nulls, empty and long texts
    texts = [None, "", " \t", ".,;", "a. b! A  b\tA b", "the the the the", "the " * 30_000, "x" * 200_000] + [
        "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\t", ". ", "\n", " ", " "])
                for _ in range(rng.randint(0, 60))) for _ in range(120)]
    rows = [(rng.choice([i, i, i, None]), t, rng.choice([None, "und", "en", "en", "é", ""]), rng.choice([None, "", "s"]),
             rng.choice([None, 0, 2**63 - 1]), 1, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[4:10], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- phrases ------------------------------------------------------------------------


def mined(rows, least, longest, top, covered):
    counts = {}
    for r in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")
        lang = "und" if r["lang"] is None else r["lang"]
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            for m in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(
                    tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            held = [b for q, b in candidates.items() if len(q) > len(p)
                    and any(q[i:i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= covered * a for b in held):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


@pytest.mark.parametrize("least, longest, top, share, bits", [
    (10, 3, 2000, 0.25, 26), (3, 3, 20, 0.02, 16), (2, 4, 50, 0.5, 7), (5, 2, 7, 0.0, 10)])
def test_phrases_agree_with_brute_force_whatever_the_sample_and_filter(docs, least, longest, top, share, bits):
    got = collocations.collocations(docs, least, longest, top, share=share, filter_bits=bits)
    assert got.dtypes[1] == ("rank", "bigint") and got.dtypes[-1] == ("score", "bigint")
    assert sorted(tuple(r) for r in got.collect()) == mined(docs.collect(), least, longest, top, 50)


def test_phrases_of_chunks_cut_inside_a_piece(monkeypatch):
    words = [random.Random(8).choice("abc") for _ in range(5_000)]
    data = " ".join(words).encode()
    found = Counter()
    for batch in collocations._counted("en", data, 5, None, None):
        found.update(dict(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())))
    want = Counter({"": len(words)})
    for m in range(1, 6):
        want.update(" ".join(words[i:i + m]) for i in range(len(words) - m + 1))
    assert found == want
    parts = list(collocations._slices([b"a b. " * 50, b"", b"c" * 99], 40))
    assert b"\n".join(parts).replace(b"\n", b"").replace(b" ", b"") == (b"ab." * 50 + b"c" * 99)


def test_phrases_of_an_empty_table(empty):
    assert collocations.collocations(empty).collect() == []


def test_scores_beyond_64_bits(spark):
    rows = [("a b", 7_000_000_000_000), ("a", 7_500_000_000_000), ("b", 9_000_000_000_001)]
    wide = spark.createDataFrame(rows, "p string, n long").withColumn("w", F.col("n").cast("decimal(14,0)"))
    got = wide.agg(*[F.max(F.when(F.col("p") == p, F.col("w"))).alias(c) for p, c in (("a b", "a"), ("a", "l"), ("b", "r"))])
    got = got.withColumn("up", F.lit(1_000_000).cast("decimal(7,0)") * (F.col("a") * F.col("a"))).withColumn(
        "down", F.col("l") * F.col("r")).select(F.expr("cast(up div down as bigint)")).first()[0]
    assert got == 1_000_000 * rows[0][1] ** 2 // (rows[1][1] * rows[2][1])


# ---- proofs -------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    paths, place, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, p in enumerate(place):
            paths[i].append((p % 2, level[p ^ 1]) if p ^ 1 < len(level) else None)
            place[i] = p // 2
        level = [digest(*level[i:i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def manifest(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    groups = {}
    for r in rows:
        def leaf(n):
            return digest(*map(field, (r["doc_id"], r["source"], r["lang"], n, r["text"])))
        forged = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
        groups.setdefault(r["lang"], []).append(
            ((r["doc_id"] is not None, r["doc_id"] or 0), leaf(r["n_chars"]), leaf(r["n_chars"] + forged if forged else r["n_chars"])))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for k in keys:
        groups[k].sort()
    below = [tree([g[1] for g in groups[k]]) for k in keys]
    root, upper = tree([sub for sub, _ in below])
    for k, (sub, paths), up in zip(keys, below, upper):
        for (order, leaf, own), path in zip(groups[k], paths):
            for step in path + up:
                own = digest(*((own,) if step is None else (step[1], own) if step[0] else (own, step[1])))
            held = digest(*[s[1] for s in path + up if s])
            yield (order[1] if order[0] else None), leaf, sub, root, held, own, own == root


@pytest.mark.parametrize("block", [12, 3, 1])
def test_manifest_agrees_with_brute_force(docs, block):
    got = [tuple(r) for r in queries.manifest(docs, block=block).collect()]
    assert sorted(got, key=str) == sorted(manifest(docs.collect()), key=str)
    assert {g[-1] for g in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 33])
def test_manifest_of_one_group(spark, n):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(None).cast("string").alias("lang"),
                               F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    got = sorted(tuple(r) for r in queries.manifest(df, block=2).collect())
    assert got == sorted(manifest(df.collect()))


def test_manifest_of_an_empty_table(empty):
    assert queries.manifest(empty).collect() == []


def test_a_hot_group_is_no_task_of_its_own(spark):
    big = spark.range(20_000).select(F.lit("=en").alias("tree"), F.col("id").alias("place"),
                                     F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    nodes, roots = merkle_manifest.tree_nodes(big, 6)
    assert roots.count() == 1 and nodes.filter("level = 0").count() == 20_000
    paths = merkle_manifest.root_paths(nodes, 6)
    assert paths.selectExpr("min(octet_length(steps)) / 33 = 15 and max(octet_length(steps)) / 33 = 15").first()[0]


# ---- byte-level BPE -------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def unpacked(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_ids_and_streams_agree_with_the_library(encoding):
    codec, rng, tokens = byte_bpe_codec.Codec(RANKS, public_tokenizers.PATTERN), random.Random(1), encoding.token_byte_values()
    for turn in range(4_000):
        kind = turn % 4
        if kind == 0:
            text = "".join(rng.choice("ab \n\t.,1é日😀　\x1c\x85 nanan") for _ in range(rng.randint(0, 40)))
        elif kind == 1:
            text = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 8))).decode(errors="ignore")
        elif kind == 2:
            text = rng.choice(["a", "-", "=", " ", "aaab", "\n", "😀", "é", "0", "  x", "<|endoftext|>"]) * rng.randint(1, 300)
        else:
            text = "".join(chr(rng.choice([rng.randint(1, 0x250), rng.randint(0x250, 0x9000), rng.randint(0x10000, 0x1FFFF)]))
                           for _ in range(rng.randint(1, 20)))
        packed, decoded = codec.encode(text)
        ids = unpacked(packed)
        assert ids == encoding.encode_ordinary(text) and decoded == text
        # ids cut anywhere decode like the library's, broken characters replaced
        cut = ids[rng.randint(0, len(ids)):][:rng.randint(0, 9)]
        assert codec.decode(cut) == encoding.decode(cut)


def test_determinised_part_can_be_forgotten(encoding, monkeypatch):
    monkeypatch.setattr(byte_bpe_codec, "TRANSITIONS", 50)
    monkeypatch.setattr(byte_bpe_codec, "MEMORY", 5)
    monkeypatch.setattr(byte_bpe_codec, "WAIT", 3)
    codec = byte_bpe_codec.Codec(RANKS, public_tokenizers.PATTERN)
    text = "aaaabaaab " * 9 + "-" * 500 + "Streams of unusual words: antidisestablishmentarianism, 日本語, ééé, xyzzy. " * 3
    assert unpacked(codec.encode(text)[0]) == encoding.encode_ordinary(text)
    assert len(codec.known) <= 5 and len(codec.transducer.pairs) <= 60


def test_a_token_that_no_merge_makes():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 300, b"xyz": 301}
    own = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    machine = byte_bpe_codec.Transducer(ranks)
    for text in ("xyz", "xyzxyz", "abc", "abcabc", "bcbc", "aabcc"):
        assert machine.encode(text.encode()) == own.encode_ordinary(text)
    with pytest.raises(ValueError):
        byte_bpe_codec.Transducer({b"a": 0})


def test_codec_over_rows(docs, empty, encoding):
    got = byte_bpe_codec.encode(docs, RANKS, public_tokenizers.PATTERN, keep=("doc_id", "text", "n")).collect()
    assert len(got) == docs.count()
    for r in got:
        assert unpacked(r["ids"]) == encoding.encode_ordinary(r["text"] or "") and r["decoded"] == (r["text"] or "")
    assert byte_bpe_codec.digests(empty, RANKS, public_tokenizers.PATTERN).collect() == []


# ---- queries -------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_collocations", "op12_merkle_manifest"])
def test_queries_agree_with_their_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.SQL[name]) == "ok"


def test_byte_query(spark, encoding):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.op13_byte_bpe(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = encoding.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
