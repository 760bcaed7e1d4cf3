"""Neighbours, equalized odds, placement, leak checks: brute force and hard cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cohortlake.operators import evaluate as E, fairness as FA, models as MD, neighbours as N, odds as OD, placement as PL
from cohortlake.operators import privacy as PR


# ---- neighbours ---------------------------------------------------------------------


def cloud(spark, n, width, seed=1):
    rng = random.Random(seed)
    rows = [(i, *[rng.gauss((i % 5) * (j % 3), 1.0) for j in range(width)]) for i in range(n)]
    names = [f"f{j}" for j in range(width)]
    return spark.createDataFrame(rows, ["id", *names]), names, rows


@pytest.mark.parametrize("width, options", [(1, {}), (3, {}), (70, {"orders": 4, "block": 256})])
def test_neighbours_are_exact_and_mostly_the_nearest(spark, width, options):
    df, names, rows = cloud(spark, 400, width)
    points = {r[0]: r[1:] for r in rows}
    hit = total = 0
    for r in N.nearest(df, names, "id", k=4, **options).collect():
        own = points[r["id"]]
        away = sorted((math.dist(own, p), i) for i, p in points.items() if i != r["id"])
        assert len(r["near"]) == 4 and [n["distance"] for n in r["near"]] == sorted(n["distance"] for n in r["near"])
        for n in r["near"]:
            assert math.isclose(n["distance"], math.dist(own, points[n["key"]]), rel_tol=1e-9)
            hit += n["distance"] <= away[3][0] + 1e-9
        total += 4
    assert hit >= 0.9 * total
    found = N.neighbour_recall(df, names, "id", k=4, queries=50, **options).first()
    assert found["n_queries"] == 50 and found["recall"] >= 0.9


def test_no_block_over_its_size(spark):
    # equal rows fall into one cell of every order
    df = spark.range(500).select("id", F.lit(1.0).alias("a"))
    near = N.nearest(df, ["a"], "id", k=3, block=8).collect()
    assert len(near) == 500 and all(len(r["near"]) == 3 and r["near"][0]["distance"] == 0 for r in near)
    assert N.nearest(df.limit(0), ["a"], "id").count() == 0
    assert N.nearest(df.limit(1), ["a"], "id").first()["near"] == []


def test_rows_without_a_feature_are_refused(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 0, 1.0), (3, 0, 2.0)], "id int, y int, a double")
    with pytest.raises(ValueError, match="lack a feature"):
        MD.oversample(df, ["a"], "y", "id")


@pytest.mark.parametrize("width", [2, 20])
def test_synthetic_rows_lie_between_neighbours(spark, width):
    df, names, rows = cloud(spark, 60, width)
    labelled = df.withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    out = MD.oversample(labelled, names, "y", "id", k=3, block=64)
    made = out.filter("is_synthetic").collect()
    assert len(made) == 30 and {r["y"] for r in made} == {1}
    minority = [r[1:] for r in rows if r[0] % 4 == 0]
    for r in made:
        x = [r[n] for n in names]
        assert min(abs(math.dist(x, a) + math.dist(x, b) - math.dist(a, b)) for a in minority for b in minority if a != b) < 1e-6


def test_a_lone_minority_row_is_copied(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (2, 0, 1.0), (3, 0, 2.0), (4, 0, 3.0)], "id int, y int, a double")
    made = MD.oversample(df, ["a"], "y", "id").filter("is_synthetic").collect()
    assert [r["a"] for r in made] == [5.0, 5.0]


# ---- equalized odds -------------------------------------------------------------------


def hull_of(points):
    out = []
    for p in sorted(points):
        while len(out) > 1 and (out[-1][1] - out[-2][1]) * (p[0] - out[-1][0]) <= (p[1] - out[-1][1]) * (out[-1][0] - out[-2][0]):
            out.pop()
        out.append(p)
    return out


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(6)
    rows = []
    for i in range(3_000):
        group, y = rng.choice(["a", "a", "a", "b", None]), int(rng.random() < 0.3)
        noise = {"a": 0.2, "b": 0.5, None: 1.5}[group]
        rows.append((i, group, y, round(y * 0.3 + rng.random() * noise, 2 if group == "a" else 4)))
    return spark.createDataFrame(rows, "row_id long, g string, y_true int, score double")


@pytest.mark.parametrize("chunk", [512, 4])
def test_hull_agrees_with_monotone_chain(scored, chunk):
    points = E.curve(scored.withColumn("g", F.coalesce("g", F.lit("Unknown"))), ["g"])
    got = {}
    for r in OD.roc_hull(points, "g", chunk).collect():
        got.setdefault(r["g"], []).append((r["fp"], r["tp"]))
    curves = {}
    for r in points.collect():
        best = curves.setdefault(r["g"], {0: 0})
        best[r["fp"]] = max(best.get(r["fp"], 0), r["tp"])
    assert {g: sorted(v) for g, v in got.items()} == {g: hull_of(c.items()) for g, c in curves.items()}


def test_all_groups_meet_at_one_point(spark, scored):
    rule = OD.equalized_odds(scored, "g")
    rules = {r["g"]: r for r in rule.collect()}
    assert set(rules) == {"a", "b", "Unknown"} and len({(r["fpr"], r["recall"]) for r in rules.values()}) == 1
    rows = scored.collect()
    for g, r in rules.items():
        own = [x for x in rows if (x["g"] or "Unknown") == g]
        for label, goal in ((0, r["fpr"]), (1, r["recall"])):
            of = [x["score"] for x in own if x["y_true"] == label]

            def rate(t):
                return 0.0 if t is None else sum(s >= t for s in of) / len(of)

            mixed = r["lenient_weight"] * rate(r["lenient_threshold"]) + (1 - r["lenient_weight"]) * rate(r["strict_threshold"])
            assert math.isclose(r["ignored"] * r["fpr"] + (1 - r["ignored"]) * mixed, goal, abs_tol=1e-9)
    # decisions follow the rule, up to chance
    done = OD.randomised_decisions(scored, rule, "g", "row_id")
    assert done.columns == [*scored.columns, "predicted"] and done.count() == scored.count()
    for r in done.groupBy("g").agg(F.avg(F.when(F.col("y_true") == 1, F.col("predicted"))).alias("recall")).collect():
        assert abs(r["recall"] - rules["a"]["recall"]) < 0.12


def test_groups_without_a_class_are_refused(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.4), ("b", 1, 0.3)], "g string, y_true int, score double")
    with pytest.raises(ValueError, match="lack one of the classes"):
        OD.equalized_odds(df, "g")


def test_a_null_group_is_a_group_of_its_own(spark, scored):
    without = {r["g"]: r["recall"] for r in FA.group_thresholds(scored.filter("g is not null"), "g").collect()}
    with_null = {r["g"]: r["recall"] for r in FA.group_thresholds(scored, "g", max_gap=1.0).collect()}
    assert set(without) == {"a", "b"} and set(with_null) == {"a", "b", "Unknown"}


# ---- placement ------------------------------------------------------------------------


def serial(requests, hospitals):
    """Where priorities are common, the stable placement serves the requests in their order."""
    tiers = {"Tertiary Care Center": 0, "Community Hospital": 1, "Rural Hospital": 2}
    free = {h: b for h, _, b, _ in hospitals}
    lists = {}
    for h, tier, b, can in sorted(hospitals, key=lambda x: (tiers.get(x[1], 99), -x[2], x[0])):
        for c in can:
            lists.setdefault(c, []).append(h)
    out = {}
    for i, c, own, risk in sorted(requests, key=lambda r: (r[3] is None, -(r[3] or 0), r[0])):
        out[i] = next((h for h in lists.get(c, []) if h != own and free[h] > 0), None)
        if out[i]:
            free[out[i]] -= 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_placement_is_stable_and_fills_no_hospital_over_its_beds(spark, seed):
    rng = random.Random(seed)
    names = ["ecmo", "dialysis", "cardiac_surgery"]
    hospitals = [(f"h{i}", rng.choice(["Tertiary Care Center", "Community Hospital", "Rural Hospital", "other"]), rng.randint(0, 4),
                  rng.sample(names, rng.randint(0, 3))) for i in range(8)]
    requests = [(i, rng.choice([*names, "mri", None]), rng.choice(["h0", "h1", "h2", None]), rng.choice([None, 0.1, 0.5, rng.random()]))
                for i in range(50)]
    flags = [(h, t, b, "{" + ", ".join(f'"{n}": {"true" if n in can else "false"}' for n in names) + "}") for h, t, b, can in hospitals]
    resources = spark.createDataFrame(flags, "hospital_id string, hospital_tier string, icu_beds_available int, specialized_capabilities string")
    asked = spark.createDataFrame(requests, "request_id long, capability string, requesting_hospital string, risk_score double")
    placed, log = PL.place_requests(asked, resources)
    got = {r["request_id"]: r["target"] for r in placed.collect()}
    assert got == serial(requests, hospitals)
    assert log[-1]["hospitals"] == 0 and all(step["rejected"] > 0 for step in log[:-1])
    assert PL.unstable_pairs(placed, asked, resources).count() == 0
    # a bed taken away from the first request makes pairs that would rather have each other
    first = next(i for i, h in got.items() if h)
    moved = placed.withColumn("target", F.when(F.col("request_id") != first, F.col("target")))
    assert PL.unstable_pairs(moved, asked, resources).filter(F.col("request_id") == first).count() > 0
    assert PL.place_requests(asked.limit(0), resources)[0].count() == 0


@pytest.mark.parametrize("block", [40, 10_000])
def test_placement_serves_long_lists_in_few_rounds(spark, monkeypatch, block):
    """Lists that share hospitals: a round serves a block of requests, however many hospitals turn them down."""
    rng = random.Random(3)
    names = ["ecmo", "dialysis", "cardiac_surgery"]
    hospitals = [(f"h{i:03}", "Rural Hospital", rng.randint(0, 2), rng.sample(names, rng.randint(1, 3))) for i in range(120)]
    requests = [(i, rng.choice([*names, "mri"]), rng.choice(["h000", "h007", None]), rng.choice([None, 0.5, rng.random()]))
                for i in range(400)]
    flags = [(h, t, b, "{" + ", ".join(f'"{n}": {"true" if n in can else "false"}' for n in names) + "}") for h, t, b, can in hospitals]
    resources = spark.createDataFrame(flags, "hospital_id string, hospital_tier string, icu_beds_available int, specialized_capabilities string")
    asked = spark.createDataFrame(requests, "request_id long, capability string, requesting_hospital string, risk_score double")
    monkeypatch.setattr(PL, "BLOCK", 1, raising=False)
    monkeypatch.setattr(PL, "LEAST_BLOCK", block, raising=False)
    placed, log = PL.place_requests(asked, resources, most_rounds=-(-400 // block))
    rows = placed.collect()
    assert {r["request_id"]: r["target"] for r in rows} == serial(requests, hospitals)
    taken = {}
    for r in rows:
        if r["target"]:
            taken.setdefault(r["target"], []).append(r["bed"])
    assert all(sorted(beds) == list(range(1, len(beds) + 1)) for beds in taken.values())
    assert log[-1]["hospitals"] == 0 and len(log) <= -(-400 // block) + 1


# ---- leaks ----------------------------------------------------------------------------


def test_identifiers_with_quotes_and_those_of_others_are_found(spark):
    people = spark.createDataFrame([
        (1, 'O"Brien Pat', "A-100 200"), (2, "Smith Jo", "B\\200"), (3, "Li", "C-300"), (4, None, None)],
        "id long, name string, mrn string")
    sent = spark.createDataFrame([
        (1, 'seen O"Brien Pat today', ["x"]), (2, "for B\\200 and SMITH, jo; see a 100 200", ["O\"brien", "pat"]),
        (3, "Li Smithson Jo", ["C-3001"]), (4, "smith", ["jo", "c 300"])], "id long, note string, list array<string>")
    own = {r["id"]: r["leaked"] for r in PR.leaked_values(people, sent, "id", ["name", "mrn"]).collect()}
    assert own == {1: ["name"], 2: ["mrn"], 3: ["mrn"]}
    found = {tuple(r) for r in PR.foreign_leaks(people, sent, "id", ["name", "mrn"]).collect()}
    assert found == {(1, "name", 1), (2, "mrn", 2), (2, "name", 2), (2, "mrn", 1), (2, "name", 1), (4, "mrn", 3)}
    assert PR.foreign_leaks(people.limit(0), sent, "id", ["name"]).count() == 0


def test_frequent_windows_are_found_beside_the_others(spark, monkeypatch):
    monkeypatch.setattr(PR, "OFTEN", 3)
    monkeypatch.setattr(PR, "ROWS_PER_TASK", 7)
    people = spark.createDataFrame([(1, "Smith Jo"), (2, "Rare One"), (3, "smith, jo"), (4, "Nobody")], "id long, name string")
    sent = spark.createDataFrame(
        [(i, "smith jo" if i % 2 else "said by rare one" if i == 4 else "nothing") for i in range(12)], "id long, note string")
    found = sorted(tuple(r) for r in PR.foreign_leaks(people, sent, "id", ["name"]).collect())
    assert found == sorted([(i, "name", o) for i in range(1, 12, 2) for o in (1, 3)] + [(4, "name", 2)])


def test_neighbours_do_not_depend_on_the_cut_into_chunks(spark, monkeypatch):
    rows = [(None if i % 97 == 0 else i % 290, (i * 7 % 50) / 5, float(i * 11 % 30)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    whole = N.nearest(df, ["a", "b"], "id", k=4, block=16).collect()
    monkeypatch.setattr(N, "CHUNK", 32)
    cut = N.nearest(df, ["a", "b"], "id", k=4, block=16).collect()
    assert sorted(map(str, whole)) == sorted(map(str, cut)) and len(cut) == 289
    seen = N.neighbour_recall(spark.createDataFrame([(i, float(i)) for i in range(40)], "id long, a double"), ["a"], "id", queries=7)
    assert seen.first().asDict() == {"n_queries": 7, "recall": 1.0}


def nearest_by_pairs(rows, k):
    at = {}
    for key, *point in rows:
        at.setdefault(key, set()).add(tuple(point))
    found = {}
    for key, own in at.items():
        away = {(sum((a - b) ** 2 for a, b in zip(x, y)), other) for x in own for other, points in at.items()
                if None not in (key, other) and other != key for y in points}
        found[key] = [(math.sqrt(d), other) for d, other in sorted(away)[:k]]
    return found


@pytest.mark.parametrize("rows", [
    # many features of unlike spread, so no order of the plane keeps near rows together
    lambda draw: [(i, *[draw.gauss(0, 1 + j) for j in range(12)]) for i in range(600)],
    # one place of most rows, ties between places, keys at several places and without a key
    lambda draw: [(None if i % 90 == 7 else i % 500, *([0.0, -0.0] if i % 3 else [draw.randrange(9) / 1.0, float(draw.randrange(9))]))
                  for i in range(560)],
])
def test_no_nearer_row_is_left_out(spark, monkeypatch, rows):
    rows = rows(random.Random(3))
    names = [f"f{j}" for j in range(len(rows[0]) - 1)]
    monkeypatch.setattr(N, "CHUNK", 64)
    df = spark.createDataFrame(rows, ", ".join(["id long", *[f"{n} double" for n in names]]))
    found = {r["id"]: [(n["distance"], n["key"]) for n in r["near"]] for r in N.nearest(df, names, "id", block=16).collect()}
    wanted = nearest_by_pairs(rows, 5)
    assert found.keys() == wanted.keys()
    for key, near in wanted.items():
        assert [n[1] for n in found[key]] == [n[1] for n in near]
        assert [n[0] for n in found[key]] == pytest.approx([n[0] for n in near], rel=1e-12)
