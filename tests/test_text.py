import difflib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dealwright.operators import extract, labels, match


def test_fuzzy_match(spark):
    df = spark.createDataFrame([("Petrl",), ("diesel",), ("banana",)], "v string")
    got = {r.v: (r.matched, r.match_note) for r in match.fuzzy_match(df, "v", ["Petrol", "Diesel"]).collect()}
    assert got == {"Petrl": ("Petrol", "corrected"), "diesel": ("Diesel", None), "banana": (None, "not recognised")}


@pytest.mark.parametrize("similarity", ["edit", "sequence"])
def test_fuzzy_segment(spark, similarity):
    catalog = spark.createDataFrame([("Toyota", "Corolla"), ("Honda", "Fit")], "make string, model string")
    df = spark.createDataFrame([("toyota corola",), ("zzzzzzzzzz",)], "v string")
    got = {r.text: (r.known_make, r.known_model) for r in match.fuzzy_segment(df, "v", catalog, similarity=similarity).collect()}
    assert got == {"toyota corola": ("Toyota", "Corolla"), "zzzzzzzzzz": ("Honda", "Fit")}
    nothing = match.fuzzy_segment(df, "v", catalog.limit(0), similarity=similarity).collect()
    assert {(r.known_make, r.known_model) for r in nothing} == {("General", "Model")}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_segments_by_their_rarest_pairs_are_the_closest_of_all(spark, monkeypatch):
    monkeypatch.setattr(match, "CHUNK", 3)
    draw = random.Random(5)
    names = sorted({("".join(draw.choices("abc", k=draw.randint(1, 5))), "".join(draw.choices("abcd", k=draw.randint(1, 8)))) for _ in range(80)})
    typed = {"".join(draw.choices("abcd ", k=draw.randint(1, 14))) for _ in range(60)} | {"", "aaaaaaaa", "a"}
    for name in names[::2]:
        text = list(" ".join(name))
        text[draw.randrange(len(text))] = draw.choice("abcdx")
        typed.add("".join(text))
    catalog = spark.createDataFrame(names, "make string, model string")
    got = match.fuzzy_segment(spark.createDataFrame([(t,) for t in typed] + [(None,)], "v string"), "v", catalog).collect()
    assert len(got) == len(typed) + 1
    for r in got:
        best = None
        if r.text is not None:
            texts = ((1 - edit_distance(r.text, " ".join(n)) / max(len(r.text), len(" ".join(n))), " ".join(n)) for n in names)
            best = max(texts)
        if best is None or best[0] < 0.5:
            assert (r.known_make, r.known_model, r.score) == (*names[0], None)
        else:
            assert (f"{r.known_make} {r.known_model}", r.score) == (best[1], pytest.approx(best[0]))


def test_rare_pairs_leave_few_names_to_compare(spark):
    """Texts with one wrong letter meet a small part of a catalog."""
    draw = random.Random(6)
    names = [("".join(draw.choices("abcdefghijklmnoprstuvw", k=6)), "".join(draw.choices("abcdefghijklmnoprstuvw", k=8))) for _ in range(3000)]
    known = spark.createDataFrame(names, "make string, model string").withColumn("text", F.concat_ws(" ", "make", "model"))
    queries = known.limit(200).select(F.concat(F.expr("substr(text, 1, 4)"), F.lit("z"), F.expr("substr(text, 6)")).alias("query"))
    counts, _ = match.gram_index(known)
    met = match.gram_probes(queries, counts, match.LEVELS[0]).agg(F.sum("n")).first()[0]
    print("share of pairs compared", met / (200 * 3000))
    assert met < 0.05 * 200 * 3000


def test_sequence_matching_agrees_with_the_standard_library(spark):
    names = [("Toyota", "Corolla"), ("Toyota", "Caldina"), ("Subaru", "Legacy"), ("Subaru", "Outback"), ("Mazda", "Demio")]
    catalog = spark.createDataFrame(names, "make string, model string")
    queries = ["toyota calina", "subaru outbak", "mazda demio", "suzuki", "legacy subaru"]
    df = spark.createDataFrame([(q,) for q in queries], "v string")
    texts = [f"{a} {b}".lower() for a, b in names]
    got = {r.text: f"{r.known_make} {r.known_model}".lower() if r.score else None
           for r in match.fuzzy_segment(df, "v", catalog, similarity="sequence").collect()}
    for q in queries:
        expected = difflib.get_close_matches(q, texts, n=1, cutoff=0.5)
        assert got[q] == (expected[0] if expected else None)


def test_few_ratios_are_taken_to_find_the_closest_sequence(monkeypatch):
    """Two bounds leave a small part of all pairs, and the name found is that of a full comparison."""
    draw = random.Random(8)
    word = lambda n: "".join(draw.choices("abcdefghijklmno", k=n))
    names = [{"text": f"{m} {n}", "make": m, "model": n} for m, n in {(word(5), word(9)) for _ in range(300)}]
    names += [{"text": "zzz", "make": None, "model": "zzz"}, {"text": "zzz", "make": "zzz", "model": None}, {"text": "", "make": None, "model": None}]
    typed = [n["text"][:4] + "z" + n["text"][5:] for n in names[:40]] + ["", "zzz", "é" * 300]
    taken = []

    class Counted(difflib.SequenceMatcher):
        def ratio(self):
            taken.append(1)
            return super().ratio()

    monkeypatch.setattr(match.difflib, "SequenceMatcher", Counted)
    tile = match._closest_of_tile(0.5)
    got = tile((), pa.table({"query": typed}), pa.Table.from_pylist(names)).to_pylist()
    print("ratios taken", len(taken), "of", len(typed) * len(names))
    assert len(taken) < 0.05 * len(typed) * len(names)
    monkeypatch.undo()
    expected = {}
    for q in typed:
        best = max((difflib.SequenceMatcher(None, n["text"], q).ratio(), n["text"]) for n in names)
        if best[0] >= 0.5:
            expected[q] = best
    assert {r["query"]: (r["best"]["score"], r["best"]["text"]) for r in got} == expected


def test_sequences_meet_as_tiles(spark, monkeypatch):
    monkeypatch.setattr(match, "ASKED", 7)
    monkeypatch.setattr(match, "NAMES", 5)
    draw = random.Random(9)
    names = sorted({("".join(draw.choices("abc", k=draw.randint(1, 5))), "".join(draw.choices("abcd", k=draw.randint(1, 8)))) for _ in range(40)})
    typed = {"".join(draw.choices("abcd ", k=draw.randint(0, 14))) for _ in range(60)}
    catalog = spark.createDataFrame(names, "make string, model string")
    rows = spark.createDataFrame([(t,) for t in typed] + [(None,)], "v string")
    for r in match.fuzzy_segment(rows, "v", catalog, similarity="sequence").collect():
        best = max((difflib.SequenceMatcher(None, " ".join(n), r.text).ratio(), " ".join(n), *n) for n in names) if r.text is not None else (0,)
        assert (r.known_make, r.known_model, r.score) == ((*best[2:], best[0]) if best[0] >= 0.5 else (*names[0], None))


def test_segments_compared_by_length_are_those_of_a_full_comparison(spark, monkeypatch):
    monkeypatch.setattr(match, "CHUNK", 4)
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcd"), n))
    names = sorted({(word(rng.integers(1, 4)), word(rng.integers(1, 9))) for _ in range(60)})
    queries = sorted({word(rng.integers(1, 12)) for _ in range(60)} | {f"{a} {b}" for a, b in names[:5]} | {""})
    catalog = spark.createDataFrame(names, "make string, model string")
    df = spark.createDataFrame([(q,) for q in queries], "v string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    for r in match.fuzzy_segment(df, "v", catalog).collect():
        scored = [(1 - distance(f"{a} {b}", r.text) / max(len(f"{a} {b}"), len(r.text)), f"{a} {b}", a, b) for a, b in names]
        best = max(scored)
        if best[0] >= 0.5:
            assert (r.known_make, r.known_model) == best[2:] and r.score == pytest.approx(best[0])
        else:
            assert (r.known_make, r.known_model, r.score) == (*names[0], None)


def test_amounts_are_no_years_and_thousands_are_distances(spark):
    ads = {
        "asking $2000 for my 2012 toyota": (2012, None),
        "2000 cc engine, 2015 model": (2015, None),
        "98 model 85k km": (2098, 85000),
        "driven 2010 km, 1,999 miles, of 2008": (2008, 2010),
        "2003 holden 120,500kms": (2003, 120500),
        "$1999 and nothing else": (None, None),
    }
    df = spark.createDataFrame(list(enumerate(ads)), "id int, text string")
    got = {r.text: (r.year, r.odometer) for r in extract.extract_fields(df).collect()}
    assert got == ads


def test_each_pattern_of_a_field_runs_once(spark):
    df = spark.createDataFrame(
        [("sold 96 model 5,000 miles 1500cc",), ("2.5L 1999 Kms 12 mi",), ("80 kms 0 cc model",), (None,), ("",)], "text string"
    )
    found = extract.extract_fields(df)
    fields = [tuple(r) for r in found.select("year", "odometer", "engine_size_cc").collect()]
    assert fields == [(2096, 8045, 1500), (None, 1999, 2500), (None, 80, None), (None, None, None), (None, None, None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    for pattern in (extract.AMOUNT, extract.SHORT_YEAR, extract.KM, extract.MILES, extract.CC):
        assert plan.count(f", {pattern}, ") == 1


def test_every_candidate_is_seen_in_chunks(spark):
    candidates = spark.createDataFrame([(f"{a}{b}", "m", "x") for a, b in itertools.product("abcd", "efgh")],
                                       "text string, make string, model string")
    df = spark.createDataFrame([("ae",), ("dh",), ("cf",)], "q string")
    best = match.best_in_chunks(df, "q", candidates, ["make", "model", "text"], match._edit_score("q"), chunk=3)
    assert {(r.q, r.best.text) for r in best.collect()} == {("ae", "ae"), ("dh", "dh"), ("cf", "cf")}


AD = "For sale: 2015 Toyota Corolla 80,000km 1.8L petrol automatic, white, Bay of Plenty, $12,500 ono"


def test_extract_listing(spark):
    catalog = spark.createDataFrame([("Toyota", "Corolla"), ("Toyota", "Blade")], "make string, model string")
    ads = spark.createDataFrame(
        [(1, AD), (2, "98 model blade 60000 miles 2400cc DIESEL 5 speed manual awd 6 cyl"), (3, "nothing useful here")],
        "id int, text string",
    )
    got = {r.id: r for r in extract.extract_listings(ads, catalog, "id").collect()}
    r = got[1]
    assert (r.make, r.model, r.year, r.odometer, r.engine_size_cc, r.fuel_type, r.transmission, r.region, r.asking_price,
            r.exterior_colour, r.confidence) == ("Toyota", "Corolla", 2015, 80000, 1800, "Petrol", "Automatic",
                                                 "Bay of Plenty", 12500, "White", "high")
    r = got[2]
    assert (r.year, r.odometer, r.engine_size_cc, r.fuel_type, r.transmission, r.cylinders, r.is_4wd, r.confidence) == (
        2098, 96540, 2400, "Diesel", "Manual", 6, True, "low")
    assert got[3].confidence == "low" and got[3].exterior_colour == "Unknown"


def test_arguments(spark):
    good = '{"make": " Toyota ", "year": "2,015", "engine_size_cc": "2.4L", "is_4wd": "Yes", "fuel_type": "ev"}'
    df = spark.createDataFrame([(1, good), (2, '{"make": '), (3, '{"odometer": 5000}')], "id int, arguments string")
    parsed, bad = extract.parse_arguments(df, "arguments")
    rows = {r.id: r for r in extract.fix_fields(parsed).collect()}
    r = rows[1]
    assert (r.make, r.year, r.engine_size_cc, r.is_4wd, r.fuel_type, r.cylinders) == ("Toyota", 2015, 2400, True, "Electric", 4)
    assert rows[3].odometer == 5000 and [b.id for b in bad.collect()] == [2]


def test_defaults(spark):
    df = spark.createDataFrame([(None, None, None, 5, None), (1985, 10, 2000, 6, "Otago")],
                               "year int, odometer int, engine_size_cc int, cylinders int, region string")
    a, b = extract.defaults_for_valuation(df).collect()
    assert tuple(a) == (2015, 100000, 1500, 4, "Auckland", None)
    assert tuple(b) == (1985, 10, 2000, 6, "Otago", "year out of range")


def test_weighted_ratio_forgives_swapped_extra_and_cut_words(spark, one):
    from dealwright.functions import scoring

    options = ["North Harbour", "Bay of Plenty", "Hawke's Bay", "Petrol", "Automatic", "Otago"]
    typed = {"harbour north": "North Harbour", "NORTH  HARBOUR!": "North Harbour", "the bay of plenty region": "Bay of Plenty",
             "hawkes bay": "Hawke's Bay", "petro": "Petrol", "automatic transmission": "Automatic", "otgao": "Otago",
             "zzz": None, "": None, "  ?! ": None, None: None}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(typed)], "i int, v string")
    got = {r.v: r for r in match.fuzzy_match_weighted(df, "v", options).collect()}
    assert {t: r.matched for t, r in got.items()} == typed
    assert got["NORTH  HARBOUR!"].match_score == 100 and got["harbour north"].match_score == 95 and got["zzz"].match_note == "not recognised"
    pairs = [("kitten", "sitting"), ("", "a"), ("abc", "abc"), ("aabb", "bbaa"), ("x", "y"), ("banana", "ananas")]
    df = spark.createDataFrame(pairs, "a string, b string")

    def common(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            new = [0]
            for j, d in enumerate(b):
                new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    assert [r[0] for r in df.select(scoring.common_length(F.col("a"), F.col("b"))).collect()] == [common(*p) for p in pairs]


def test_components_against_brute_force(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(100 + i, 101 + i) for i in range(30)]
    nodes = sorted({n for e in edges for n in e})
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = labels.connected_components(
        spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "a long, b long")
    )
    assert {r.node: r.component for r in got.collect()} == {n: find(n) for n in nodes}


def test_clusters_separate_tight_groups_and_leave_noise(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(3, 16))
    rows = [(f"{g}-{i}", (centres[g] + rng.normal(0, 0.01, 16)).tolist()) for g in range(3) for i in range(30)]
    rows += [("lonely", rng.normal(size=16).tolist())]
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    got = {r.id: r.cluster for r in labels.cluster_cells(df, "id", bits=12, dimensions=16).collect()}
    groups = [{got[f"{g}-{i}"] for i in range(30)} - {labels.NOISE} for g in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3 and got["lonely"] == labels.NOISE


@pytest.mark.parametrize("n", [500, 4000])
def test_planted_clusters_come_out_pure_at_any_size(spark, n):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 64))
    rows = [(i, i % 12, (centres[i % 12] + rng.normal(0, 0.25, 64) if i % 12 < 10 else rng.normal(size=64)).tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, truth int, embedding array<double>")
    got = labels.cluster_cells(df, "id").join(df.select("id", "truth"), "id").toPandas()
    found = got[got.cluster != labels.NOISE]
    purity = found.groupby("cluster")["truth"].agg(lambda t: t.value_counts().iloc[0]).sum() / len(found)
    planted = got[got.truth < 10]
    assert purity >= 0.9 and found.groupby("cluster")["truth"].agg(lambda t: t.mode()[0]).nunique() >= 8
    assert (planted.cluster != labels.NOISE).mean() > 0.5 and (got[got.truth >= 10].cluster == labels.NOISE).mean() > 0.5


def test_weights_count_rows(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], 12), ("b", [-1.0, 0.5], 3)], "id string, embedding array<double>, w int")
    got = {r.id: r.cluster for r in labels.cluster_cells(df, "id", bits=4, dimensions=2, weight="w").collect()}
    assert got["a"] != labels.NOISE and got["b"] == labels.NOISE


def test_mode_ties_go_to_the_first_value(spark):
    df = spark.createDataFrame([(0, v) for v in "baba"], "cluster int, value string")
    assert labels.mode_per_cluster(df).first().label == "a"


def test_labels_of_a_column(spark):
    texts = ["bright red"] * 30 + ["bright reds"] * 25 + ["navy blue"] * 40 + ["x9!"] * 2 + [None] * 15
    df = spark.createDataFrame(list(enumerate(texts)), "id int, exterior_colour string")
    out = labels.classify_column(df, "exterior_colour", "colour_label", "No colour").toPandas()
    assert len(out) == len(texts) and out["colour_label"].notna().all()
    by_text = out.groupby("exterior_colour")["colour_label"].first()
    assert by_text["navy blue"] == "navy blue" and by_text["bright red"] == "bright red"
    only_fill = spark.createDataFrame([(1, None)], "id int, exterior_colour string")
    assert labels.classify_column(only_fill, "exterior_colour", "colour_label", "No colour").first().colour_label == "Unknown"


def test_centroid_classifier(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.9, 0.1], "x"), (3, [0.0, 1.0], "y")],
                               "id int, embedding array<double>, label string")
    got = labels.classify_by_centroid(df, "id", labels.centroids(df)).collect()
    assert {(r.id, r.predicted) for r in got} == {(1, "x"), (2, "x"), (3, "y")}


def test_counts_of_grams_are_those_of_the_feature_stages(spark, monkeypatch):
    """Counted in bulk, texts have the counts that tokens, grams and hashes make one by one, in any script."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    texts = ["", "a", "Toyota Rav4", "ΑΣ ΟΔΟΣ", "İstanbul ß", "日本語のテキスト", "a\nb\t c\r\n", "😀😀 x", "é" * 50, "the quick brown fox " * 30]
    texts += ["".join(chr(c) for c in range(start, start + 300)) for start in (32, 0x400, 0x4E00)]
    df = spark.createDataFrame([(t, 1) for t in texts], "value string, weight long")
    stages = [
        RegexTokenizer(inputCol="_padded", outputCol="_letters", pattern="(?s).", gaps=False, minTokenLength=1),
        NGram(n=3, inputCol="_letters", outputCol="_grams"), HashingTF(numFeatures=256, inputCol="_grams", outputCol="_told"),
    ]
    padded = df.withColumn("_padded", F.concat(F.lit(" "), "value", F.lit(" ")))
    told = Pipeline(stages=stages).fit(padded).transform(padded).select("value", vector_to_array("_told").alias("c"))
    expected = {r.value: r.c for r in told.collect()}
    assert "RegexTokenizer" not in str(labels.fit_embedder(df).stages)
    for at_once, most in ((1_000_000, 4_000_000), (40, 10)):
        monkeypatch.setattr(labels, "LETTERS_AT_ONCE", at_once)
        monkeypatch.setattr(labels, "MOST_RUNS", most)
        counts = []
        for text in texts:
            counts += list(labels.gram_counts([text], 256, 3))
        assert all(list(c) == expected[t] for t, c in zip(texts, counts))
        assert [list(c) for c in labels.gram_counts(texts, 256, 3)] == [expected[t] for t in texts]
    got = labels._counted(df, 256).select("value", vector_to_array("_counts").alias("c"))
    assert {r.value: r.c for r in got.collect()} == expected
    few = labels.gram_counts(["abc"], 7, 3)
    assert few.shape == (1, 7) and few.sum() == 3


def test_documents_are_digested_once_each(spark):
    """The digest of a text is made before its dimensions become rows, not for each of these."""
    from dealwright.plans import all_queries

    df = all_queries.QUERIES["embed_documents"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("md5(") and plan.count("md5(") == 1
