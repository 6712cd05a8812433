import datetime
import os

import pytest
from pyspark.sql import functions as F

from trustweave import expr as X
from trustweave.functions import text
from trustweave.model import DirectRef, ModelError, OntologyClass, Policy, Slot, Source, Spec
from trustweave.operators import graph as G
from trustweave.operators import normalize as N
from trustweave.operators import quality as Q
from trustweave.operators import resolution as R
from trustweave.operators import temporal as T
from trustweave.operators import trust
from trustweave.operators.components import components
from trustweave.plans.lowering import Graph
from trustweave.plans.plugins import DataContext, fulfil, load
from trustweave.sources import lake as L
from trustweave.streaming.ingest import ingest, latest_per_key

BAG = "canonical_id string, source string, trust double, asserted_at timestamp_ntz, year int, tags array<string>"


def bag(spark, *rows):
    return spark.createDataFrame([(i, s, t, datetime.datetime(2024, 1, d), y, None) for i, s, t, d, y in rows], BAG)


def one(df, slot="year"):
    return {r["canonical_id"]: r[slot] for r in df.collect()}


BASIC = (("m", "imdb", 0.91, 1, 1999), ("m", "tmdb", 0.62, 3, 2000), ("m", "wikidata", 0.78, 2, 1999))


@pytest.mark.parametrize("policy,want", [(Policy.ARGMAX_TRUST, 1999), (Policy.MODE, 1999), (Policy.WEIGHTED_VOTE, 1999), (Policy.MEDIAN_NUMERIC, 1999.0), (Policy.LATEST_WATERMARK, 2000)])
def test_policies(spark, policy, want):
    assert one(trust.resolve(bag(spark, *BASIC), "year", policy)) == {"m": want}
    assert one(trust.resolve(bag(spark, *reversed(BASIC)), "year", policy)) == {"m": want}


def test_trusted_null_passes_to_the_next(spark):
    rows = bag(spark, ("m", "imdb", 0.9, 1, None), ("m", "tmdb", 0.5, 1, 2001), ("n", "imdb", 0.9, 1, None))
    for policy in (Policy.ARGMAX_TRUST, Policy.MODE, Policy.WEIGHTED_VOTE, Policy.MEDIAN_NUMERIC, Policy.LATEST_WATERMARK, Policy.UNIQUE_OR_FAIL):
        assert one(trust.resolve(rows, "year", policy)) == {"m": 2001, "n": None}
    assert one(trust.null_contributions(rows, "year"), "n_null_contributions") == {"m": 1, "n": 1}


def test_ties(spark):
    tie = bag(spark, ("m", "a", 0.5, 1, 1), ("m", "b", 0.5, 1, 2), ("m", "c", 0.5, 1, 3))
    assert one(trust.resolve(tie, "year")) == {"m": 3}
    mode = bag(spark, ("m", "a", 0.9, 1, 1), ("m", "b", 0.5, 1, 2))
    assert one(trust.resolve(mode, "year", Policy.MODE)) == {"m": 1}
    vote = bag(spark, ("m", "a", 0.9, 1, 1), ("m", "b", 0.5, 1, 2), ("m", "c", 0.5, 1, 2))
    assert one(trust.resolve(vote, "year", Policy.WEIGHTED_VOTE)) == {"m": 2}


def test_unique_or_fail(spark):
    rows = bag(spark, *BASIC)
    with pytest.raises(trust.Disagreement, match="2 sources disagree: 1999, 2000"):
        trust.resolve(rows, "year", Policy.UNIQUE_OR_FAIL)
    spec = Spec((OntologyClass("M", (Slot("m_id", identifier=True), Slot("year", "integer", policy=Policy.UNIQUE_OR_FAIL))),))
    with pytest.raises(trust.Disagreement):
        trust.resolve_class(rows, spec, "M")
    assert one(trust.resolve_class(rows, spec, "M", strict=False)) == {"m": None}
    found = Q.agreement(rows, spec, "M").collect()
    assert [tuple(r) for r in found] == [("agreement:M.year", "M", "year", "m", "2 sources disagree: 1999, 2000")]
    with pytest.raises(ModelError):
        Q.agreement(rows.drop("canonical_id"), spec, "M")


def test_median_needs_numbers(spark):
    spec = Spec((OntologyClass("M", (Slot("m_id", identifier=True), Slot("year", "string", policy=Policy.MEDIAN_NUMERIC))),))
    with pytest.raises(ModelError):
        trust.resolve_class(bag(spark, *BASIC), spec, "M")


# Relations

SPEC = Spec(
    (
        OntologyClass("Person", (Slot("person_id", identifier=True), Slot("name"), Slot("boss", "Person"))),
        OntologyClass("Movie", (Slot("movie_id", identifier=True), Slot("title"), Slot("director", "Person", reference=DirectRef("Person")), Slot("rating", "float"))),
        OntologyClass("Credit", (Slot("credit_id", identifier=True), Slot("movie", "Movie"), Slot("person", "Person"), Slot("role"))),
        OntologyClass("Studio", (Slot("studio_id", identifier=True),)),
    )
)


@pytest.fixture
def movies(spark):
    person = spark.createDataFrame([("p1", "Ada", None), ("p2", "Bo", "p1"), ("p3", None, "p2")], "person_id string, name string, boss string")
    movie = spark.createDataFrame([("m1", "One", "p1", 8.0), ("m2", "Two", "p9", None), ("m3", "Three", None, 5.0)], "movie_id string, title string, director string, rating double")
    credit = spark.createDataFrame([("c1", "m1", "p1", "director"), ("c2", "m1", "p2", None), ("c3", "m3", "p2", "actor")], "credit_id string, movie string, person string, role string")
    return Graph(SPEC, {"Person": person, "Movie": movie, "Credit": credit, "Studio": spark.createDataFrame([("s1",)], "studio_id string")})


def ids(df, c):
    return sorted(r[c] for r in df.collect())


CREDITS = X.RelationRef("Credit", "movie")


def test_universal_and_existential(movies):
    assert ids(movies.where("Movie", CREDITS.all_(X.path("Credit", "role") == "director")), "movie_id") == ["m2"]
    assert ids(movies.where("Movie", CREDITS.all_()), "movie_id") == ["m2"]
    assert ids(movies.where("Movie", CREDITS.any_(X.path("Credit", "role").is_null())), "movie_id") == ["m1"]
    assert ids(movies.where("Movie", ~CREDITS.any_()), "movie_id") == ["m2"]
    assert ids(movies.where("Movie", CREDITS.any_() & (X.path("Movie", "rating") > 6)), "movie_id") == ["m1"]


def test_owners_without_rows_count_zero(movies):
    rows = movies.derive("Movie", {"n": CREDITS.count(), "kinds": CREDITS.agg("count", "role", distinct=True)}).collect()
    assert {r["movie_id"]: (r["n"], r["kinds"]) for r in rows} == {"m1": (2, 1), "m2": (0, 0), "m3": (1, 1)}


def test_paths_keep_rows_whose_key_leads_nowhere(movies):
    rows = movies.derive("Movie", {"by": X.path("Movie", "director", "name")}).collect()
    assert {r["movie_id"]: r["by"] for r in rows} == {"m1": "Ada", "m2": None, "m3": None}
    two = movies.derive("Person", {"top": X.path("Person", "boss", "boss", "name")}).collect()
    assert {r["person_id"]: r["top"] for r in two} == {"p1": None, "p2": None, "p3": "Ada"}


def test_relations_that_lead_nowhere_are_refused(movies):
    with pytest.raises(ModelError):
        movies.relation(X.RelationRef("Credit", "person"), "Studio")
    with pytest.raises(ModelError):
        movies.derive("Movie", {"x": X.path("Movie", "title", "name")})
    with pytest.raises(ModelError):
        movies.derive("Movie", {"x": X.RecursiveTraversal(CREDITS, 2)})


def test_assert_unique(movies):
    with pytest.raises(ModelError):
        movies.aggregate(CREDITS.first("credit_id", assert_unique=True), "Movie")
    assert movies.aggregate(CREDITS.where(X.path("Credit", "role") == "actor").first("credit_id", assert_unique=True), "Movie").count() == 1


def test_format_skips_nulls(movies):
    rows = movies.derive("Movie", {"label": X.FormatDerivation("{title}: {rating}!")}).collect()
    assert {r["movie_id"]: r["label"] for r in rows} == {"m1": "One: 8.0!", "m2": "Two: !", "m3": "Three: 5.0!"}


def test_closure_and_context(movies):
    up = movies.closure("Person", X.RecursiveTraversal(X.RelationRef("Person", "boss"), 5)).collect()
    assert sorted((r["src_id"], r["dst_id"], r["depth"]) for r in up) == [("p1", "p2", 1), ("p1", "p3", 2), ("p2", "p3", 1)]
    got = fulfil(movies, DataContext("Movie", X.path("Movie", "rating") > X.ConfigRef("least"), ("title",)), {"least": 6})["Movie"]
    assert got.columns == ["title"] and got.count() == 1
    with pytest.raises(ModelError):
        fulfil(movies, DataContext("Nothing"))
    assert load("trustweave.operators.resolution:score_titles") is R.score_titles


def test_not_in_with_null(movies):
    assert ids(movies.where("Movie", X.path("Movie", "rating").not_in([8.0])), "movie_id") == ["m3"]
    assert ids(movies.where("Movie", X.path("Movie", "title").ends_with("e")), "movie_id") == ["m1", "m3"]


# Entity resolution


def people(spark, rows):
    return spark.createDataFrame(rows, "row_id string, source string, name string, birthdate string, wikidata_id string")


def works(spark, *rows):
    return spark.createDataFrame([(f"{s}:{i}", s, t, y) for i, (s, t, y) in enumerate(rows)], "row_id string, source string, title string, year int")


def test_title_pairs(spark):
    same = R.score_titles(works(spark, ("a", "Inception", 2010), ("b", "Inception", 2010))).collect()
    assert len(same) == 1 and same[0]["score"] >= 0.9
    assert R.score_titles(works(spark, ("a", "Inception", 2010), ("b", "Inception", 2015))).count() == 0
    assert R.score_titles(works(spark, ("a", "Inception", 2010), ("b", "Parasite", 2010))).count() == 0
    assert R.score_titles(works(spark, ("a", "Inception", 2010), ("a", "Inception", 2010))).count() == 0
    missing = R.score_titles(works(spark, ("a", "Inception", None), ("b", "Inception", 2010))).collect()
    assert missing[0]["score"] == pytest.approx(0.7)


def test_person_pairs(spark):
    shared = people(spark, [("1", "a", "Akira Kurosawa", None, "Q7798"), ("2", "b", "Kurosawa Akira", None, "Q7798")])
    assert [r["score"] for r in R.score_persons(shared).collect()] == [1.0]
    near = people(spark, [("1", "a", "Martin Scorsese", "1942-11-17", None), ("2", "b", "Martin Scorsese", "1942-05-01", "")])
    assert R.score_persons(near).count() == 1
    far = people(spark, [("1", "a", "Martin Scorsese", "1942-11-17", ""), ("2", "b", "Martin Scorsese", "1950-05-01", "")])
    assert R.score_persons(far).count() == 0


def test_link_pairs_need_keys(spark):
    make = lambda *r: spark.createDataFrame([(str(i), *x) for i, x in enumerate(r)], "row_id string, source string, person string, work string, role string")
    assert R.score_links(make(("a", "p", "w", "DIRECTOR"), ("b", "p", "w", "director"))).count() == 1
    assert R.score_links(make(("a", None, "w", "x"), ("b", None, "w", "x"))).count() == 0


def test_clusters_and_decisions(spark):
    rows = spark.createDataFrame([(x,) for x in "abcdef"], "row_id string")
    pairs = spark.createDataFrame([("a", "b", 0.95), ("b", "c", 0.91), ("d", "e", 0.4)], "a string, b string, score double")
    links = R.decide(pairs, 0.9, spark.createDataFrame([("f", "d")], "a string, b string"), spark.createDataFrame([("c", "b")], "a string, b string"))
    got = {r["row_id"]: r["cluster"] for r in R.cluster(rows, links).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e", "f": "d"}
    with pytest.raises(ModelError):
        R.cluster(rows, links, "strong")


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(chain).collect()}
    assert {got[i] for i in range(61)} == {0} and got[100] == 100 and got[201] == 200
    assert components(chain.limit(0)).count() == 0


def test_reconciliation(spark):
    clusters = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "d"), ("e", "e"), ("f", "e")], "row_id string, cluster string")
    prior = spark.createDataFrame([("a", "x"), ("c", "y"), ("d", "y"), ("e", "u"), ("f", "v")], "row_id string, canonical_id string")
    got = {r["cluster"]: (r["outcome"], r["canonical_id"]) for r in R.reconcile(clusters, prior).collect()}
    assert got == {"a": ("kept", "x"), "c": ("split", "y"), "d": ("split", None), "e": ("conflict", None)}


# Normalizing


def test_normalize(spark):
    spec = Spec(
        (OntologyClass("M", (Slot("id", identifier=True), Slot("title", required=True), Slot("rating", "float"), Slot("genres", multivalued=True), Slot("born", "date"), Slot("role", permissible=("director", "actor")))),),
        (Source("s", "M", "imdb_id", mapping={"id": "imdb_id", "title": "name"}),),
    )
    rows = spark.createDataFrame(
        [("1", "  A  Title ", "0.0", " x | y ", "05/16/1990", "DIRECTOR"), ("2", "", "bad", None, "May 16 1990", "dIRECTOR"), ("", "No id", None, None, None, None), ("4", "Spider–Man", None, "", "1990-05-16", "cook")],
        "imdb_id string, name string, rating string, genres string, born string, role string",
    )
    made = N.normalize(spec, spec.sources[0], rows)
    got = {r["src_key"]: r for r in made.facts["M"].collect()}
    assert set(got) == {"1", "4"}
    first = got["1"]
    assert (first["title"], first["rating"], first["genres"], str(first["born"]), first["role"]) == ("A Title", 0.0, ["x", "y"], "1990-05-16", "director")
    assert got["4"]["title"] == "Spider-Man" and got["4"]["genres"] is None and got["4"]["role"] == "cook"
    assert sorted((r["src_key"], r["reason"]) for r in made.rejected.collect()) == [("", "missing identifier"), ("2", "missing title")]
    again = N.normalize(spec, spec.sources[0], rows).facts["M"].select("row_id").collect()
    assert sorted(again) == sorted(made.facts["M"].select("row_id").collect())


def test_unknown_route_fails(spark):
    spec = Spec((OntologyClass("A", (Slot("id", identifier=True),)),), (Source("s", "A", "id", discriminator="kind", routes={"a": "A", "b": None}),))
    rows = spark.createDataFrame([("1", "a"), ("2", "B"), ("3", "c")], "id string, kind string")
    with pytest.raises(ModelError, match="no route"):
        N.normalize(spec, spec.sources[0], rows)
    assert N.normalize(spec, spec.sources[0], rows.where("kind <> 'c'")).facts["A"].count() == 1


def test_similarity(spark):
    row = spark.range(1).select(text.token_sort_similarity(F.lit("Kurosawa  Akira"), F.lit("akira kurosawa")), text.similarity(F.lit(""), F.lit("")), text.similarity(F.lit("ab"), F.lit("ax"))).first()
    assert list(row) == [1.0, 1.0, 0.5]


# Checks, history, publishing


def test_gate(spark):
    bad = spark.createDataFrame([("r", "c", None, "1", "d")], "rule_id string, class_name string, slot_name string, offending_pk string, detail string")
    assert Q.gate({"w": (Q.WARNING, bad), "e": (Q.ERROR, lambda: bad.limit(0))}) == {"w": 1, "e": 0}
    with pytest.raises(Q.BlockedPublish):
        Q.gate({"e": (Q.ERROR, bad)})


def test_failure_trend(spark):
    rows = spark.createDataFrame([(r, rule, n, 100) for r in range(4) for rule, n in (("up", 10 * r), ("flat", 5))], "run_no int, rule_id string, n_failed int, n_rows int")
    assert [r["offending_pk"] for r in Q.failure_rate_trend(rows, "C").collect()] == ["up"]


def test_publish_is_idempotent(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 2)], "canonical_id string, v int")
    once = G.upsert_nodes(None, nodes)
    assert sorted(map(tuple, G.upsert_nodes(once, nodes).collect())) == [("a", 1), ("b", 2)]
    assert tuple(G.audit_row(nodes, "r", "h").first()) == ("r", "h", 2)


def test_as_of_join_at_the_edges(spark):
    t = lambda d: datetime.datetime(2024, 1, d)
    versions = spark.createDataFrame([("k", "v1", t(2), t(4)), ("k", "v2", t(4), None), ("z", "w", t(1), t(3))], "k string, v string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    events = spark.createDataFrame([("k", t(1), 1), ("k", t(2), 2), ("k", t(4), 3), ("z", t(3), 4), ("q", t(3), 5)], "k string, t timestamp_ntz, n int")
    got = {r["n"]: r["v"] for r in T.as_of_join(events, versions, "k", "t").collect()}
    assert got == {1: None, 2: "v1", 3: "v2", 4: None, 5: None}


# Files


def test_csv_keeps_zero_empty_and_null_apart(spark, tmp_path):
    (tmp_path / "m.csv").write_text('id,rating,note\n1,0.0,""\n2,,x\n')
    rows = {r["id"]: (r["rating"], r["note"]) for r in L.read_csv(spark, f"{tmp_path}/m.csv").collect()}
    assert rows == {"1": ("0.0", ""), "2": (None, "x")}


def test_sources_by_kind(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id\n1\n")
    spark.range(3).write.parquet(f"{tmp_path}/b.parquet")
    assert L.find_source(spark, str(tmp_path), "a").count() == 1 and L.find_source(spark, str(tmp_path), "b").count() == 3
    with pytest.raises(FileNotFoundError):
        L.find_source(spark, str(tmp_path), "c")
    assert L.mount(spark, str(tmp_path)) == ["b"] and "b" in L.views(spark)
    assert L.read_location(spark, f"lake://{tmp_path}/b.parquet").count() == 3
    assert L.columns(spark.table("b")) == {"id": "bigint"} and L.drop_view(spark, "b")
    with pytest.raises(ModelError):
        L.read_location(spark, "s3://x/y.unknown")


def test_lake_switches_whole_versions(spark, tmp_path):
    lake = L.Lake(spark, f"file:{tmp_path}/lake")
    lake.write(spark.range(2), "t", "zstd")
    lake.write(spark.range(5).withColumn("source", F.lit("s")), "t", partition_by=("source",))
    assert lake.read("t").count() == 5
    failing = spark.range(3).select(F.assert_true(F.col("id") < 2), "id")
    with pytest.raises(Exception):
        lake.write(failing, "t")
    assert lake.read("t").count() == 5
    assert len([n for n in os.listdir(tmp_path / "lake/t") if n.startswith("v")]) == 2
    for bad in ({"codec": "rar"}, {"name": "../x"}):
        with pytest.raises(ModelError):
            lake.write(**{"df": spark.range(1), "name": "t", **bad})
    with pytest.raises(FileNotFoundError):
        lake.read("none")
    L.export_csv(spark.range(2).withColumn("l", F.array(F.lit(1))), f"{tmp_path}/out")
    assert L.read_csv(spark, f"{tmp_path}/out").count() == 2


def test_streaming_reads_each_file_once(spark, tmp_path):
    schema = "id long, ts timestamp_ntz, v string"
    rows = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1), "a"), (1, datetime.datetime(2024, 1, 2), "b"), (2, datetime.datetime(2024, 1, 1), "c")], schema)
    rows.write.parquet(f"{tmp_path}/in")
    args = (spark, f"{tmp_path}/in", "parquet", rows.schema, f"{tmp_path}/out", f"{tmp_path}/check")
    assert ingest(*args) == 3 and ingest(*args) == 0
    rows.limit(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert ingest(*args) == 1 and spark.read.parquet(f"{tmp_path}/out").count() == 4
    seen = []
    latest_per_key(spark, f"{tmp_path}/in", rows.schema, "id", "ts", f"{tmp_path}/check2", lambda d, n: seen.extend((r["id"], r["v"]) for r in d.collect()))
    assert sorted(seen) == [(1, "b"), (2, "c")]


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "trust_argmax" in entry.queries()
