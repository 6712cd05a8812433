from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import pytest

from trustweave import expr as X
from trustweave.model import DirectRef, ModelError, OntologyClass, PolymorphicRef, Slot, Source, Spec
from trustweave.plans import compiler, lineage
from trustweave.plans.canonical import digest, dump
from trustweave.plans.lens import Lens, SpecLens
from trustweave.plans.manifest import Control, decode, encode
from trustweave.plans.plugins import DataContext, defaults, reads, settings
from trustweave.sources.lake import Conflict, Lake

TITLE = OntologyClass("Title", (Slot("title", required=True), Slot("year", "integer")), abstract=True)
MOVIE = OntologyClass("Movie", (Slot("movie_id", identifier=True), Slot("director", "Person", reference=DirectRef("Person"))), is_a="Title", overrides={"year": {"minimum": 1888}})
PERSON = OntologyClass("Person", (Slot("person_id", identifier=True), Slot("name")))
SPEC = Spec((MOVIE, TITLE, PERSON), (Source("imdb", "Movie", "movie_id", trust=0.9, slot_trust={"year": 0.2}), Source("tmdb", "Person", "person_id")))


def test_slots_are_inherited_and_overridden():
    assert [s.name for s in SPEC.slots("Movie")] == ["movie_id", "director", "title", "year"]
    assert SPEC.slot("Movie", "year").minimum == 1888
    assert SPEC.slot("Title", "year").minimum is None
    assert SPEC.trust("imdb", "year") == 0.2 and SPEC.trust("imdb", "title") == 0.9
    assert SPEC.descendants("Title") == ["Movie", "Title"]


def test_slots_of_one_name_in_two_classes_stay_apart(spark, tmp_path):
    spec = Spec((OntologyClass("A", (Slot("id", identifier=True),)), OntologyClass("B", (Slot("id", "integer", identifier=True),))))
    back = decode(encode(spec))
    assert back.slot("A", "id").range == "string" and back.slot("B", "id").range == "integer"


def test_unknown_names_are_refused():
    with pytest.raises(ModelError):
        SPEC.slot("Movie", "nothing")
    with pytest.raises(ModelError):
        Spec((MOVIE, MOVIE))
    assert lineage.check_names(SPEC, [("Movei", None), ("Movie", "titel"), ("Movie", "title")]) == [
        "no class 'Movei'; did you mean 'Movie'?",
        "class 'Movie' has no slot 'titel'; did you mean 'title'?",
    ]


def test_expressions():
    p = X.path("Movie", "year")
    tree = (p > 1990) & ~(p == 2000)
    assert [type(n).__name__ for n in X.walk(tree)] == ["BoolExpr", "Compare", "SlotPath", "Literal", "BoolExpr", "Compare", "SlotPath", "Literal"]
    with pytest.raises(ModelError):
        bool(p > 1)
    with pytest.raises(ModelError):
        X.BoolExpr("not", (p, p))
    bound = X.bind_config(p > X.ConfigRef("from"), {"from": 1950})
    assert bound.right.value == 1950
    with pytest.raises(ModelError):
        X.bind_config(X.ConfigRef("x"), {})
    assert X.Matches(p, "%.jpg").is_regex and not X.Matches(p, "a%").is_regex


def test_lens_refuses_bare_comparison_of_several_values():
    assert isinstance(SpecLens(SPEC).Movie.year > 3, X.Compare)
    aware = SpecLens(SPEC, Lens.DISAGREEMENT_AWARE).Movie.year
    with pytest.raises(TypeError):
        aware > 3
    with pytest.raises(TypeError):
        aware.between(1, 2)
    assert isinstance(aware.any_() > 3, X.Compare)


def test_canonical_hash():
    assert digest(SPEC) == digest(decode(encode(SPEC)))
    assert digest({"b": 1, "a": 2.0}) == digest({"a": 2, "b": 1})
    moved = Spec(SPEC.classes, (Source("imdb", "Movie", "movie_id", trust=0.9, slot_trust={"year": 0.2}, location="/elsewhere"), SPEC.sources[1]))
    assert digest(moved) == digest(SPEC)
    assert digest(Spec(SPEC.classes)) != digest(SPEC)
    assert " " not in dump({"a": [1, 2]})


def test_topological():
    assert compiler.topological({"b": {"a"}, "a": set(), "c": set()}) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="cycle"):
        compiler.topological({"a": {"b"}, "b": {"a"}})


def test_compile():
    w = compiler.compile_spec(SPEC)
    names = [s.name for s in w.stages]
    assert "normalize:Movie:imdb" in names and not any(":Title" in n for n in names)
    assert names.index("merge:Person") < names.index("resolve:Movie")
    again = compiler.compile_spec(SPEC)
    assert again == w
    later = compiler.compile_spec(SPEC, cursors={"tmdb": 7})
    key = lambda w, n: next(s.key for s in w.stages if s.name == n)
    assert key(later, "normalize:Movie:imdb") == key(w, "normalize:Movie:imdb")
    assert key(later, "resolve:Movie") != key(w, "resolve:Movie")
    pinned = [compiler.compile_spec(SPEC, cursors={"tmdb": c}, pins={"Person": "x"}) for c in (1, 2)]
    assert key(pinned[0], "merge:Movie") == key(pinned[1], "merge:Movie")
    only = compiler.compile_spec(SPEC, "stage:resolve:Movie")
    assert [s.kind for s in only.stages] == ["normalize", "resolve"]
    configured = compiler.compile_spec(SPEC, implementations={("resolve", "Movie"): "m:f"}, config={"m:f": {"w": 2}})
    assert key(configured, "resolve:Movie") != key(w, "resolve:Movie")


def test_refused_at_compile():
    step = X.RecursiveTraversal(X.RelationRef("Movie", "director"), 3)
    with pytest.raises(ModelError, match="recursive"):
        compiler.check(Spec((PERSON, TITLE, OntologyClass("Movie", (*MOVIE.slots, Slot("all", derivation=step)), is_a="Title"))))
    with pytest.raises(ModelError):
        compiler.check(Spec((OntologyClass("A", (Slot("a", "Nowhere"),)),)))
    loop = OntologyClass("A", (Slot("x", "integer", derivation=X.ScalarDerivation(X.path("A", "y"))), Slot("y", "integer", derivation=X.ScalarDerivation(X.path("A", "x")))))
    with pytest.raises(ValueError, match="cycle"):
        compiler.check(Spec((loop,)))


def test_execution_skips_and_records_failures():
    w = compiler.compile_spec(SPEC)
    ran, states = [], []
    handlers = {k: (lambda s: ran.append(s.name)) for k in compiler.KINDS}
    done: set = set()
    compiler.execute(compiler.Run("1", w), handlers, done)
    assert len(ran) == len(w.stages)
    second = compiler.execute(compiler.Run("2", w), handlers, done)
    assert second.status == "succeeded" and len(second.skipped) == len(w.stages) and len(ran) == len(w.stages)
    bad = compiler.Run("3", compiler.compile_spec(SPEC, cursors={"imdb": 1}))
    with pytest.raises(ZeroDivisionError):
        compiler.execute(bad, {**handlers, "resolve": lambda s: 1 // 0}, done, lambda r: states.append(r.status))
    assert bad.status == "failed" and "ZeroDivisionError" in bad.error and states == ["running", "failed"]


DERIVED = OntologyClass("Movie", (*MOVIE.slots, Slot("by", derivation=X.ScalarDerivation(X.path("Movie", "director", "name")))), is_a="Title", overrides=MOVIE.overrides, constraints={"old": X.path("Movie", "year") > 1888})
RICH = Spec((DERIVED, TITLE, PERSON), SPEC.sources)


def test_impact_by_edit():
    def refs(*args, **names):
        return lineage.impact(RICH, *args, **names).refs

    assert refs("rename_slot", "Person", "name") == ("slot:Movie.by",)
    assert lineage.impact(RICH, "delete_slot", "Person", "name").classes == ("Movie", "Person")
    assert "constraint:Movie.old" in refs("change_range", "Title", "year")
    assert "slot:Movie.by" in refs("remove_class", "Person")
    assert refs("remove_source", source="imdb") == ("class:Movie", "constraint:Movie.old", "slot:Movie.by", "source:imdb")
    assert "slot:Movie.by" in refs("change_trust", source="tmdb")
    assert refs("add_slot", "Title", "runtime") == ("class:Movie", "source:imdb")
    assert refs("add_slot", "Title", "movie_id") == ()  # the descendant has one of its own
    assert refs("add_constraint", "Title") == ("class:Movie",)
    assert refs("add_class", "Podcast") == () and "class:Movie" in refs("add_class", "Podcast", parent="Title")
    assert lineage.impact(RICH, "add_class", "Podcast", parent="Title").classes == ("Podcast", "Title")
    lost = lineage.impact(RICH, "change_superclass", "Movie", parent="Person")
    assert "constraint:Movie.old" in lost.refs and set(lost.classes) == {"Movie", "Person", "Title"}
    assert "constraint:Movie.old" not in refs("change_superclass", "Person", parent="Title")
    assert refs("add_derivation", "Person", "name") == ("slot:Movie.by",)
    with pytest.raises(ModelError, match="did you mean 'rename_slot'"):
        lineage.impact(RICH, "rename_slto", "Movie")
    for wrong in (("add_class", "Movie"), ("delete_slot", "Movie"), ("delete_slot", "Movie", "nothing"), ("add_slot", "Movie"), ("remove_source",)):
        with pytest.raises(ModelError):
            lineage.impact(RICH, *wrong)


def test_impact_on_implementations():
    def bound(path, context):
        return lineage.Bound("resolve", context.primary, path, tuple(reads(RICH, context)))

    all_bound = [bound("m:movies", DataContext("Movie", X.path("Movie", "director", "name") == "x")), bound("m:people", DataContext("Person", project=("person_id",)))]
    assert (None in {s for _, s in reads(RICH, DataContext("Movie"))}) and ("Person", "name") in reads(RICH, DataContext("Movie", X.path("Movie", "director", "name") == "x"))
    hit = lambda *a, **k: lineage.impact(RICH, *a, **k, bound=all_bound)
    assert hit("add_slot", "Movie", "budget").implementations == ("m:movies",) and hit("add_slot", "Movie", "budget").workflows == ("Movie",)
    assert hit("delete_slot", "Person", "name").implementations == ("m:movies", "m:people")
    assert hit("delete_slot", "Title", "year").implementations == ("m:movies",)
    assert hit("add_class", "Book").implementations == ()
    assert hit("add_source", "Person").workflows == ("Movie", "Person")


def test_differences():
    assert lineage.diff(SPEC, RICH) == [("added", "constraint:Movie.old"), ("added", "slot:Movie.by")]
    assert [(c.kind, c.name) for c in lineage.changes(SPEC, RICH)] == [("constraint.added", "Movie.old"), ("slot.added", "Movie.by")]
    other = Spec((MOVIE, replace(TITLE, slots=(Slot("title", description="said"), Slot("year", "float"))), PERSON), (replace(SPEC.sources[0], trust=0.3, location="/x"),))
    got = [(c.kind, c.name) for c in lineage.changes(SPEC, other)]
    assert got == [("slot.range", "Title.year"), ("slot.required", "Title.title"), ("source.removed", "tmdb"), ("source.trust", "imdb")]
    assert lineage.changes(SPEC, SPEC) == []


def test_what_is_said_about_a_model_changes_no_hash():
    said = Spec((replace(MOVIE, description="films"), TITLE, PERSON), SPEC.sources, author="me", created_at="2024-01-01", label="x")
    assert digest(said) == digest(SPEC)
    with pytest.raises(ModelError):
        compiler.check(Spec((replace(PERSON, identifier_pattern=("name", "nothing")),)))


@settings(threshold=0.8, mode="strict")
def declared(context, facts):
    """A resolver with settings."""


def test_declared_settings():
    assert declared.threshold == 0.8 and defaults(declared) == {"threshold": 0.8, "mode": "strict"} and defaults(None) == {}
    with pytest.raises(ModelError):
        settings(settings=1)(declared)


def test_revisions_workflows_and_traces(spark, tmp_path):
    control = Control(Lake(spark, f"file:{tmp_path}/lake"))
    control.save_spec(RICH)
    here = f"{__name__}:declared"
    assert control.bind("resolve", "Movie", here)["revision"] == 1
    assert control.bind("resolve", "Movie", here)["revision"] == 1
    with pytest.raises(ModelError):
        control.bind("glue", "Movie", here)
    with pytest.raises(ModelError, match="nothing is bound"):
        control.configure("a:b", x=1)
    with pytest.raises(ModelError, match="did you mean 'threshold'"):
        control.configure(here, treshold=1)
    assert control.configure(here, threshold=0.7)["revision"] == 1 and control.configure(here, threshold=0.7)["revision"] == 1
    first = control.start_run("class:Movie", pins={"Person": "p"})
    assert control.configure(here, mode="lax")["revision"] == 2
    assert control.bind("resolve", "Movie", here, [("Person", "name")])["revision"] == 2
    second = control.start_run("class:Movie")
    assert control.settings(here) == {"threshold": 0.7, "mode": "lax"} and control.settings(here, 1) == {"threshold": 0.7}
    assert control.implementation("resolve", "Movie", 1)["reads"] == [["Movie", None]]
    assert [w["digest"] for w in control.workflows()] == [second.workflow.digest, first.workflow.digest]
    assert control.workflows()[0]["n_stages"] == len(control.workflow(second.workflow.digest)["stages"]) == len(second.workflow.stages)
    compiler.execute(first, {k: lambda s: None for k in compiler.KINDS}, set(), control.record)
    trace = control.trace(first.run_id)
    assert trace["run"]["status"] == "succeeded" and trace["pins"] == {"Person": "p"} and digest(trace["spec"]) == digest(RICH)
    assert trace["settings"] == {here: {"threshold": 0.7}} and trace["implementations"]["resolve:Movie"]["revision"] == 1
    assert [s["name"] for s in control.sources()] == ["imdb", "tmdb"]
    assert control.impact("rename_slot", cls="Person", slot="name").implementations == (here,)
    with pytest.raises(ModelError):
        control.workflow("none")


def test_no_change_of_two_writers_is_lost(spark, tmp_path):
    lake = Lake(spark, f"file:{tmp_path}/lake")
    control = Control(lake)
    control.save_spec(SPEC)
    number, state = lake.read_state("control")
    lake.write_state("control", state, number)
    with pytest.raises(Conflict):
        lake.write_state("control", state, number)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: control.decide("merge", "Movie", f"a{i}", "b"), range(12)))
    assert sorted(d["a"] for d in control.decisions("Movie")) == sorted(f"a{i}" for i in range(12))
    assert len(lake.json_names("control")) <= 10


def test_control(spark, tmp_path):
    control = Control(Lake(spark, f"file:{tmp_path}/lake"))
    assert control.save_spec(SPEC)["revision"] == 1
    assert control.save_spec(SPEC)["revision"] == 1
    control.save_draft("d", Spec(SPEC.classes))
    assert control.publish_draft("d")["revision"] == 2
    assert control.spec(1).source("imdb").trust == 0.9 and control.spec().sources == ()
    with pytest.raises(ModelError, match="did you mean"):
        control.bind("resolve", "Movei", "x:y")
    control.bind("resolve", "Movie", "trustweave.operators.resolution:score_titles", [("Movie", "title")])
    control.configure("trustweave.operators.resolution:score_titles", weight=0.5)
    run = control.start_run()
    assert control.run(run.run_id)["status"] == "pending"
    compiler.execute(run, {k: lambda s: None for k in compiler.KINDS}, set(), control.record)
    assert [r["status"] for r in control.runs()] == ["succeeded"]
    control.correct("Movie", "c1", "year", 1999, "2024-01-01")
    control.decide("merge", "Movie", "a", "b")
    assert control.corrections("Movie")[0]["value"] == "1999" and control.decisions("Movie", "split") == []
    with pytest.raises(ModelError):
        control.decide("glue", "Movie", "a", "b")


def test_polymorphic_reference_keeps_its_order():
    s = Slot("x", reference=PolymorphicRef(("Movie", "Person")))
    assert decode(encode(s)) == s
