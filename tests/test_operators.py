"""Small fixtures: helpers, search rules, ingestion, streaming."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from recollect.functions import filters, identity, scalars, times
from recollect.operators import hierarchy, ingest, observations as reading, reads, search, texts
from recollect.operators.search import And, Entity, Not, Or, Property
from recollect.sources import tables
from recollect.streaming import pipelines


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)]).select(column).first()[0]


def test_identity(spark):
    assert one(spark, identity.entity_pk(F.lit("User"), F.lit("123"))) == hashlib.md5(b"user-123").hexdigest()
    assert one(spark, identity.entity_pk(F.lit("User"), F.lit(None))) == hashlib.md5(b"user-None").hexdigest()
    assert one(spark, identity.triplet_id(F.lit("a"), F.lit(None), F.lit("b"))) == hashlib.md5(b"a-None-b").hexdigest()
    a, b = (one(spark, identity.traits_hash(F.create_map(*[F.lit(x) for x in p]))) for p in (("k", "1", "l", "2"), ("l", "2", "k", "1")))
    assert a == b


@pytest.mark.parametrize(("column", "value"), [
    (lambda: scalars.try_number(F.lit("1e3")), 1000.0), (lambda: scalars.try_number(F.lit("x")), None), (lambda: scalars.clean_value(F.lit(" a \n b ")), "a b"),
    (lambda: scalars.clean_value(F.lit("x" * 120)), "x" * 100 + "..."), (lambda: scalars.clean_text(F.lit(" a \n\n b")), "a\nb"), (lambda: scalars.slug(F.lit("A b!")), "a-b"),
    (lambda: scalars.label_of_event(F.lit("page-viewed")), "Page Viewed"), (lambda: scalars.is_email(F.lit("a@b.co")), True), (lambda: scalars.is_email(F.lit(None)), False),
    (lambda: scalars.pretty_seconds(F.lit(90061)), "1d 01:01:01"), (lambda: scalars.is_hex(F.lit("0fG")), False),
    (lambda: scalars.fill_template('{{a}} is {{b ! "unknown"}}', {"a": F.lit("x"), "b": F.lit(None)}), "x is unknown"),
    (lambda: scalars.traits_text(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))), '(a="1", b="2")'),
    (lambda: scalars.fill_template('{{a ? "of %s"}}, {{b ? "%s" ! "-"}}', {"a": F.lit(3), "b": F.lit(None)}), "of 3, -"), (lambda: scalars.split_list(F.lit(" a, ,b")), ["a", "b"]),
    (lambda: scalars.split_list(F.lit(None).cast("string")), []), (lambda: scalars.is_url(F.lit("https://a.co/x?y")), True), (lambda: scalars.is_url(F.lit("ftp://a.co")), False),
    (lambda: scalars.camel_case(F.lit("Page_viewed now")), "pageViewedNow"), (lambda: scalars.languages(F.lit("de;q=0.5, en-US, fr;q=0.9")), ["en-us", "fr", "de"]),
    (lambda: scalars.forwarded_ip(F.lit(" 1.2.3.4, 5.6.7.8")), "1.2.3.4"), (lambda: scalars.fact_text(F.lit("Ann"), F.lit("bought-a"), F.lit(None)), "Ann bought a."),
    (lambda: scalars.email_domain(F.lit("x@Mail.org")), "mail.org"), (lambda: scalars.try_json(F.lit("{")).isNull(), True),
    (lambda: scalars.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))), None)])
def test_scalars(spark, column, value):
    assert one(spark, column()) == value


@pytest.fixture(scope="module")
def memory(spark):
    state = spark.createDataFrame(
        [("A", "p1", "Person", "name", "Alice", 1), ("A", "p1", "Person", "city", "Rome", 1), ("A", "p2", "person", "name", "alice", 1), ("A", "p2", "person", "city", "Paris", 1),
         ("B", "p2", "person", "city", "Rome", 2), ("A", "x1", "place", "name", "old", 5), ("B", "x1", "place", "name", "new", 5)],
        "observer_pk string, entity_pk string, entity_type string, property_name string, property_value string, ts long")
    links = spark.createDataFrame([("p1", "o1", "Person"), ("p2", "o2", "person"), ("x1", "o2", "place"), ("x1", "o3", "place")], "entity_pk string, observation_id string, entity_type string")
    return state, links


def ids(df):
    return sorted(r["observation_id"] for r in df.collect())


def test_search_rules(memory):
    state, links = memory
    both = Entity("PERSON", (Property("name", "ALICE"), Property("city", "rome")))
    assert ids(search.qualifying(state, links, [both])) == ["o1", "o2"]  # kinds and values without case; newest observer wins
    assert ids(search.qualifying(state, links, [both], end=1)) == ["o1"]
    assert ids(search.qualifying(state, links, [both], end=1, unmatched_traits=1)) == ["o1", "o2"]
    assert ids(search.qualifying(state, links, [both, Entity("place")])) == ["o2"]
    assert ids(search.qualifying(state, links, [both, Entity("place")], unmatched_entities=1)) == ["o1", "o2", "o3"]
    assert ids(search.qualifying(state, links, [Entity("place", (Property("name", "new"),))])) == ["o2", "o3"]  # tie in time: larger observer
    assert ids(search.none_of(search.qualifying(state, links, [both]), search.qualifying(state, links, [Entity("place")]))) == ["o1"]
    with pytest.raises(ValueError):
        search.qualifying(state, links, [])


def test_search_vectors(spark, memory):
    state, links = memory
    vectors = spark.createDataFrame([("Rome", [1.0, 0.0]), ("Paris", [0.6, 0.8])], "value string, vector array<double>")
    near = Entity("person", (Property("city", "", vector=(1.0, 0.1)),))
    assert ids(search.qualifying(state, links, [near], vectors=vectors)) == ["o1", "o2"]
    with pytest.raises(ValueError):  # without vectors no group is left
        search.qualifying(state, links, [near])
    named = Entity("person", (Property("name", "alice"), Property("city", "", vector=(1.0, 0.1))))
    assert ids(search.qualifying(state, links, [named])) == ["o1", "o2"]  # nor is the nearness required
    asked = search.with_vectors([Entity("person", (Property("city", "Rome", vector=()),))], lambda texts: [[1.0, 0.0] for _ in texts])
    assert ids(search.qualifying(state, links, asked, vectors=vectors)) == ["o1", "o2"]


def test_search_trees(spark, memory):
    state, links = memory
    rome, place, nowhere = Entity("person", (Property("city", "rome"),)), Entity("place"), Entity("person", (Property("city", "Oslo"),))
    every = links.select("observation_id")

    def found(tree):
        return ids(search.matching(state, links, tree, every))

    assert found(And((rome, place))) == ["o2"] and found(Or((rome, place))) == ["o1", "o2", "o3"]
    assert found(And((place, Not(rome)))) == ["o3"] and found(Not(And((rome, place)))) == ["o1", "o3"]
    assert found(And((Or((nowhere, rome)), Not(Not(place))))) == ["o2"] and found(Not(Or((rome, place)))) == []
    assert search.flattened(And((rome, And((place, Or((nowhere,))))))) == And((rome, place, nowhere))
    assert search.leaves(And((rome, Not(place)))) == [rome]


def observations(spark, rows):
    return spark.createDataFrame(rows, ingest.OBSERVATION)


def obs(key, day, name, consent=True, source="s"):
    people = {"me": {"kind": "Person", "id": "1", "traits": {"name": name, "age": "3"}}, "it": {"kind": "thing", "id": "9", "traits": None}}
    return (key, datetime(2024, 1, day), "l", "me", source, None, consent, people, [{"label": "has", "ts": None, "actor": "me", "objects": ["it", "gone"], "traits": None}, {"label": "is", "ts": None, "actor": "me", "objects": [], "traits": None}])


def test_ingest(spark):
    o = observations(spark, [obs("a", 1, "x"), obs("b", 2, "y", consent=False), obs("c", 3, "z", source="@internal")])
    kept = ingest.admitted(o)
    assert [r["id"] for r in kept.collect()] == ["a"]
    assert ingest.fact_rows(kept).count() == 3
    entities = ingest.entity_rows(kept)
    assert ingest.link_rows(entities).count() == 2
    p = {r["property_name"]: r for r in ingest.property_rows(entities).collect()}
    assert set(p) == {"name", "age"} and p["age"]["property_number"] == 3 and p["name"]["property_number"] is None


def test_merge(spark):
    m = ingest.merge_observations(observations(spark, [obs("a", 2, "new"), obs("a", 1, "old", consent=False)])).collect()
    assert len(m) == 1 and m[0]["consent"] is False and m[0]["entities"]["me"]["traits"]["name"] == "new" and len(m[0]["relation"]) == 4


def test_latest_overlay_histogram(spark):
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, "b")], "k int, ts int, v string")
    assert {(r["k"], r["v"]) for r in tables.latest(log, ["k"], ["ts"]).collect()} == {(1, None), (2, "b")}
    both = reads.overlay(spark.createDataFrame([(1, "p"), (2, "p")], "id int, v string"), spark.createDataFrame([(2, "t"), (3, "t")], "id int, v string"))
    assert sorted(map(tuple, both.collect())) == [(1, "p", True), (2, "t", True), (3, "t", False)]
    h = reads.histogram(spark.createDataFrame([(datetime(1970, 1, 1, 0, 0, 5),)], "ts timestamp"), 0, 60, 6).orderBy("bucket").collect()
    assert [r["n"] for r in h] == [1, 0, 0, 0, 0, 0]


def test_sessions_and_counts_stream(spark, tmp_path):
    schema = "obs_id string, ts timestamp, entity_pk string, property_name string, property_value string"
    facts = spark.createDataFrame([("o", datetime(2024, 1, 1, 10, 0), "p", "n", "v"), ("o", datetime(2024, 1, 1, 10, 30), "p", "n", "v"), ("o", datetime(2024, 1, 1, 12, 0), "p", "n", "w")], schema)
    facts.write.json(str(tmp_path / "in"))
    for name, made in (("ended", pipelines.ended_sessions), ("counts", pipelines.property_counts)):
        q = made(tables.json_stream(spark, str(tmp_path / "in"), schema)).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert sorted((r["since"], r["till"], r["facts"]) for r in spark.table("ended").collect()) == [(datetime(2024, 1, 1, 10), datetime(2024, 1, 1, 11, 30), 2), (datetime(2024, 1, 1, 12), datetime(2024, 1, 1, 13), 1)]
    assert sorted((r["property_value"], r["n"]) for r in spark.table("counts").collect()) == [("v", 2), ("w", 1)]


def test_merge_keeps_traits(spark):
    def person(day, traits, label):
        return ("a", datetime(2024, 1, day), label, "me", "s", "x", None, {"me": {"kind": "Person", "id": "1", "traits": traits}}, [])

    a, b, c = person(1, {"x": "1", "y": "1"}, "one"), person(2, {"y": "2"}, "two"), ("a", datetime(2024, 1, 2), "three", "me", "s", "x", None, {"it": {"kind": "thing", "id": "9", "traits": None}}, [])
    found = [ingest.merge_observations(observations(spark, rows)).collect() for rows in ([a, b, c], [c, b, a])]
    assert found[0] == found[1] and len(found[0]) == 1
    m = found[0][0]
    assert m["entities"]["me"]["traits"] == {"x": "1", "y": "2"} and m["entities"]["it"]["id"] == "9" and m["ts"] == datetime(2024, 1, 2)


def test_admission(spark):
    o = observations(spark, [obs("a", 1, "x"), obs("b", 2, "y"), obs(None, 3, "z")])
    assert ingest.admitted(o, whole=True).count() == 0  # all link an entity that isn't there
    agents = spark.createDataFrame([("a", "GoogleBot/2"), ("b", "Firefox")], "id string, agent string")
    assert [r["id"] for r in ingest.admitted(o, agents).collect()] == ["b"]
    sources = spark.createDataFrame([("s", True), ("t", False)], "source_id string, enabled boolean")
    assert ingest.of_known_sources(o, sources).count() == 3 and ingest.of_known_sources(o, sources.where("not enabled")).count() == 0
    wiped = ingest.without_traits(o, spark.createDataFrame([("person", "1")], "kind string, id string")).where("id = 'a'").first()
    assert wiped["entities"]["me"]["traits"] == {} and wiped["entities"]["me"]["id"] == "1" and wiped["entities"]["it"]["traits"] is None
    slots = {r["session_id"] for r in ingest.with_sessions(o).collect()}
    assert len(slots) == 3 and None not in slots
    linked = o.withColumn("relation", F.transform("relation", lambda r: r.withField("traits", F.create_map(F.lit("a"), F.lit("$(me).name"), F.lit("b"), F.lit("$(no).x"), F.lit("c"), F.lit("plain")))))
    assert ingest.resolved_references(linked).where("id = 'a'").first()["relation"][0]["traits"] == {"a": "x", "b": "$(no).x", "c": "plain"}
    own = {r["property_name"] for r in ingest.property_rows(ingest.entity_rows(o), own=True).collect()}
    assert own == {"name", "age", "$id", "$pk", "$type"}


def test_spans_of_time():
    now = datetime(2024, 3, 1)
    assert times.span(None, None, now) == (datetime(1970, 1, 1), now)
    assert times.span((-1, "month"), (-1, "day"), now) == (datetime(2024, 1, 30), datetime(2024, 2, 29))
    assert times.delta(1, "year").days == 356 and times.parse_delta("-5 m").total_seconds() == -300 and times.parse_delta("2 weeks").days == 14
    for wrong in (lambda: times.span(now, (-1, "day"), now), lambda: times.delta(1, "eon")):
        with pytest.raises(ValueError):
            wrong()


def test_texts_and_references(spark):
    t = spark.createDataFrame([("a", "one two three four five six seven"), ("b", "x y"), ("c", None)], "id string, text_string string")
    assert sorted((r["place"], r["text_string"]) for r in texts.chunks(t, 3, 1).collect()) == [(0, "one two three"), (1, "three four five"), (2, "five six seven")]
    got = texts.embedded(t.where("text_string is not null"), lambda many: [[float(len(x))] for x in many]).collect()
    assert {r["id"]: r["vector"] for r in got} == {"a": [33.0], "b": [3.0]}
    assert texts.bm25(t, "").count() == 0
    mails = spark.createDataFrame([("a@gmail.com",), ("b@x.org",), (None,)], "mail string")
    free = spark.createDataFrame([("GMail.com",), ("gmail.com",)], "domain string")
    assert {r["mail"]: r["free"] for r in scalars.in_reference(mails, scalars.email_domain("mail"), free, "free").collect()} == {"a@gmail.com": True, "b@x.org": False, None: False}
    assert hierarchy.paths(spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], "id int, parent_id int, name string")).count() == 0
    o = spark.createDataFrame([("o1", 1)], "id string, ts int")
    none = spark.createDataFrame([], "observation_id string, entity_pk string, entity_type string, traits map<string,string>, state_ts long")
    assert reading.nested(o, none).first()["entities"] == []


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", ("x", (2,))), (2, None, (None, None)), (3, "b", None)], "k int, v string, s struct<p: string, q: struct<r: int>>")

    def kept(condition):
        return [r["k"] for r in df.where(condition).orderBy("k").collect()]

    v = F.col("v")
    assert kept(filters.equals(v, None)) == [2] and kept(filters.equals(v, "*")) == kept(filters.equals(v, "None")) == [1, 3]
    assert kept(filters.equals(v, ["a"])) == kept(filters.equals(v, "a")) == [1] and kept(filters.differs(v, "a")) == kept(filters.differs(v, ["a"])) == [3] and kept(filters.differs(v, None)) == [1, 3]
    flat = filters.flattened(df)
    assert flat.columns == ["k", "v", "s.p", "s.q.r"] and [r[3] for r in flat.orderBy("k").collect()] == [2, None, None]


def test_catalog_and_backup(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS memory_test LOCATION '{tmp_path}/db'")
    tables.create_table(spark, "memory_test.links", "entity_pk string, observation_id string, month string", ("month",), ("entity_pk",), 2)
    assert {(r["table"], r["column"]) for r in tables.catalog(spark, "memory_test").collect()} == {("links", c) for c in ("entity_pk", "observation_id", "month")}
    raw = spark.createDataFrame([("1", datetime(2024, 1, 5), "{}")], "id string, ts timestamp, payload string")
    for _ in range(2):  # a batch that runs again replaces itself
        tables.back_up(raw, str(tmp_path / "raw"), 7)
    assert [(r["id"], str(r["month"])) for r in spark.read.parquet(str(tmp_path / "raw")).collect()] == [("1", "2024-01")]
    assert {r["name"]: r["rows"] for r in tables.table_counts(spark, "/root/testdata/sf0.001", ["region", "nation"]).collect()} == {"region": 5, "nation": 25}
    flat = tables.project(raw, {"id": "key", "payload": "body"}, ("key",))
    assert flat.columns == ["key", "body"] and flat.count() == 1
    spark.sql("DROP DATABASE memory_test CASCADE")
