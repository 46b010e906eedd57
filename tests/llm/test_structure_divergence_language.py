"""Conversation repair, source divergence and language identification against brute force, SQL and held-out accuracy."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from recollect.llm import divergence, language, repair

TURNS = "conv_id long, turn long, role string, text string, n long, key string, fault string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, value long"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
REPLY = {0: "user", 1: "user", 2: "assistant", 3: "user"}


def sql_rows(name, **tables):
    from recollect.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    for table, frame in tables.items():
        con.register(f"{table}_rows", frame.toArrow())
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM {table}_rows")
    return Counter(con.execute(ORACLE_SQL[name]).fetchall())


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = text.strip(repair.BLANK)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else None if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def by_all_scripts(rows):
    """(cost, audit, repaired) over every script of at most two inserts in a row."""
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            cost, audit, state, kept = 0, "", 0, []
            for k, edit, row, fault in itertools.zip_longest(inserts, edits, rows, faults_of(rows)):
                for _ in range(k):
                    kept.append((REPLY[state], ""))
                    state = NEXT[state, REPLY[state][0]]
                cost, audit = cost + 5 * k, audit + "I" * k
                if edit is None:
                    break
                if edit != "D":
                    role = row[1] if edit == "K" else REPLY[state]
                    if fault in ("blank", "duplicate") or (state, role[:1]) not in NEXT:
                        break
                    state = NEXT[state, role[:1]]
                    kept.append((role, row[2]))
                cost += {"K": 0, "R": 1, "D": 2}[edit] + 5 * (fault == "truncated" and edit != "D")
                audit += edit
            else:
                continue
            if edit is None and state in (0, 3) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, kept)
    return best


def conversations():
    rng, rows = random.Random(4), []
    roles, said = ["user", "assistant", "system", "tool", "", None, "ulysses"], ["Yes.", "No", "What?", "", " \n", None, "yes.", "long " * 40 + "!", "é"]
    for conv in range(60):
        for turn in range(rng.randrange(5)):
            rows.append((conv, turn if rng.random() < 0.9 else None, rng.choice(roles), rng.choice(said), 1, "clash", None))
            if rng.random() < 0.15:
                rows.append(rows[-1])
    rows += [(None, 3, "user", "Hi.", None, None, None), (None, None, "assistant", "Oh", None, None, None), (70, 2**62, "user", "a.", 0, "", ""), (70, -(2**62) - 5, "assistant", "b.", 0, "", "")]
    return rows


def test_repair_against_all_scripts(spark):
    rows = conversations()
    turns = spark.createDataFrame(rows, TURNS).repartition(5)
    by_conv = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        by_conv[conv].append((turn, " " if role is None else role, " " if text is None else text))
    found = {r["conv_id"]: r for r in repair.summaries(turns).collect()}
    edits = defaultdict(list)
    for r in repair.repair(turns).collect():
        edits[r["conv_id"]].append(r)
    assert found.keys() == by_conv.keys()
    for conv, own in by_conv.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][: repair.HEAD]))
        faults, got = Counter(faults_of(own)), found[conv]
        assert (got["blank"], got["duplicate"], got["truncated"]) == (faults["blank"], faults["duplicate"], faults["truncated"])
        assert got["illegal"] == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        known = [t for t, *_ in own if t is not None]
        assert got["gaps"] == (min(max(known) - min(known) + 1 - len(set(known)), 2**63 - 1) if known else 0)
        if len(own) <= 4:
            cost, audit, kept = by_all_scripts(own)
            assert (got["cost"], got["audit"]) == (cost, audit), own
            said = "\n".join(f"{role}:{text}" for role, text in kept)
            assert got["repaired_sha256"] == hashlib.sha256(said.encode()).hexdigest()
            mine = sorted(edits[conv], key=lambda r: r["at"])
            assert "".join(r["edit"] for r in mine) == audit and [(r["role"], r["text"]) for r in mine if r["edit"] != "D"] == kept


def test_repair_query_on_odd_rows_against_sql(spark):
    turns = spark.createDataFrame(conversations(), TURNS)
    turns = turns.where("conv_id is null or conv_id <> 70")  # the SQL's gaps would overflow
    got = repair.summaries(repair.damage(turns), conversations=turns)
    assert Counter(map(tuple, got.collect())) == sql_rows("op11_repair_ranked_edits", conversations=turns.select("conv_id", "turn", "role", "text"))


def test_repair_of_a_hot_conversation(spark):
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["ok.", f"t{t}", f"t{t}."]), 0, "", "") for t in range(20_000)]
    rows += [(1, 7, "user", "copy.", 0, "", "")] * 5_000 + [(2, 0, "user", "Hi.", 0, "", ""), (2, 1, "assistant", "Hi.", 0, "", "")]
    turns = spark.createDataFrame(rows, TURNS)
    one, two = repair.summaries(turns).orderBy("conv_id").collect()
    assert two["audit"] == "KK" and one["duplicate"] >= 4_999 and sum(one["audit"].count(c) for c in "KRD") == 25_000
    roles = "".join(r["role"][0] for r in repair.repair(turns).where("conv_id = 1 and edit <> 'D'").orderBy("at").collect())
    assert re.fullmatch("(s?(ua)+)?", roles)
    layers = repair.Layers()
    course = repair.Course(layers)
    for _ in range(100_000):
        course.push(rng.choice(["D", "s", "u", "a", "x", "st", "ut", "at", "xt"]))
    assert len(layers.steps) < 2_000  # layers repeat, so a row costs a look-up


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert repair.summaries(empty).count() == repair.repair(empty).count() == 0
    gone = repair.summaries(empty, conversations=spark.createDataFrame([(3,)], "conv_id long")).collect()
    assert [tuple(r) for r in gone] == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def odd_documents():
    rng = random.Random(6)
    words = ["Alpha", "beta", "Éclair", "éclair", "γ", "x1y", "don't", "日本", "z"]
    rows = [(i, " ".join(rng.choices(words, [9, 5, 3, 2, 2, 1, 1, 1, 4], k=rng.randrange(1, 60))), rng.choice(["en", "fr", "", None]), rng.choice(["a", "b", "é", None, ""]), 0, "clash", 1) for i in range(90)]
    rows += [(100, None, "en", "silent", 0, "", 1), (101, "12 34 !", "xx", "digits", 0, "", 1), (102, "lone", "xx", "other", 0, "", 1), (None, None, None, None, None, None, None)]
    rows += [(103, "same words here " * 2000, "de", "long", 0, "", 1)] * 3 + [(104, "x" * 100_000, "de", "short", 0, "", 1)]
    return rows


def test_divergence_against_sql(spark):
    docs = spark.createDataFrame(odd_documents(), DOCS).repartition(4)
    got = Counter(map(tuple, divergence.audit(docs).collect()))
    assert got == sql_rows("op12_divergence_supports", documents=docs.select("doc_id", "text", "lang", "source"))
    assert ("xx", "digits", "pair", "other", 0, 1) in got  # no kept term
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_divergence_flushes_and_cuts_between_terms(spark, monkeypatch):
    docs = spark.createDataFrame(odd_documents(), DOCS)
    want = Counter(map(tuple, divergence.audit(docs).collect()))
    monkeypatch.setattr(divergence, "PIECE", 7)
    text = "Éclair! naïve words, and@more [X] {y} a`b" * 3
    found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
    assert [t.decode() for piece in divergence.terms(text) for t in piece] == ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in found]
    monkeypatch.setattr(divergence, "PIECE", 1 << 22)
    monkeypatch.setattr(divergence, "HELD", 5)
    assert Counter(map(tuple, divergence.audit(docs).collect())) == want


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs.select("doc_id", "text", "lang"))
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_odd_rows(spark):
    syllables = {"aa": ["ba", "le", "mo"], "bb": ["xi", "zu", "qo"]}
    rng = random.Random(1)
    rows = [(i, " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(rng.randrange(1, 80))), lang, "s", 0, "", 0) for i, lang in enumerate(["aa", "bb"] * 40)]
    odd = [(200, None, "aa", None, 0, "", 0), (201, "123 !?", "aa", None, 0, "", 0), (202, "", "bb", None, 0, "", 0), (203, "BALEMO " * 50_000, None, None, 0, "", 0), (None, "xizuqo xixixi", "bb", None, 0, "", 0)]
    found = language.identify(spark.createDataFrame(rows + odd + odd[:1], DOCS)).collect()
    pred = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows) + len(odd) + 1
    assert all(pred[i]["lang_pred"] == "und" and pred[i]["score"] == 0 and not pred[i]["accepted"] for i in (200, 201, 202))
    assert pred[203]["lang_pred"] == "aa" and pred[203]["accepted"] and pred[None]["lang_pred"] == "bb" and pred[None]["held_out"] is False
    assert sum(pred[i]["lang_pred"] == lang for i, _, lang, *_ in rows) >= 76
    one = language.identify(spark.createDataFrame(rows[:1] + odd[:1], DOCS), margin=0.5).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} in ({("aa", 1.0), ("und", 0.0)}, {("und", 0.0)})
    assert language.identify(spark.createDataFrame([], DOCS)).count() == 0
    nothing = language.identify(spark.createDataFrame([(1, "words", None, None, 0, "", 0)], DOCS)).collect()
    assert [(r["lang_pred"], r["score"]) for r in nothing] == [("und", 0.0)]


def test_dictionaries_are_bounded_and_never_empty(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(8)), "aa", "s", 0, "", 0) for i in range(3000)]
    rows += [(6, "the same text over and over", "bb", "s", 0, "", 0)] * 3000 + [(i, "x" * i, "cc", "s", 0, "", 0) for i in range(4000, 4004)]
    found = language.dictionaries(spark.createDataFrame(rows, DOCS).repartition(9), rows=20, size=400)
    assert set(found) == {"aa", "bb", "cc"} and all(0 < len(d) <= 400 for d in found.values())
    assert len(found["aa"]) > 350 and b"the same" in found["bb"] or b"over" in found["bb"] or b"text" in found["bb"]


def test_label_does_not_reach_a_prediction(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    changed = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 'zz' ELSE lang END AS lang", "'x' AS source")
    assert {tuple(r) for r in language.identify(docs).collect()} == {tuple(r) for r in language.identify(changed).collect()}


@pytest.mark.parametrize("name", ["op11_repair_ranked_edits", "op12_divergence_supports"])
def test_query_against_sql(spark, name):
    from recollect.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    df = QUERIES[name](spark, folder)
    tables = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "conversations")}
    assert Counter(map(tuple, df.collect())) == sql_rows(name, **tables)
