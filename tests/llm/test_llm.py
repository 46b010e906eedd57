"""The training-data operators against brute force, on small fixtures with nulls, empty and repeated rows, and on a real table."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from recollect.llm import chat, class_lm, common, licences, mixing, near_dedup, neighbours, packing, quality, simhash, substring_dedup, warc

WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, size long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def texts():
    rng = np.random.default_rng(3)
    words = ["the", "Of", "naïve", "data", "x", "#tag", "[INST]", "</s>", "\\l", "line"] + [f"w{i}" for i in range(60)]
    out = [None, "", " \n\t ", "one", "two words", "a b c d", "a b c d e"]
    passage = " ".join(rng.choice(words, 70))
    out += [passage, passage, " ".join(["start", passage, "end"]), passage.replace("w", "v", 1), "spam " * 300]
    for n in rng.integers(1, 400, 40):
        out.append(" ".join(rng.choice(words, n)) + ("\n" if n % 2 else "  ") + ("MIT License" if n % 3 else "the Apache-License."))
    out += [out[-1], passage + "\n" + out[-2], "\n".join(["same line"] * 5), " ".join(rng.choice(words, 30_000))]
    return out


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, 0, "clash", 7) for i, t in enumerate(texts())]
    rows += [rows[8], (None, "no id here", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_empty_tables(spark, empty):
    assert packing.pack(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0 and near_dedup.keep_one(empty).count() == 0
    assert class_lm.score(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert licences.scan(empty).count() == 0
    assert quality.judge(empty).count() == 0 and quality.keep(empty).count() == 0
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(vectors, vectors).count() == 0
    path = warc.archive_folder(spark)
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.assemble(warc.read_archives(spark, path)).count() == 0


def test_packing(documents):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = packing.pack(documents).collect()
    want = Counter((d, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (0,)) for d, t in plain(documents))
    by_doc = defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
        by_doc[r["doc_id"]].append(r)
    for doc_id, pieces in by_doc.items():
        ids = next(i for d, i in want if d == doc_id)
        assert sum(r["length"] for r in pieces) == len(ids) * want[doc_id, ids]
        for r in pieces:
            assert tuple(r["ids"]) == ids[r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(ids)
    for _, pieces in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        end = 0
        for r in pieces:
            assert r["offset"] == end
            end += r["length"]
        assert end == 1024 or end & (end - 1) == 0


def test_level_array_minimises_squares():
    levels, rng = packing.LevelArray(16), np.random.default_rng(0)
    for size in rng.integers(1, 16, 300).tolist():
        n = levels.counts.copy()
        costs = {}
        for h in [0, *(h for h in range(1, 17 - size) if n[h])]:
            m = n.copy()
            m[h] -= h > 0
            m[h + size] += h + size < 16
            costs[h] = (m**2).sum()
        assert costs[levels.choose(size)] == min(costs.values())
        levels.place((0, 0, b"\0\0\0\0" * size, size), size)
    assert all(sum(len(p[2]) // 4 for p in w) in (1, 2, 4, 8, 16) for w in levels.close())


def brute_fingerprint(text, width):
    w = WORD.findall(lower(text))
    s = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values, radius):
    label = list(range(len(values)))
    near = [[j for j, w in enumerate(values) if (v ^ w).bit_count() <= radius] for v in values]
    while True:
        new = [min(label[j] for j in near[i]) for i in range(len(values))]
        if new == label:
            return label
        label = new


def test_simhash(documents):
    rows = sorted({(d, brute_fingerprint(t, 4)) for d, t in plain(documents) if d is not None})
    label = components([f for _, f in rows], 4)
    got = {(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(documents).collect() if r["doc_id"] is not None}
    assert got == {(d, f, rows[label[i]][0]) for i, (d, f) in enumerate(rows)}


def test_near_links_of_a_hot_bucket(spark):
    rng = np.random.default_rng(1)
    values = {0}
    while len(values) < 300:  # a chain of near fingerprints and some far ones
        values.add(max(values) ^ (1 << int(rng.integers(64))) if rng.random() < 0.8 else int(rng.integers(2**63)))
    values = sorted(values)
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    roots = common.connected_components(simhash.near_links(fps, 4, 6, shard=8)).collect()
    label = components(values, 4)
    got, want = defaultdict(set), defaultdict(set)
    for r in roots:
        got[r["root"]].add(r["node"] % (1 << 64))
    for i, v in enumerate(values):
        want[label[i]].add(v)
    assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def similar_classes(rows, width=5, least=0.8):
    """Component of each id: texts linked at a Jaccard similarity of their shingle sets, by all pairs."""
    sets = []
    for _, text in rows:
        words = WORD.findall(lower(text))
        sets.append({tuple(words[i : i + width]) for i in range(max(len(words) - width, 0) + 1)} if words else set())
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if both >= least * either and label[i] != label[j]:
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    return {d: rows[at][0] for (d, _), at in zip(rows, label)}


def test_near_dedup(spark, documents):
    table = common.table(spark, "/root/testdata/sf0.001", "documents")
    for docs in (documents, table):
        want = similar_classes(sorted({(d, t) for d, t in plain(docs) if d is not None}, key=lambda r: r[0]))
        assert {r["doc_id"]: r["component_id"] for r in near_dedup.classes(docs).where("doc_id is not null").collect()} == want
        kept = near_dedup.keep_one(docs)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(want.values()) | ({None} if docs is documents else set())


def test_near_dedup_of_a_hot_group(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(200):  # each is similar to the base text, few are to each other
        words = list(base)
        for at in rng.choice(200, 3, replace=False):
            words[at] = f"x{rng.integers(10**9)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(500, " ".join(base)), *enumerate(texts)], "doc_id long, text string")
    rows = sorted(plain(docs))
    found = near_dedup.sketches(docs, "doc_id", "text", 5, 16).withColumnRenamed("doc_id", "node")
    links = near_dedup.similar(near_dedup.candidate_links(found, shard=64), found, 5, 0.8)
    assert links.count() <= 20 * len(rows)
    roots = {r["node"]: r["root"] for r in common.connected_components(links).collect()}
    assert {d: roots.get(d, d) for d, _ in rows} == similar_classes(rows)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.classes(docs).collect()} == similar_classes(rows)


def test_near_dedup_of_template_texts(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base, rows = [f"w{i}" for i in range(200)], []
    for d in range(400):  # pairs lie around the threshold, so many light forest edges fail
        words = list(base)
        for at in rng.choice(200, rng.integers(2, 6), replace=False):
            words[at] = f"x{rng.integers(10**9)}"
        rows.append((d, " ".join(words)))
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), similar_classes(rows)
    for size in (near_dedup.BLOCK, 5_000):  # one block, and many of which some have one label
        monkeypatch.setattr(near_dedup, "BLOCK", size)
        assert {r["doc_id"]: r["component_id"] for r in near_dedup.classes(docs).collect()} == want


def test_near_dedup_without_broadcast(spark, monkeypatch):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    want = {(r["doc_id"], r["component_id"]) for r in near_dedup.classes(docs).collect()}
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    assert {(r["doc_id"], r["component_id"]) for r in near_dedup.classes(docs).collect()} == want


def test_spanning_forest():
    rng = np.random.default_rng(6)
    for n in (2, 5, 40):
        u, v = rng.integers(0, n, (2, 3 * n))
        label, want = list(range(n)), []
        for i, (a, b) in enumerate(zip(u.tolist(), v.tolist())):
            if label[a] != label[b]:
                want.append(i)
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
        assert sorted(near_dedup.spanning_forest(n, u, v).tolist()) == want


def test_bk_tree():
    rng = np.random.default_rng(2)
    values = list({int(x) for x in rng.integers(0, 2**16, 400)})
    tree = simhash.BKTree(values)
    want = {q: {i for i, v in enumerate(values) if (v ^ q).bit_count() <= 3} for q in values[:50]}
    assert {q: set(tree.search(q, 3)) for q in want} == want
    got = defaultdict(set)
    for at, near in tree.search_all(np.array(values[:50], np.uint64), 3):
        for i in near.tolist():
            got[values[i]].add(at)
    assert got == want


def test_class_lm(documents):
    rows = plain(documents)
    tokens = [[*WORD.findall(lower(t)), None] for _, t in rows]
    out = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
    c = Counter(w for t, o in zip(tokens, out) if not o for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter((d, o, len(t), sum(w in c for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for (d, _), t, o in zip(rows, tokens, out))
    got = class_lm.score(documents).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


@pytest.mark.parametrize("head", [30, 10**6])
def test_class_lm_score_by_hand(spark, documents, monkeypatch, head):
    monkeypatch.setattr(class_lm, "HEAD", head)
    monkeypatch.setattr(class_lm, "CORE", 12)
    rows = common.stored(class_lm.encoded(documents, "doc_id", "text"), "words")
    training = rows.where("not held_out")
    counts = common.stored(class_lm.count_words(training), "counts")
    found = {r["word"]: (r["class"], r["n"]) for r in class_lm.clustered(training, counts).collect()}
    texts = [(r["doc_id"], r["held_out"], np.frombuffer(r["words"], np.int64).tolist()) for r in rows.collect()]
    seen = Counter(w for _, out, words in texts if not out for w in words)
    assert {w: n for w, (_, n) in found.items()} == seen and all(0 <= c < class_lm.CLASSES for c, _ in found.values())
    unseen, sizes, steps = class_lm.CLASSES + 1, Counter(), Counter()

    def chain(words):
        return [class_lm.CLASSES, *(found[w][0] if w in found else unseen for w in words), class_lm.CLASSES]

    for _, out, words in texts:
        if not out:
            sizes.update(chain(words)[1:])
            steps.update(itertools.pairwise(chain(words)))
    after, want = Counter(), Counter()
    for (a, _), n in steps.items():
        after[a] += n
    for d, _, words in texts:
        value = sum(math.log10((steps[p] + 1) / (after[p[0]] + class_lm.CLASSES + 2)) for p in itertools.pairwise(chain(words)))
        want[d, round(value + sum(math.log10(found[w][1] / sizes[found[w][0]]) for w in words if w in found), 5)] += 1
    assert Counter((r["doc_id"], round(r["score"], 5)) for r in class_lm.score(documents).collect()) == want


def test_choices_are_the_best_moves():
    rng = np.random.default_rng(3)
    words, contexts = 40, class_lm.CLASSES + 2
    counts = rng.poisson(0.2, (words, contexts)) + (rng.integers(0, contexts, words)[:, None] == np.arange(contexts))
    own = rng.integers(-1, 5, words)
    table = rng.poisson(2.0, (contexts, class_lm.CLASSES)).astype(float)
    for w in np.flatnonzero(own >= 0):
        table[:, own[w]] += counts[w]
    at = [np.flatnonzero(c) for c in counts]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in at])[:-1]))
    got = class_lm.choices(np.concatenate(at), np.concatenate([c[x] for c, x in zip(counts, at)]).astype(float), starts, own, table)
    for w in range(words):
        def moved(c, w=w):
            t = table.copy()
            if own[w] >= 0:
                t[:, own[w]] -= counts[w]
            t[:, c] += counts[w]
            return class_lm.likelihood(t)

        assert moved(got[w]) >= max(map(moved, range(class_lm.CLASSES))) - 1e-6


def test_sweeps_raise_the_likelihood(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    training = common.stored(class_lm.encoded(docs, "doc_id", "text"), "words")
    counts = common.stored(class_lm.count_words(training), "counts")
    of = {r["word"]: r["class"] for r in class_lm.clustered(training, counts).collect()}
    top = [r["word"] for r in counts.where(F.col("word") != class_lm.END).orderBy(F.desc("n"), "word").limit(class_lm.CORE).collect()]
    core, rest = set(top), Counter()

    def reached(of):
        table = np.zeros((class_lm.CLASSES + 2, class_lm.CLASSES))
        for (context, w), n in rest.items():
            table[context, of[w]] += n
        return class_lm.likelihood(table)

    for r in training.collect():
        words = [class_lm.END, *np.frombuffer(r["words"], np.int64).tolist()]
        for a, b in itertools.pairwise(words):
            if b not in core:
                rest[class_lm.CLASSES if a == class_lm.END else of[a] if a in core else class_lm.CLASSES + 1, b] += 1
    assert reached(of) > reached({w: w % class_lm.CLASSES for w in of})


def test_exchange_raises_likelihood_and_keeps_counts():
    rng = np.random.default_rng(0)
    kind = rng.integers(0, 4, 80)
    counts = rng.poisson(0.3, (120, 120)).astype(float)
    for i in range(80):
        counts[i, np.flatnonzero(kind == (kind[i] + 1) % 4)] += 5
    of, table = class_lm.exchange(counts, 80)
    again = np.zeros_like(table)
    np.add.at(again, (of[:, None], of[None, :]), counts)
    assert np.allclose(table, again)

    def likelihood(t):
        return class_lm.x_log_x(t).sum() - class_lm.x_log_x(t.sum(0)).sum() - class_lm.x_log_x(t.sum(1)).sum()

    start = np.zeros_like(table)
    first = np.concatenate((np.arange(80) % 64, 64 + np.arange(40)))
    np.add.at(start, (first[:, None], first[None, :]), counts)
    assert likelihood(table) > likelihood(start)


def test_exchange_ends_where_no_move_helps(monkeypatch):
    monkeypatch.setattr(class_lm, "CLASSES", 8)
    chain, bigrams = np.random.default_rng(1).integers(0, 121, 4000), np.zeros((121, 121))
    np.add.at(bigrams, (chain, np.roll(chain, -1)), 1)  # every word follows as often as it is followed

    def likelihood(of):
        table = np.zeros((9, 9))
        np.add.at(table, (of[:, None], of[None, :]), bigrams)
        return class_lm.x_log_x(table).sum() - class_lm.x_log_x(table.sum(axis=0)).sum() - class_lm.x_log_x(table.sum(axis=1)).sum()

    of, _ = class_lm.exchange(bigrams, 120)
    reached = likelihood(of)
    for w, c in itertools.product(range(120), range(8)):
        moved = of.copy()
        moved[w] = c
        assert likelihood(moved) <= reached + 1e-6


def test_held_out_perplexity(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    s = class_lm.score(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert s[0] > s[1]


@pytest.mark.parametrize("words", [50, 7])
def test_substring_dedup(documents, words):
    rows = plain(documents)
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - words + 1) if d is not None else ():
            k = tuple(w[i : i + words])
            first[k] = min(d, first.get(k, d))
    want = Counter()
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - words + 1) if d is not None else ():
            if first[tuple(w[i : i + words])] < d:
                gone[i : i + words] = [True] * words
        want[d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()] += 1
    got = substring_dedup.remove_repeats(documents, words=words)
    assert got.columns == [*documents.columns, "kept_text", "n_words", "n_removed", "kept_sha256"]
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()) == want
    assert any(k[2] for k in want)


def brute_targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_, rest = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(sizes.values())
    while rest > 1e-9 and open_:
        share, total = rest, sum(w[s] for s in open_)
        rest = 0.0
        for s in list(open_):
            target[s] += share * w[s] / total
            if target[s] >= 2 * sizes[s]:
                rest += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_mixing(documents):
    rows = mixing.mix_plan(documents).collect()
    sizes = Counter()
    for r in documents.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    target, taken = brute_targets(sizes), Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * (1 + target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(rows) == documents.count()
    assert all(abs(taken[s] - target[s]) <= 2 for s in sizes)
    assert Counter((r["doc_id"], r["taken"]) for r in rows) == Counter((r["doc_id"], r["taken"]) for r in mixing.mix_plan(documents.repartition(5)).collect())
    mixed = mixing.mix(documents)
    assert mixed.columns == documents.columns
    assert sum(len(WORD.findall(r["text"] or "")) for r in mixed.collect()) == sum(taken.values())


def test_mixing_shards_follow_the_leaves(spark, documents, monkeypatch):
    how = {"shard_words": 3000, "block_words": 300}
    rows = mixing.mix_plan(documents, **how).collect()
    shards = defaultdict(Counter)
    for r in rows:
        for d in r["draws"]:
            shards[d["shard"]][r["source"]] += d["taken"]
    total = sum(r["taken"] for r in rows)
    assert 8 <= len(shards) <= 2 ** (math.ceil(total / 3000) - 1).bit_length()
    assert total == sum(sum(c.values()) for c in shards.values())
    short = Counter()  # without the long text
    for r in rows:
        short.update({d["shard"]: d["taken"] for d in r["draws"] if r["size"] < 5000})
    assert max(short.values()) < 3000
    plain = Counter((r["doc_id"], r["taken"]) for r in rows)
    monkeypatch.setattr(mixing, "split_quotas", lambda quotas, depth: quotas.select(F.lit(0).cast("long").alias("shard"), F.transform("quotas", lambda q: q * 0).alias("starts"), "quotas"))
    one = mixing.mix_plan(documents, **how).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in one) == plain and {d["shard"] for r in one for d in r["draws"]} == {0}
    monkeypatch.setattr(mixing, "split_quotas", lambda quotas, depth: quotas.select(F.lit(0).cast("long").alias("shard"), F.transform("quotas", lambda q: q * 0).alias("starts"), F.transform("quotas", lambda q: F.floor(q / 2)).alias("quotas")))
    assert sum(r["taken"] for r in mixing.mix_plan(documents, **how).collect()) < 0.8 * total  # what leaves don't ask for isn't drawn


def test_splitting_tree_adds_up(spark):
    quotas = [1000, 0, 37, 1, 250_000]
    leaves = mixing.split_quotas(spark.createDataFrame([(quotas,)], "quotas array<bigint>"), 3).collect()
    for k in range(5):  # each leaf starts where the one before ends
        at = 0
        for r in sorted(leaves, key=lambda r: r["shard"]):
            assert r["starts"][k] == at
            at += r["quotas"][k]
    assert len(leaves) == 8 and [sum(c) for c in zip(*(r["quotas"] for r in leaves))] == quotas
    totals = [sum(r["quotas"]) for r in leaves]
    assert max(totals) - min(totals) <= 3
    assert all(abs(r["quotas"][4] - 250_000 / 8) < 600 for r in leaves)


def test_hypergeometric_mean(spark):
    draws = spark.range(4000).select(mixing.hypergeometric(F.lit(50).cast("long"), F.lit(20).cast("long"), F.lit(10).cast("long"), mixing.uniform(F.col("id"))).alias("k"))
    m = draws.agg(F.avg("k"), F.variance("k"), F.min("k"), F.max("k")).first()
    assert abs(m[0] - 4) < 0.1 and abs(m[1] - 10 * 0.4 * 0.6 * 40 / 49) < 0.2 and m[2] >= 0 and m[3] <= 10


def test_licences(documents):
    word, want = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), Counter()
    for d, t in plain(documents):
        w = word.findall(lower(t))
        found = [(i, label) for p, label in licences.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in found]
        want[d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))] += 1
    rows = licences.scan(documents).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows) == want
    assert all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows)


def test_licence_spans(spark):
    text = "Intro words. " + licences.TEMPLATES[3][1].replace("retain", "keep") + " More."
    r = licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["labels"] == "bsd" and r["base_labels"] == "" and r["score"] > 0.8
    assert r["spans"][0]["first_word"] == 2


def test_licence_score_of_a_part_before_a_short_match(spark):
    words = licences.licence_words(licences.TEMPLATES[0][1])
    part = b" ".join(words[: len(words) // 2]).decode()
    text = f"{part} {'other ' * 20}{b' '.join(words[:6]).decode()}"
    docs = spark.createDataFrame([(1, part), (2, text)], "doc_id long, text string")
    alone, followed = (r["score"] for r in licences.scan(docs).orderBy("doc_id").collect())
    assert alone == followed == (len(words) // 2) / len(words)


def test_automaton_has_all_substrings():
    rng = np.random.default_rng(5)
    sequences = [rng.integers(0, 3, n).tolist() for n in (12, 9, 15, 1)]
    a = licences.SuffixAutomaton(sequences)
    for n in range(1, 7):
        for s in itertools.product(range(3), repeat=n):
            want = {(k, i + n - 1) for k, q in enumerate(sequences) for i in range(len(q) - n + 1) if tuple(q[i : i + n]) == s}
            state = 0
            for x in s:
                state = a.next[state].get(x) if state is not None else None
            assert (a.places[state] if state is not None else set()) == want


def test_chat(spark):
    hard = ["</s>", "<s>user\nhi</s>", "\\l", "\\b<", "\\n", "", None, "a\nb", "</s>[INST] ok [/INST]", "\\", "<", "</", "é" * 5, "[/INST]</s"]
    rows = [(c, i, r, t, "x") for c in (1, 2, None) for i, (r, t) in enumerate(itertools.product(("user", "assistant", "odd\nrole</s>", None), hard))]
    rows += [rows[0], (3, None, "assistant", "only", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    for r in made.collect():
        assert r["round_trip"]
        for span, text in zip(r["loss_spans"], [t for c, i, role, t, _ in sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: (x[1] or 0, x[2] or "", x[3] or "")) if role == "assistant"]):
            assert chat_unescape(r["formatted"][span["start"] : span["start"] + span["length"]]) == (text or "")
    for key in (1, 2, None, 3):
        own = sorted((x for x in rows if x[0] == key), key=lambda x: (x[1] or 0, x[2] or "", x[3] or ""))
        turns = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t, _ in own)
        loss = "".join(t or "" for _, _, r, t, _ in own if r == "assistant")
        g = got[key]
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def chat_unescape(text):
    return text.replace("\\n", "\n").replace("\\l", "<").replace("\\b", "\\")


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    x[100:180] = 3 * x[100]  # many equal vectors, nearest to themselves
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15), (904, [float("inf")] * 16), (None, [1.0] * 16), rows[5]]
    df = spark.createDataFrame([(*r, 0) for r in rows + bad], "vec_id long, embedding array<float>, rank int")
    got = defaultdict(list)
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 900, 20))
    hits, y = 0, x.astype(float)
    for q, found in got.items():
        s = y @ y[q]
        want = [i for i in np.lexsort((np.arange(900), -s.round(9))).tolist() if i != q][:20]
        assert len(found) == 20 and all(abs(s[i] - v) < 1e-9 for i, v in found)
        hits += len(set(want) & {i for i, _ in found})
    assert hits / (20 * len(got)) >= 0.9
    assert [i for i, _ in got[100]] == list(range(101, 121))


def test_neighbours_at_equal_scores(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 64)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(9)
    x = rng.permutation(401).astype(float)
    rows = [(i, [1.0, float(v)]) for i, v in enumerate(x)] + [(1000, [2.0, 0.0])]  # all have 2 as their product with the last
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.where("vec_id = 1000")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, 2.0) for i in range(20)]


def test_neighbours_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 50)
    monkeypatch.setattr(neighbours, "BLOCK", 10)
    rng = np.random.default_rng(10)
    centres = 8 * rng.standard_normal((12, 24))
    x = centres[rng.integers(0, 12, 3000)] + rng.standard_normal((3000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, hits = defaultdict(set), 0
    for r in neighbours.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got[r["query_id"]].add(r["vec_id"])
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(found & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 60 and hits >= 0.95 * 20 * 60


def test_quality_statistics(documents):
    want = Counter()
    for d, t in plain(documents):
        t = t or ""
        w = WORD.findall(t)
        three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c, gone = Counter(three), [False] * len(w)
        for i, x in enumerate(three):
            if c[x] > 1:
                gone[i : i + 3] = [True] * 3
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[d, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), sum(gone), len(w) < 50 or 100 * sum(gone) > 50 * len(w)] += 1
    rows = quality.judge(documents).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows) == want
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert quality.keep(documents).count() == sum(r["kept"] for r in rows)


def test_quality_least_determinant(spark):
    rng, rows = np.random.default_rng(8), []
    for source, n in (("a", 40), ("b", 61), ("c", 29)):
        for i in range(n):
            odd = i % 5 == 0  # a fifth lies together, elsewhere
            words = int(np.exp(rng.normal(6 + odd, 0.6 - 0.4 * odd)))
            rows.append(("en", source, words + 60, int((words + 60) * rng.normal(5 + 2 * odd + 0.3 * np.log(words), 0.4)), int(odd * words * 0.2 + rng.integers(0, 3)), int(rng.integers(0, 9)), 40, int(rng.integers(0, 20))))
    stats = spark.createDataFrame(rows, "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long")
    x = quality.with_features(stats).toPandas()
    for r in quality.estimates(stats).collect():
        z = np.array([(x[x["source"] == r["gb"]][c] - r[f"m{i}"]) / r[f"d{i}"] for i, c in enumerate(quality.X)]).T
        floor, h, least = np.array([quality.FLOORS[i] / r[f"d{i}"] for i in range(5)]) ** 2, math.ceil(quality.SHARE * len(z)), np.inf
        for _ in range(300):  # concentration from random subsets
            held, last = rng.permutation(len(z))[:7], np.inf
            while True:
                cov = np.cov(z[held].T, bias=True)
                cov[np.arange(5), np.arange(5)] = np.maximum(np.diag(cov), floor)
                cov += 1e-9 * np.eye(5)
                now = np.linalg.slogdet(cov)[1] if len(held) == h else np.inf
                if len(held) == h and now > last - 1e-9:
                    break
                last, off = now, z - z[held].mean(0)
                held = np.argsort(np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off))[:h]
            least = min(least, last)
        assert r["logdet"] <= least + 0.2, (r["gb"], r["logdet"], least)


def test_quality_outliers(spark):
    rng = np.random.default_rng(6)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "rst", "lling", "m")]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(60, 900)))), "en", "s") for i in range(200)]
    rows += [(1000 + i, " ".join(f"{w} ## $$" for w in rng.choice(words, 100)), "en", "s") for i in range(5)]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] for i in range(200)) and not any(kept[1000 + i] for i in range(5))


def test_quality_outliers_of_small_groups(spark):
    rng = np.random.default_rng(6)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "rst", "lling", "m")]
    places = [("en", "big")] * 200 + [("en", "small")] * 10 + [("xx", "big")] * 10 + [(None, None)] * 5
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(60, 900)))), *p) for i, p in enumerate(places)]
    rows += [(1000 + i, " ".join(f"{w} ## $$" for w in rng.permutation(words)), *p) for i, p in enumerate([("en", "small"), ("xx", "big"), ("xx", "other"), (None, None), (None, "big")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    judged = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert len(judged) == len(rows) and all(r["distance"] is not None for r in judged.values())
    assert {d for d, r in judged.items() if r["kept"]} == {r["doc_id"] for r in quality.keep(docs).collect()} == set(range(len(places)))


def test_warc(spark):
    page = "<html>" + "é" * 600
    tricky = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "y" * 1200
    big = "<b>" + "z" * 1_500_000
    rows = [(30, "http://big/", big), (31, "http://big/", big[:-700_000]), (1, "http://a/1", page), (2, "http://a/2", page), (3, None, page), (4, "http://b/", None), (5, "http://b/\n", "small"), (6, "u", "small"), (7, "t", tricky), (8, "t", tricky), (None, "n", page), (None, "m", "lone"), (5, "http://b/\n", "small")]
    path = warc.archive_folder(spark)
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path, file_bytes=200_000)
    records = warc.read_archives(spark, path)
    got = warc.assemble(records).collect()
    found = Counter((r["capture"]["page_id"], r["capture"]["type"], r["capture"]["refers_to"], r["capture"]["payload_digest"], r["metadata"][0]["payload_bytes"]) for r in got)
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        owner = max((j for j, _, g in rows if g == h and j is not None), default=None) if len(b) >= 1000 else None
        again = owner is not None and owner != i
        want[i, "revisit" if again else "response", owner if again else None, hashlib.sha1(b).hexdigest(), len(b)] += 1
    assert found == want
    assert all(r["request"] is not None and len(r["metadata"]) == 1 for r in got)
    assert {bytes(r["capture"]["payload"]).decode() for r in got if r["capture"]["type"] == "response"} == {h or "" for _, _, h in rows}


def test_warc_of_rows_that_move(spark):
    """Each computation of the pages deals and orders them anew; revisits must still name a record that is there."""
    page = "<html>" + "x" * 1500
    rows = [(i, f"http://a/{i}", page + str(i % 3)) for i in range(60)] + [(59, "http://a/59", page + "2")] * 3 + [(None, None, page + "0")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = df.repartition(4, F.rand()).sortWithinPartitions(F.rand())
    path = warc.archive_folder(spark)
    warc.write_archives(pages, path)
    lines = [x for r in spark.read.option("recursiveFileLookup", "true").text(path).collect() for x in [r["value"].strip()]]
    refers = {x.removeprefix("WARC-Refers-To: ") for x in lines if x.startswith("WARC-Refers-To: ")}
    ids = [x.removeprefix("WARC-Record-ID: ") for x in lines if x.startswith("WARC-Record-ID: ")]
    assert len(ids) == len(set(ids)) == 3 * len(rows) and refers and refers <= set(ids)
    records = warc.read_archives(spark, path)
    responses = {r["record_id"] for r in records.where("type = 'response'").collect()}
    assert refers <= responses and warc.assemble(records).count() == len(rows)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), common.stored(stage(spark, docs, ""), "stage")
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        assert 0 < docs.count() and (docs.count() <= before or "mixing" in name)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_pipeline_stages_on_odd_rows(spark, documents, empty):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty.select(*corpus_pipeline.COLUMNS), "").count() == 0, name
    odd = documents.select(*corpus_pipeline.COLUMNS)  # null, blank, repeated and very long texts, null ids and sources
    for name, stage in (s for s in corpus_pipeline.STAGES if s[0] != "SimHash near-dedup"):  # test_near_dedup has that
        found = stage(spark, odd, "")
        assert found.count() > 0 and (name == "packing" or found.columns == list(corpus_pipeline.COLUMNS)), name


@pytest.mark.parametrize("name", ["op4_substring_doubling", "op7_chat_round_trip", "op10_warc_transactions", "licence_phrases", "quality_statistics", "mix_targets"])
def test_query_against_sql(spark, name):
    import duckdb
    from recollect.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    found = con.execute(ORACLE_SQL[name])
    assert [d[0] for d in found.description] == df.columns
    assert Counter(map(tuple, df.collect())) == Counter(found.fetchall())
