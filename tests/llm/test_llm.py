"""The operators of the llm package on small inputs, against plain models."""

import collections
import itertools
import random
import zlib

import numpy as np
import pytest
from compare import difference, duck
from pyspark.sql import functions as F

import corpus_pipeline
from linkloom.llm import line_dedup, mixing, neighbours, packing, quality, sharding, simhash, substrings, toxicity, url_filter
from linkloom.llm.components import connected_components
from linkloom.llm.near_texts import near_classes
from linkloom.llm.queries import QUERIES, SQL
from linkloom.operators.storage import RunFolder

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, size long, shard int"
LABELS = "doc_id long, quality int, toxic int"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
PROSE = " ".join(f"word{i}" for i in range(80))


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", f"src{n % 3}", None, "k", None, 1, 2) for n, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS)


def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows; columns with clashing names."""
    texts = [None, None, "", " \t\n", "One two three.", LONG, PROSE, PROSE, PROSE, "a\nb\n" + PROSE]
    rows = docs(spark, texts, [None, 1, 2, 3, 4, 5, 6, 7, 7, 8])
    nulls = spark.createDataFrame([(9, "x y z", None, None, None, None, None, None, None)], DOCS)
    return rows.union(nulls)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folders of odd and of empty tables."""
    made = {}
    for name in ("odd", "empty"):
        folder = str(tmp_path_factory.mktemp(name))
        rows = odd_docs(spark) if name == "odd" else docs(spark, [])
        rows.write.parquet(f"{folder}/documents.parquet")
        labels = [(4, 1, 0), (6, None, None), (7, 0, 1), (None, 1, 1)] if name == "odd" else []
        spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
        pages = [(1, None), (2, "no scheme"), (3, "http://A.Example.org/en/1?x"), (3, "http://A.Example.org/en/1?x"), (None, "https://x.net")]
        spark.createDataFrame(pages if name == "odd" else [], "page_id long, url string").write.parquet(f"{folder}/pages.parquet")
        inf = float("inf")
        vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (20, [0.5, inf]), (40, [1.0, 0.0]), (None, [1.0, 1.0]), (5, [1.0, None]), (6, [1.0])]
        spark.createDataFrame(vectors if name == "odd" else [], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
        turns = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, None, None, ""), (2, 0, "tool", PROSE), (2, 0, "tool", PROSE), (None, 1, "user", "x"), (3, 7, "", "y")]
        spark.createDataFrame(turns if name == "odd" else [], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
        made[name] = folder
    return made


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_empty_results(spark, tables, name):
    assert QUERIES[name](spark, tables["empty"]).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, tables, name):
    rows = QUERIES[name](spark, tables["odd"]).collect()
    if name in ("op1_simhash_near_dup", "op4_quality_rules", "op7_line_dedup", "op9_sharding", "op10_toxicity"):
        assert len(rows) == 11
    if name == "op2_url_filter":
        assert sorted((r.host, r.path, r.rule or "") for r in rows) == sorted(
            [("", "", ""), ("", "", ""), ("x.net", "", "")] + [("a.example.org", "/en/1", "example.org/en/1")] * 2)
    if name == "op5_nearest_neighbours":
        assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(rows, key=lambda r: (r.query_id, r.rank))] == [
            (0, 1, 1, 1.0), (0, 2, 40, 1.0), (0, 3, 2, 0.0), (40, 1, 0, 1.0), (40, 2, 1, 1.0), (40, 3, 2, 0.0)]


def test_pipeline_on_odd_and_empty_tables(spark, tables):
    assert corpus_pipeline.run(spark, tables["empty"]).count() == 0
    packed = corpus_pipeline.run(spark, tables["odd"]).collect()
    assert packed and all(r.bin_offset + r.tokens <= r.bin_length for r in packed)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert difference(spark, duck(SF), name, SF) is None


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(7, 7)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    rows = connected_components(spark.createDataFrame(edges, "u long, v long"), RunFolder(spark, "test")).collect()
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(top(a), top(b))] = min(top(a), top(b))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert sorted((r.node, r.root) for r in rows) == sorted((x, top(x)) for x in linked)


def test_bk_forest_finds_what_brute_force_finds():
    rng = random.Random(2)
    codes = {0, (1 << 64) - 1}
    for _ in range(20):
        base = rng.getrandbits(64)
        codes |= {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(30)}
    codes = np.array(sorted(codes), dtype=np.uint64)
    groups = np.arange(len(codes)) % 2
    forest = simhash.BKForest(codes, groups)
    q, n = forest.search(codes, np.array([forest.root_of[g] for g in groups.tolist()]), 2)
    near = lambda i, j: groups[i] == groups[j] and int(codes[i] ^ codes[j]).bit_count() <= 2
    assert set(zip(q.tolist(), n.tolist())) == {p for p in itertools.product(range(len(codes)), repeat=2) if near(*p)}


@pytest.mark.parametrize("crowd", [4096, 3])
def test_near_links_join_all_within_radius(spark, crowd, monkeypatch):
    monkeypatch.setattr(simhash.shards, "__defaults__", (simhash.RADIUS, crowd))
    rng = random.Random(3)
    codes = {rng.getrandbits(64) for _ in range(5)}
    for base in list(codes):
        codes |= {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(12)}
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    links = simhash.near_links(spark.createDataFrame([(c,) for c in signed], "print long"), RunFolder(spark, "test")).collect()
    graph = collections.defaultdict(set)
    for link in links:
        assert ((link.u ^ link.v) & ((1 << 64) - 1)).bit_count() <= 64
        graph[link.u].add(link.v)
        graph[link.v].add(link.u)

    def reach(x):
        seen, todo = {x}, [x]
        while todo:
            for y in graph[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen

    for a, b in itertools.combinations(signed, 2):
        if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2:
            assert b in reach(a)


def test_near_dedup_keeps_the_least_of_each_group(spark):
    kept = simhash.keep_one_per_group(docs(spark, [PROSE, PROSE + " ", LONG, "", None, LONG], [5, 3, 9, 8, 4, None]))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 9] and kept.columns == docs(spark, []).columns


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def near_roots(spark, texts):
    keyed = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    found = {r["key"]: r["root"] for r in near_classes(keyed, RunFolder(spark, "test")).collect()}
    return [found.get(i, i) for i in range(len(texts))]


def test_near_classes_join_edited_copies(spark):
    rng = random.Random(10)
    texts, groups = [], []
    for n in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        edited = list(words)
        for at in rng.sample(range(300), 1 + n % 6):
            edited[at] = "edited"
        half = words[:200] + [f"v{rng.randrange(5000)}" for _ in range(100)]
        texts += [" ".join(words), " ".join(edited), " ".join(half)]
        groups.append(jaccard(texts[-3], texts[-2]))
        assert jaccard(texts[-3], texts[-1]) < 0.6
    assert min(groups) < 0.83 and max(groups) > 0.95
    near = [g >= 0.8 for g in groups]
    kept = {i for i, root in enumerate(near_roots(spark, texts)) if root == i}
    assert {3 * n for n in range(150)} | {3 * n + 2 for n in range(150)} <= kept
    found = sum(3 * n + 1 not in kept for n in range(150) if near[n])
    assert found >= 0.98 * sum(near) and all(3 * n + 1 in kept for n in range(150) if not near[n])


def test_pipeline_near_dedup_is_that_of_the_operator(spark):
    words = " ".join(f"w{i}" for i in range(400))
    texts = [words, words.upper(), words + "\n", PROSE, "", None, words.replace("w7 ", "x ")]
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(spark, texts), "").collect()}
    prints = simhash.fingerprints(docs(spark, texts), "text", {"doc_id": F.col("doc_id")}).collect()
    distance = {r.doc_id: ((r.print ^ prints[0].print) & (2**64 - 1)).bit_count() for r in prints}
    assert prints[0].doc_id == 0 and distance[1] == distance[2] == 0
    assert kept == {0, 3, 4} | ({6} if distance[6] > 2 else set())


def test_host_reputation_blocks_bad_hosts_only(spark):
    rows = [("bad.example.com", 0)] * 40 + [("good.example.com", 1)] * 40 + [("new.example.com", None), ("one.example.com", 0)]
    rated = {r.host: r for r in url_filter.rate_hosts(spark.createDataFrame(rows, "host string, good int"), RunFolder(spark, "test")).collect()}
    assert rated["bad.example.com"].bound < 0.5 < rated["good.example.com"].share
    assert rated["new.example.com"].bound > 0.5
    assert rated["bad.example.com"].share < rated["one.example.com"].share < rated["new.example.com"].share


def test_label_model_trusts_the_rules_that_agree():
    rng = random.Random(4)
    patterns = collections.Counter()
    for _ in range(2000):
        good = rng.random() < 0.8
        vote = lambda p: (1 if good == (rng.random() < p) else -1) if rng.random() < 0.9 else 0
        patterns[(vote(0.95), vote(0.9), vote(0.9), vote(0.6))] += 1
    model = quality.fit_label_model(patterns, 4)
    assert abs(model.prior - 0.8) < 0.06
    assert model.accuracies[0] > 0.9 and model.accuracies[3] < 0.7


def test_abstaining_tells_classes_apart():
    """One rule never votes bad; that it abstains for bad documents is what counts."""
    patterns = {(1, 1, 1): 900, (-1, -1, 0): 80, (0, 0, 0): 20}
    model = quality.fit_label_model(patterns, 3)
    assert model.log_odds((1, 1, 1)) > 0 > model.log_odds((-1, -1, 0)) and model.weight(2, 0) < 0 < model.weight(2, 1)


def test_quality_rejects_beyond_the_base_rules(spark):
    folder = "/root/testdata/sf0.01"
    kept = quality.op4_quality_rules(spark, folder).select("doc_id", "base_failed", "kept")
    labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = kept.join(labels, "doc_id").collect()
    bad = [r.kept for r in rows if r.quality == 0]
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    assert any(not r.kept and not r.base_failed for r in rows)
    assert sum(bad) <= 0.2 * len(bad) and sum(good) >= 0.98 * len(good)


def test_repeated_windows_count_each_word_once(spark):
    def model(text):
        words = text.split()
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        counts = collections.Counter(windows)
        return len({i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)})

    texts = ["a b c d e a b c d e", "a " * 12, PROSE, PROSE + " x " + PROSE, "a b c d e f a b c d e g b c d e f"]
    rows = quality.text_counts(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.n_repeat_words for r in rows] == [model(t) for t in texts]


def test_shards_hold_every_row_once(spark):
    texts = ["same"] * 500 + [str(i) for i in range(531)]
    rows = sharding.external_shuffle(docs(spark, texts, [1] * 1031), "n_chars", bucket_bytes=1).collect()
    assert collections.Counter(r.record.text for r in rows) == collections.Counter(texts)
    by_shard = collections.defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert {len(s) for s in by_shard.values()} <= {1031 // 8, 1031 // 8 + 1}


def test_shard_order_is_random(spark):
    sized = docs(spark, [str(i) for i in range(2000)]).withColumn("size", F.lit(100).cast("long"))
    rows = sharding.external_shuffle(sized, "size", bucket_bytes=50_000).collect()
    order = [r.record.doc_id for r in sorted(rows, key=lambda r: (r.slot, r.shard))]
    assert abs(np.corrcoef(order, range(2000))[0, 1]) < 0.1


def test_budgets_reach_siblings_before_ancestors(spark):
    leaves = [("web", "en", "a", 10), ("web", "en", "b", 1000), ("web", "de", "c", 1000), ("reference", "en", "d", 1000)]
    rows = mixing.leaf_budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), F.lit(1000), epochs=1).collect()
    got = {r.source: r.budget for r in rows}
    assert got == {"a": 10, "b": 390, "c": 200, "d": 400}


def test_mix_is_a_prefix_of_each_leaf(spark):
    rng = random.Random(5)
    rows = [(i, f"{i:032x}", "web", "en", f"s{i % 3}", rng.randrange(1, 50)) for i in range(900)]
    run = RunFolder(spark, "test")
    table = run.keep(spark.createDataFrame(rows, "doc long, key string, domain string, lang string, source string, tokens long"), "rows")
    chosen = mixing.mix(table, run, percent=50).collect()
    total = sum(r[5] for r in rows)
    assert total * 0.5 <= sum(r.tokens for r in chosen) <= total * 0.5 + 3 * 50
    assert len({(r.doc, r.epoch) for r in chosen}) == len(chosen)


def test_best_fit_packs_everything_tightly():
    rng = random.Random(6)
    costs = packing.bin_costs(packing.LENGTHS)
    pieces = [min(8192, int(rng.paretovariate(1.1) * 60)) for _ in range(3000)]
    bins, offsets, lengths = packing.best_fit(pieces, costs)
    used = collections.defaultdict(int)
    for b, o, n in sorted(zip(bins, offsets, pieces)):
        assert o == used[b]
        used[b] += n
    assert all(used[b] <= n for b, n in enumerate(lengths))
    assert all(n == min(x for x in costs if x >= used[b]) for b, n in enumerate(lengths))
    assert sum(pieces) / sum(lengths) > 0.95


def test_templates_with_variable_fields_recur(spark):
    clean = [f"{w} opens a text of its own about {w}" for w in ("salt", "tin", "rain", "oak", "iron", "moss")]
    texts = [f"Posted on {d} May by {n} in the news\n{c}\n{c} twice and then some\nmore words on {c} at the end" for d, n, c in zip(range(10, 16), ("Ann", "Bo", "Cy", "Di", "Ed", "Flo"), clean)]
    changed, dropped = line_dedup.drop_recurring_lines(docs(spark, texts))
    assert [r.text for r in changed.orderBy("doc_id").collect()] == [t.split("\n", 1)[1] for t in texts]
    assert {tuple(r.places) for r in dropped.collect()} == {(0,)}


def test_copies_of_whole_documents_keep_their_lines(spark):
    text = "\n".join(f"line {w} of a copied text with words" for w in "abcdefgh")
    changed, _ = line_dedup.drop_recurring_lines(docs(spark, [text] * 4))
    assert {r.text for r in changed.collect()} == {text}


def test_recurring_lines_go_whatever_share_they_are(spark):
    lines = ["this page is shared under the licence of the wiki", "back to the top of the whole index"]
    own = [f"{w} has a line of its own on {w} alone" for w in ("salt", "tin", "rain", "oak")]
    texts = ["\n".join([*lines, own[0]]), "\n".join([*lines, own[1]]), lines[0], "\n".join([lines[1], own[2]]), "\n".join([own[3], *lines])]
    changed, _ = line_dedup.drop_recurring_lines(docs(spark, texts))
    assert [r.text for r in changed.orderBy("doc_id").collect()] == [own[0], own[1], "", own[2], own[3]]


def test_near_copies_do_not_make_their_lines_recur(spark):
    rng = random.Random(11)
    lines = [[f"w{rng.randrange(3000)}x".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(30)] for _ in range(10)]
    texts = []
    for n in range(5):
        edited = [list(x) for x in lines]
        edited[n][20] = "edited"
        edited[9][10 + n] = "edited"
        texts.append("\n".join(" ".join(x) for x in edited))
    changed, dropped = line_dedup.drop_recurring_lines(docs(spark, texts))
    assert dropped.count() == 0 and [r.text for r in changed.orderBy("doc_id").collect()] == texts


def test_planted_passages_are_found(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(60)]
    fuzzy = [w if i % 9 else "odd" for i, w in enumerate(passage)]
    body = lambda: [word() for _ in range(100)]
    texts = [" ".join(body() + p + body()) for p in (passage, passage, fuzzy)] + [" ".join(body()) for _ in range(5)]
    rows = substrings.shared_passages(docs(spark, texts + [texts[3]])).collect()
    assert {x for r in rows for x in (r.doc_id, r.other_doc_id)} == {0, 1, 2, 3, 8}
    for r in rows:
        if r.doc_id != 8:
            assert 95 <= r.start_word <= 105 and 155 <= r.end_word <= 165


def test_neighbours_on_clusters(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16))
    points = np.concatenate([c + 0.1 * rng.normal(size=(60, 16)) for c in centres])
    points = points / np.linalg.norm(points, axis=1, keepdims=True)
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda v: v % 20 == 0).collect()
    got = collections.defaultdict(set)
    for r in found:
        got[r.query_id].add(r.vec_id)
    hits = sum(len(got[q] & {v for v in np.argsort(-(points @ points[q])).tolist() if v != q} & set(np.argsort(-(points @ points[q]))[:21].tolist())) for q in range(0, 1200, 20))
    assert hits / (60 * 20) >= 0.9


def test_toxicity_is_learnt_without_the_held_out_fold(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice("abcdefghij") * 3 + rng.choice("xyz") for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(40)] = words[rng.randrange(40)] = rng.choice(["grumble", "fiddlesticks"])
        rows.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
    table, known = docs(spark, rows), spark.createDataFrame(labels, LABELS)
    model = toxicity.fit(table, known)
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((model.score(rows[i]) >= 0.5) == bool(labels[i][2]) for i in held)
    flipped = spark.createDataFrame([(i, q, 1 - t if i in held else t) for i, q, t in labels], LABELS)
    assert toxicity.fit(table, flipped) == model
