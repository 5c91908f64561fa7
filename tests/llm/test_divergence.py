"""The divergence audit against a model that follows its definition word by word."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from linkloom.llm.divergence import divergence_audit, skyband, terms_of

SCHEMA = "doc_id long, text string, lang string, source string, `rank` int, `value` string"


def audit(rows, least_docs, top):
    docs = [(text or "", lang or "", source or "") for _, text, lang, source, *_ in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, holders = defaultdict(Counter), defaultdict(Counter)
    groups = {(lang, source) for _, lang, source in docs}
    for text, lang, source in docs:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower))
        count[lang, source].update(words)
        holders[lang].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in holders[lang].items() if n >= least_docs]
        of_lang = Counter()
        for g in groups:
            if g[0] == lang:
                of_lang.update(count[g])

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = shares(of_lang)
        p = {s: shares(count[lang, s]) for x, s in groups if x == lang}
        for s in p:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if count[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked[:most])}
    return out


def rows_of(df):
    rows = df.collect()
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert len(set(rows)) == len(rows)
    return {tuple(r) for r in rows}


def test_terms():
    assert terms_of("Ab1cD\x00é É_x\x85 z\x7f`[") == [b"ab", b"cd", "é".encode(), "É".encode(), "x\x85".encode(), b"z"]


def test_skyband_keeps_exactly_what_few_dominate():
    draw = np.random.default_rng(3)
    for size, top in ((1, 1), (700, 3), (900, 50)):
        n, lang_n = draw.integers(1, 12, size), draw.integers(1, 30, size)
        terms = [f"{x:x}".encode() for x in draw.permutation(5 * size)[:size]]
        expected = {
            i for i in range(size)
            if sum(n[j] >= n[i] and lang_n[j] <= lang_n[i] and terms[j] < terms[i] for j in range(size)) < top
        }
        stays = skyband(n, lang_n, terms, top).tolist()
        assert set(stays) == expected and len(stays) == len(expected)


def test_against_the_definition(spark):
    draw = random.Random(5)
    words = ["Aa", "b", "é", "É", "ñandú", "zz", "Zz", "c", "d", "e1f", "漢字", "x\x80y"]
    rows = []
    for i in range(160):
        source = draw.choice(["s0", "s0", "s0", "s1", "S1", "é", "", None, "s9"])
        text = " ".join(draw.choices(words, weights=range(1, 13), k=draw.randint(0, 30)))
        rows.append((i % 150, draw.choice([text, text, text, "", None, "12 34"]), draw.choice(["en", "fr", None, ""]), source, 1, "v"))
    rows += rows[:9]
    rows.append((900, "long " * 30_000, "en", "s1", 1, "v"))
    rows.append((901, "alone", "xx", "only", 1, "v"))
    rows += [(902, "q", "yy", "a", 1, "v"), (903, None, "yy", "b", 1, "v")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    expected = audit(rows, 4, 3)
    assert rows_of(divergence_audit(docs, least_docs=4, top=3)) == expected
    assert rows_of(divergence_audit(docs, least_docs=4, top=3, buckets=2, block=2)) == expected
    assert {r for r in expected if r[0] == "xx"} == set()
    assert {r[2:] for r in expected if r[0] == "yy"} == {("pair", "a", 0, 1), ("pair", "b", 0, 1)}


def test_no_documents(spark):
    assert rows_of(divergence_audit(spark.createDataFrame([], SCHEMA))) == set()
