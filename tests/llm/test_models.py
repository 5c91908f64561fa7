"""Operators against their definitions, written out plainly."""

import random
import re

import duckdb
import xxhash
from compare import difference
from pyspark.sql import functions as F

from linkloom.llm import simhash

SCHEMA = "doc_id long, text string"


def fingerprint(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    draw = random.Random(1)
    words = ["Ab", "ab", "É", "é", "x\u00a0y", "漢", "z.", "Q"]
    texts = [None, "", " \t", "A", "a b", "One two THREE", "x \x1f y\x85z"]
    texts += [draw.choice([" ", "\n", "  "]).join(draw.choices(words, k=draw.randint(1, 60))) for _ in range(80)]
    rows = simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), SCHEMA), "text", {"doc_id": F.col("doc_id")}).collect()
    assert {r.doc_id: r["print"] % 2**64 for r in rows} == {i: fingerprint(t) for i, t in enumerate(texts)}


def test_components_of_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    prints = {d: fingerprint(t) for d, t in docs}
    parent = {d: d for d in prints}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.op1_simhash_near_dup(spark, folder).collect()}
    assert got == {(d, f"{p:016x}", top(d)) for d, p in prints.items()}


def test_host_reputation_decides_where_no_rule_fits(spark, tmp_path):
    urls = [f"http://bad.com/de/{i}" for i in range(60)] + [f"http://bad.com/zz/{i}" for i in range(5)]
    urls += [f"http://www.good.com/fr/{i}" for i in range(60)] + [f"http://www.good.com/zz/{i}" for i in range(5)]
    urls += ["http://new.net/", "http://bad.com", None, "nonsense", "http://BAD.com?de/"]
    rows = [(i, u, "") for i, u in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert difference(spark, connection, "op2_url_filter", str(tmp_path)) is None
    from linkloom.llm.url_filter import op2_url_filter

    verdict = {urls[r.page_id]: r.verdict for r in op2_url_filter(spark, str(tmp_path)).collect() if r.rule is None}
    assert verdict["http://bad.com/zz/1"] == verdict["http://bad.com"] == "block"
    assert verdict["http://www.good.com/zz/1"] == "allow"
