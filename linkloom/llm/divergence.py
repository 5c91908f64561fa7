"""How far the sources of a language are from each other and from the language.

Shares of terms are smoothed integers, so that every figure is exact. Two parts
come out: the distance of every source from every other one of its language, and
the terms that a source uses most above its language.

The second part needs few terms of many. A term is dominated by another one that
the source uses at least as often, the language at most as often, and that comes
earlier in UTF-8: whatever the totals are, the other one ranks before it. Each
partition keeps its skyband, the terms with fewer than k dominators; skybands are
merged into the skyband of the whole, and only those terms are ranked exactly.

The first part is a sum over all terms for all pairs of sources, which no bound
shortens. Terms are dealt into buckets and sources into blocks; a task adds up
the distances of one pair of blocks over one bucket, a few thousand terms at a time.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.storage import RunFolder

#: A term is kept where this many documents of the language hold it.
LEAST_DOCS = 30
#: Ranks of the terms that are reported.
TOP = 50
SHARE, SMOOTHING = 1_000_000_000, 5
#: Counts that a task holds before it hands them on.
HELD_COUNTS = 400_000
#: Sources in a block, buckets of terms, and cells of a matrix of shares.
BLOCK_SOURCES, BUCKETS, CELLS = 256, 64, 1 << 20
CHUNK, HELD_TERMS = 256, 16_384

_LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms_of(text: str) -> list[bytes]:
    """Runs of ASCII letters and non-ASCII characters in order, A-Z lower-cased, as UTF-8."""
    return text.encode().translate(_LETTERS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of every term of a group, in parts to be summed.

    A group's row without a term says that the group occurs. Every row is a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, holders) in counts.items():
                terms = list(n)
                size = len(terms) + 1
                columns = [
                    pa.array([lang] * size, pa.string()),
                    pa.array([source] * size, pa.string()),
                    pa.array([None, *terms], pa.binary()).cast(pa.string()),
                    pa.array([0, *n.values()], pa.int64()),
                    pa.array([0, *(holders[t] for t in terms)], pa.int64()),
                ]
                yield from pa.table(columns, names=names).to_batches(max_chunksize=50_000)
            counts.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(*(batch[c] for c in ("lang", "source", "text"))):
                n, holders = counts.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                words, before = terms_of(text.as_py()), len(n)
                n.update(words)
                holders.update(set(words))
                held += len(n) - before
                if held > HELD_COUNTS:
                    yield from handed_on()
                    held = 0
        yield from handed_on()

    names = ["lang", "source", "term", "n", "docs"]
    filled = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = filled.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(10^9 (count + 5) / (total + 5 kept))``, in decimals that hold every product."""
    whole = F.lit(SHARE).cast("decimal(10,0)") * (count + SMOOTHING).cast("decimal(20,0)")
    parts = F.greatest(total + SMOOTHING * kept, F.lit(1)).cast("decimal(20,0)")
    return (F.floor((whole - F.pmod(whole, parts)) / parts) + 1).cast("long")


def skyband(group_count: np.ndarray, lang_count: np.ndarray, terms: list[bytes], k: int) -> np.ndarray:
    """Places of the terms that fewer than ``k`` others dominate, most used first.

    Terms are distinct. In this order all dominators of a term come before it, and
    a term that is left out has ``k`` dominators among those that stay, so only
    these have to be looked at.
    """
    alphabetical = np.empty(len(terms), np.int64)
    alphabetical[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))
    order = np.lexsort((alphabetical, lang_count, -group_count))
    stays = np.empty(0, np.int64)
    for at in range(0, len(order), CHUNK):
        some = order[at:at + CHUNK]
        rare, early = lang_count[some, None], alphabetical[some, None]
        n = ((lang_count[stays] <= rare) & (alphabetical[stays] < early)).sum(axis=1)
        n += np.tril((lang_count[some] <= rare) & (alphabetical[some] < early), -1).sum(axis=1)
        stays = np.concatenate([stays, some[n < k]])
    return stays


def skybands(rows: DataFrame, k: int) -> DataFrame:
    """Skybands of the groups of each partition of ``rows(lang, source, term, n, lang_n)``.

    Rows come sorted by group. A group's terms are held up to a number, then
    reduced to their skyband, to which further terms are added.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def reduced(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            terms = table["term"].cast(pa.binary()).to_pylist()
            n, lang_n = (table[c].to_numpy() for c in ("n", "lang_n"))
            return table.take(pa.array(skyband(n, lang_n, terms, k))).combine_chunks().to_batches()[0]

        held: list[pa.RecordBatch] = []
        rows_held, enough, group = 0, HELD_TERMS, None
        for batch in batches:
            if not batch.num_rows:
                continue
            lang, source = batch["lang"], batch["source"]
            new = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(source[1:], source[:-1]))
            starts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
            for at, end in zip(starts, starts[1:]):
                here = (lang[at].as_py(), source[at].as_py())
                if held and here != group:
                    yield reduced(held)
                    held, rows_held, enough = [], 0, HELD_TERMS
                group = here
                held.append(batch.slice(at, end - at))
                rows_held += end - at
                if rows_held >= enough:
                    held = [reduced(held)]
                    rows_held = held[0].num_rows
                    enough = max(HELD_TERMS, 2 * rows_held)
        if held:
            yield reduced(held)

    schema = "lang string, source string, term string, n long, lang_n long"
    sorted_rows = rows.select("lang", "source", "term", "n", "lang_n").sortWithinPartitions("lang", "source")
    return sorted_rows.mapInArrow(run, schema)


def distances(kept: DataFrame, groups: DataFrame, buckets: int = BUCKETS, block: int = BLOCK_SOURCES) -> DataFrame:
    """``(lang, a, b, value)``: summed differences of shares of the sources numbered ``a < b`` of a language.

    A source's terms go to each pair of blocks that its block is in, once per
    ``block`` sources of the language. Ahead of a bucket's terms come all
    sources of the two blocks, with the share of a term they lack.
    """
    numbered = groups.select(
        "lang", "source", "no", F.col("none").alias("p"), F.floor(F.col("no") / block).cast("int").alias("x"),
        F.floor((F.max("no").over(Window.partitionBy("lang"))) / block).cast("int").alias("last"), "kept",
    )

    def to_pairs(rows: DataFrame) -> DataFrame:
        y = rows.withColumn("y", F.explode(F.sequence(F.lit(0), "last")))
        return y.select("lang", "bucket", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "term", "no", "p")

    heads = numbered.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))).withColumn("term", F.lit(None).cast("string"))
    of_source = numbered.select("lang", "source", "no", "x", "last")
    terms = kept.select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"))
    rows = to_pairs(heads).union(to_pairs(terms.join(of_source, ["lang", "source"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        numbers = base = place = total = None
        seen = 0
        cells: list[pa.RecordBatch] = []

        def add_up(held: list[pa.RecordBatch]) -> None:
            nonlocal total, seen
            table = pa.Table.from_batches(held)
            term = table["term"].combine_chunks()
            new = pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
            line = np.concatenate([[0], np.cumsum(new)]).astype(np.int64)
            column = place[table["no"].to_numpy() - low]
            p = table["p"].to_numpy()
            step = max(1, CELLS // len(numbers))
            for at in range(0, int(line[-1]) + 1, step):
                a, b = np.searchsorted(line, (at, at + step))
                shares = np.tile(base, (int(line[b - 1]) - at + 1, 1))
                shares[line[a:b] - at, column[a:b]] = p[a:b]
                for c in range(len(numbers)):
                    total[c] += np.abs(shares - shares[:, c:c + 1]).sum(axis=0)
            seen += int(line[-1]) + 1

        def finished() -> pa.RecordBatch:
            lang, i, j = key[0], key[2], key[3]
            of = numbers // block
            first, second = np.nonzero((of[:, None] == i) & (of[None, :] == j) & (numbers[:, None] < numbers[None, :]))
            unseen = np.abs(base[first] - base[second])
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(first), pa.string()), pa.array(numbers[first]), pa.array(numbers[second]),
                 pa.array(total[first, second] - seen * unseen), pa.array(unseen)],
                names=["lang", "a", "b", "more", "none"],
            )

        def settle(last: bool) -> None:
            # The last term may run on in the next batch.
            nonlocal cells
            if not cells:
                return
            table = pa.Table.from_batches(cells).combine_chunks()
            end = table.num_rows
            if not last:
                term = table["term"].combine_chunks()
                end = pc.index(term, term[end - 1]).as_py()
            if end:
                add_up(table.slice(0, end).to_batches())
            cells = table.slice(end).to_batches()

        low = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [batch[c] for c in ("lang", "bucket", "i", "j")]
            new = np.zeros(batch.num_rows - 1, bool)
            for part in parts:
                new |= pc.not_equal(part[1:], part[:-1]).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for at, end in zip(starts, starts[1:]):
                here = tuple(part[at].as_py() for part in parts)
                if here != key:
                    if key is not None:
                        settle(True)
                        yield finished()
                    key, seen, cells = here, 0, []
                    numbers, base, total = np.empty(0, np.int64), np.empty(0, np.int64), None
                rows_here = batch.slice(at, end - at)
                heads_here = rows_here["term"].null_count
                if heads_here:
                    numbers = np.concatenate([numbers, rows_here["no"][:heads_here].to_numpy()])
                    base = np.concatenate([base, rows_here["p"][:heads_here].to_numpy()])
                    rows_here = rows_here.slice(heads_here)
                    total = np.zeros((len(numbers), len(numbers)), np.int64)
                    low = int(numbers.min())
                    place = np.zeros(int(numbers.max()) - low + 1, np.int64)
                    place[numbers - low] = np.arange(len(numbers))
                if rows_here.num_rows:
                    cells.append(rows_here)
            settle(False)
        if key is not None:
            settle(True)
            yield finished()

    keys = ("lang", "bucket", "i", "j")
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, F.col("term").asc_nulls_first(), "no")
    sums = dealt.mapInArrow(run, "lang string, a long, b long, more long, none long").groupBy("lang", "a", "b").agg(
        F.sum("more").alias("more"), F.max("none").alias("none")
    )
    kept_terms = groups.select("lang", "kept").distinct()
    return sums.join(kept_terms, "lang").select("lang", "a", "b", (F.col("more") + F.col("kept") * F.col("none")).alias("value"))


def divergence_audit(
    docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, buckets: int = BUCKETS, block: int = BLOCK_SOURCES
) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of ``docs(lang, source, text)``.

    Part ``pair`` ranks the other sources of the language by distance, part ``term``
    the ``top`` terms whose share of the source is most above that of the language.

    Null text, language and source count as empty. Every row is a document, also
    where rows or IDs repeat. Empty texts have no terms, but their group
    occurs. A language without kept terms has distances of zero and no terms; an
    empty table has no rows. Ties go to the item that is earlier in UTF-8.
    """
    run = RunFolder(docs.sparkSession, "divergence")
    counts = run.keep(term_counts(docs), "counts")
    of_term = Window.partitionBy("lang", "term")
    kept = run.keep(
        counts.filter("term IS NOT NULL")
        .select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("lang_n"), F.sum("docs").over(of_term).alias("docs"))
        .filter(F.col("docs") >= least_docs).drop("docs"),
        "kept",
    )
    of_lang = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("n")).groupBy("lang").agg(
        F.count("*").alias("kept"), F.sum("n").alias("lang_total")
    )
    occurring = counts.filter("term IS NULL").select("lang", "source")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = run.keep(
        occurring.join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left").select(
            "lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "kept", "lang_total")),
            (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("no"),
        ).withColumn("none", F.when(F.col("kept") == 0, 0).otherwise(share(F.lit(0), F.col("total"), F.col("kept")))),
        "groups",
    )
    shares = run.keep(
        kept.join(groups, ["lang", "source"]).select(
            "lang", "source", "term", "n", "lang_n",
            share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
            share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"),
        ),
        "shares",
    )

    apart = run.keep(distances(shares, groups, buckets, block), "distances")
    both = apart.select("lang", F.col("a").alias("no"), F.col("b").alias("other"), "value").union(
        apart.select("lang", F.col("b").alias("no"), F.col("a").alias("other"), "value")
    )
    names = groups.select("lang", "no", "source")
    pairs = both.join(names, ["lang", "no"]).join(
        names.select("lang", F.col("no").alias("other"), F.col("source").alias("item")), ["lang", "other"]
    ).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    above = shares.filter("p > q")
    local = run.keep(skybands(above, top), "skybands")
    merged = skybands(local.repartition("lang", "source"), top)
    terms = merged.join(groups.select("lang", "source", "total", "kept", "lang_total"), ["lang", "source"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        (share(F.col("n"), F.col("total"), F.col("kept")) - share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))).alias("value"),
    )

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    return pairs.withColumn("rank", rank).union(terms.withColumn("rank", rank).filter(F.col("rank") <= top))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    """Distances between sources, and the terms that set each source apart."""
    return divergence_audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


DIVERGENCE_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 30
), langs AS (
  SELECT lang, count(*) AS v, sum(lang_n)::HUGEINT AS lang_total FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source
  GROUP BY g.lang, g.source
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.lang_n + 5)) // (l.lang_total + 5 * l.v) AS q
  FROM groups g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), distances AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM dense WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM parts
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
