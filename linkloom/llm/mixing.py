"""Mixing sources to target weights by hierarchical budgets.

The budget of tokens runs down a tree (domain, language, source). Each family of
siblings shares its parent's budget by weight; a child that cannot spend its
share, even by repeating its documents for the permitted number of epochs, passes
the rest on to its siblings, and only what a whole family cannot spend reaches
the families above. A leaf then takes a prefix of its documents, epoch after
epoch, each in a seeded order of its own.
"""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import word_list
from linkloom.operators.storage import RunFolder

SEED, EPOCHS = "mix-1", 4
#: Parts of the seeded order of a leaf that are counted before rows are: hex digits.
PART_DIGITS = 3
LEVELS = ("domain", "lang", "source")
#: Whole-number weights by level and name; other names weigh ``OTHER``.
WEIGHTS: dict[str, dict[str, int]] = {
    "domain": {"web": 60, "reference": 40},
    "lang": {"en": 40, "de": 20, "fr": 20, "es": 20},
    "source": {},
}
OTHER = 10
#: The budget as a share of all tokens, in hundredths.
BUDGET_PERCENT = 80


def domain_of(source: Column) -> Column:
    """Sources with an even number are web crawls, others reference works."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)$", 1)
    odd = F.substr(number, F.length(number)).isin("1", "3", "5", "7", "9")
    return F.when(odd, "reference").otherwise("web")


def weight_of(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    found = F.lit(OTHER).cast("long")
    for name, weight in weights.get(level, {}).items():
        found = F.when(F.col(level) == name, F.lit(weight).cast("long")).otherwise(found)
    return found


def share_out(families: DataFrame, parents: list[str], child: str, weights) -> DataFrame:
    """``budget`` of each child of ``families(parents.., child, capacity, above)``.

    ``above`` is the parent's budget. Children are filled in order of capacity per
    weight: those before the first that can take its share of what is left spend
    their capacity, the others share the rest by weight.
    """
    w = weight_of(child, weights)
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    by_need = family.orderBy("need", child)
    rated = families.withColumn("w", w).withColumn("need", F.col("capacity") / F.col("w"))
    rest = F.col("above") - F.coalesce(F.sum("capacity").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("w").over(by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = rated.withColumn("level", rest / open_weight)
    # The first child that is not filled up sets the level for all after it.
    first = F.min(F.when(F.col("level") <= F.col("need"), F.struct("need", child, "level"))).over(family)
    reached = F.coalesce(first["level"] * F.col("w"), F.col("capacity").cast("double"))
    return level.withColumn("budget", F.least(F.col("capacity").cast("double"), reached)).drop("w", "need", "level", "above")


def leaf_budgets(leaves: DataFrame, budget: Column, levels=LEVELS, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``budget`` in whole tokens for each of ``leaves(levels.., tokens)``.

    One row per leaf enters; windows run within families of siblings.
    """
    tree = leaves.withColumn("capacity", F.col("tokens") * epochs)
    budgets = tree.agg(F.least(F.sum("capacity"), budget).alias("above"))
    for depth, child in enumerate(levels):
        parents = list(levels[:depth])
        nodes = tree.groupBy(*levels[: depth + 1]).agg(F.sum("capacity").alias("capacity"))
        if parents:
            nodes = nodes.join(budgets.withColumnRenamed("budget", "above"), parents)
        else:
            above = budgets.first()[0] or 0
            nodes = nodes.withColumn("above", F.lit(above).cast("double"))
        budgets = share_out(nodes, parents, child, weights).select(*levels[: depth + 1], "budget")
    return budgets.withColumn("budget", F.floor("budget").cast("long"))


def mix(rows: DataFrame, run: RunFolder, levels=LEVELS, weights=WEIGHTS, percent: int = BUDGET_PERCENT,
        epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """``(doc, key, levels.., tokens, epoch)`` for every chosen copy of ``rows(doc, key, levels.., tokens)``.

    A leaf's rows in seeded order are taken while the tokens before them stay
    below its budget, so the last row may run over it; an epoch starts when all
    rows before it were taken. Rows without tokens are never chosen. ``rows``
    should be a stored table. Null levels are leaves of their own, written
    ``(none)``, and repeated rows are rows of their own.

    The order is by a hash, so a leaf is cut into parts of about equal size by
    its first digits. Tokens are summed per part; whole parts are decided at
    once and only the rows of the part in which a budget ends are lined up, so a
    leaf with a third of all rows is never sorted by one task.
    """
    named = rows.filter("tokens > 0").withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("(none)")) for c in levels})
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("epoch").cast("string"), F.coalesce(F.col("doc").cast("string"), F.lit("")), "key"))
    keys = list(levels)
    leaves = run.keep(named.groupBy(*keys).agg(F.sum("tokens").alias("tokens")), "leaves")
    budget = F.floor(F.sum("tokens") * percent / 100)
    planned = leaf_budgets(leaves, budget, levels, weights, epochs).join(leaves, keys)
    # Which epochs are taken whole, and what is left for the last one.
    planned = run.keep(
        planned.select(*keys, F.floor(F.col("budget") / F.col("tokens")).alias("whole"), F.pmod("budget", "tokens").alias("left")),
        "budgets",
    )
    copies = named.join(planned, keys)
    every = F.sequence(F.lit(1).cast("long"), F.col("whole"))
    whole = copies.filter("whole >= 1").withColumn("epoch", F.explode(every))
    last = copies.filter("left > 0").withColumn("epoch", F.col("whole") + 1).withColumn("order", order)
    last = last.withColumn("part", F.substring("order", 1, PART_DIGITS))
    parts = last.groupBy(*keys, "part").agg(F.sum("tokens").alias("part_tokens"))
    so_far = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = run.keep(parts.withColumn("before", F.coalesce(F.sum("part_tokens").over(so_far), F.lit(0))), "parts")
    lined = last.join(parts, [*keys, "part"]).filter("before < left")
    inside = F.col("before") + F.col("part_tokens") <= F.col("left")
    row_order = Window.partitionBy(*keys, "part").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    edge = lined.filter(~inside).withColumn("done", F.coalesce(F.sum("tokens").over(row_order), F.lit(0)))
    columns = ["doc", "key", *keys, "tokens", "epoch"]
    return (
        whole.select(*columns)
        .union(lined.filter(inside).select(*columns))
        .union(edge.filter("before + done < left").select(*columns))
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """``(doc, key, domain, lang, source, tokens)``; tokens are words, the key is the text's."""
    return docs.select(*(c.alias(name) for name, c in _row().items()))


def _row() -> dict[str, Column]:
    return {
        "doc": F.col("doc_id"),
        "key": F.md5(F.coalesce(F.col("text"), F.lit(""))),
        "domain": domain_of(F.col("source")),
        "lang": F.coalesce("lang", F.lit("(none)")),
        "source": F.coalesce("source", F.lit("(none)")),
        "tokens": F.size(word_list(F.col("text"))).cast("long"),
    }


def mix_documents(docs: DataFrame) -> DataFrame:
    """The chosen documents with the columns of ``docs``, each as often as it was chosen.

    Rows that agree in ID, text, language and source stand for each other: as many
    copies as were chosen among them come out, all of one of them.
    """
    run = RunFolder(docs.sparkSession, "mixing")
    rows = run.keep(document_rows(docs), "rows")
    same = ["key", "domain", "lang", "source"]
    chosen = mix(rows, run).groupBy("doc", *same).agg(F.count("*").alias("times"))
    chosen = run.keep(chosen.withColumnRenamed("doc", "_doc"), "chosen")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                        *(c.alias(name) for name, c in _row().items() if name != "tokens"))
    together = [F.col("doc").eqNullSafe(F.col("_doc")), *(whole[c] == chosen[c] for c in same)]
    found = whole.join(chosen, together).select("row", "doc", whole["key"], whole["lang"], whole["source"], "times")
    one = found.dropDuplicates(["doc", "key", "lang", "source"])
    copies = one.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"))
    return copies.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op3_source_mixing(spark, sf_dir: str) -> DataFrame:
    """Every chosen copy of a document, its leaf, tokens and epoch."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    run = RunFolder(spark, "mixing")
    chosen = mix(run.keep(document_rows(docs), "rows"), run)
    return chosen.select(F.col("doc").alias("doc_id"), *LEVELS, "tokens", "epoch")


def _sql() -> str:
    def case(level: str) -> str:
        whens = "".join(f" WHEN {level} = '{n}' THEN {w}" for n, w in WEIGHTS[level].items())
        return f"CASE{whens} ELSE {OTHER} END" if whens else str(OTHER)

    def family(depth: int, above: str) -> str:
        child, parents = LEVELS[depth], list(LEVELS[:depth])
        names = ", ".join(LEVELS[: depth + 1])
        part = f"PARTITION BY {', '.join(parents)}" if parents else ""
        join = f"JOIN b{depth - 1} USING ({', '.join(parents)})" if parents else ""
        return f"""
n{depth} AS (SELECT {names}, sum(tokens) * {EPOCHS} AS capacity, {case(child)} AS w FROM leaves GROUP BY {names}),
r{depth} AS (SELECT {names}, capacity, w, CAST(capacity AS DOUBLE) / w AS need, CAST({above} AS DOUBLE) AS above FROM n{depth} {join}),
l{depth} AS (SELECT *, (above - coalesce(sum(capacity) OVER ({part} ORDER BY need, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER ({part} ORDER BY need, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM r{depth}),
f{depth} AS (SELECT *, arg_min(lvl, need) FILTER (lvl <= need) OVER ({part}) AS cut FROM l{depth}),
b{depth} AS (SELECT {names}, least(CAST(capacity AS DOUBLE), coalesce(cut * w, CAST(capacity AS DOUBLE))) AS budget{depth} FROM f{depth}),"""

    keys = ", ".join(LEVELS)
    total = f"(SELECT least(sum(tokens) * {EPOCHS}, floor(sum(tokens) * {BUDGET_PERCENT} / 100)) FROM leaves)"
    return rf"""
WITH named AS (SELECT doc_id, md5(coalesce(text, '')) AS key,
 CASE WHEN right(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), 1) IN ('1', '3', '5', '7', '9') THEN 'reference' ELSE 'web' END AS domain,
 coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
 len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	
]+'), lambda x: x <> '')) AS tokens FROM documents),
leaves AS (SELECT {keys}, sum(tokens) AS tokens FROM named WHERE tokens > 0 GROUP BY {keys}),
{family(0, total)}{family(1, 'budget0')}{family(2, 'budget1')}
planned AS (SELECT {keys}, CAST(floor(floor(budget2) / tokens) AS BIGINT) AS whole,
  CAST(floor(budget2) AS BIGINT) % CAST(tokens AS BIGINT) AS lft FROM b2 JOIN leaves USING ({keys})),
copies AS (SELECT * FROM named JOIN planned USING ({keys}) WHERE tokens > 0),
whole AS (SELECT *, unnest(range(1, whole + 1)) AS epoch FROM copies),
lined AS (SELECT *, whole + 1 AS epoch, coalesce(sum(tokens) OVER (PARTITION BY {keys} ORDER BY
  md5('{SEED}|' || CAST(whole + 1 AS VARCHAR) || '|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || key)
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM copies WHERE lft > 0)
SELECT doc_id, {keys}, CAST(tokens AS BIGINT) AS tokens, CAST(epoch AS BIGINT) AS epoch FROM whole
UNION ALL SELECT doc_id, {keys}, CAST(tokens AS BIGINT), CAST(epoch AS BIGINT) FROM lined WHERE done < lft
"""


MIXING_SQL = _sql()
