"""Line dedup with a log-template tree.

The tree has a fixed depth: the number of tokens of a line, then its leading
tokens. Tokens with digits are variable fields from the start. Within a leaf, a
place whose token varies from line to line becomes a variable field. A line may fit
two kinds of templates: the leaf's common one, of the tokens that most documents agree on, and one
of all its tokens that recur in their places, of which a leaf has as many as it
takes. Lines of a template that recurs across documents are dropped, whatever
share of a document they are. Equal and near-equal texts count as one document, so
that copies do not make their own lines recur.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import BLANKS, text_key
from linkloom.llm.near_texts import near_classes
from linkloom.operators.storage import RunFolder

FIELD = "<*>"
#: Leading tokens on the path to a leaf.
DEPTH = 4
#: Lines of fewer tokens have no template. In prose they recur by chance, so they are
#: dropped where the very same line is in ``SHORT_DOCS`` documents or more.
LEAST_TOKENS, SHORT_DOCS = 5, 5
#: Documents in which a template has to occur; near-equal texts are one.
LEAST_DOCS = 3
#: Share of a leaf's lines that must agree on a place's token, and of a line's
#: places that must be fixed in the template and agree with it, in hundredths.
AGREE, FIXED = 60, 60

# A word with a digit in it. It starts after a blank, so long runs are passed once.
_VARIABLE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
_BLANK_RUN = r"[\x20\x09-\x0D]+"


def masked(line: Column) -> Column:
    """The line with variable words as fields, blanks single and none at its ends.

    Most lines need neither pattern; the tests for that are much cheaper.
    """
    fields = F.when(line.rlike("[0-9]"), F.regexp_replace(line, _VARIABLE, FIELD)).otherwise(line)
    odd = F.lit(False)
    for blanks in ("  ", "\t", "\x0b", "\f", "\r"):
        odd = odd | F.contains(line, F.lit(blanks))
    return F.btrim(F.when(odd, F.regexp_replace(fields, _BLANK_RUN, " ")).otherwise(fields))


def _split_once(text: Column, use) -> Column:
    """``use`` of the lines of a text, which is split once and not at each use.

    Spark writes out an expression wherever it is used, inside lambdas too; the
    argument of a lambda is made once.
    """
    return F.get(F.transform(F.array(F.split(text, "\n", -1)), use), F.lit(0))


def n_tokens(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def leaf_of(line: Column, depth: int = DEPTH) -> Column:
    """Key of the leaf that a masked line falls to."""
    return F.xxhash64(n_tokens(line), F.substring_index(line, " ", depth))


def line_keys(docs: DataFrame, text: str, doc: str, depth: int, least_tokens: int) -> DataFrame:
    """``(doc, key, place, line, leaf, n)``: hashes of lines, where they are, their tokens.

    Places count from 0 and follow ``split``. Lines of fewer than ``least_tokens`` go
    by all their tokens, variable ones too; blank lines are left out.
    """
    body = F.col(f"`{text}`")
    lines = docs.select(F.col(f"`{doc}`").alias("doc"), text_key(body).alias("key"), F.posexplode(F.split(body, "\n", -1)).alias("place", "raw"))
    bare = F.btrim("raw", F.lit(BLANKS))
    # A filter by the masked line, which is blank where the raw one is, would mask every line twice.
    shown = lines.filter(bare != "").select("doc", "key", "place", "raw", masked(F.col("raw")).alias("line"))
    n = n_tokens(F.col("line"))
    whole = F.regexp_replace(bare, _BLANK_RUN, " ")
    line = F.when(n < least_tokens, F.xxhash64(F.lit("short"), whole)).otherwise(F.xxhash64("line"))
    return shown.select("doc", "key", "place", line.alias("line"), leaf_of(F.col("line"), depth).alias("leaf"), n.alias("n"))


def _open_texts(docs: DataFrame, text: str, doc: str, once: DataFrame, varied: DataFrame) -> DataFrame:
    """``(key, text, wanted)``: every text of ``once(line, leaf, key, doc, place)``, with its lines to read.

    ``wanted`` holds ``(place, line)`` of the lines of the leaves ``varied`` that are read
    in this text, null for none; each line is read in one text. Texts are joined with their
    keys by shuffling both, since those keys are too many to be sent to all tasks, and move only
    here: whatever is wanted of them later comes from these rows. Repeated rows come out repeated.
    """
    places = once.join(varied, "leaf", "left_semi").groupBy("line").agg(F.min(F.struct("key", "place")).alias("first"))
    lines = places.groupBy("first.key").agg(F.collect_list(F.struct("first.place", "line")).alias("wanted"))
    wanted = once.groupBy("key").agg(F.min("doc").alias("_doc")).join(lines, "key", "left")
    wanted = wanted.select("_doc", F.col("key").alias("_key"), "wanted").hint("shuffle_hash")
    body = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{doc}`").alias("doc"), text_key(body).alias("key"), body.alias("text"))
    return rows.join(wanted, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key"))).select("key", "text", "wanted")


def _line_tokens(open_texts: DataFrame, open_lines: DataFrame) -> DataFrame:
    """``open_lines(line, leaf, n_docs)`` with their tokens, from ``open_texts(text, wanted)``."""
    def at_places(lines: Column) -> Column:
        return F.transform("wanted", lambda w: F.struct(w["line"].alias("line"), F.get(lines, w["place"]).alias("raw")))

    each = open_texts.filter(F.col("wanted").isNotNull()).select(F.explode(_split_once(F.col("text"), at_places)).alias("x"))
    one = each.groupBy("x.line").agg(F.first("x.raw").alias("raw"))  # repeated rows give a line more than once
    return one.join(open_lines, "line").select("line", "leaf", "n_docs", F.split(masked(F.col("raw")), " ").alias("tokens"))


def recurring_lines(docs: DataFrame, text: str, doc: str, keyed: DataFrame, run: RunFolder, least_docs: int = LEAST_DOCS, least_tokens: int = LEAST_TOKENS, short_docs: int = SHORT_DOCS) -> DataFrame:
    """``(line)``: 64-bit keys of the masked lines whose template recurs.

    ``keyed`` holds ``line_keys(docs)`` of the lines that may be dropped. A class of
    near-equal texts counts once for a template it repeats. Counting combines before
    each shuffle, so a line of all documents costs no more than a rare one.
    """
    short = F.col("n") < least_tokens
    # Documents of one key hold one text, so any of them and any of the line's places will do to read it.
    by_text = run.keep(keyed.groupBy("line", "leaf", "n", "key").agg(F.min("doc").alias("doc"), F.min("place").alias("place")), "by_text")
    # Only lines of a leaf that enough texts reach can recur, and only their texts have to be told apart.
    lines = by_text.groupBy("line", "leaf", "n").agg(F.count("*").alias("n_texts"))
    lines = run.keep(lines, "lines")
    leaves = lines.filter(~short).groupBy("leaf").agg(F.sum("n_texts").alias("n"), F.count("*").alias("n_lines")).filter(F.col("n") >= least_docs)
    leaves = run.keep(leaves, "leaves")
    long_enough = lines.filter(~short).join(leaves.select("leaf"), "leaf", "left_semi").select("line")
    open_keys = run.keep(long_enough.union(lines.filter(short & (F.col("n_texts") >= short_docs)).select("line")), "open_lines")
    once = run.keep(by_text.join(open_keys, "line", "left_semi"), "once")
    varied = leaves.filter("n_lines > 1").select("leaf")
    open_texts = run.keep(_open_texts(docs, text, doc, once, varied), "open_texts")
    near = near_classes(open_texts.select("key", "text"), run)
    held = run.keep(once.join(near, "key", "left").select("line", "leaf", "n", F.coalesce("root", "key").alias("class")).distinct(), "held")
    counted = run.keep(held.groupBy("line", "leaf", "n").agg(F.count("*").alias("n_docs")), "counted")
    same = counted.filter(F.col("n_docs") >= F.when(short, short_docs).otherwise(least_docs)).select("line")
    # All lines of a leaf make its templates, by their documents, recurring ones too.
    long_lines = counted.filter(~short)
    leaves = long_lines.groupBy("leaf").agg(F.sum("n_docs").alias("n_docs"), F.count("*").alias("n")).filter((F.col("n_docs") >= least_docs) & (F.col("n") > 1))
    open_lines = run.keep(long_lines.join(leaves.select("leaf"), "leaf", "left_semi").select("line", "leaf", "n_docs"), "open")
    texts = run.keep(_line_tokens(open_texts, open_lines), "line_tokens")
    places = texts.select("line", "leaf", "n_docs", F.posexplode("tokens").alias("place", "token"))
    tokens = run.keep(places.groupBy("leaf", "place", "token").agg(F.sum("n_docs").alias("n")), "tokens")
    templates = run.keep(_common_template(texts, tokens).union(_recurring_templates(texts, places, tokens, least_docs)), "templates")
    # Variants of a line in one class are one document for their template.
    found = held.join(templates, ["line", "leaf"]).groupBy("template", "class").agg(F.lit(1).alias("n"))
    kept = found.groupBy("template").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= least_docs)
    return same.union(templates.join(kept, "template", "left_semi").select("line")).distinct()


def _common_template(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(line, leaf, template)`` of the lines that fit their leaf's one template of the tokens most documents agree on."""
    most = tokens.groupBy("leaf", "place").agg(F.sum("n").alias("all"), F.max(F.struct("n", "token")).alias("most"))
    fixed = F.when(F.col("most.n") * 100 >= F.col("all") * AGREE, F.col("most.token"))
    # Every place has an entry, so the sorted entries are the template; fields are null.
    entries = F.sort_array(F.collect_list(F.struct("place", fixed.alias("token"))))
    common = most.groupBy("leaf").agg(entries.alias("common"))
    agree = F.size(F.filter(F.zip_with("tokens", F.col("common.token"), lambda a, b: a == b), lambda x: x))
    alike = texts.join(common, "leaf").filter(agree * 100 >= F.size("tokens") * FIXED)
    return alike.select("line", "leaf", F.xxhash64(F.lit("common"), "leaf").alias("template"))


def _recurring_templates(texts: DataFrame, places: DataFrame, tokens: DataFrame, least_docs: int) -> DataFrame:
    """``(line, leaf, template)`` by the tokens that recur in their place of the leaf; the others are fields.

    A leaf has as many templates as its recurring tokens make. Those of a line that are
    fewer than ``FIXED`` of its places are none.
    """
    recurring = tokens.filter(F.col("n") >= least_docs).select("leaf", "place", "token")
    # A place and its token as one number, added up: the order of rows does not matter.
    held = places.join(recurring, ["leaf", "place", "token"]).groupBy("line", "leaf").agg(
        F.count("*").alias("fixed"), F.bit_xor(F.xxhash64("place", "token")).alias("tokens_key")
    )
    sized = texts.select("line", F.size("tokens").alias("n"))
    alike = held.join(sized, "line").filter(F.col("fixed") * 100 >= F.col("n") * FIXED)
    return alike.select("line", "leaf", F.xxhash64(F.lit("recurring"), "leaf", "fixed", "tokens_key").alias("template"))


def drop_recurring_lines(docs: DataFrame, text: str = "text", doc: str = "doc_id", depth: int = DEPTH,
                         least_tokens: int = LEAST_TOKENS, least_docs: int = LEAST_DOCS, short_docs: int = SHORT_DOCS) -> tuple[DataFrame, DataFrame]:
    """``(changed, dropped)``.

    ``dropped`` is ``(doc, key, places)``: for each text that loses lines, by ID
    and content key, the places of those lines, from 0. ``changed`` is ``docs``
    with those lines cut out of ``text``; other rows are as they were, null and
    empty texts among them. Rows that agree in ID and text lose the same lines,
    and an empty table gives empty results.
    """
    run = RunFolder(docs.sparkSession, "line_dedup")
    body = F.col(f"`{text}`")
    keyed = run.keep(line_keys(docs, text, doc, depth, least_tokens), "keyed")
    recurring = run.keep(recurring_lines(docs, text, doc, keyed, run, least_docs, least_tokens, short_docs), "recurring")
    hit = keyed.join(recurring, "line").groupBy("doc", "key").agg(F.sort_array(F.collect_set("place")).alias("places"))
    dropped = run.keep(hit, "dropped")
    names = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(f"`{doc}`").alias("doc"), text_key(body).alias("key"))
    lost = dropped.select(F.col("doc").alias("_doc"), F.col("key").alias("_key"), "places").hint("shuffle_hash")
    joined = rows.join(lost, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left")
    def without_places(lines: Column) -> Column:
        keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "places")
        return F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n")

    rest = _split_once(F.col("row").getField(text), without_places)
    new = F.when(F.col("places").isNull(), F.col("row").getField(text)).otherwise(rest)
    changed = joined.select(*((new if c == text else F.col("row").getField(c)).alias(c) for c in names))
    return changed, dropped


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its text after line dedup, as length and CRC, and the lines it lost."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    changed, _ = drop_recurring_lines(docs)
    kept = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    return changed.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.crc32("text").cast("long").alias("text_crc32"), kept.cast("long").alias("n_lines"))
