"""Line deduplication by a log-template tree (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import saved

#: Lines of fewer tokens recur by chance: they must stand in so many documents that their copies make SHORT_CHARS characters.
MIN_TOKENS, SHORT_CHARS = 5, 80
#: Lines of so many characters are copies wherever they are repeated letter by letter: all but the first go.
LONG_CHARS = 80
#: Leading tokens that lead to a leaf, after the number of tokens.
LEAD = 4
#: Documents that a template must stand in to be dropped.
MIN_DOCS = 4
#: Share of a group's lines that must agree on a token for it to be fixed, and share of the tokens behind the leading ones that a line must have in common with the template.
FIXED, ALIKE = 0.6, 0.6
VARIABLE = "<*>"

_FIELD = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"


def masked_lines(text: Column) -> Column:
    """A text's lines with variable fields (tokens with a digit) replaced, in order."""
    text = F.coalesce(text, F.lit(""))
    # most texts have no digit, and looking for one is much cheaper than replacing
    return F.split(F.when(text.rlike("[0-9]"), F.regexp_replace(text, _FIELD, VARIABLE)).otherwise(text), "\n", -1)


def masked_line(line: Column, digits: Column) -> Column:
    """One line as masked_lines has it; digits: whether its text has any."""
    return F.when(digits & line.rlike("[0-9]"), F.regexp_replace(line, _FIELD, VARIABLE)).otherwise(line)


def n_tokens(line: Column) -> Column:
    # bytes, whose number is known, and not characters, which would be counted
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def leaf_of(line: Column) -> Column:
    """The tree's path: number of tokens, then the leading tokens."""
    return F.xxhash64(n_tokens(line), F.substring_index(line, " ", LEAD))


def line_key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def needed(line: Column, min_docs: int) -> Column:
    """Documents that a masked line or its template must stand in. Lines of few tokens are weighed by characters (as scripts without
    blanks must be), variable fields left out; short lines of variable fields alone have no constant text and get null."""
    chars = F.length(F.replace(F.replace(line, F.lit(VARIABLE), F.lit("")), F.lit(" "), F.lit("")))
    short = F.greatest(F.lit(min_docs), F.ceil(F.lit(SHORT_CHARS) / F.when(chars > 0, chars)))
    return F.when(n_tokens(line) >= MIN_TOKENS, F.lit(min_docs).cast("long")).when(chars > 0, short)


def of_row(doc_id: str, text: str) -> list[Column]:
    """What tells rows apart: __id, and __of, a digest of the text (a longer one where the doc_id is null)."""
    digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))
    return [F.col(doc_id).alias("__id"), F.when(F.col(doc_id).isNull(), digest).otherwise(F.substring(digest, 1, 8)).alias("__of")]


def keyed_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """__id, __of, at (from 0), key and leaf of each row's masked lines, empty ones left out, as a table in the shared folder. long marks
    raw lines of LONG_CHARS or more; raw is the key of those that masking changes."""
    # the text's digest is taken here, once, and not behind the lines, for each of them
    rows = docs.select(*of_row(doc_id, text), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digits", F.col("text").rlike("[0-9]"))
    lines = rows.select("__id", "__of", "digits", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).where("line <> ''")
    lines = lines.withColumns({"masked": masked_line(F.col("line"), F.col("digits")), "long": F.length("line") >= LONG_CHARS})
    raw = F.when(F.col("long") & F.col("digits") & (F.col("line") != F.col("masked")), line_key(F.col("line")))
    return saved(lines.select("__id", "__of", "at", line_key(F.col("masked")).alias("key"), leaf_of(F.col("masked")).alias("leaf"), "long", raw.alias("raw")), "lines")


def long_repeats(keyed: DataFrame) -> DataFrame:
    """__id, __of and at: the raw lines of LONG_CHARS or more that a row of smaller doc_id (null last, then by text) has, too."""
    lines = keyed.where("long").select("__id", "__of", "at", F.coalesce("raw", "key").alias("key"))
    row = F.struct(F.col("__id").isNull().alias("none"), "__id", "__of")
    first = lines.groupBy("key").agg(F.min(row).alias("first"), F.max(row).alias("last")).where("first < last").select("key", "first")
    return lines.join(first, "key").where(row > F.col("first")).select("__id", "__of", "at")


def grouped(tokens: DataFrame) -> DataFrame:
    """leaf, key and group: each line in its leaf's group 0 and, where it has recurring tokens, in the group of its pattern.

    A template's own tokens stand in as many of the leaf's lines as the template itself, whatever else is in the leaf. So of a line's tokens
    behind the leading ones, those that are equally frequent make its pattern: the largest such set, of equals the most frequent.
    """
    behind = tokens.where((F.col("at") >= LEAD) & (F.col("token") != VARIABLE))
    often = behind.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("n"), F.count("*").alias("lines")).where("lines > 1")
    sets = behind.join(often, ["leaf", "at", "token"]).groupBy("leaf", "key", "n").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("at", "token")).alias("group"))
    pattern = sets.groupBy("leaf", "key").agg(F.max(F.struct("size", "n", "group")).alias("top")).select("leaf", "key", F.col("top.group").alias("group"))
    return tokens.where("at = 0").select("leaf", "key", F.lit(0).cast("long").alias("group")).unionByName(pattern)


def recurring_lines(docs: DataFrame, keyed: DataFrame, text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """Masked lines that follow a template standing in enough documents (see needed): key, leaf, template and docs.

    A line counts once per document. Leaves under ``min_docs`` lines are left out first, on their numbers alone;
    only the lines of other leaves are grouped as text, each task's copies merged first. A leaf's different lines fall into groups, so
    that it holds several templates. Of a group's lines, a position is fixed where most documents agree on its token, else it is variable.
    Lines with enough of the tokens behind the leading ones, and one fixed token there, follow the template of their pattern's group, or else
    the leaf's. The others are templates of their own. A line of up to LEAD tokens is a leaf of its own. Empty lines are left out.
    """
    leaves = saved(keyed.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf"), "leaves")
    lines = docs.select(F.explode(F.array_distinct(masked_lines(F.col(text)))).alias("line")).where("line <> ''")
    lines = lines.withColumn("leaf", leaf_of(F.col("line")))
    kept = lines.join(leaves, "leaf", "left_semi").groupBy("leaf", "line").agg(F.count("*").alias("docs"))
    kept = saved(kept.withColumn("key", line_key(F.col("line"))), "leaf-lines")

    # a leaf's only line is its own template
    several = kept.groupBy("leaf").agg(F.count("*").alias("lines")).where("lines > 1").select("leaf")
    tokens = saved(kept.where(n_tokens(F.col("line")) > LEAD).join(several, "leaf", "left_semi").select("leaf", "key", "docs", F.posexplode(F.split("line", " ", -1)).alias("at", "token")), "tokens")
    of = saved(grouped(tokens), "groups")
    members = tokens.join(of, ["leaf", "key"])
    votes = members.groupBy("leaf", "group", "at", "token").agg(F.sum("docs").alias("n"))
    fixed = votes.groupBy("leaf", "group", "at").agg(F.max(F.struct("n", "token")).alias("top"), F.sum("n").alias("all"))
    fixed = saved(fixed.select("leaf", "group", "at", F.when(F.col("top.n") >= FIXED * F.col("all"), F.col("top.token")).alias("fixed")), "leaf-tokens")
    template = fixed.groupBy("leaf", "group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("fixed", F.lit(VARIABLE)).alias("t")))), lambda x: x["t"]), " ").alias("template"))
    same = F.col("token") == F.coalesce("fixed", F.lit(VARIABLE))
    alike = members.where(F.col("at") >= LEAD).join(fixed, ["leaf", "group", "at"]).groupBy("leaf", "group", "key", "docs").agg(F.avg(same.cast("double")).alias("share"), F.max(same & (F.col("token") != VARIABLE)).alias("anchored"))
    follows = saved(alike.where(F.col("anchored") & (F.col("share") >= ALIKE)).select("leaf", "group", "key", "docs"), "follows")
    common = follows.groupBy("leaf", "group").agg(F.sum("docs").alias("all")).where(F.col("all") >= min_docs).join(template, ["leaf", "group"])
    shared = follows.join(common, ["leaf", "group"]).groupBy("leaf", "key").agg(F.max(F.struct((F.col("group") != 0).alias("own"), "template", "all")).alias("of"))
    found = kept.join(shared, ["leaf", "key"], "left").where(F.col("of").isNotNull() | (F.col("docs") >= needed(F.col("line"), min_docs)))
    return found.select("key", "leaf", F.coalesce("of.template", "line").alias("template"), F.coalesce("of.all", "docs").alias("docs"))


def drop_recurring(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the text less its recurring lines, and n_lines and n_dropped.

    Whether a recurring line goes depends on the line alone, so it goes from every row. Other long lines (LONG_CHARS) that
    several rows have letter by letter stay in that of the smallest doc_id; rows without a doc_id come last, in order of a digest of
    the text. Null and empty texts have one empty line and stay as they are. Rows that share doc_id and text are treated alike; rows that
    share a doc_id alone, or have none, are rows of their own. A long text takes time in proportion to its lines. Columns
    named n_lines and n_dropped are replaced. An empty table gives no rows.
    """
    keyed = keyed_lines(docs, doc_id, text)
    gone = saved(recurring_lines(docs, keyed, text, min_docs).select("key"), "recurring")
    places = keyed.select("__id", "__of", "at", "key").join(gone, "key").select("__id", "__of", "at").unionByName(long_repeats(keyed))
    # a row for each text, of places that it has
    of = places.groupBy("__id", "__of").agg(F.collect_set("at").alias("__gone"))
    rows = docs.drop("n_lines", "n_dropped").withColumn("__text_of", of_row(doc_id, text)[1])
    rows = rows.join(of, F.col(doc_id).eqNullSafe(of["__id"]) & (F.col("__text_of") == of["__of"]), "left").drop("__id", "__of", "__text_of")
    raw = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    stays = F.array_except(F.sequence(F.lit(0), F.size(raw) - 1), F.col("__gone"))
    # an array of one row, so that the text is split once and not for each line
    kept = F.transform(F.array(F.struct(raw.alias("raw"), stays.alias("stays"))), lambda x: F.transform(x["stays"], lambda i: F.get(x["raw"], i)))[0]
    cleaned = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    dropped = F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")).cast("long")
    out = rows.withColumns({"n_lines": F.size(raw).cast("long"), "n_dropped": dropped, "__text": cleaned})
    return out.withColumn(text, F.col("__text")).drop("__text", "__gone")


def op9_log_templates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = drop_recurring(docs)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
