"""Line deduplication by the suffix order of line-ID sequences, native operators only.

Suffixes are ranked by distributed prefix doubling: the ranks of depth 2d come from sorting the pairs of ranks of depth d at distance d.
Suffixes of one rank are a longest-common-prefix interval; those that are alone in theirs leave, so the rounds shrink, and they end
when no repeated run is twice as long. Going down again, each interval with a suffix that is not its first position is cut by
the ranks of the next smaller depths, until for every suffix the longest run is known that begins at an earlier position
too (position: id, then line). Runs that no line before them prolongs are maximal. Of these, the ones of RUN_WORDS words or more
are deleted; the first copy of a run has no earlier one and stays.

A line that a third of all documents hold is one key of the first rounds: keys are pre-aggregated before
they move and the joins back are plain equality joins that adaptive execution splits. Of an interval only what still asks is carried on.

Defined results: null text has no lines and stays null; an empty text is one empty line; lines end at "\\n"
alone; blank lines count as lines and have no words; lines are told apart by 128 bits of hash; rows that repeat id and text are one document
with one result each; a null id comes after all others; ids are numbers or strings; texts of any length are read whole; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselens.llm.common import stash, table

RUN_WORDS = 5


#: A document: whether its id is null, its id, its text's hash; in the order of ids, null last.
DOC = ["n", "d", "t"]
PLACE = [*DOC, "p"]


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with the columns of DOC beside `_id` and `_text` alone."""
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return docs.select(own.alias("_id"), text.alias("_text"), own.isNull().alias("n"), F.coalesce(own, F.lit(0).cast(docs.select(own).schema[0].dataType)).alias("d"), F.xxhash64(text).alias("t"))


def positions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """DOC, p (its line), a, b (the line's identity)."""
    lines = named(docs, id_col, text_col).select(*DOC, F.posexplode(F.split("_text", "\n", -1)).alias("p", "line"))
    return lines.select(*PLACE, F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, PLACE) as PLACE, rank, first: intervals of two or more in the order of their keys, and each one's first position."""
    found = rows.groupBy(*keys).agg(F.min(F.struct(*PLACE)).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    found = stash(found.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()), "intervals")
    return stash(rows.join(found, keys).select(*PLACE, "rank", "first"), "suffixes")


def suffix_ranks(docs: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    """By k the suffixes (PLACE) whose first 2 ** k lines stand twice: their rank by these lines, and its first position."""
    whole = stash(positions(docs, id_col, text_col), "lines")
    often = stash(whole.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "b"), "often")
    repeated = whole.join(often, ["a", "b"]).groupBy(*PLACE).agg(F.first("a").alias("a"), F.first("b").alias("b"))  # repeated rows count once
    ranks, depth = [ranked(stash(repeated, "repeated"), ["a", "b"])], 1
    while not ranks[-1].isEmpty():
        now = ranks[-1].select(*PLACE, F.col("rank").alias("this"))
        shifted = now.select(*DOC, (F.col("p") - depth).alias("p"), F.col("this").alias("next"))
        ranks.append(ranked(stash(now.join(shifted, PLACE), "pairs"), ["this", "next"]))
        depth *= 2
    return ranks[:-1]


def longest_earlier(ranks: list[DataFrame]) -> DataFrame | None:
    """PLACE, l: of every suffix with an earlier copy of its first line, how many lines the longest run at p has that stands earlier too.

    `nodes` holds the members of intervals of l lines in which some member asks whether it has a longer earlier copy."""
    place, done, nodes = F.struct(*PLACE), [], None
    for k in range(len(ranks) - 1, -1, -1):
        later = ranks[k].filter(place > F.col("first"))
        if k + 1 < len(ranks):
            above = ranks[k + 1].filter(place > F.col("first")).select(*PLACE)
            later = later.join(above, PLACE, "left_anti")
        ask = stash(later.select(*PLACE, "rank"), "asking")
        if k == 0:
            done.append(ask.select(*PLACE, F.lit(1).alias("l")))
        else:
            members = ranks[k].join(ask.select("rank").distinct(), "rank", "left_semi").join(ask.select(*PLACE, F.lit(True).alias("asks")), PLACE, "left")
            own = members.select(F.lit(-k).alias("round"), F.col("rank").alias("node"), F.lit(1 << k).alias("l"), *PLACE, F.coalesce("asks", F.lit(False)).alias("asks"))
            nodes = own if nodes is None else nodes.unionByName(own)
        if nodes is None:
            continue
        if k == 0:
            done.append(nodes.filter("asks").select(*PLACE, "l"))
            break
        half = 1 << (k - 1)
        step = ranks[k - 1].select(*DOC, F.col("p").alias("at"), F.col("rank").alias("next"))
        cut = stash(nodes.withColumn("at", F.col("p") + F.col("l")).join(step, [*DOC, "at"], "left").drop("at"), "cut")
        key = ["round", "node", "next"]
        parts = cut.filter("next is not null").groupBy(*key).agg(F.min(place).alias("first"), F.max(F.when(F.col("asks"), place)).alias("last"))
        parts = stash(parts.filter("last > first").select(*key, "first", F.monotonically_increasing_id().alias("part")), "parts")
        met = stash(cut.join(parts, key, "left").withColumn("won", F.col("asks") & F.coalesce(place > F.col("first"), F.lit(False))), "met")
        deeper = met.filter("part is not null").select(F.lit(k).alias("round"), F.col("part").alias("node"), (F.col("l") + half).alias("l"), *PLACE, F.col("won").alias("asks"))
        stay = met.select("round", "node", "l", *PLACE, (F.col("asks") & ~F.col("won")).alias("asks"))
        open_ = stay.filter("asks").select("round", "node").distinct()
        nodes = deeper.unionByName(stay.join(open_, ["round", "node"], "left_semi"))
        if k > 1:
            nodes = stash(nodes, "nodes")
    out = None
    for x in done:
        out = x if out is None else out.unionByName(x)
    return out


def later_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """DOC, runs: the maximal runs (first line, lines) of each document that stand earlier too."""
    found = longest_earlier(suffix_ranks(docs, id_col, text_col))
    if found is None:
        none = named(docs, id_col, text_col).select(*DOC).limit(0)
        return none.withColumn("runs", F.expr("cast(array() as array<struct<first:int,lines:int>>)"))
    before = stash(found, "earlier").select(*DOC, (F.col("p") + 1).alias("p"), F.col("l").alias("was"))
    runs = found.join(before, PLACE, "left").filter("was is null or was <> l + 1")
    return runs.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct(F.col("p").alias("first"), F.col("l").alias("lines")))).alias("runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows as: the id, text without later copies, n_lines, n_deleted, runs (first line, lines; those deleted) and deepest_copy, the lines of the longest."""
    found = stash(later_runs(docs, id_col, text_col), "runs")
    rows = named(docs, id_col, text_col)
    none = F.expr("cast(array() as array<struct<first:int,lines:int>>)")
    lines = F.split("_text", "\n", -1)
    count = lambda r: F.size(F.filter(F.split(F.array_join(F.slice(lines, r["first"] + 1, r["lines"]), " "), " "), lambda w: w != ""))
    joined = rows.join(found, DOC, "left")
    joined = joined.select("_id", "_text", F.when(F.col("runs").isNull(), none).otherwise(F.filter("runs", lambda r: count(r) >= RUN_WORDS)).alias("runs"))
    kept = F.filter(lines, lambda x, i: ~F.exists("runs", lambda r: (i >= r["first"]) & (i < r["first"] + r["lines"])))
    out = joined.select("_id", "_text", "runs", F.when(F.size("runs") == 0, F.lit(None)).otherwise(kept).alias("kept"))
    return out.select(
        F.col("_id").alias(id_col),
        F.when(F.col("kept").isNull(), F.col("_text")).otherwise(F.array_join("kept", "\n")).alias(text_col),
        F.when(F.col("_text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("kept").isNull(), 0).otherwise(F.size(lines) - F.size("kept")).cast("long").alias("n_deleted"),
        "runs",
        F.coalesce(F.array_max(F.transform("runs", lambda r: r["lines"])), F.lit(0)).cast("long").alias("deepest_copy"),
    )


def op8_line_dedup(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_deleted", F.size("runs").cast("long").alias("n_runs"), "deepest_copy", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )


#: Pairs of equal lines lie on diagonals; a run of pairs on one diagonal is a common run of two places. The longest from p on that
#: stands earlier is `l`; a run is maximal if the line before does not begin one that is a line longer.
OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, CAST(p AS BIGINT) AS p, ls[p] AS line, ls, len(ls) AS n
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
), pairs AS (
  SELECT b.doc_id, b.p, a.doc_id AS other, b.p - a.p AS diagonal
  FROM l a JOIN l b ON a.line = b.line AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.p < b.p))
), common AS (
  SELECT doc_id, p, max(p) OVER (PARTITION BY doc_id, other, diagonal, island) - p + 1 AS l
  FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, other, diagonal ORDER BY p) AS island FROM pairs)
), longest AS (
  SELECT doc_id, p, max(l) AS l FROM common GROUP BY doc_id, p
), runs AS (
  SELECT x.doc_id, x.p, x.l FROM longest x LEFT JOIN longest y ON y.doc_id = x.doc_id AND y.p = x.p - 1
  JOIN l ON l.doc_id = x.doc_id AND l.p = x.p
  WHERE coalesce(y.l <> x.l + 1, true) AND len(regexp_extract_all(array_to_string(ls[x.p : x.p + x.l - 1], chr(10)), '[^ 
]+')) >= 5
), counted AS (
  SELECT doc_id, count(*) AS n_runs, max(l) AS deepest_copy FROM runs GROUP BY doc_id
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_deleted, coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '') AS text
  FROM (SELECT l.doc_id, l.p, any_value(line) AS line, bool_or(coalesce(r.p IS NOT NULL, false)) AS gone
        FROM l LEFT JOIN runs r ON r.doc_id = l.doc_id AND l.p >= r.p AND l.p < r.p + r.l GROUP BY l.doc_id, l.p) GROUP BY doc_id
)
SELECT documents.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted,
       CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(coalesce(deepest_copy, 0) AS BIGINT) AS deepest_copy, sha256(coalesce(kept.text, '')) AS text_sha256
FROM documents LEFT JOIN kept USING (doc_id) LEFT JOIN counted USING (doc_id)
"""
