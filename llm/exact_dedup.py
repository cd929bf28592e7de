"""Exact dedup by deterministic block naming.

Every text is cut into blocks of a fixed number of characters. Distinct blocks are sorted (by two hashes, then by
bytes) and named by their rank; the names replace the blocks. Adjacent names are then paired, distinct pairs are
sorted and named by rank in turn, and so on until a text is one name. A rank doesn't depend on how rows are
partitioned, so neither do names. Equal (rounds, number) means equal text: names are given to
whole contents, so two contents never share one.

Block contents are brought together by a 128-bit hash but always told apart by their bytes: should two
contents share a hash, the occurrences of that hash are named by a join on the bytes themselves.

Rows are told apart by doc_id and the digest of their text, so rows that repeat a doc_id with different texts are
named each by its own text.

Edge cases: null text counts as empty; empty texts (also those of white space alone) are equal to each
other; a row that repeats another counts in its group, and all rows that carry the group's keep_id stay; a null
doc_id is the smallest; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, table

SPACES = " \t\n\x0b\x0c\r"
BLOCK_CHARS = 4096


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _ranked(distinct: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The distinct keys with their rank in sorted order as ``name``: the same however the rows are partitioned.

    Rows are sorted into ranges and numbered within each; the ranges before a range hold as many rows as their counts say.
    """
    at = materialise(distinct.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), f"{name}-sorted")
    part, within = F.shiftright("at", 33).cast("int"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(at.groupBy(part.alias("part")).count().collect())  # one row for each partition
    before = [(r["part"], sum(x["count"] for x in counts[:k])) for k, r in enumerate(counts)]
    offsets = at.sparkSession.createDataFrame(before, "part int, before long")
    ranked = materialise(at.join(F.broadcast(offsets), part == F.col("part")).select(*keys, (F.col("before") + within).alias("name")), name)
    discard(at)
    return ranked


def _row_key(digest: Column) -> Column:
    """What tells rows apart: doc_id, which may be null, and the text's digest."""
    return F.named_struct(F.lit("doc_id"), "doc_id", F.lit("digest"), F.unhex(digest))


def block_names(docs: DataFrame, block_chars: int = BLOCK_CHARS, hash_bits: int = 64) -> DataFrame:
    """(row, rounds, name): the identity of every text, for each different (doc_id, digest). ``hash_bits`` is lowered by tests to force hash clashes."""
    mask = F.lit((1 << hash_bits) - 1 if hash_bits < 63 else -1).cast("long")
    cut = F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))
    blocks = (
        docs.select("doc_id", normalised(F.col("text")).alias("norm"))
        .select(_row_key(F.sha2("norm", 256)).alias("row"), F.posexplode(cut).alias("pos", "block"))
        .withColumn("h1", F.xxhash64("block").bitwiseAND(mask))
        .withColumn("h2", F.xxhash64(F.lit(7), F.col("block")).bitwiseAND(mask))
    )
    # one shuffle of the text: distinct blocks, equal ones combined before it; of contents that share a hash the place among them by bytes
    contents = materialise(blocks.groupBy("h1", "h2", "block").agg(F.count("*").alias("n")).drop("n"), "contents")
    hashes = materialise(contents.groupBy("h1", "h2").agg(F.count("*").alias("n_blocks")), "hashes")
    several = hashes.where("n_blocks > 1").select("h1", "h2")
    by_bytes = contents.join(several, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.array_sort(F.collect_list("block")).alias("blocks"))  # contents of one 128-bit hash
    clashes = materialise(by_bytes.select("h1", "h2", F.posexplode("blocks").alias("k", "block")), "clashes")
    told_apart = hashes.where("n_blocks = 1").select("h1", "h2", F.lit(-1).alias("k")).unionByName(clashes.select("h1", "h2", "k"))
    names = _ranked(told_apart, ["h1", "h2", "k"], "blocks")
    # a scan on either side, so that adaptive execution can split a block that many texts share
    level = blocks.select("row", "pos", "h1", "h2").join(names.where("k = -1").select("h1", "h2", "name"), ["h1", "h2"]).select("row", "pos", "name")
    if clashes.head(1):
        level = level.unionByName(blocks.join(clashes, ["h1", "h2", "block"]).join(names, ["h1", "h2", "k"]).select("row", "pos", "name"))
    level = materialise(level, "level")
    discard(contents, hashes, clashes, names)
    return _paired(level)


def _paired(level: DataFrame) -> DataFrame:
    """Names adjacent pairs until each row has one name."""
    done: DataFrame | None = None
    rounds = 0
    while True:
        single = level.groupBy("row").agg(F.max("pos").alias("last"), F.min("name").alias("name"))
        ended = single.where("last = 0").select("row", F.lit(rounds).alias("rounds"), "name")
        done = ended if done is None else done.unionByName(ended)
        open_docs = single.where("last > 0").select("row")
        if not open_docs.head(1):
            return done
        pairs = (
            level.join(open_docs, "row", "left_semi")
            .groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("pair"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            )
            .select("row", F.col("pair").alias("pos"), "left", "right")
        )
        pairs = materialise(pairs, "pairs")
        names = _ranked(pairs.select("left", "right").distinct(), ["left", "right"], "pairnames")
        named = materialise(pairs.join(names, ["left", "right"]).select("row", "pos", "name"), "level")
        discard(pairs, names)
        level = named
        rounds += 1


def exact_dedup(docs: DataFrame, block_chars: int = BLOCK_CHARS, hash_bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per document, equal texts in one group.

    Of a group the longest original text stays, then the smallest doc_id. A repeated doc_id has a row for each of its rows.
    """
    facts = docs.select("doc_id", F.length(F.coalesce(F.col("text"), F.lit(""))).alias("chars"), F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
    names = block_names(docs, block_chars, hash_bits).select("row.digest", F.col("row.doc_id").alias("id"), "rounds", "name")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.unhex("text_sha256") == F.col("digest"))
    named = materialise(facts.join(names, same).drop("id", "digest"), "named")
    groups = materialise(
        named.groupBy("rounds", "name").agg(F.count("*").alias("group_size"), F.min(F.struct(-F.col("chars"), F.col("doc_id"))).getField("doc_id").alias("keep_id")),
        "groups",
    )
    return named.join(groups, ["rounds", "name"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, (-length(text), doc_id)) AS keep_id FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
