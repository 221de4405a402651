"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.columns import SPACE, SPACES, seeded, whole, words
from corpusmill.session import written


def apportion(members: DataFrame, group: str, member: str, weight: str, seats: str) -> DataFrame:
    """(group, member, quota): seats by the highest quotients weight / (2 quota + 1).

    With n seats, m members and weights summing to W, a member of weight w gets between
    w (n - m/2) / W - 1/2 and w (n + m/2) / W + 1/2 seats, so only the quotients in
    between are compared, about two per member whatever n is. Members of no weight
    get none; ties go to the smaller member.
    """
    whole_group = Window.partitionBy(group)
    known = members.where(F.col(weight) > 0).select(
        group, member, F.col(weight).cast("double").alias("w"), F.col(seats).alias("n"),
        F.sum(F.col(weight).cast("double")).over(whole_group).alias("all"), F.count("*").over(whole_group).alias("m"))
    bound = lambda side: F.col("w") / F.col("all") * (F.col("n") + side * F.col("m") / 2) + 0.5 * side
    sure = known.select(group, member, "w", "n", F.greatest(F.lit(0), F.floor(bound(-1)) - 1).alias("low"), (F.ceil(bound(1)) + 1).alias("high"))
    open_seats = sure.select("*", (F.col("n") - F.sum("low").over(whole_group)).alias("open"))
    bids = open_seats.select("*", F.explode(F.sequence(F.col("low"), F.col("high"))).alias("q"))
    best = Window.partitionBy(group).orderBy((F.col("w") / (2 * F.col("q") + 1)).desc(), member, "q")
    won = bids.select("*", F.row_number().over(best).alias("at"))
    return won.groupBy(group, member).agg((F.first("low") + F.sum((F.col("at") <= F.col("open")).cast("long"))).alias("quota"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), epochs: int = 3) -> DataFrame:
    """(source, source_no, source_size, target): one row per source.

    Weights repeat over the sources by code point, null last. A target never exceeds
    ``epochs`` times the source; what is cut is shared by weight among the others,
    which puts every source that is not cut at one level per weight. Sorted by size
    over weight, that level follows from running sums over the source table.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = sources.select("*", number.alias("source_no")).withColumn(
        "w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int")))
    capped = listed.withColumn("cap", epochs * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    rising, every = Window.orderBy("ratio", "source_no"), Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing))
    levelled = capped.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(every) - before) / rest)
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every)
    return levelled.withColumn("target", F.least("cap", F.coalesce(level, F.lit(0.0)) * F.col("w"))).select("source", "source_no", "source_size", "target")


def _picked(x: Column, block: int) -> Column:
    """Words of [0, x) of a shard that lie in its chosen blocks."""
    j = F.floor(x / block)
    return block * (_step(j) - _step(F.lit(0))) + (_step(j + 1) - _step(j)) * (x - block * j)


def _step(i: Column) -> Column:
    """Chosen blocks before block ``i``, up to a constant.

    The ``k`` chosen of a shard's ``m`` blocks follow one another round the shard's
    shuffled documents from a seeded start, so at most two documents a shard are cut.
    """
    run = lambda x: F.greatest(F.lit(0), F.least(x - F.col("start"), F.col("k")))
    return run(i) + run(i + F.col("m"))


def _ranges(low: Column, high: Column, block: int) -> Column:
    """The runs of words of [low, high) of a shard that lie in its chosen blocks, counted from ``low``."""
    chosen = lambda j: _step(j + 1) > _step(j)
    one, last = F.floor(low / block), F.floor((high - 1) / block)
    blocks = F.sequence(one, last)
    opens = F.filter(blocks, lambda j: chosen(j) & ((j == one) | ~chosen(j - 1)))
    ends = F.filter(blocks, lambda j: chosen(j) & ((j == last) | ~chosen(j + 1)))
    return F.when(high > low, F.zip_with(opens, ends, lambda a, b: F.struct(
        F.greatest(a * block - low, F.lit(0)).cast("int").alias("low"), (F.least((b + 1) * block, high) - low).cast("int").alias("high"))))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """Per input row: id, size, source_size, target and ``taken``, the words the mix takes.

    All words of the table are dealt out again in blocks of ``block`` words: to the
    sources by their targets, then to shards of about ``shard_words`` words inside
    each source, both by highest quotients. A shard takes whole passes over its
    documents, then a run of blocks from a seeded start. Shard and order inside it are
    seeded hashes of id and text, so reruns agree. Hot sources have many shards, and so
    have rows of one id or none; only counts travel.

    Null and empty texts have size 0 and nothing is taken of them; a null source is
    one more source, the last; rows with a null or repeated id count separately.
    """
    return dealt_ranges(docs, id_col, text_col, source_col, **settings).drop("ranges")


def dealt_ranges(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, row: Sequence[str] = (),
    weights: Sequence[float] = (5, 2, 1), epochs: int = 3, block: int = 32, shard_words: int = 1_000_000, seed: int = 9,
) -> DataFrame:
    """The columns of ``mix``, behind the columns named in ``row``, and ``ranges``: the words
    [low, high) of the row that lie in chosen blocks. What is taken is those words and
    whole passes besides. Equal rows are laid out in the order of ``row``.
    """
    sizes = written(docs.select(
        *row, F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(source_col).cast("string").alias("source"),
        F.size(words(whole(F.col(text_col)))).cast("long").alias("size")), "mixing")
    sources = written(source_targets(sizes, weights, epochs), "mixing-sources")
    blocks = F.round(F.sum("source_size").over(Window.partitionBy(F.lit(1))) / block).cast("long")
    quotas = apportion(sources.select("*", blocks.alias("n"), F.lit(0).alias("all_sources")), "all_sources", "source_no", "target", "n")
    planned = sources.join(quotas, "source_no", "left").select(
        F.col("source").alias("of"), "source_no", "source_size", "target", F.coalesce("quota", F.lit(0)).alias("seats"),
        F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long").alias("n_shards"))
    placed = sizes.join(planned, F.col("source").eqNullSafe(F.col("of"))).select(
        *row, "id", "mark", "size", "source_no", "source_size", "target", "seats",
        F.pmod(seeded(seed, F.col("id"), F.col("mark")), F.col("n_shards")).alias("shard"), seeded(seed + 1, F.col("id"), F.col("mark")).alias("key"))
    shards = placed.groupBy("source_no", "shard").agg(F.sum("size").alias("shard_size"), F.first("seats").alias("seats"))
    shares = apportion(shards, "source_no", "shard", "shard_size", "seats")
    dealt = (
        shards.join(shares, ["source_no", "shard"]).withColumn("words", F.least(F.col("quota") * block, epochs * F.col("shard_size")))
        .withColumn("passes", F.floor(F.col("words") / F.col("shard_size"))).withColumn("m", F.ceil(F.col("shard_size") / block))
        .select(
            "source_no", "shard", "passes", "m", F.pmod(seeded(seed + 2, F.col("source_no"), F.col("shard")), F.col("m")).alias("start"),
            F.least(F.col("m"), F.round((F.col("words") - F.col("passes") * F.col("shard_size")) / block).cast("long")).alias("k")))
    line = Window.partitionBy("source_no", "shard").orderBy("key", "id", "mark", "size", *row).rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.withColumn("end", F.sum("size").over(line)).join(dealt, ["source_no", "shard"], "left")
    taken = F.col("passes") * F.col("size") + _picked(F.col("end"), block) - _picked(F.col("end") - F.col("size"), block)
    ranges = _ranges(F.col("end") - F.col("size"), F.col("end"), block)
    return laid.select(*row, F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"), ranges.alias("ranges"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """One row per copy that the mix takes of a document: a whole text per pass, then what
    the chosen blocks hold, the words of a range as they stand in the text, a line break
    between two ranges. Rows of which nothing is taken go.

    Rows are numbered on disk, so each gets its own words, also where ids repeat. A
    task's later passes follow its earlier ones, so copies of a text are not neighbours.
    """
    rows = written(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("_row")), "mixed-rows")
    dealt = dealt_ranges(rows.select("_row", "doc.doc_id", "doc.text", "doc.source"), row=("_row",), **settings).where("taken > 0")
    passes, more = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size") > 0
    copies = dealt.select("_row", "ranges", passes.alias("_passes"), F.explode(F.sequence(F.lit(0), passes - F.when(more, 0).otherwise(1))).alias("_pass"))
    cut = lambda spelled: F.array_join(F.transform("ranges", lambda r: F.rtrim(F.array_join(F.slice(spelled, r["low"] + 1, r["high"] - r["low"]), ""), F.lit(SPACES))), "\n")
    # bound as a variable, so that a text is split once for all of its ranges
    spelled = F.array(F.regexp_extract_all("doc.text", F.lit(f"{SPACE.replace('[', '[^')}+{SPACE}*"), F.lit(0)))
    text = F.when(F.col("_pass") < F.col("_passes"), F.col("doc.text")).otherwise(F.get(F.transform(spelled, cut), F.lit(0)))
    taken = rows.join(copies, "_row").sortWithinPartitions("_pass", "_row")
    return taken.select(*[text.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns])
