"""Words one edit apart, found by walking a trie kept as an edge table.

A word and its near word share all but one place. Where that place lies in the second half
of the word, the walk starts behind the first half in a trie of the words; else in a trie of the
reversed words. So no state stands near the root, where a trie branches most.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.columns import seeded, whole
from corpusmill.session import written

RUN = "[A-Za-z\\u00C0-\\u00FF]+"


def damaged_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word): each run of letters of each text with A-Z lower-cased; where the checksum of
    ``id:run`` is a multiple of 199, less one code point, the checksum's modulo its length.

    Null texts have no runs; a null id counts as empty.
    """
    lower = F.translate(whole(F.col(text_col)), string.ascii_uppercase, string.ascii_lowercase)
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    hashed = rows.select("run", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % 199 == 0, less).otherwise(F.col("run")).alias("word"))


def frequent_words(words: DataFrame, min_chars: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n) of the distinct words of at least ``min_chars`` code points that occur at
    least ``min_count`` times; counted in each task first. Null words count as none.
    """
    counted = words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _node(side: Column, prefix: Column) -> Column:
    """Trie node of a prefix; the two tries have nodes of their own."""
    return F.xxhash64(side, prefix)


def _step(depth: Column, rest: Column) -> Column:
    """Length of the edge that a state takes: the largest power of two that divides the depth
    and is not above the code points left.
    """
    lowest = F.when(depth == 0, F.lit(1 << 30)).otherwise(depth.bitwiseAND(-depth))
    longest = F.call_function("shiftleft", F.lit(1), F.floor(F.log2(F.greatest(rest, F.lit(1)))).cast("int"))
    return F.least(lowest, longest)


def _sides(words: DataFrame) -> DataFrame:
    """Each word in both tries: (side, word, n, spelled, length)."""
    both = F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("word").alias("spelled")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("spelled"))))
    return words.select("word", "n", both.alias("s")).select("s.side", "word", "n", "s.spelled", F.length("word").alias("length"))


def edges(sided: DataFrame) -> DataFrame:
    """Distributed edge table (node, label, child) of both tries, behind the first half of words.

    A node at depth d has edges of 1 code point, and longer ones of 2, 4, … where d is a
    multiple of that, so that long words are walked in few joins; a word of L code points
    has at most L of them.
    """
    powers = F.expr("transform(sequence(0, cast(floor(log2(length)) as int)), k -> shiftleft(1, k))")
    starts = F.expr("sequence(0, length - size, size)")
    sized = sided.select("side", "spelled", "length", F.explode(powers).alias("size"))
    placed = sized.select("side", "spelled", "size", "length", F.explode(starts).alias("at")).where(F.col("at") >= F.floor(F.col("length") / 2))
    return placed.select(
        _node(F.col("side"), F.substring("spelled", F.lit(1), F.col("at"))).alias("node"),
        F.substring("spelled", F.col("at") + 1, F.col("size")).alias("label"),
        _node(F.col("side"), F.substring("spelled", F.lit(1), F.col("at") + F.col("size"))).alias("child"),
    ).distinct()


STATE = ["side", "word", "n", "spelled", "position", "depth", "node", "edits"]


def _frontier(sided: DataFrame) -> DataFrame:
    """States without an edit: a word at each of its own nodes behind its first half, where
    an edit may come. Their nodes follow from the word, so they need no join.
    """
    half = F.floor(F.col("length") / 2)
    first = F.when(F.col("side") == 0, half).otherwise(F.col("length") - half).cast("int")
    last = F.col("length") - 1
    rows = sided.withColumn("position", F.explode(F.sequence(first, last)))
    node = _node(F.col("side"), F.substring("spelled", F.lit(1), F.col("position")))
    return rows.withColumns({"depth": F.col("position"), "node": node, "edits": F.lit(0)}).select(*STATE)


def _edited(frontier: DataFrame, table: DataFrame) -> DataFrame:
    """States after the edit: the word's code point is replaced by a later one of the
    alphabet that leaves the node, or is deleted.

    Of two words that differ by a replaced code point the one with the earlier goes on, of
    two of different length the longer: insertions are the deletions of the other word.
    """
    own = F.substring("spelled", F.col("position") + 1, F.lit(1))
    single = table.where(F.length("label") == 1)
    changed = frontier.join(single, "node").where(F.col("label") > own).withColumns(
        {"node": F.col("child"), "depth": F.col("depth") + 1, "position": F.col("position") + 1, "edits": F.lit(1)})
    deleted = frontier.withColumns({"position": F.col("position") + 1, "edits": F.lit(1)})
    return changed.select(*STATE).unionByName(deleted.select(*STATE))


def _advanced(states: DataFrame, table: DataFrame) -> DataFrame:
    """States one edge further, by the code points of their words; those without one end."""
    rest = F.length("spelled") - F.col("position")
    step = _step(F.col("depth"), rest).cast("int")
    asked = states.withColumns({"_step": step, "label": F.substring("spelled", F.col("position") + 1, step)})
    moved = asked.join(table, ["node", "label"]).withColumns(
        {"node": F.col("child"), "depth": F.col("depth") + F.col("_step"), "position": F.col("position") + F.col("_step")})
    return moved.select(*STATE)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of distinct words that differ by exactly one inserted, deleted
    or replaced code point, in both directions; ``words`` are (word, n) without repeats.

    States (word, position, node, edits) walk the edge table level by level: a join each.
    Each level is written, so a lost executor repeats one level only. A state ends when its
    word does; on the node of a whole word that word is its neighbour. Nodes are
    64-bit hashes of prefixes, and found pairs are compared afterwards. The number of levels
    grows with the logarithm of the longest word. Words whose paths share a node meet there
    with its edges, an alphabet at most.
    """
    sided = written(_sides(words), "trie-words")
    table = written(edges(sided), "trie-edges")
    longest = sided.agg(F.max("length")).first()[0] or 0
    active = F.col("position") < F.length("spelled")
    states = written(_edited(_frontier(sided), table), "trie-states")
    ended = [states.where(~active)]
    for _ in range(2 * longest.bit_length() + 1):
        waiting = states.where(active)
        if waiting.isEmpty():
            break
        states = written(_advanced(waiting, table), "trie-states")
        ended.append(states.where(~active))
    terminal = sided.select(
        _node(F.col("side"), F.col("spelled")).alias("node"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    reached = ended[0]
    for more in ended[1:]:
        reached = reached.unionByName(more)
    met = reached.select("node", "word", "n").join(terminal, "node").where(F.levenshtein("word", "near", 1) == 1)
    once = written(met.select("word", "n", "near", "near_n").distinct(), "near-words")
    return once.unionByName(once.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def forms(words: DataFrame, pairs: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n): a word's near word of largest n (ties: the smallest),
    if that n is at least ``ratio`` times its own.
    """
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best"))
    joined = words.join(best, "word", "left")
    good = -F.col("best.n") >= ratio * F.col("n")
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.n")).alias("form_n"))


def roots(formed: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, root) of the words that have a form: the last one along the forms.

    Each round doubles the way a word has looked along. Counts grow by ``ratio`` at each form,
    so the largest count bounds the rounds.
    """
    linked = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    steps, most = 1, formed.agg(F.max("n")).first()[0] or 0
    while most >= ratio:
        steps, most = steps + 1, most // ratio
    for _ in range(steps.bit_length()):
        further = linked.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        linked = written(linked.join(further, "root", "left").select("word", F.coalesce("_further", "root").alias("root")), "word-roots")
    return linked


def group_words(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words with their counts: the spelling
    each is probably a variant of, and the last one along such forms, which names its group.

    Words without a near word have 0, no form and themselves as root; no words give no rows.
    """
    words = written(words.select("word", "n"), "words")
    formed = written(forms(words, near_pairs(words), ratio), "word-forms")
    rooted = formed.join(roots(formed, ratio), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
