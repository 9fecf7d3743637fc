"""Fuzzy line deduplication (native).

Lines are normalised (lower case, runs of letters and digits, single spaces). One
pass over the documents gives every line occurrence two hashes (96 bits) that name
its class of equal lines and a 64-bit SimHash of its words; no text is shuffled:

* the 64-bit hash of every word of four characters or more votes for the bits (of
  every word, in lines whose words average less): the short words that every line of
  a language has would make unrelated lines alike. The votes of four bits share one long
  in fields of 16 bits, so 16 sums per line count them all, and the majorities are
  taken with one addition and mask per sum. Words are counted in chunks of 16 000
  so that a field cannot overflow; the few lines of more chunks are added up apart;
* four blocks of 16 bits. Lines whose SimHashes differ in 2 bits or fewer agree in
  two blocks (pigeonhole), so an equi-join on the six pairs of blocks (32 bits)
  finds all those, and many that differ more.

Candidates are verified by edit similarity, 1 - distance / longer length, with
Spark's bounded Levenshtein distance of what lies between their common start and end;
only their texts are read again, and only lines that occur again or share a block take
part in any step after the hashes. Within a
value of a pair of blocks every line is compared with one leader; lines that are then
not connected with it are compared with all others of the value that lie in another
component, so no link between candidates is lost while a large group of variants
costs comparisons in proportion to its size.

Of each connected group the first occurrence, by doc_id and then line number, is kept
and all others are removed from their documents.

Defined cases: a null or empty text has no lines; lines of fewer than
``least_words`` words are never removed; rows of equal doc_id are one document, and
repeated rows get equal results; a null doc_id comes last; an empty table gives an
empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_key, whole_text, written
from .components import connected_components
from .quality import once

SIMILARITY, LEAST_WORDS, SHORT = 0.85, 5, 4
# 16-bit fields; a chunk's votes and the threshold's offset together stay below 2**15
FIELD, TOP, CHUNK = 0x0001000100010001, 0x4000, 16_000
OCCURRENCE = ["doc_id", "text_key", "pos", "h1", "h2"]
# all ASCII but line feeds, digits and letters, one by one: Java looks single characters
# of a class up in a table, where it tries ranges one after the other. Runs are matched
# possessively: nothing follows them, so there is nothing to step back for
BREAKS = "".join(f"\\x{c:02X}" for c in range(128) if c != 10 and not chr(c).isalnum())


def normal_lines(text: Column) -> Column:
    """The text with each line normalised but for spaces at its ends."""
    return F.regexp_replace(F.lower(text), f"[{BREAKS}]++", " ")


def line_words(docs: DataFrame, least_words: int) -> DataFrame:
    """OCCURRENCE, w (the words), chars (their length with spaces) and row_id (tells
    repeated rows apart) of every line of enough words."""
    t = docs.select("doc_id", whole_text().alias("text"))
    lines = t.select("doc_id", text_key(F.col("text")).alias("text_key"), F.monotonically_increasing_id().alias("row_id"),
                     F.posexplode(F.split(normal_lines(F.col("text")), "\n")).alias("pos", "line"))
    n = lines.select("doc_id", "text_key", "row_id", "pos", F.trim("line").alias("norm"))
    # the words come from a generator: filters on a projected column would split the line again
    w = n.select("*", F.explode(F.array(F.split("norm", " "))).alias("w")).filter(F.size("w") >= least_words)
    return w.select("doc_id", "text_key", "row_id", "pos", F.xxhash64("norm").alias("h1"), F.hash("norm").alias("h2"),
                    "w", F.char_length("norm").alias("chars"))


def majority(votes: list[Column], n: Column) -> Column:
    """The SimHash from 16 sums of four fields: bit s + 16 k is set if field k of sum s
    is more than half of n."""
    offset = (F.lit(TOP) - F.floor(n / 2) - 1).cast("long") * F.lit(FIELD)
    bits = [F.shiftrightunsigned((v + offset).bitwiseAND(F.lit(TOP * FIELD)), 14 - s) if s < 15
            else F.shiftleft((v + offset).bitwiseAND(F.lit(TOP * FIELD)), 1) for s, v in enumerate(votes)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def line_hashes(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """OCCURRENCE and simhash of every line of enough words."""
    names = [f"v{s}" for s in range(16)]
    key = [*OCCURRENCE, "row_id", "size"]
    words = line_words(docs, least_words).select(*OCCURRENCE, "row_id", F.size("w").alias("size"), "chars", F.posexplode("w").alias("i", "word"))
    voting = words.filter((F.char_length("word") >= SHORT) | (F.col("chars") + 1 < (SHORT + 1) * F.col("size")))
    w = voting.select(*key, F.floor(F.col("i") / CHUNK).cast("int").alias("chunk"), F.xxhash64("word").alias("x"))
    votes = w.groupBy(*key, "chunk").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.shiftrightunsigned("x", s).bitwiseAND(F.lit(FIELD))).alias(v) for s, v in enumerate(names)])
    table = written(votes.select(
        *key, "n", F.when(F.col("size") <= CHUNK, majority([F.col(v) for v in names], F.col("n"))).alias("simhash"),
        F.when(F.col("size") > CHUNK, F.array(*names)).alias("votes")), "lines")
    # lines of several chunks: the fields as numbers of their own
    line = [*OCCURRENCE, "row_id"]
    chunks = table.filter("votes is not null")
    parts = chunks.select(*line, "n", F.posexplode("votes").alias("s", "v")).select(
        *line, "n", "s", F.posexplode(F.array(*[F.shiftrightunsigned("v", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)])).alias("k", "c"))
    bits = parts.groupBy(*line, "s", "k").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    long = bits.groupBy(*line).agg(F.bit_or(F.expr("if(2 * c > n, shiftleft(1L, s + 16 * k), 0L)")).alias("simhash")).drop("row_id")
    return table.filter("votes is null").select(*OCCURRENCE, "simhash").unionByName(long)


def line_classes(hashes: DataFrame) -> DataFrame:
    """One row per distinct line: h1, h2, first_doc, its simhash and n (occurrences)."""
    return hashes.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.first("simhash").alias("simhash"), F.count(F.lit(1)).alias("n"))


def block_pairs(classes: DataFrame) -> DataFrame:
    """id (h1), pair and value: the six pairs of 16-bit blocks of each class."""
    block = [F.shiftrightunsigned("simhash", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    values = [F.shiftleft(block[i], 16).bitwiseOR(block[j]) for i, j in combinations(range(4), 2)]
    return classes.select(F.col("h1").alias("id"), F.posexplode(F.array(*values)).alias("pair", "value"))


def shared_start(a: Column, b: Column) -> Column:
    """Characters that two texts have in common at their start (up to 2**16 - 1 of them)."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(16))])
    n = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.substring(a, at + 1, s) == F.substring(b, at + 1, s), at + s).otherwise(at))
    return F.least(n, F.char_length(a), F.char_length(b))


def apart(p: Column) -> Column:
    """The pair without its common start, both texts reversed; the edit distance is the same."""
    def rest(x, n):
        return F.reverse(F.substring(x, n + 1, F.char_length(x)))

    return once(shared_start(p["a"], p["b"]), lambda n: F.struct(rest(p["a"], n).alias("a"), rest(p["b"], n).alias("b"), p["most"].alias("most")))


def similar(a: Column, b: Column, similarity: float) -> Column:
    """Edit similarity of two lines reaches the threshold. Their common start and end are
    taken off, and smaller bounds are tried first, as the distance costs in proportion
    to its bound; the last bound decides."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    most = F.floor((1 - F.lit(similarity)) * longer + 1e-9).cast("int")

    def near(p):
        bounds = [F.ceil(p["most"] / 8).cast("int"), F.ceil(p["most"] / 3).cast("int"), p["most"]]
        return reduce(lambda x, y: x | y, [F.call_function("levenshtein", p["a"], p["b"], m) >= 0 for m in bounds])

    pair = F.struct(a.alias("a"), b.alias("b"), most.alias("most"))
    return (F.abs(F.char_length(a) - F.char_length(b)) <= most) & once(pair, lambda p: once(apart(p), lambda q: once(apart(q), near)))


def verified(pairs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) pairs whose lines are similar; lines(id, norm)."""
    x = lines.select(F.col("id").alias("a"), F.col("norm").alias("a_norm"))
    y = lines.select(F.col("id").alias("b"), F.col("norm").alias("b_norm"))
    return pairs.join(x, "a").join(y, "b").filter(similar(F.col("a_norm"), F.col("b_norm"), similarity)).select("a", "b")


def texts_of(docs: DataFrame, chosen: DataFrame, broadcast_rows: int) -> DataFrame:
    """(id, norm) of the chosen (doc_id, text_key, pos, id): only their documents are
    read again; the places are broadcast if they are few (counted), else joined."""
    places = chosen.groupBy(F.col("doc_id").alias("o_id"), F.col("text_key").alias("o_key")).agg(
        F.collect_list(F.struct("pos", "id")).alias("places"))
    places = written(places, "places")
    if places.count() <= broadcast_rows:
        places = F.broadcast(places)
    rows = docs.select("doc_id", text_key(whole_text()).alias("text_key"), whole_text().alias("text"))
    found = rows.join(places, rows["doc_id"].eqNullSafe(F.col("o_id")) & (rows["text_key"] == F.col("o_key"))).select(
        "places", F.split("text", "\n").alias("lines"))
    # the lines are bound to a lambda's variable, so a text is split once, not per place
    picked = F.flatten(F.transform(F.array("lines"), lambda a: F.transform("places", lambda p: F.struct(
        p["id"].alias("id"), F.get(a, p["pos"]).alias("line")))))
    # a line feed stays as it is in a normalised text, so its lines can be normalised alone
    lines = found.select(F.explode(picked).alias("x")).select("x.*").dropDuplicates(["id"])
    return lines.select("id", F.trim(normal_lines(F.col("line"))).alias("norm"))


def shared_blocks(classes: DataFrame) -> DataFrame:
    """key (pair and value in one long), id and leader of the blocks that several classes
    have. The rows are shuffled once, for the count and for the join."""
    blocks = block_pairs(classes).select("id", F.shiftleft(F.col("pair").cast("long"), 32).bitwiseOR(F.col("value")).alias("key")).repartition("key")
    shared = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("leader")).filter("n > 1").drop("n")
    return written(blocks.join(shared.hint("shuffle_hash"), "key"), "blocks")


def known_classes(classes: DataFrame, members: DataFrame) -> DataFrame:
    """c1, c2, first_doc and id (null if no candidate) of the classes of which a line may go:
    they have several occurrences, or share a block. The others need no further step."""
    ids = members.select("id").distinct()
    return written(classes.join(ids.hint("shuffle_hash"), F.col("h1") == F.col("id"), "left").filter("n > 1 or id is not null").select(
        F.col("h1").alias("c1"), F.col("h2").alias("c2"), "first_doc", "id"), "known")


def occurrences(hashes: DataFrame, known: DataFrame) -> DataFrame:
    """OCCURRENCE, first_doc and id of the lines of the known classes."""
    return written(hashes.select(*OCCURRENCE).join(known, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2"))).drop("c1", "c2"), "occurrences")


def linked_groups(docs: DataFrame, found: DataFrame, members: DataFrame, similarity: float, broadcast_rows: int) -> DataFrame:
    """(node, component) of the classes, named by h1, that are linked with another, from
    the occurrences of known classes and the members of shared blocks."""
    # one occurrence of each candidate class, the smallest place of its first document
    places = found.filter(F.col("id").isNotNull() & F.col("doc_id").eqNullSafe(F.col("first_doc"))).groupBy("doc_id", "id").agg(
        F.min(F.struct("text_key", "pos")).alias("place")).select("doc_id", "place.text_key", "place.pos", "id")
    lines = written(texts_of(docs, places, broadcast_rows), "texts")
    star = members.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    formed = connected_components(written(verified(star, lines, similarity), "links"))
    named = members.join(formed, F.col("id") == F.col("node"), "left").select(
        "key", "id", "leader", F.coalesce("component", "id").alias("component"))
    of_leader = named.filter("id = leader").select(F.col("key").alias("o_key"), F.col("component").alias("o_component"))
    # lines apart from their leader's component meet all others of the value
    away = named.join(of_leader, F.col("key") == F.col("o_key")).filter(
        F.col("component") != F.col("o_component")).select("key", F.col("id").alias("a"), F.col("component").alias("ca"))
    rest = away.join(named.select("key", F.col("id").alias("b"), F.col("component").alias("cb")), "key").filter(
        F.col("ca") != F.col("cb")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # pairs with a leader were compared before
    rest = rest.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = verified(rest, lines, similarity)
    # these links join whole components, by their labels (a line of none is one by itself)
    for end in ("a", "b"):
        label = formed.select(F.col("node").alias("l_node"), F.col("component").alias("label"))
        more = more.join(label, F.col(end) == F.col("l_node"), "left").withColumn(end, F.coalesce("label", end)).select("a", "b")
    joined = connected_components(written(more.distinct(), "more"))
    to = joined.select(F.col("node").alias("o_node"), F.col("component").alias("to"))
    every = formed.unionByName(joined.select("node", F.col("node").alias("component"))).distinct()
    return every.join(to, F.col("component") == F.col("o_node"), "left").select("node", F.coalesce("to", "component").alias("component"))


def fuzzy_groups(docs: DataFrame, hashes: DataFrame, classes: DataFrame, similarity: float = SIMILARITY,
                 broadcast_rows: int = 200_000) -> DataFrame:
    """(node, component) of the classes, named by h1, that are linked with another."""
    members = shared_blocks(classes)
    return linked_groups(docs, occurrences(hashes, known_classes(classes, members)), members, similarity, broadcast_rows)


def duplicate_lines(docs: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS,
                    broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, text_key, pos of every line occurrence that goes."""
    hashes = line_hashes(docs, least_words)
    classes = written(line_classes(hashes), "classes")
    members = shared_blocks(classes)
    known = known_classes(classes, members)
    found = occurrences(hashes, known)
    groups = linked_groups(docs, found, members, similarity, broadcast_rows)
    named = known.join(groups, F.col("c1") == F.col("node"), "left").select(
        "c1", "c2", "first_doc", F.coalesce("component", "c1").alias("component"))
    # the first document of a group of several classes
    keep = named.groupBy(F.col("component").alias("g")).agg(F.min("first_doc").alias("keep_doc"))
    target = named.join(keep, F.col("component") == F.col("g")).select("c1", "c2", "component", "keep_doc")
    rows = found.select(*OCCURRENCE).join(target, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")))
    rows = written(rows.select("doc_id", "text_key", "pos", "component", F.col("doc_id").eqNullSafe(F.col("keep_doc")).alias("here")), "rows")
    # in that document the first place of the group stays
    stays = rows.filter("here").groupBy(F.col("component").alias("g"), F.col("text_key").alias("k")).agg(F.min("pos").alias("first_pos"))
    again = rows.filter("here").join(stays, (F.col("component") == F.col("g")) & (F.col("text_key") == F.col("k"))).filter(
        F.col("pos") != F.col("first_pos"))
    return rows.filter("not here").select("doc_id", "text_key", "pos").unionByName(again.select("doc_id", "text_key", "pos"))


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key, n_lines, n_removed and removed (line
    numbers from 0, sorted). ``without_positions`` applies it."""
    gone = duplicate_lines(docs, similarity, least_words).groupBy(F.col("doc_id").alias("o_id"), F.col("text_key").alias("o_key")).agg(
        F.array_sort(F.collect_set("pos")).alias("removed"))
    text = whole_text()
    rows = docs.select("doc_id", text_key(text).alias("text_key"), (
        F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    return rows.join(gone, rows["doc_id"].eqNullSafe(gone["o_id"]) & (rows["text_key"] == gone["o_key"]), "left").select(
        rows["doc_id"], rows["text_key"], "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def without_positions(text: Column, removed: Column) -> Column:
    """The text without the lines at the given places."""
    kept = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(removed, i))
    return F.when(F.size(removed) == 0, text).otherwise(F.array_join(kept, "\n"))
