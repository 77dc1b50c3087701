"""Personal data by pattern, and information-theoretic sanitisation of the terms around it; DataFrame functions only.

Patterns find e-mail addresses, IP addresses, payment cards (Luhn) and telephone numbers: the protected entities. The
words of a document that has an entity are terms. Over the distinct texts of the corpus
    pmi(t, e) = log2( p(t, e) / (p(t) * p(e)) )   and   p(e | t) = n(t, e) / n(t),
where n counts the texts with t, e or both. A term discloses e where p(e | t) is at least `disclosure` even at the lower
end of its confidence interval (Wilson, `z` standard deviations: 1.2816 is 90 % on one side), so that few texts count for
what they are worth, and its pmi reaches `share` of e's own information -log2 p(e): knowing t then all but gives e away.
Such a term is generalised to its kind or removed wherever it stands, in texts without the entity too.

Defined cases: null and empty texts have no spans; equal texts (copies) count once, so copies alone disclose nothing;
repeated rows and ids are treated each on its own; an empty table gives an empty result; texts of any length are scanned
whole; only the id and text columns are read; rows are told apart by file and place (input that is no file is written once).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, row_key, settled
from .spans import find_spans, joined, let, place_among, tag

# The patterns of the op8 contract, in the contract's order.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]|)"
IP_VALID = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
#: Characters up to which the rows with flagged terms are broadcast to the texts.
BROADCAST_CHARS = 8 << 20
#: Words that can be terms.
TERM = r"(?:\G|(?<![\p{L}\p{Nd}]))[\p{L}\p{Nd}]{3,}+"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True where the string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: let(c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda d: d - F.when(d > 9, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def card_ok(s: Column) -> Column:
    return let(digits(s["match"]), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)))


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "email": find_spans(text, EMAIL),
        "ip": F.filter(find_spans(text, IP), lambda s: s["match"].rlike(IP_VALID)),
        "card": F.filter(find_spans(text, CARD), card_ok),
        "phone": F.filter(find_spans(text, PHONE), lambda s: F.length(digits(s["match"])).between(9, 15)),
    }


def entity_key(kind: str, match: Column) -> Column:
    """The entity that a match names: digits alone for numbers, lower case for addresses."""
    return F.concat(F.lit(kind + ":"), F.lower(match) if kind in ("email", "ip") else digits(match))


def least_share(n_te: Column, n_t: Column, z: float) -> Column:
    """The lower end of Wilson's interval of n_te / n_t: what the share is at least, at z standard deviations."""
    p, zz = n_te / n_t, z * z / n_t
    return (p + zz / 2 - F.sqrt(zz * (p * (1 - p) + zz / 4))) / (1 + zz)


def least_texts(disclosure: float, z: float) -> int:
    """The texts that a term must be in, each with the entity, for the lower end 1 / (1 + z^2 / n) to reach the share."""
    if disclosure <= 0 or z == 0:
        return 1
    return 1 << 31 if disclosure >= 1 else max(1, math.ceil(z * z * disclosure / (1 - disclosure) - 1e-9))


#: Classes of entities, and of terms, that are paired in one row's arrays.
CHUNK = 1024


def _together(held: DataFrame, least: int, disclosure: float, z: float, scratch: Scratch) -> DataFrame:
    """(term, n_te, n_e): how many distinct texts have the term and one of the entities, of which n_e have the entity, where
    n_te alone leaves the share within reach. held: row, seen, entities, terms.

    What is in fewer than `least` texts leaves first. Entities that stand in the same texts are one class, and so are terms
    (by the number of their texts and two 64-bit sums of them); all pairs of two classes have one n_te. So the lists of an
    address book, in however many versions, meet as few classes, and their pairs are dealt out in chunks."""
    bearing = held.where(F.size("entities") > 0).groupBy("seen").agg(F.min_by(F.struct("row", "entities", "terms"), "row").alias("b")).select("b.*")
    bearing = scratch.write(bearing.withColumn("mark", F.xxhash64("row.file", "row.at")))
    of = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor("mark").alias("x"), F.bit_xor(F.xxhash64("mark", F.lit(1))).alias("y"))

    def classes(rows: DataFrame, name: str) -> DataFrame:
        return scratch.write(rows.groupBy(name).agg(of.alias("c")).where(F.col("c.n") >= least))

    def by_text(rows: DataFrame, name: str, found: DataFrame, column: str) -> DataFrame:
        return rows.join(found, name).groupBy("row").agg(F.collect_set("c").alias(column))

    mentions = bearing.select("row", "mark", F.explode("entities").alias("entity"))
    alive = scratch.write(by_text(mentions, "entity", classes(mentions, "entity"), "es"))
    used = bearing.join(alive.select("row"), "row", "left_semi").select("row", "mark", F.explode("terms").alias("term"))
    terms = classes(used, "term")
    both = scratch.write(alive.join(by_text(used, "term", terms, "ts"), "row"))
    pieces = lambda c: F.explode(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / CHUNK)))
    piece = lambda c, i: F.slice(c, (F.col(i) * CHUNK + 1).cast("int"), CHUNK)
    dealt = both.withColumn("i", pieces("es")).withColumn("j", pieces("ts")).select("row", "i", "j", piece("es", "i").alias("es"), piece("ts", "j").alias("ts")).repartition("row", "i", "j")
    pairs = dealt.select("ts", F.explode("es").alias("e")).select("e", F.explode("ts").alias("t")).groupBy("e", "t").agg(F.count(F.lit(1)).alias("n_te"))
    # of all texts with the term at least t.n count, and n_te at least
    near = pairs.where((F.col("n_te") >= least) & (least_share(F.col("n_te"), F.col("t.n"), z) >= disclosure))
    near = near.select(F.col("t").alias("c"), "n_te", F.col("e.n").alias("n_e")).distinct()
    return near.join(terms, "c").select("term", "n_te", "n_e")


def _sized(table: DataFrame, size: Column, otherwise: str = "merge") -> DataFrame:
    """A written table to be broadcast where its strings come to BROADCAST_CHARS at most; joined by shuffle beyond."""
    held = table.agg(F.coalesce(F.sum(size + 32), F.lit(0))).first()[0]
    return F.broadcast(table) if held <= BROADCAST_CHARS else table.hint(otherwise)


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = 0.5, share: float = 0.8, z: float = 1.2816) -> DataFrame:
    """(row, id, email, ip, card, phone, term): arrays of spans in code points of the text; row is common.row_key of the
    settled input."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pii")
    docs = settled(docs, scratch)
    source = dict(scratch.tables)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), row_key(docs).alias("row"))
    seen = F.struct(F.xxhash64("text").alias("h"), F.crc32(F.encode("text", "UTF-8")).alias("k")).alias("seen")
    found = src.select("row", "id", "text", seen, *[c.alias(k) for k, c in base_spans(F.col("text")).items()])

    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: entity_key(kind, s["match"]))

    entities = F.array_distinct(F.concat(*[named(k) for k in KINDS]))
    bare = {k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in KINDS}
    terms = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), 0), F.lower))
    held = found.select("row", "id", "seen", "text", *bare.values(), entities.alias("entities"))
    held = scratch.write(held.select("row", "id", "seen", *KINDS, "entities", F.when(F.size("entities") > 0, terms).alias("terms")))

    # one row of each distinct text: all counts are over these
    first = held.groupBy("seen").agg(F.min("row").alias("row")).select("row")
    texts = src.select("row", "text").join(first.hint("shuffle_hash"), "row", "left_semi")
    words = scratch.write(texts.select("row", terms.alias("terms")))
    total = scratch.write(first.agg(F.count(F.lit(1)).alias("total")))
    candidates = scratch.write(_together(held, least_texts(disclosure, z), disclosure, z, scratch))
    # partial counts are summed before the shuffle, so a common word costs a row per task
    n_t = words.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    scored = candidates.join(n_t, "term").crossJoin(F.broadcast(total))
    pmi = F.log2(F.col("n_te") * F.col("total") / (F.col("n_t") * F.col("n_e")))
    flagged = scored.where((least_share(F.col("n_te"), F.col("n_t"), z) >= disclosure) & (pmi >= share * F.log2(F.col("total") / F.col("n_e"))))
    # a term discloses wherever it stands, so its entities no longer matter
    flagged = scratch.write(flagged.select("term").distinct())
    where = words.select("row", F.explode("terms").alias("term")).join(flagged, "term").groupBy("row").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    alike = held.select("row", "seen").join(held.groupBy("seen").agg(F.min("row").alias("first")), "seen").select("row", "first")
    where = scratch.write(alike.join(where.withColumnRenamed("row", "first"), "first").select("row", "terms"))
    scratch.free(held, where, *source.values())
    hits = src.select("row", "text").join(_sized(where, F.length(F.array_join("terms", " ")), "shuffle_hash"), "row")
    few = F.size("terms") <= 64  # else a search in the sorted terms, so that a text of many is not gone through for each word
    among = lambda t: F.when(few, F.array_contains("terms", t)).otherwise(F.coalesce(F.get("terms", place_among(F.col("terms"), t, 31)) == t, F.lit(False)))
    hit = F.filter(find_spans(F.col("text"), TERM), lambda w: among(F.lower(w["match"])))
    hits = hits.select("row", F.transform(hit, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"))).alias("near"))
    # words of an entity itself are the entity's span
    out = held.select("row", "id", *KINDS).join(hits, "row", "left")
    base = F.concat(*KINDS)
    edges = F.struct(F.sort_array(F.transform(base, lambda b: b["start"])).alias("start"), F.sort_array(F.transform(base, lambda b: b["end"])).alias("end"))
    # a word is apart from all spans where as many have ended before it as have begun before its end
    apart = let(edges, lambda e: F.filter(F.col("near"), lambda w: place_among(e["start"], w["end"], 31) == place_among(e["end"], w["start"] + 1, 31)))
    out = out.select("row", "id", *KINDS, F.coalesce(apart, F.array().cast("array<struct<start:int,end:int>>")).alias("term"))
    return out.withColumnRenamed("id", id_col)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: bool = False, **settings) -> DataFrame:
    """(row, id, text): texts whose spans are generalised to <kind>, or removed. Overlapping spans keep the earliest."""
    docs = settled(docs, Scratch(docs.sparkSession, "pii"))
    found = find_personal(docs, id_col, text_col, **settings)
    tagged = F.sort_array(F.concat(*[tag(F.col(k), k, i) for i, k in enumerate((*KINDS, "term"))]))
    src = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), row_key(docs).alias("row"))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        put = F.lit("") if remove else F.concat(F.lit("<"), x["kind"], F.lit(">"))
        added = F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), put)
        return F.when(x["start"] < s["at"], s).otherwise(F.struct(x["end"].alias("at"), added.alias("out")))

    cut = let(F.aggregate("spans", zero, step), lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    return found.select("row", id_col, tagged.alias("spans")).join(src, "row").select("row", id_col, cut.alias(text_col))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The op8 contract's row for each document."""
    base = F.concat(*[tag(F.col(k), k, i) for i, k in enumerate(KINDS)])
    every = F.concat(base, tag(F.col("term"), "term", len(KINDS)))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(every).alias("spans"))
