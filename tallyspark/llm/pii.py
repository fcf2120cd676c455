"""Personal data by patterns, and terms that give protected entities away.

Base kinds (email, ip, card, phone) are found by patterns over whole texts; each
pattern is written so that it takes time linear in the text and finds what the
plain pattern, leftmost and without overlaps, finds.

Terms in the text of a protected entity may reveal it by themselves.  Over the
corpus, with equal texts counted once and words counted over whole texts, a unit x
that n(x) of N texts hold has the information log2(N / n(x)), of which a term t gives
away log2(N n(t,x) / (n(t) n(x))), where n(t,x) counts texts that have both.  What t
leaves open is their difference, log2(n(t) / n(t,x)) bits, whatever N is.  The share
n(t,x) / n(t) is known from n(t) texts only, so its lower confidence bound (Wilson's,
one-sided) stands for it: one or two joint texts prove nothing.  In the texts that
hold x, terms that leave at most ``generalise_at`` bits open are replaced by a class
tag, with at most ``remove_at`` bits they go; a term must also tell ``min_gain`` bits of
x, so that a unit most texts hold is not told by everything.

An entity that few texts hold backs off to units that repeat: a text stands for the
units ``_units`` lists, the entity, its domain or prefixes, and its kind.

Terms are words of any length; in scripts without blanks, pairs of neighbouring
characters.  Words inside an email address belong to it and are no terms of the text.

Everything is DataFrame functions.

Contract: a null text is empty; rows that repeat a key are judged by their own
text; texts without entities are left alone; other columns of the input are kept
by ``sanitise``, whatever their names, while ``pii_spans`` replaces columns named as
its own (``RESERVED``); empty tables give empty results.  Overlapping spans are all
reported, and hidden together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage, unstage

KINDS = ["email", "ip", "card", "phone", "term"]
_LOCAL = "[A-Za-z0-9._%+-]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: kind -> (pattern, what a text must contain for it).  A match starts where the
#: run of its first characters starts, or where the match before it ended.
PATTERNS = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    # The longest chain of digits with single separators, if it has 16 to 19.
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])", ""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
#: Bits of a unit that a term may leave open to be replaced, and to be removed.
GENERALISE_AT, REMOVE_AT = 1.0, 1 / 3
#: Bits of a unit that a term must tell.
MIN_GAIN = 1.0
#: Normal quantile of the confidence bound (one-sided 95 %).
CONFIDENCE = 1.645
_BLANKLESS = "".join(rf"\p{{Is{s}}}" for s in (
    "Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan")) + "\u30fc"
#: What a text with any such character contains, and with none does not.
_HIGH = r"[\u0E00-\x{10FFFF}]"
#: Bits that mark digests of several rows.
_BITS = 1 << 22
#: Addresses (taken whole, then left out), runs without blanks, words.
_WORD = (rf"(?<!{_LOCAL}){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
         rf"|[{_BLANKLESS}&&[\p{{L}}\p{{M}}]]++|[\p{{L}}\p{{M}}&&[^{_BLANKLESS}]]++")
#: Columns that ``pii_spans`` adds.
RESERVED = ["_whole", "_digest", "_digit", *(f"_{k}" for k in KINDS)]
_SPAN = "array<struct<start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda acc, i: acc + F.when(
            i % 2 == 1, F.substr(digits, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(2 * d - 9 * (d > 4)) for d in range(10)]),
                         F.substr(digits, i, F.lit(1)).cast("int") + 1)))
    return total % 10 == 0


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


def find_spans(text: Column, pattern: Column, where: Column) -> Column:
    """Matches with their places: lengths of the gaps between them add up to these."""
    found = F.when(where, F.regexp_extract_all(text, pattern, F.lit(0)))
    gaps = F.split(text, pattern, -1)
    parts = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), found.alias("value"))
    walked = F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + p["gap"] + F.coalesce(F.length(p["value"]), F.lit(0))).alias("at"),
            F.when(p["value"].isNull(), acc["out"]).otherwise(
                F.concat(acc["out"], F.array(F.struct(
                    (acc["at"] + p["gap"]).alias("start"),
                    (acc["at"] + p["gap"] + F.length(p["value"])).alias("end"),
                    p["value"].alias("value"))))).alias("out")))
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, walked["out"]).otherwise(
        F.array().cast(_SPAN))


def _valid(kind: str) -> Column:
    return F.filter(f"_{kind}", lambda s: VALID[kind](s["value"]))


def with_base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one column of valid spans per base kind (_email, ...) and _whole."""
    rows = docs.withColumn("_whole", F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumn("_digit", F.col("_whole").rlike("[0-9]"))
    for kind, (pattern, sign) in PATTERNS.items():
        where = F.col("_whole").contains(sign) if sign in ("@", "+") else F.col("_digit")
        rows = rows.withColumn(f"_{kind}",
                               find_spans(F.col("_whole"), F.lit(pattern), where))
        rows = rows.withColumn(f"_{kind}", _valid(kind))
    return rows.drop("_digit")


def _units() -> Column:
    """Names of what the base spans of a row stand for: entities, what groups them, kinds."""
    def named(kind: str) -> Column:
        def units(s: Column) -> Column:
            value = s["value"]
            names = {
                "email": lambda: [F.lower(value), F.substring_index(F.lower(value), "@", -1)],
                "ip": lambda: [value, F.substring_index(value, ".", 3),
                               F.substring_index(value, ".", 2)],
                "card": lambda: [_digits(value), F.substr(_digits(value), F.lit(1), F.lit(6))],
                "phone": lambda: [_digits(value), F.regexp_replace(_digits(value), ".{4}$", "")],
            }[kind]()
            return F.array(*[F.concat(F.lit(f"{kind}{i}:"), n) for i, n in enumerate(names)],
                           F.lit(f"{kind}:"))
        return F.flatten(F.transform(f"_{kind}", units))
    return F.array_distinct(F.concat(*[named(k) for k in PATTERNS]))


def _pieces(word: Column) -> Column:
    """The terms of a match of _WORD, in order; none of an address."""
    low = F.lower(word)
    return (F.when(word.contains("@"), F.array().cast("array<string>"))
            .when(word.rlike(f"^[{_BLANKLESS}]{{2,}}"),
                  F.regexp_extract_all(low, F.lit("(?s)(?=(..))"), F.lit(1)))
            .otherwise(F.array(low)))


def _holds() -> Column:
    return sum((F.size(f"_{k}") for k in PATTERNS), F.lit(0)) > 0


def _occurrences(held: DataFrame) -> DataFrame:
    """(digest, start, end, term) of every term in the texts of ``held``."""
    words = F.regexp_extract_all("_whole", F.lit(_WORD), F.lit(0))
    parts = F.arrays_zip(F.split("_whole", _WORD, -1).alias("gap"), words.alias("word"))
    upto = Window.partitionBy("digest").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    size = F.length("gap") + F.coalesce(F.length("word"), F.lit(0))
    return (held.select("digest", F.posexplode(parts).alias("pos", "part"))
            .select("digest", "pos", "part.gap", "part.word")
            .withColumn("start", (F.sum(size).over(upto) - F.length("word")).cast("int"))
            .where(F.col("word").isNotNull())
            .select("digest", "start", F.posexplode(_pieces(F.col("word"))).alias("at", "term"))
            .select("digest", (F.col("start") + F.col("at")).alias("start"),
                    (F.col("start") + F.col("at") + F.length("term")).alias("end"), "term"))


def _terms(text: Column) -> Column:
    """The distinct terms of a text.  Only some texts need the slow pattern."""
    lower = lambda words: F.transform(words, F.lower)
    return F.array_distinct(
        F.when(text.contains("@") | text.rlike(_HIGH), F.flatten(F.transform(
            F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), _pieces)))
        .otherwise(lower(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}]++"), F.lit(0)))))


def _once(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` (digest, _whole) with equal texts once, and their number.

    Only texts that may have equals are sent anywhere: digests of several rows set bits
    of a mask of fixed size, and a text whose bit is not set has none.
    """
    per = stage(rows.groupBy("digest").agg(F.count("*").alias("n")), "digests")
    bit = F.pmod(F.col("digest"), F.lit(_BITS))
    word, flag = F.expr(f"pmod(digest, {_BITS}) div 64"), (bit % 64).cast("int")
    masks = stage(per.where("n > 1").select(word.alias("word"), F.call_function(
        "shiftleft", F.lit(1).cast("long"), flag).alias("mask"))
        .groupBy("word").agg(F.bit_or("mask").alias("mask")), "masks")
    total = per.count()
    unstage(per)
    marked = (rows.withColumn("word", word)
              .join(F.broadcast(masks), "word", "left")  # _BITS / 64 rows at most
              .withColumn("maybe", F.coalesce(F.call_function(
                  "shiftrightunsigned", F.col("mask"), flag).bitwiseAND(F.lit(1)), F.lit(0)) == 1))
    alone = marked.where(~F.col("maybe")).select("digest", "_whole")
    again = marked.where("maybe").groupBy("digest").agg(F.first("_whole").alias("_whole"))
    return alone.unionByName(again), total


def share_bound(joint: Column, texts: Column, z: float = CONFIDENCE) -> Column:
    """Wilson's lower bound of the share of a term's texts that hold the unit."""
    share = joint / texts
    spread = z * F.sqrt(share * (1 - share) / texts + z * z / (4 * texts * texts))
    return (share + z * z / (2 * texts) - spread) / (1 + z * z / texts)


def disclosing_terms(docs: DataFrame, words: DataFrame, holders: DataFrame, text: str = "text",
                     generalise_at: float = GENERALISE_AT, min_gain: float = MIN_GAIN
                     ) -> DataFrame:
    """(digest, term, open): terms that leave at most ``generalise_at`` bits of a unit of the
    text open, with the fewest bits over its units.

    ``words``: (digest, term), ``holders``: (digest, unit), of the distinct texts of
    ``docs`` that hold entities.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows, total = _once(docs.select(F.xxhash64(whole).alias("digest"), whole.alias("_whole")))
    counts = (rows.select(F.explode(_terms(F.col("_whole"))).alias("term"))
              .groupBy("term").agg(F.count("*").alias("n_t")))
    # No term of fewer texts reaches the bound, even if all of them hold the unit.
    least = 2.0 ** -generalise_at
    fewest = CONFIDENCE ** 2 * least / (1 - least) if least < 1 else float("inf")
    sizes = (holders.groupBy("unit").agg(F.count("*").alias("n_x"))
             .where(F.col("n_x") >= fewest - 1e-9))
    units = holders.join(sizes, "unit")
    # n(t,x) is n(x) at most.
    within = (F.col("n_t") >= fewest - 1e-9) & (F.col("n_t") * least <= F.col("n_x") + 1e-9)
    pairs = stage(words.join(counts, "term").join(units, "digest").where(within), "pairs")
    joint = pairs.groupBy("unit", "term").agg(
        F.count("*").alias("n_tx"), F.first("n_x").alias("n_x"), F.first("n_t").alias("n_t"))
    bound = share_bound(F.col("n_tx"), F.col("n_t"))
    gain = F.log2(bound * float(total or 1) / F.col("n_x"))
    telling = (joint.withColumn("open", -F.log2(bound))
               .where((F.col("open") <= generalise_at) & (gain >= min_gain))
               .select("unit", "term", "open"))
    return (pairs.join(telling, ["unit", "term"]).groupBy("digest", "term")
            .agg(F.min("open").alias("open")))


def pii_spans(docs: DataFrame, text: str = "text", generalise_at: float = GENERALISE_AT,
              remove_at: float = REMOVE_AT, min_gain: float = MIN_GAIN) -> DataFrame:
    """``docs`` with _whole, base spans per kind, and _term spans (value: tag or '')."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in RESERVED and c != text])
    based = with_base_spans(docs, text)
    held = stage(with_base_spans(docs.select(text), text).where(_holds())
                 .select(F.xxhash64("_whole").alias("digest"), "_whole", _units().alias("units"))
                 .dropDuplicates(["digest"]), "entities")
    spoken = stage(_occurrences(held), "occurrences")
    holders = held.select("digest", F.explode("units").alias("unit"))
    terms = stage(disclosing_terms(docs, spoken.select("digest", "term").distinct(), holders,
                                   text, generalise_at, min_gain), "terms")
    told = (spoken.join(terms, ["digest", "term"])
            .groupBy(F.col("digest").alias("_digest"))
            .agg(F.array_sort(F.collect_list(F.struct(
                "start", "end", F.when(F.col("open") <= remove_at, F.lit(""))
                .otherwise(F.lit("[TERM]")).alias("value")))).alias("_term")))
    told = stage(told, "told")
    unstage(held, spoken, terms)
    none = F.array().cast(_SPAN)
    # Rows that hold nothing are not sent to the join.
    plain = based.where(~_holds()).withColumns({f"_{k}": none for k in KINDS})
    found = (based.where(_holds()).withColumn("_digest", F.xxhash64("_whole"))
             .join(told, "_digest", "left").drop("_digest")
             .withColumn("_term", F.coalesce("_term", none)))
    return found.unionByName(plain)


def span_list(kind: str) -> Column:
    """kind:start:end of each span."""
    return F.transform(f"_{kind}", lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def sanitise(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """``docs`` with every span hidden: base kinds by a tag, terms by theirs or nothing."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    found = pii_spans(docs.toDF(*names.values()), names[text], **limits)

    def tagged(kind: str) -> Column:
        return F.transform(f"_{kind}", lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"),
            (s["value"] if kind == "term" else F.lit(f"[{kind.upper()}]")).alias("value")))

    spans = F.array_sort(F.concat(*map(tagged, KINDS)))
    whole = F.col("_whole")
    walked = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
            s["end"].alias("at"),
            F.concat(acc["out"], F.substr(whole, acc["at"] + 1, s["start"] - acc["at"]),
                     s["value"]).alias("out")))
        .otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))))
    hidden = F.concat(walked["out"], F.substr(whole, walked["at"] + 1, F.length(whole)))
    new_text = F.when(F.size(spans) > 0, hidden).otherwise(F.col(names[text]))
    return found.select(*[(new_text if c == text else F.col(own)).alias(c)
                          for c, own in names.items()])
