"""Personal data: base patterns as seeds, and further identifiers by bootstrapped contexts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.session import stored

# The kinds in their order, and the pattern of each. Starts are held to the first place of a run (or the
# end of the last match), where any match must begin, and repeats never give back, so matching takes linear time.
KINDS = ("email", "ip", "card", "phone", "id")
EMAIL, IP, CARD, PHONE, TOKEN = range(5)
PATTERNS = {
    EMAIL: r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"[0-9](?:[\x20-]?[0-9])++",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
    TOKEN: r"(?:\G|(?<![A-Za-z0-9._@%+/:=-]))[A-Za-z._@%+/:=-]*+[0-9][A-Za-z0-9._@%+/:=-]*+",
}
# What a text must hold for a kind to be looked for at all.
HINTS = {EMAIL: "@", IP: r"[0-9]\.[0-9]", CARD: r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", PHONE: r"\+[0-9]", TOKEN: "[0-9]"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
EDGE = r"[._@%+/:=-]+"
# End of the fixed values.

WINDOW_CHARS = 80  # on either side of an identifier, from which its patterns are taken
MIN_TOKEN_CHARS, MIN_TOKEN_DIGITS = 6, 3
MIN_SEEDS = 3  # different seeds or confirmed instances that a pattern must stand by
MIN_SCORE = 0.6


def matches(text: Column, kind: int) -> Column:
    """Array of the kind's matches in order, each with the text between it and the one before (its length and ends).

    The last element has no match: it is the rest of the text. Null without a hint of a match.
    """
    pattern = F.lit(PATTERNS[kind])
    gaps = F.transform(
        F.split(text, PATTERNS[kind], -1),
        lambda g: F.struct(F.char_length(g).alias("gap"), F.substring(g, 1, WINDOW_CHARS).alias("first"), F.right(g, F.lit(WINDOW_CHARS)).alias("last")),
    )
    both = F.arrays_zip(F.regexp_extract_all(text, pattern, 0).alias("hit"), gaps.alias("gap"))
    rows = F.transform(
        both,
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), x["hit"].alias("hit"), x["gap"]["gap"].alias("gap"), x["gap"]["first"].alias("first"), x["gap"]["last"].alias("last")
        ),
    )
    return F.when(text.rlike(HINTS[kind]), rows)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    backwards = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(backwards, i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid() -> Column:
    """Whether a match (columns kind, hit) passes the check of its kind."""
    digits = F.regexp_replace("hit", "[^0-9]", "")
    count = F.length(digits)
    core = F.regexp_replace("hit", f"^{EDGE}|{EDGE}$", "")
    return (
        F.when(F.col("kind") == IP, F.col("hit").rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
        .when(F.col("kind") == CARD, F.when(count.between(16, 19), luhn(digits)).otherwise(False))
        .when(F.col("kind") == PHONE, count.between(8, 15))
        .when(F.col("kind") == TOKEN, (F.length(core) >= MIN_TOKEN_CHARS) & (count >= MIN_TOKEN_DIGITS))
        .otherwise(True)
    )


def scan(docs: DataFrame) -> DataFrame:
    """One row per document, written once: row, doc_id, text_hash and all matches of all kinds; no text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), text.alias("text"))
    kinds = [F.coalesce(matches(F.col("text"), k), F.array().cast(MATCH)) for k in PATTERNS]
    return stored(rows.select("row", "doc_id", "text_hash", F.concat(*kinds).alias("parts")), "matches")


MATCH = "array<struct<kind:int,i:int,hit:string,gap:int,first:string,last:string>>"


def located(scanned: DataFrame) -> DataFrame:
    """Valid matches with their places in code points and the text around: row, kind, start, end, hit, left, right, before, after, ends.

    A place is the sum of the lengths before it, a running sum inside the
    document. Tokens are trimmed of punctuation; `left` and `right` are the
    places with it. `ends` says that the document ends within `after`.
    """
    rows = scanned.select("row", F.inline("parts"))
    order = Window.partitionBy("row", "kind").orderBy("i")
    length = F.coalesce(F.char_length("hit"), F.lit(0))
    rows = rows.withColumn("end", F.sum(F.col("gap") + length).over(order)).withColumn("after", F.lead("first").over(order))
    rows = rows.withColumn("ends", F.lead("hit").over(order).isNull() & (F.lead("gap").over(order) <= WINDOW_CHARS))
    rows = rows.where("hit is not null").where(valid())
    lead = F.when(F.col("kind") == TOKEN, F.char_length(F.regexp_extract("hit", f"^{EDGE}", 0))).otherwise(0)
    tail = F.when(F.col("kind") == TOKEN, F.char_length(F.regexp_extract("hit", f"{EDGE}$", 0))).otherwise(0)
    core = F.when(F.col("kind") == TOKEN, F.regexp_replace("hit", f"^{EDGE}|{EDGE}$", "")).otherwise(F.col("hit"))
    return rows.select(
        "row",
        "kind",
        (F.col("end") - F.char_length("hit") + lead).cast("long").alias("start"),
        (F.col("end") - tail).cast("long").alias("end"),
        core.alias("hit"),
        (F.col("end") - F.char_length("hit")).cast("long").alias("left"),
        F.col("end").cast("long").alias("right"),
        F.col("last").alias("before"),
        "after",
        "ends",
    )


def free_tokens(found: DataFrame) -> DataFrame:
    """Base matches, and tokens that no base match touches."""
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    # The rows that follow are those before in the opposite order: Spark walks that frame in one pass.
    behind = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    base_end, base_start = F.when(F.col("kind") != TOKEN, F.col("end")), F.when(F.col("kind") != TOKEN, F.col("start"))
    ended = F.coalesce(F.max(base_end).over(before), F.lit(0))
    begins = F.min(base_start).over(behind)
    rows = found.withColumn("ended", ended).withColumn("begins", begins)
    touched = (F.col("ended") > F.col("start")) | (F.col("begins") < F.col("end"))
    return rows.where((F.col("kind") != TOKEN) | ~F.coalesce(touched, F.lit(False))).drop("ended", "begins")


def plain(word: Column) -> Column:
    """A context word, or a text of them: lower case, every digit as 0."""
    return F.translate(F.lower(word), "123456789", "000000000")


def beside(found: DataFrame) -> DataFrame:
    """The word just before and just after every match: value, seed, pattern, word, and its place: row, from, to.

    A word is a run without white space, cut at matches; `whole` says that
    nothing was cut off it.
    """
    body, rest = F.regexp_replace("before", r"\s+$", ""), F.regexp_replace(F.coalesce("after", F.lit("")), r"^\s+", "")
    rows = found.select("*", F.xxhash64("kind", "hit").alias("value"), (F.col("kind") != TOKEN).alias("seed"), body.alias("body"), rest.alias("rest"))
    rows = rows.withColumns({"w_before": F.regexp_extract("body", r"\S+$", 0), "w_after": F.regexp_extract("rest", r"^\S+", 0)})
    to = F.col("left") - F.char_length("before") + F.char_length("body")
    start = F.col("right") + F.char_length("after") - F.char_length("rest")
    open_left = (F.char_length("w_before") < F.char_length("body")) | (F.col("left") == F.char_length("before"))
    open_right = (F.char_length("w_after") < F.char_length("rest")) | F.col("ends")
    sides = F.array(
        F.struct(F.lit("<").alias("side"), F.col("w_before").alias("raw"), (to - F.char_length("w_before")).alias("from"), to.alias("to"), ((to < F.col("left")) & open_left).alias("whole")),
        F.struct(F.lit(">").alias("side"), F.col("w_after").alias("raw"), start.alias("from"), (start + F.char_length("w_after")).alias("to"), ((start > F.col("right")) & open_right).alias("whole")),
    )
    words = rows.select("row", "value", "seed", F.inline(sides)).where("raw <> ''")
    return words.withColumn("word", plain(F.col("raw"))).withColumn("pattern", F.concat("side", "word")).drop("side", "raw")


def word_totals(docs: DataFrame, words: DataFrame) -> DataFrame:
    """How often every word stands in all texts, each place once: word, total.

    Runs between white space over the whole texts, and the pieces of runs that
    matches cut. Runs too long to be a context word are left out.
    """
    runs = docs.select(F.explode(F.split(plain(F.coalesce("text", F.lit(""))), r"\s+")).alias("word")).where(F.char_length("word").between(1, 3 * WINDOW_CHARS))
    pieces = words.where("not whole").select("row", "from", "to", "word").distinct()
    every = runs.groupBy("word").agg(F.count("*").alias("n")).union(pieces.groupBy("word").agg(F.count("*").alias("n")))
    return every.groupBy("word").agg(F.sum("n").alias("total"))


def bootstrap(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Identifiers beyond the base kinds: (value, confidence).

    Instances are matched strings; seeds are those of the base kinds. A
    pattern is the word just before or just after an instance. In each round a
    pattern's score is the confidence of the instances it stands by, over all
    places of its word in the texts (so a word that often stands elsewhere
    scores low), and an unseen instance gets the confidence that one of its
    good patterns is right. Patterns need MIN_SEEDS different instances that are seeds or
    confirmed by the round before, so confirmed ones bring patterns of their
    own. Scores and confidences never fall from round to round; the last round
    is the one that brings no instance and no pattern and raises no score in
    its second decimal. Only patterns that no round can accept are dropped
    before. All is grouping and joining of thin rows; counts are added up per
    (pattern, instance) first, so a frequent word or value is no hot row.
    """
    words = beside(found)
    pairs = words.groupBy("pattern", "word", "value").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    reach = pairs.groupBy("pattern").agg(F.count("*").alias("values"), F.sum("n").alias("most")).where(F.col("values") >= MIN_SEEDS)
    totals = word_totals(docs, words)
    graph = pairs.join(reach, "pattern").join(totals, "word").where(F.col("most") >= MIN_SCORE * F.col("total"))
    graph = stored(graph.select("pattern", "value", "seed", "n", "total"), "graph")
    seeds = graph.where("seed").select("value", F.lit(1.0).alias("confidence")).distinct()
    belief, before = seeds, None
    while True:
        weight = F.sum(F.col("n") * F.col("confidence")) / F.first("total")
        scored = graph.join(belief, "value").groupBy("pattern").agg(F.least(weight, F.lit(0.99)).alias("score"), F.count("*").alias("support"))
        good = stored(scored.where((F.col("support") >= MIN_SEEDS) & (F.col("score") >= MIN_SCORE)).select("pattern", "score"), "good")
        # The best pattern alone is a bound that rounding of the product must not undercut.
        confidence = F.greatest(F.max("score"), 1 - F.exp(F.sum(F.log(1 - F.col("score")))))
        unseen = stored(graph.where("not seed").join(good, "pattern").groupBy("value").agg(confidence.alias("confidence")), "unseen")
        now = (unseen.count(), *good.agg(F.count("*"), F.sum(F.round(F.col("score") * 100).cast("long"))).first())
        if now == before:
            return unseen
        belief, before = seeds.union(unseen), now


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All documents (row, doc_id, text_hash), and their spans (row, kind, start, end): base kinds and discovered ones."""
    scanned = scan(docs)
    found = stored(free_tokens(located(scanned)), "found")
    unseen = bootstrap(docs, found)
    more = found.where(F.col("kind") == TOKEN).withColumn("value", F.xxhash64("kind", "hit")).join(unseen, "value")
    names = ["row", "kind", "start", "end"]
    return scanned.select("row", "doc_id", "text_hash"), found.where(F.col("kind") != TOKEN).select(names).union(more.select(names))


def find(docs: DataFrame) -> DataFrame:
    """Personal data of every whole text as places in code points.

    Returns doc_id, text_hash, n_email, n_ip, n_card, n_phone, n_id, base (the base
    kinds' spans as `kind:start:end`, by kind and start), spans (all of them)
    and list (all as structs). Base matches are leftmost and do not overlap
    within their kind; those that fail their check are dropped. Null texts are
    empty; texts without a match have zero counts and empty strings; repeated
    rows and null ids give a row each; other columns are not looked at.
    """
    rows, all_spans = spans(docs)
    one = F.struct("kind", "start", "end")
    count = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{KINDS[k]}") for k in PATTERNS]
    per = all_spans.groupBy("row").agg(*count, F.sort_array(F.collect_list(one)).alias("list"))

    def said(items: Column) -> Column:
        name = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(F.transform(items, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    out = rows.join(per, "row", "left")
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    out = out.withColumn("list", F.coalesce("list", none)).fillna(0, [f"n_{k}" for k in KINDS])
    base = F.filter("list", lambda x: x["kind"] != TOKEN)
    return out.select("doc_id", "text_hash", *[f"n_{k}" for k in KINDS], said(base).alias("base"), said(F.col("list")).alias("spans"), "list")


def report(docs: DataFrame) -> DataFrame:
    """Counts of base kinds, the digest of their spans, and all spans, per document."""
    return find(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_id", F.sha2("base", 256).alias("base_sha256"), "spans")


def masked(docs: DataFrame) -> DataFrame:
    """The same rows with every span in `text` replaced by its kind in angle brackets; touching spans become one.

    Spans depend on a text alone, so rows are matched by id and text.
    """
    names = docs.columns
    ids, all_spans = spans(docs)
    before = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    apart = all_spans.withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0)))
    kept = F.when(F.col("start") >= F.col("from"), F.struct("start", "from", "kind"))
    per = apart.groupBy("row").agg(F.sort_array(F.collect_list(kept)).alias("cuts"), F.max("end").alias("last"))
    found = ids.join(per, "row").select(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash"), "cuts", "last").dropDuplicates(["f_id", "f_hash"])
    rows = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("d_id"), F.xxhash64("text").alias("d_hash"))
    joined = rows.join(found, F.col("d_id").eqNullSafe(F.col("f_id")) & (F.col("d_hash") == F.col("f_hash")), "left")
    mark = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    text = F.col("row.text")

    def part(x: Column) -> Column:
        return F.concat(F.substring(text, (x["from"] + 1).cast("int"), (x["start"] - x["from"]).cast("int")), F.get(mark, x["kind"]))

    rest = F.substring(text, (F.col("last") + 1).cast("int"), F.char_length(text))
    clean = F.when(F.col("cuts").isNull(), text).otherwise(F.concat(F.array_join(F.transform("cuts", part), ""), rest))
    return joined.select(*[clean.alias(n) if n == "text" else F.col("row")[n].alias(n) for n in names])
