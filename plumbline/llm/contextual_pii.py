"""Personal data: base patterns and bootstrapped contextual extraction, in DataFrame functions only.

Base spans of four kinds come from fixed patterns. They are the seeds: the words left and right of tokens that overlap a
seed are lexical patterns. Patterns and the identifier-shaped tokens (eight or more characters, four or more of them
digits) that they enclose make a graph over the whole corpus. In each round a pattern's confidence is the share of its
distinct tokens that are believed, shrunk by ``PRIOR`` unbelieved ones, and a token's belief is the noisy-or of its
confident patterns; seeds stay at 1. Beliefs never fall, and rounds go on until none rises. Tokens believed at the end are spans of kind ``id``.

All text is read once; what is kept of it (spans and identifier-shaped tokens) is a small table in the shared folder, on which
rounds run. A word that a third of all tokens follow is one group of distinct tokens, aggregated before the shuffle.

Positions are found without Python: a text split at a pattern gives the lengths between the matches, and running
sums over stretches of ``STRETCH`` matches give their places, in code points. The patterns have possessive loops, which
match the same and can't run deep on long digit strings. Spans of a kind don't overlap and are in order, so a token
finds the one that may overlap it by binary search; ``redact`` cuts a text into blocks of ``BLOCK`` characters first and
takes each piece from its blocks. So a text with many matches takes time in proportion to them (and the search's logarithm).

Defined cases: null text is empty; rows repeated with one id and text have the same spans; rows of one id with different
texts are told apart by a hash; null ids pass through; an empty table gives an empty result; columns other than id and
text are not used, and pass through ``redact``, whatever their names; long texts are read whole; words of any length, and
any white space between, are context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, fresh, quoted, stored

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns; the email's and ip's starts are the leftmost ones in a run of their characters.
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP_OK = rf"^{BYTE}(?:\.{BYTE}){{3}}$"
WHITE = r"\x20\x09-\x0D"
#: The last word of what stands before a token, the first of what stands after it.
BEFORE, AFTER = rf"(?<![^{WHITE}])([^{WHITE}]++)[{WHITE}]++$", rf"^[{WHITE}]++([^{WHITE}]++)"
#: A word with a digit or @, from its start.
TOKEN = rf"(?<![^{WHITE}])[^{WHITE}0-9@]*+[0-9@][^{WHITE}]*+"
LEAD, TAIL = r"""^["'(<\[{]*""", r"""[.,;:!?"')>\]}]*$"""
STRETCH, BLOCK = 64, 1024
PRIOR, MIN_SEEDS, MIN_CONFIDENCE, MIN_BELIEF = 2.0, 3, 0.5, 0.7
#: Rounds go on while a belief rises by more.
SETTLED = 1e-9


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("int"), lambda a, x: a + x)


def running(values: Column, join, start: Column) -> Column:
    """What ``join`` makes of the first STRETCH * k values, for each k: a short array, from which the rest follows."""
    return F.aggregate(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STRETCH).cast("int")),
        F.array(start),
        lambda acc, k: F.concat(acc, F.array(join(F.element_at(acc, -1), F.slice(values, k * STRETCH + 1, STRETCH)))),
    )


def located(df: DataFrame, name: str, pattern: str, gate: Column, text: str = "_text") -> DataFrame:
    """Column ``name``: the matches in order, as structs (n, start, end, value); _name_p: the texts between them."""
    f, p, w, b = (f"_{name}_{x}" for x in "fpwb")
    none = F.array().cast("array<string>")
    df = df.withColumn(f, F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    some = F.size(f) > 0
    df = df.withColumn(p, F.when(some, F.split(F.col(text), pattern, -1)).otherwise(none))
    df = df.withColumn(w, F.zip_with(F.slice(p, 1, F.size(f)), f, lambda x, y: F.char_length(x) + F.char_length(y)))
    base = running(F.col(w), lambda total, some: total + _sum(some), F.lit(0).cast("int"))
    df = df.withColumn(b, F.when(some, base).otherwise(F.array().cast("array<int>")))

    def span(value: Column, i: Column) -> Column:
        within = (i % STRETCH).cast("int")
        start = F.get(F.col(b), F.floor(i / STRETCH).cast("int")) + _sum(F.slice(w, i - within + 1, within)) + F.char_length(F.get(F.col(p), i))
        return F.struct(i.alias("n"), start.alias("start"), (start + F.char_length(value)).alias("end"), value.alias("value"))

    return df.withColumn(name, F.transform(f, span))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def overlaps(spans: Column, token: Column) -> Column:
    """Whether one of ``spans`` (in order, none overlapping another) overlaps ``token``: only the first that ends after the
    token's start can, and binary search finds it."""
    n = F.size(spans)
    steps = F.sequence(F.lit(1), F.ceil(F.log2(n + F.lit(1.0))).cast("int"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        beyond = F.get(spans, middle)["end"] > token["start"]
        low = F.when((at["low"] < at["high"]) & ~beyond, middle + 1).otherwise(at["low"])
        high = F.when((at["low"] < at["high"]) & beyond, middle).otherwise(at["high"])
        return F.struct(low.alias("low"), high.alias("high"))

    first = F.aggregate(steps, F.struct(F.lit(0).alias("low"), n.alias("high")), halve)["low"]
    return F.when(n > 0, F.coalesce(F.get(spans, first)["start"] < token["end"], F.lit(False))).otherwise(F.lit(False))


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, base (array of kind, start, end) and tokens (start, end, value, left, right, seed)."""
    df = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.xxhash64(quoted(text)).alias("text_key"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("_text"))
    df = df.withColumn("_at", F.contains("_text", F.lit("@"))).withColumn("_digit", F.col("_text").rlike("[0-9]"))
    df = located(df, "email", EMAIL, F.col("_at"))
    df = located(df, "ip", IP, F.col("_digit") & F.col("_text").rlike(r"[0-9]\.[0-9]"))
    df = located(df, "card", CARD, F.col("_digit"))
    df = located(df, "phone", PHONE, F.col("_digit") & F.contains("_text", F.lit("+")))
    df = located(df, "tokens", TOKEN, F.col("_digit") | F.col("_at"))
    card = lambda s: (F.length(_digits(s["value"])).between(16, 19)) & F.when(F.length(_digits(s["value"])).between(16, 19), _luhn(_digits(s["value"]))).otherwise(False)
    rules = {"email": lambda s: F.lit(True), "ip": lambda s: s["value"].rlike(IP_OK), "card": card, "phone": lambda s: F.length(_digits(s["value"])).between(8, 15)}
    tagged = lambda k: lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    for k in KINDS:
        df = df.withColumn(f"_{k}_spans", F.transform(F.filter(k, rules[k]), tagged(k)))

    def core(s: Column) -> Column:
        lead = F.char_length(F.regexp_extract(s["value"], LEAD, 0))
        word = F.regexp_replace(F.regexp_replace(s["value"], LEAD, ""), TAIL, "")
        return F.struct(s["n"].alias("n"), (s["start"] + lead).alias("start"), (s["start"] + lead + F.char_length(word)).alias("end"), word.alias("value"))

    def judged(s: Column) -> Column:
        seed = F.lit(False)
        for k in KINDS:
            seed = seed | overlaps(F.col(f"_{k}_spans"), s)
        return F.struct(*[s[c].alias(c) for c in ("n", "start", "end", "value")], seed.alias("seed"))

    df = df.withColumn("_cores", F.transform("tokens", core))
    df = df.withColumn("_cores", F.transform("_cores", judged))
    # seeds of any shape teach patterns; what patterns may find has the shape of an identifier
    df = df.withColumn("_cores", F.filter("_cores", lambda s: s["seed"] | ((F.char_length(s["value"]) >= 8) & (F.length(_digits(s["value"])) >= 4))))
    left = lambda s: F.lower(F.regexp_extract(F.get(F.col("_tokens_p"), s["n"]), BEFORE, 1))
    right = lambda s: F.lower(F.regexp_extract(F.get(F.col("_tokens_p"), s["n"] + 1), AFTER, 1))
    tokens = F.transform("_cores", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), left(s).alias("left"), right(s).alias("right"), s["seed"].alias("seed")))
    return df.select("doc_id", "text_key", F.concat(*[f"_{k}_spans" for k in KINDS]).alias("base"), tokens.alias("tokens"))


def believed(marks: DataFrame) -> DataFrame:
    """Values that are spans where base patterns miss them: those that confident patterns extract, by bootstrapping on the
    graph of patterns and tokens, and seeds that occur elsewhere without a base span."""
    t = marks.where(F.size("tokens") > 0).select(F.explode("tokens").alias("t")).select("t.value", "t.left", "t.right", "t.seed")
    seeds = t.groupBy("value").agg(F.max("seed").alias("seed"), F.min("seed").alias("always"))
    missed = seeds.where(F.col("seed") & ~F.col("always")).select("value")
    seeds = seeds.select("value", "seed")
    edges = t.select("value", F.explode(F.array(F.concat(F.lit("L:"), "left"), F.concat(F.lit("R:"), "right"))).alias("pattern"))
    edges = edges.where(F.length("pattern") > 2).distinct().join(seeds, "value")
    # only patterns that seeds have induced matter
    induced = edges.groupBy("pattern").agg(F.count_if("seed").alias("seeds")).where(F.col("seeds") >= MIN_SEEDS).select("pattern")
    edges = stored(edges.join(induced, "pattern"), "pii-graph")
    belief, superseded = edges.select("value", F.col("seed").cast("double").alias("belief")).distinct(), None
    while True:
        weighed = edges.join(belief, "value")
        confident = weighed.groupBy("pattern").agg((F.sum("belief") / (F.count(F.lit(1)) + PRIOR)).alias("confidence"))
        doubt = F.log(1 - F.least(F.when(F.col("confidence") >= MIN_CONFIDENCE, F.col("confidence")).otherwise(0.0), F.lit(0.999999)))
        now = edges.join(confident, "pattern").groupBy("value").agg(F.max("seed").alias("seed"), (1 - F.exp(F.sum(doubt))).alias("b"))
        before, belief = belief, stored(now.select("value", F.when(F.col("seed"), 1.0).otherwise(F.col("b")).alias("belief")), "pii-belief")
        risen = belief.join(before.withColumnRenamed("belief", "was"), "value").agg(F.max(F.col("belief") - F.col("was"))).first()[0]
        if superseded is not None:
            dropped(superseded)
        superseded = belief
        if risen is None or risen <= SETTLED:
            break
    fresh = belief.join(seeds.where(~F.col("seed")).select("value"), "value")
    return fresh.where(F.col("belief") >= MIN_BELIEF).select("value").unionByName(missed)


def all_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, base and more (arrays of kind, start, end), a row for each row of ``docs``."""
    marks = stored(scanned(docs, doc_id, text), "pii-marks")
    found = marks.where(F.size("tokens") > 0).select("doc_id", "text_key", F.explode("tokens").alias("t")).where(~F.col("t.seed"))
    found = found.select("doc_id", "text_key", F.col("t.value").alias("value"), F.struct(F.lit("id").alias("kind"), F.col("t.start").alias("start"), F.col("t.end").alias("end")).alias("span"))
    found = found.join(believed(marks), "value").groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("span")).alias("more"))
    same = F.col("m.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("m.text_key") == F.col("f.text_key"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return marks.alias("m").join(found.alias("f"), same, "left").select("m.doc_id", "m.text_key", "m.base", F.coalesce("f.more", none).alias("more"))


def named(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id (spans that the contexts add), n_spans (all) for
    every row."""
    out = all_spans(docs, doc_id, text)
    is_kind = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("base", is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    more = [F.size("more").cast("long").alias("n_id"), (F.size("base") + F.size("more")).cast("long").alias("n_spans")]
    return out.select("doc_id", *counts, F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(F.concat("base", "more")).alias("spans"), *more)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: a column read once, in a lambda, would be put there and computed for
    each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def united(spans: Column) -> Column:
    """``spans`` (structs of start, end, kind, in order) with overlapping ones as one, of the first one's kind."""
    places = F.sequence(F.lit(0), F.size(spans) - 1)

    def highest(ends: Column, base: Column) -> Column:
        """For each place, the highest end so far."""

        def upto(i: Column) -> Column:
            within = (i % STRETCH).cast("int")
            return F.greatest(F.get(base, F.floor(i / STRETCH).cast("int")), F.array_max(F.slice(ends, i - within + 1, within + 1)))

        return F.transform(places, upto)

    def joined(upto: Column) -> Column:
        first = F.filter(places, lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get(upto, F.greatest(i - 1, F.lit(0)))))

        def one(heads: Column) -> Column:
            end = lambda g: F.get(upto, F.coalesce(F.get(heads, g + 1), F.size(spans)) - 1)
            return F.transform(heads, lambda i, g: F.struct(F.get(spans, i)["start"].alias("start"), end(g).alias("end"), F.get(spans, i)["kind"].alias("kind")))

        return let(first, one)

    ends = F.transform(spans, lambda s: s["end"])
    most = lambda e: running(e, lambda high, some: F.greatest(high, F.array_max(some)), F.lit(0))
    return let(let(ends, lambda e: let(most(e), lambda b: highest(e, b))), joined)


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; overlapping spans become the first one's."""
    own_id, own_key, spans, blocks = fresh(docs.columns, "own_id", "own_key", "spans", "blocks")
    found = all_spans(docs, doc_id, text).where(F.size("base") + F.size("more") > 0).groupBy("doc_id", "text_key").agg(F.first(F.concat("base", "more")).alias("found"))
    order = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    found = found.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key), let(F.array_sort(order), united).alias(spans))
    body = F.col(quoted(text))
    rows = docs.join(found, F.col(quoted(doc_id)).eqNullSafe(F.col(own_id)) & (F.xxhash64(body) == F.col(own_key)), "left")
    rows = rows.withColumn(blocks, F.when(F.col(spans).isNotNull(), F.regexp_extract_all(body, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))
    block = lambda k: F.get(F.col(blocks), k)

    def piece(start: Column, end: Column) -> Column:
        """The characters from ``start`` to ``end``."""
        a, b = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
        x, y = start - a * BLOCK, end - b * BLOCK
        head, tail = F.substring(block(a), x + 1, F.lit(BLOCK)), F.coalesce(F.substring(block(b), F.lit(1), y), F.lit(""))
        between = F.array_join(F.slice(blocks, a + 2, F.greatest(b - a - 1, F.lit(0))), "")
        return F.when(a == b, F.coalesce(F.substring(block(a), x + 1, y - x), F.lit(""))).otherwise(F.concat(head, between, tail))

    before = lambda i: F.when(i > 0, F.get(F.col(spans), F.greatest(i - 1, F.lit(0)))["end"]).otherwise(F.lit(0))
    pieces = F.transform(spans, lambda s, i: F.concat(piece(before(i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    rest = piece(F.element_at(spans, -1)["end"], F.char_length(body))
    cleaned = F.when(F.col(spans).isNull(), body).otherwise(F.concat(F.array_join(pieces, ""), rest))
    return rows.select(*[cleaned.alias(c) if c == text else F.col(quoted(c)) for c in docs.columns])
