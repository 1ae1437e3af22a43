"""Personal data by candidate gradient boosting, in DataFrame operations throughout.

Base formats find e-mail addresses, IP addresses, card and phone numbers, which always count. Besides, wide
generators propose spans that may overlap these and each other: any chain of digits and separators, any address-like text,
spelled-out forms too, and of a chain with spaces every run of at most ``RUN`` pieces. Boosted trees score every proposal by features of its
format and context. Examples are base spans without the cue by which the base finds them, in their own context: addresses spelled out, phone
numbers without "+", country code or in other separators, cards in other groups, IP addresses made harmless.
Counterexamples are what is known not to be of the kind: examples taken for another kind, proposals on base spans of other kinds, parts of
longer tokens, dates, numbers behind words like "order", card-like numbers that fail the Luhn test, real ones with another last digit too, and, in the contexts of base spans, dates, stamps, codes, prices and numbers written
from a hash. All other proposals are of unknown truth and teach nothing. On a held-out half of the texts a threshold is set for each
kind so that nearly all above it are examples; proposals away from any base span that reach it are added, but for those inside another
added span of their kind.

The trees are fitted, and the thresholds set, on the forms of all base spans and all counterexamples; those of equal features are one weighted row.
Texts are searched whole; the patterns are written so that a long run of one character class takes linear time: a match starts at a run's
start or at the end of the last match, and quantifiers give nothing back where that can't help.

Defined results: a null text counts as empty and has no spans; rows of equal id and text get equal results; a null doc_id is a value like any
other; a kind without examples, or whose threshold can't be set, adds nothing to the base; an empty table gives an empty table; other columns play
no part. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismal.session import materialize

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be worth trying.
NEEDS = {"email": "@", "phone": "+"}
#: An "at" and a "dot", spelled out in brackets or between spaces, or as signs; "at the dot" is no address.
_WORD = "(?i:a|an|the|this|that|each|every|one|any|some|my|your|his|her|its|our|their|which)"
_AT = rf"(?:\x20?(?:@|[(\[{{](?i:at)[)\]}}])\x20?|\x20(?i:at)\x20(?!{_WORD}\x20)(?=[A-Za-z0-9-]++\x20(?i:dot)\x20))"
_DOT = r"(?:\x20?(?:\.|[(\[{](?i:dot)[)\]}])\x20?|\x20(?i:dot)\x20)"
WIDE = {
    "address": rf"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "digits": r"\(?[0-9](?:[\x20().-]{0,2}[0-9])++",
    "quads": r"(?:(?<![0-9])|\G)[0-9]{1,3}+(?:\x20?[(\[{]?(?:\.|(?i:dot))[)\]}]?\x20?[0-9]{1,3}+){3}(?![0-9])",
}
#: What a text must match for a wide pattern to be worth trying.
HINTS = {"address": r"@|(?i:at)[)\]}]|\x20(?i:dot)\x20", "digits": "[0-9]", "quads": "[0-9]"}
#: Kinds that a wide span is proposed as.
PROPOSED = {"address": ("email",), "digits": ("ip", "card", "phone"), "quads": ("ip",)}
#: Pieces of a chain that are proposed together.
RUN = 5
CONTEXT = 24
CLUES = {"phone": r"\b(?:tel|phone|call|fax|mobile|cell|text)", "card": r"\b(?:card|visa|credit|debit|pay)", "email": r"\b(?:mail|contact|write|reach)",
         "ip": r"\b(?:ip|host|server|address|addr|from)\b"}
#: Words, right before a number, by which it is no personal data.
COUNTER = r"\b(?:order|invoice|isbn|issn|version|ver|no|nr|number|ref|id|sku|item|part|page|build|ticket)\b[\s.:#=]*$"
DATE = r"(?:^|[^0-9])(?:(?:19|20)[0-9]{2}[.-][01]?[0-9][.-][0-3]?[0-9]|[0-3]?[0-9][.-][01]?[0-9][.-](?:19|20)[0-9]{2})(?:[^0-9]|$)"
FEATURES = ("kind", "n_chars", "n_digits", "n_groups", "first_group", "last_group", "longest_group", "n_spaces", "n_dashes", "n_dots", "n_brackets", "luhn",
            "octets", "before_letter", "before_digit", "after_letter", "after_digit", "clue", "distinct_digits", "counter", "date",
            "tail_letters")


def spans_of(name: str, pattern: str) -> Column:
    """All matches as an array of (idx, before, head, gap, match): ``gap`` is the length of the text since the last match."""
    text = F.col("text")
    tried = F.when(F.contains(text, F.lit(NEEDS[name])), text) if name in NEEDS else F.when(text.rlike(HINTS.get(name, "[0-9]")), text)
    matches = F.regexp_extract_all(tried, F.lit(pattern), F.lit(0))
    pieces = F.transform(F.split(tried, pattern, -1), lambda p: F.struct(
        F.length(p).alias("gap"), F.right(p, F.lit(CONTEXT)).alias("before"), F.left(p, F.lit(CONTEXT)).alias("after")))
    numbered = F.transform(matches, lambda m, i: F.struct(
        F.lit(name).alias("pattern"), i.alias("idx"), m.alias("match"), F.get(pieces, i)["gap"].alias("gap"),
        F.get(pieces, i)["before"].alias("before"), F.get(pieces, i + 1)["after"].alias("after")))
    return F.coalesce(numbered, F.array())


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string of at most 19 passes the Luhn test."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: (
        F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0


def octets(match: Column) -> Column:
    """Whether all parts between dots are numbers of at most 255."""
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return match.rlike(rf"^{part}(?:\.{part}){{3}}$")


def passes(kind: Column, match: Column) -> Column:
    """The base formats' further conditions."""
    digits = digits_of(match)
    n = F.length(digits)
    return (F.when(kind == "email", F.lit(True)).when(kind == "ip", octets(match))
            .when(kind == "card", F.when(n.between(16, 19), luhn(digits)).otherwise(False)).otherwise(n.between(8, 15)))


def matches(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A row for each match of a base or wide pattern, with its place: ``doc_id``, ``hash``, ``pattern``, ``start``, ``end``, ``match``, ``before``, ``after``."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("hash", F.unhex(F.md5("text")))
    found = docs.select("doc_id", "hash", F.explode(F.concat(*[spans_of(n, p) for n, p in {**BASE, **WIDE}.items()])).alias("m")).select("doc_id", "hash", "m.*")
    found = found.dropDuplicates(["doc_id", "hash", "pattern", "idx"])  # rows of equal id and text are found alike
    upto = Window.partitionBy("doc_id", "hash", "pattern").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = F.length("match")
    found = found.withColumn("end", F.sum(F.col("gap") + length).over(upto)).withColumn("start", F.col("end") - length)
    return found.drop("idx", "gap")


def featured(proposals: DataFrame) -> DataFrame:
    """Adds the features of a proposal's format and context."""
    m, digits = F.col("match"), digits_of(F.col("match"))
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: F.length(g) > 0)
    sizes = F.transform(groups, lambda g: F.length(g))
    n = F.length(digits)

    def count(pattern: str) -> Column:
        return F.length(m) - F.length(F.regexp_replace(m, pattern, ""))

    last, next_ = F.right("before", F.lit(1)), F.left("after", F.lit(1))
    clue = reduce(lambda a, b: a | b, [(F.col("as") == k) & F.lower("before").rlike(p) for k, p in CLUES.items()])
    values = {
        "kind": F.array_position(F.array(*map(F.lit, KINDS)), F.col("as")), "n_chars": F.length(m), "n_digits": n, "n_groups": F.size(groups),
        "first_group": F.coalesce(F.get(sizes, F.lit(0)), F.lit(0)), "last_group": F.coalesce(F.try_element_at(sizes, F.lit(-1)), F.lit(0)),
        "longest_group": F.coalesce(F.array_max(sizes), F.lit(0)), "n_spaces": count(" "), "n_dashes": count("-"), "n_dots": count("[.]"),
        "n_brackets": count("[()\\[\\]{}]"), "luhn": F.when(n.between(12, 19), luhn(digits)).otherwise(False), "octets": F.coalesce(F.size(groups) == 4, F.lit(False)) & F.forall(groups, lambda g: g.rlike("^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$")),
        "before_letter": last.rlike(r"\p{L}"), "before_digit": last.rlike("[0-9]"),
        "after_letter": next_.rlike(r"\p{L}"), "after_digit": next_.rlike("[0-9]"), "clue": clue,
        "distinct_digits": F.size(F.array_distinct(F.split(digits, ""))), "counter": F.lower("before").rlike(COUNTER), "date": m.rlike(DATE),
        "tail_letters": F.length(F.regexp_extract(m, "[A-Za-z]*$", 0)),
    }
    return proposals.withColumns({f"f_{k}": F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in values.items()})


def pieces(wide: DataFrame) -> DataFrame:
    """Runs of at most ``RUN`` pieces of the chains of digits with spaces, each with its place and context; whole chains are not repeated."""
    chain = wide.filter(F.col("pattern") == "digits").filter(F.contains("match", F.lit(" ")))
    tokens = chain.select("doc_id", "hash", F.col("start").alias("_at"), F.col("before").alias("_b"), F.col("after").alias("_a"),
                          F.posexplode(F.regexp_extract_all("match", F.lit(r"[^\x20]+\x20*"), F.lit(0))).alias("_i", "_t"))
    order = Window.partitionBy("doc_id", "hash", "_at").orderBy("_i")

    def joined(first: int, last: int) -> Column:
        return F.array_join(F.collect_list("_t").over(order.rowsBetween(first, last)), "")

    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "hash", "_at"))
    ends = F.sum(F.length("_t")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # A piece and its space take two characters or more, so this many pieces fill the context.
    runs = tokens.select("doc_id", "hash", "_b", "_a", "_i", n.alias("_n"), (F.col("_at") + ends - F.length("_t")).alias("start"),
                         joined(-CONTEXT, -1).alias("_past"), joined(0, RUN + CONTEXT).alias("_next"),
                         F.collect_list("_t").over(order.rowsBetween(0, RUN - 1)).alias("_run"))
    runs = runs.withColumn("_k", F.explode(F.sequence(F.lit(1), F.size("_run")))).filter("_k < _n")
    match = F.rtrim(F.array_join(F.slice("_run", F.lit(1), F.col("_k")), ""))
    ahead = F.concat(F.expr("substring(_next, length(match) + 1)"), F.when(F.col("_i") + RUN + CONTEXT + 1 >= F.col("_n"), F.col("_a")).otherwise(""))
    out = runs.withColumn("match", match).filter(F.col("match").rlike(r"^\(?[0-9].*[0-9]$")).select(
        "doc_id", "hash", F.lit("digits").alias("pattern"), "match", F.right(F.concat("_b", "_past"), F.lit(CONTEXT)).alias("before"),
        F.left(ahead, F.lit(CONTEXT)).alias("after"), (F.col("start") + F.length("match")).alias("end"), "start")
    return out


def as_kinds(wide: DataFrame) -> DataFrame:
    """A row for each kind (``as``) that a wide match may be by its pattern and number of digits."""
    kinds = reduce(lambda out, p: out.when(F.col("pattern") == p, F.array(*map(F.lit, PROPOSED[p]))), list(WIDE)[1:],
                   F.when(F.col("pattern") == "address", F.array(*map(F.lit, PROPOSED["address"]))))
    digits = F.length(digits_of(F.col("match")))
    four = (F.col("pattern") == "quads") | F.col("match").rlike(r"^[0-9]+(?:[\x20().-]+[0-9]+){3}$")
    fits = F.when(F.col("as") == "email", True).when(F.col("as") == "ip", four).when(F.col("as") == "card", digits.between(12, 19)).otherwise(digits.between(7, 15))
    return wide.withColumn("as", F.explode(kinds)).filter(fits)


def proposals(found: DataFrame) -> DataFrame:
    """Wide matches with the kinds they may be (``as``), and whether base spans of the kind (``own``) or of any (``any``) overlap them."""
    wide = found.filter(F.col("pattern").isin(*WIDE))
    wide = wide.unionByName(pieces(wide))
    # A number behind its country code is proposed by itself, too: its code may be anything.
    rest = F.regexp_extract("match", r"^[0-9]{1,3}[\x20.-]+(\(?[0-9].*)$", 1)
    national = wide.filter(F.col("pattern") == "digits").withColumn("_rest", rest).filter(F.length("_rest") > 0)
    national = national.withColumn("before", F.right(F.concat("before", F.expr("left(match, length(match) - length(_rest))")), F.lit(CONTEXT)))
    national = national.withColumn("start", F.col("end") - F.length("_rest")).withColumn("match", F.col("_rest")).drop("_rest")
    wide = as_kinds(wide).unionByName(as_kinds(national).filter(F.col("as") == "phone")).dropDuplicates(["doc_id", "hash", "start", "end", "as"])
    base = found.filter(F.col("pattern").isin(*KINDS) & passes(F.col("pattern"), F.col("match"))).withColumn("as", F.col("pattern"))
    rows = wide.unionByName(base)
    is_base = F.col("pattern").isin(*KINDS)
    # One walk along each document in both directions: the furthest end of base spans so far, the next base start.
    doc = Window.partitionBy("doc_id", "hash").orderBy("start", "end")
    back, ahead = doc.rowsBetween(Window.unboundedPreceding, Window.currentRow), doc.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    for k in KINDS:
        own = is_base & (F.col("as") == k)
        rows = rows.withColumn(f"_e_{k}", F.max(F.when(own, F.col("end"))).over(back)).withColumn(f"_s_{k}", F.min(F.when(own, F.col("start"))).over(ahead))

    def meets(k: str) -> Column:
        return (F.coalesce(F.col(f"_e_{k}"), F.lit(-1)) > F.col("start")) | (F.coalesce(F.col(f"_s_{k}"), F.lit(1 << 60)) < F.col("end"))

    any_ = reduce(lambda a, b: a | b, map(meets, KINDS))
    own_ = reduce(lambda a, b: a | b, [(F.col("as") == k) & meets(k) for k in KINDS])
    return rows.filter(~is_base).withColumn("any", any_).withColumn("own", own_).drop(*[f"_{x}_{k}" for k in KINDS for x in "es"])


def fours(c: Column, by: str) -> Column:
    """A string of digits in groups of four."""
    return F.regexp_replace(c, "([0-9]{4})(?=[0-9])", f"$1{by}")


def masked(base: DataFrame) -> DataFrame:
    """Base spans (``pattern``, ``match``) written in ways that the base formats don't find, as an array ``forms``."""
    m = F.col("match")
    name, site = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)

    def dots(c: Column, by: str) -> Column:
        return F.replace(c, F.lit("."), F.lit(by))

    bare = F.substring(m, F.lit(2), F.length(m))
    national = F.regexp_replace(bare, r"^[0-9]{1,3}[\x20.-]+", "")
    digits = digits_of(m)
    forms = (F.when(F.col("pattern") == "email", F.array(F.concat(name, F.lit(" (at) "), dots(site, " (dot) ")), F.concat(name, F.lit("[at]"), dots(site, "[dot]")),
                                                         F.concat(name, F.lit(" @ "), site), F.concat(name, F.lit(" at "), dots(site, " dot "))))
             .when(F.col("pattern") == "ip", F.array(dots(m, "[.]"), dots(m, " . "), dots(m, "(dot)"), dots(m, " dot ")))
             .when(F.col("pattern") == "card", F.array(digits, fours(digits, " "), fours(digits, "."), fours(digits, "  ")))
             .otherwise(F.array(bare, F.concat(F.lit("00"), bare), national, F.regexp_replace(F.regexp_replace(national, "[()]", ""), r"[\x20-]+", "."),
                                F.regexp_replace(F.regexp_replace(national, "[()]", ""), r"[.-]+", " "))))
    return base.withColumn("forms", F.array_distinct(forms))


def strangers(base: DataFrame) -> DataFrame:
    """Numbers and prices written from a hash that are of no kind, and cards with another last digit, as an array ``forms``, in the contexts of base spans."""
    def drawn(i: int) -> Column:
        return F.lpad(F.pmod(F.xxhash64("match", "start", "hash", F.lit(i)), F.lit(10**17)).cast("string"), 17, "0")

    z = F.concat(drawn(1), drawn(2), drawn(3))

    def cut(at: int, n: int) -> Column:
        return F.substring(z, at, n)

    day = F.concat(F.lit("20"), cut(1, 2), F.lit("-0"), F.pmod(cut(3, 1).cast("int"), F.lit(9)) + 1, F.lit("-1"), cut(4, 1))
    length = F.pmod(cut(20, 5).cast("int"), F.lit(13)) + 7
    beyond = [F.concat((F.pmod(cut(i, 1).cast("int"), F.lit(7)) + 3).cast("string"), cut(i + 1, 2)) for i in (5, 8, 11, 14)]
    numbers = [day, F.concat(F.replace(day, F.lit("-"), F.lit("")), cut(5, 6)), F.concat(F.lit("1"), cut(6, 9)), F.concat(F.lit("1"), cut(6, 12)),
               F.substring(F.concat(F.lit("7"), z), F.lit(1), length), F.concat_ws("-", cut(7, 2), cut(9, 4), cut(13, 2)), F.concat_ws(".", cut(7, 4), cut(11, 5)),
               F.concat(F.lit("978-3-"), cut(8, 2), F.lit("-"), cut(10, 6), F.lit("-"), cut(16, 1)), F.concat(day, F.lit(" "), cut(17, 4)),
               F.concat_ws("[.]", *beyond), F.concat_ws(" . ", *beyond), F.concat_ws(" dot ", *beyond), F.concat_ws(" ", *[cut(i, 2) for i in range(7, 19, 2)])]
    prices = [F.concat(cut(1, 2), F.lit(" @ "), cut(3, 1), F.lit("."), cut(4, 2)), F.concat(F.lit("lunch (at) 1"), cut(1, 1), F.lit("."), cut(2, 2)),
              F.concat(F.lit("release @ "), F.concat_ws(".", cut(1, 1), cut(2, 1), cut(3, 1))), F.concat(F.lit("sold at "), cut(4, 2), F.lit(" dot "), cut(6, 2))]
    digits = digits_of(F.col("match"))
    other = F.concat(F.left(digits, F.length(digits) - 1), F.pmod(F.right(digits, F.lit(1)).cast("int") + 1 + F.pmod(cut(1, 9).cast("int"), F.lit(9)), F.lit(10)).cast("string"))
    return base.withColumn("forms", F.when(F.col("pattern") == "email", F.array(*prices)).when(
        F.col("pattern") == "card", F.array(*numbers, other, fours(other, " "), fours(other, "."))).otherwise(F.array(*numbers)))


def formed(rows: DataFrame) -> DataFrame:
    """A row for each of ``forms`` that a wide pattern takes whole, and each kind it may be; ``kind`` is that of the base span."""
    rows = rows.withColumn("kind", F.col("pattern")).withColumn("match", F.explode("forms")).drop("forms", "pattern")
    taken = F.array(*[F.when(F.col("match").rlike(f"^(?:{p})$"), F.lit(name)) for name, p in WIDE.items()])
    rows = rows.withColumn("pattern", F.explode(F.array_compact(taken)))
    return as_kinds(rows).dropDuplicates(["doc_id", "hash", "start", "match", "as"])


def examples(found: DataFrame, wide: DataFrame, most_examples: int | None = None, seed: int = 7) -> DataFrame | None:
    """Examples and counterexamples (``label`` 1 and 0) with their features; nothing without base spans. All of them, unless a caller asks for fewer."""
    mine = F.pmod(F.xxhash64("doc_id", "hash", "start", F.lit(seed)), F.lit(1 << 20))

    def at_most(rows: DataFrame, kind: str) -> DataFrame:
        if most_examples is None:
            return rows
        sizes = {r[kind]: r["count"] for r in rows.groupBy(kind).count().collect()}  # a row for each of the four kinds
        share = F.coalesce(*[F.when(F.col(kind) == k, F.lit(min(1.0, most_examples / n))) for k, n in sizes.items()], F.lit(0.0))
        return rows.filter(mine < share * (1 << 20))

    base = at_most(found.filter(F.col("pattern").isin(*KINDS)).filter(passes(F.col("pattern"), F.col("match"))), "pattern")
    if base.isEmpty():
        return None
    good = formed(masked(base)).withColumn("label", (F.col("as") == F.col("kind")).cast("double")).drop("kind")
    bad = formed(strangers(base)).withColumn("label", F.lit(0.0)).drop("kind")
    # A part of a longer token, a date, a number behind a counter-clue, a failing check digit, or what a base span of another kind covers.
    inside = F.col("f_before_letter") + F.col("f_after_letter") + F.col("f_counter") + F.col("f_date") > 0
    invalid = (F.col("as") == "card") & (F.col("f_luhn") == 0)
    known = wide.filter(~F.col("own") & (F.col("any") | invalid | ((F.col("as") != "email") & inside)))
    known = at_most(known, "as").withColumn("label", F.lit(0.0))
    made = featured(good.unionByName(bad))
    return made.unionByName(known.select(*made.columns))


def fit(chosen: DataFrame | None, precision: float = 0.95, iterations: int = 20, depth: int = 4, seed: int = 7):
    """The boosted trees, each kind's threshold, and the share of held-out examples that reach it; nothing where a class is missing."""
    if chosen is None:
        return None, {}, {}
    # Trees and thresholds see an example's features, kind and label alone.
    features = [f"f_{c}" for c in FEATURES]
    chosen = materialize(chosen, "made")  # so that no feature is taken again for the groups
    chosen = chosen.groupBy((F.pmod(F.xxhash64("hash", F.lit(seed)), F.lit(2)) == 1).alias("_test"), "as", "label", *features).agg(F.count(F.lit(1)).cast("double").alias("n"))
    chosen = materialize(chosen, "examples")
    assemble = VectorAssembler(inputCols=[f"f_{c}" for c in FEATURES], outputCol="v")
    train = assemble.transform(chosen.filter("NOT _test")).select("v", "label", "n")
    if train.select("label").distinct().count() < 2:
        return None, {}, {}
    model = GBTClassifier(featuresCol="v", labelCol="label", weightCol="n", maxIter=iterations, maxDepth=depth, seed=seed).fit(train)
    tested = probability(model, chosen.filter("_test")).groupBy("as", F.floor(F.col("p") * 1000).cast("int").alias("step")).agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")).collect()
    limits, found = {}, {}
    for kind in KINDS:
        good = n = 0
        own = sorted((r for r in tested if r["as"] == kind), key=lambda r: -r["step"])
        for r in own:
            if r["step"] < 500:
                break
            good, n = good + r["good"], n + r["n"]
            if good >= precision * n and good:
                limits[kind], found[kind] = r["step"] / 1000, good / sum(x["good"] for x in own)
    return model, limits, found


def probability(model, rows: DataFrame) -> DataFrame:
    assemble = VectorAssembler(inputCols=[f"f_{c}" for c in FEATURES], outputCol="v")
    return model.transform(assemble.transform(rows)).withColumn("p", vector_to_array("probability")[1]).drop("v", "rawPrediction", "probability", "prediction")


def spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text", most_examples: int | None = None, seed: int = 7, **options) -> DataFrame:
    """All spans: ``doc_id``, ``hash`` (md5 of the text), ``kind``, ``start``, ``end``, ``added`` (by the trees), ``score``."""
    found = materialize(matches(df, doc_id, text), "matches")
    base = found.filter(F.col("pattern").isin(*KINDS)).filter(passes(F.col("pattern"), F.col("match"))).select(
        "doc_id", "hash", F.col("pattern").alias("kind"), "start", "end", F.lit(False).alias("added"), F.lit(1.0).alias("score"))
    wide = materialize(featured(proposals(found)), "proposals")
    model, limits, _ = fit(examples(found, wide, most_examples, seed), seed=seed, **options)
    if not limits:
        return base
    scored = probability(model, wide.filter("NOT any"))
    limit = F.coalesce(*[F.when(F.col("as") == k, F.lit(t)) for k, t in limits.items()], F.lit(2.0))
    # Of the kinds that one span reaches the threshold for, the likeliest is taken.
    more = scored.filter(F.col("p") >= limit).groupBy("doc_id", "hash", "start", "end").agg(F.max(F.struct("p", "as")).alias("b"))
    more = more.select("doc_id", "hash", F.col("b.as").alias("kind"), "start", "end", F.lit(True).alias("added"), F.col("b.p").alias("score"))
    wider = Window.partitionBy("doc_id", "hash", "kind").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    more = more.withColumn("_upto", F.max("end").over(wider)).filter(F.col("_upto").isNull() | (F.col("_upto") < F.col("end"))).drop("_upto")
    return base.unionByName(more)


def find(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: counts of base spans, their digest and all spans as text."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    entry = F.struct(order.alias("k"), "start", "end", F.concat_ws(":", "kind", "start", "end").alias("s"), "added")
    per = spans(df, doc_id, text, **options).groupBy("doc_id", "hash").agg(F.sort_array(F.collect_list(entry)).alias("all"))
    base = F.filter("all", lambda e: ~e["added"])
    per = per.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), F.array_join(F.transform("all", lambda e: e["s"]), ",").alias("spans"),
                     F.array_join(F.transform(base, lambda e: e["s"]), ",").alias("_base"),
                     *[F.size(F.filter(base, _is_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS, 1)])
    docs = df.select(F.col(doc_id).alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))).alias("hash"))
    out = docs.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
                      F.sha2(F.coalesce("_base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def _is_kind(number: int):
    return lambda e: e["k"] == number


def redact(df: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text", mask: str = "[{}]") -> DataFrame:
    """``df`` with every span of its text replaced by its kind in brackets; of overlapping spans the first is named and all are covered."""
    per = found.groupBy("doc_id", "hash").agg(F.sort_array(F.collect_list(F.struct("start", (-F.col("end")).alias("e"), "kind"))).alias("_all"))
    per = per.withColumnsRenamed({"doc_id": "_id", "hash": "_hash"})
    own = df.withColumn("_h", F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))))
    joined = own.join(per, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")), "left")
    before, after = (mask.split("{}") + [""])[:2]
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    walked = F.aggregate("_all", start, lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], -s["e"]).alias("at"), a["out"].alias("out"))).otherwise(
        F.struct((-s["e"]).alias("at"), F.concat(a["out"], F.substring(F.col(text), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")),
                                                 F.lit(before), s["kind"], F.lit(after)).alias("out"))))
    done = joined.withColumn("_w", walked)
    covered = F.when(F.col("_all").isNull(), F.col(text)).otherwise(F.concat(F.col("_w.out"), F.substring(F.col(text), (F.col("_w.at") + 1).cast("int"), F.length(text))))
    return done.withColumn(text, covered).drop("_h", "_id", "_hash", "_all", "_w")
