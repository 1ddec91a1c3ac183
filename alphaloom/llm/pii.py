"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Seeds are what the four exact formats find: mail addresses, IPv4 addresses, payment card numbers
that pass the check digit, phone numbers. Each place in a text where an identifier may stand - a
seed, or a run of words that hold digits or an at sign - is an instance with three lexical patterns:
its shape with the word before it, its shape with the word after it, and, whatever its shape, the
two words with a coarse class: an at sign, many digits or few. A shape writes runs of letters as
``a``, of digits as their number, and keeps the rest. So a sure pair of words proves shapes that no
exact format has, and these prove other pairs of words.

The graph of patterns and instances is scored round by round. A pattern's score for a kind is the
mean score of its instances, seeds of the kind counting 1, seeds of other kinds 0 and other
instances half their score so far, pulled towards 0 while its instances are few; an instance that is no seed then takes the chance that at
least one of its patterns by shape is right, after a pattern's own doubt, or that of its pair of
words if it is larger. What one of the two ways makes sure counts in full for the patterns of the other, never for its own. Patterns above ``CONFIDENT``
give their kind to the instances that no exact format knows: the method adds those spans and takes
none away. All instances of the corpus take part; sums are made per pattern and per instance text,
never in one task for all.

Whole texts are searched for identifiers. Only the context beside an instance is bounded: its words
are looked for among the 40 characters on either side, and 30 characters of a word stand for it.

Defined results: a null text is empty and holds nothing; a null id is kept; repeated rows give
repeated results; very long runs of digits or letters are matched without backtracking; an empty
table gives an empty table; other columns are kept by ``redact`` and dropped by ``find``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.common import row_key, stored

KINDS = ("email", "ip", "card", "phone")
#: The exact formats. Possessive runs and the looks behind match what the plain forms match first,
#: in time that is linear in the text.
FORMATS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the format to be looked for at all.
NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": "[+]"}
#: Where identifiers may stand: a run of words with a digit or an at sign, digits groups together.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+(?:\x20[(]?[0-9][0-9().-]*+(?![^\x20\x09-\x0D.,;:!?]))*+"
EDGES = r"^[^A-Za-z0-9+(]+|[^A-Za-z0-9)]+$"
#: From how many digits an instance without an at sign has many.
MANY = 7
ROUNDS = 4
CONFIDENT = 0.9
#: A pattern of n instances with mean score m scores m * n / (n + DOUBT).
DOUBT = 1.0
#: How far a single pattern is trusted when an instance has two.
TRUST = 0.95
#: What an instance that is no seed gives its patterns of its own score, so that they don't prove each other.
HELD = 0.5


def _luhn(digits: Column) -> Column:
    """The check digit of a string of digits: every second digit from the right doubled."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(numbers, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(found, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 4).try_cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


MATCH = "struct<start:int,end:int,found:string,before:string,after:string>"
#: Matches whose places are added up together; the sums of such groups then place the groups.
GROUP = 128


def _matches(text: Column, pattern: str) -> Column:
    """(start, end, found, before, after) of the leftmost matches that don't overlap, in code points.

    The parts between matches give the places: a match starts where the parts and the matches
    before it end. ``before`` and ``after`` are up to 40 characters beside it, from the parts and
    matches next to it.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.split(text, pattern, -1)
    rows = F.zip_with(
        F.slice(parts, F.lit(1), F.size(found)),
        F.arrays_zip(found.alias("found"), F.concat(F.array(F.lit("")), found).alias("last"), F.slice(F.concat(found, F.array(F.lit(""))), 2, 2**30).alias("next"), F.slice(parts, 2, 2**30).alias("part")),
        lambda part, f: F.struct(
            F.length(part).alias("gap"),
            f["found"].alias("found"),
            F.right(F.concat(f["last"], part), F.lit(40)).alias("before"),
            F.left(F.concat(f["part"], f["next"]), F.lit(40)).alias("after"),
        ),
    )
    # arrays_zip has one row more than there are matches, the last match as "last".
    rows = F.slice(rows, F.lit(1), F.size(found))
    parted = lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / GROUP).cast("int")), lambda g: F.slice(r, g * GROUP + 1, GROUP))
    total = lambda g: F.aggregate(g, F.lit(0), lambda a, r: a + r["gap"] + F.length(r["found"]))
    none = F.array().cast(f"array<{MATCH}>")

    def place(state: Column, r: Column) -> Column:
        start = state["at"] + r["gap"]
        end = start + F.length(r["found"])
        row = F.struct(start.alias("start"), end.alias("end"), r["found"].alias("found"), r["before"].alias("before"), r["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(state["done"], F.array(row)).alias("done"))

    def join(state: Column, g: Column) -> Column:
        return F.struct((state["at"] + total(g)).alias("at"), F.concat(state["done"], F.array(F.aggregate(g, F.struct(state["at"].alias("at"), none.alias("done")), place)["done"])).alias("done"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{MATCH}>>").alias("done"))
    # In an array of one, so that a lambda's variable holds the rows and they are made once.
    placed = F.transform(F.array(rows), lambda r: F.flatten(F.aggregate(parted(r), start, join)["done"]))
    return F.when(F.size(found) > 0, F.get(placed, F.lit(0))).otherwise(none)


def base_spans(text: Column) -> Column:
    """All spans of the exact formats, by kind as listed, then by start."""
    nothing = F.array().cast(f"array<struct<kind:int,{MATCH[7:]}>")

    def of(k: int, kind: str) -> Column:
        valid = F.filter(_matches(text, FORMATS[kind]), lambda m: _valid(kind, m["found"]))
        marked = F.transform(valid, lambda m: F.struct(F.lit(k).alias("kind"), *(m[c].alias(c) for c in ("start", "end", "found", "before", "after"))))
        return F.when(text.rlike(NEEDS[kind]), marked).otherwise(nothing)

    return F.concat(*(of(k, kind) for k, kind in enumerate(KINDS)))


def _shape(found: Column) -> Column:
    """Letters as a, each run of digits as its length, other characters as they are."""
    runs = F.regexp_replace(found, r"\p{L}++", "a")
    for n in range(19, 0, -1):
        runs = F.regexp_replace(runs, rf"(?<![0-9<])[0-9]{{{n}}}(?![0-9>])", f"<{n}>")
    return F.regexp_replace(runs, r"(?<![0-9<])[0-9]++(?!>)", "<+>")


def _instance(kind: Column, m: Column) -> Column:
    """A match with its two patterns by shape, and that of the words beside it (null without both)."""
    left = F.regexp_extract(m["before"], r"([^\x20\x09-\x0D]{1,30})[\x20\x09-\x0D]+[^A-Za-z0-9\x20\x09-\x0D]{0,4}$", 1)
    right = F.regexp_extract(m["after"], r"^[^A-Za-z0-9\x20\x09-\x0D]{0,4}[\x20\x09-\x0D]+([^\x20\x09-\x0D]{1,30})", 1)
    shape = _shape(m["found"])
    digits = F.length(F.regexp_replace(m["found"], "[^0-9]", ""))
    coarse = F.when(F.contains(m["found"], F.lit("@")), "@").when(digits >= MANY, "#").otherwise("n")
    pair = F.when((left != "") & (right != ""), F.concat_ws(" ", F.lower(left), coarse, F.lower(right)))
    return F.struct(kind.alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.concat_ws(" ", F.lit("<"), F.lower(left), shape).alias("left"), F.concat_ws(" ", F.lit(">"), shape, F.lower(right)).alias("right"), pair.alias("pair"))


def _marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, row_key, base, instances) of each row, made in one pass; the text is left behind."""
    own = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    places = F.array().cast(f"array<{MATCH}>")
    own = own.select("*", base_spans(F.col("text")).alias("spans"), F.when(F.col("text").rlike("[0-9@]"), _matches(F.col("text"), CANDIDATE)).otherwise(places).alias("open"))

    def trimmed(c: Column) -> Column:
        start = c["start"] + F.length(F.regexp_extract(c["found"], r"^[^A-Za-z0-9+(]*", 0))
        found = F.regexp_replace(c["found"], EDGES, "")
        # What is trimmed off stands beside the rest.
        after = F.concat(F.substring(c["found"], start - c["start"] + F.length(found) + 1, F.lit(40)), c["after"])
        return F.struct(start.alias("start"), (start + F.length(found)).alias("end"), found.alias("found"), c["before"].alias("before"), after.alias("after"))

    open_ = F.filter(F.transform("open", trimmed), lambda c: (c["end"] > c["start"]) & ~F.exists("spans", lambda s: (s["start"] < c["end"]) & (s["end"] > c["start"])))
    seeds = F.transform("spans", lambda s: _instance(s["kind"], s))
    unknown = F.transform(open_, lambda c: _instance(F.lit(None).cast("int"), c))
    base = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return own.select("doc_id", "row_key", base.alias("base"), F.concat(seeds, unknown).alias("instances"))


def _discovered(instances: DataFrame) -> DataFrame:
    """(left, right, kind): the pairs of patterns that make an unknown instance one of a kind."""
    n = len(KINDS)
    seed = [F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"seed{k}") for k in range(n)]
    # Instances with the same patterns by shape share their words, and so score alike: an edge of the graph is a pair of patterns.
    edges = stored(instances.groupBy("left", "right", "pair").agg(F.count("*").alias("n"), F.sum(F.when(F.col("kind").isNull(), 1).otherwise(0)).alias("unknown"), *seed), "pii-edges")
    # Only patterns that a seed reaches by way of shared instances can ever score; the rest stays at 0.
    # s: the chance by the patterns by shape; w: by the pair of words; p: the larger one
    state = edges.select("*", *(F.lit(0.0).alias(f"{c}{k}") for k in range(n) for c in "swp"))
    for _ in range(ROUNDS):

        def mean(k: int, other: str) -> Column:
            sure = F.col(f"{other}{k}")
            held = F.greatest(F.lit(HELD) * F.col(f"p{k}"), F.when(sure >= F.lit(CONFIDENT), sure).otherwise(0.0))
            return F.sum(F.col(f"seed{k}") + F.col("unknown") * held) / (F.sum("n") + F.lit(DOUBT))

        by_left = state.groupBy("left").agg(*(mean(k, "w").alias(f"l{k}") for k in range(n)))
        by_right = state.groupBy("right").agg(*(mean(k, "w").alias(f"r{k}") for k in range(n)))
        by_pair = state.where("pair IS NOT NULL").groupBy("pair").agg(*(mean(k, "s").alias(f"b{k}") for k in range(n)))
        kept = ("left", "right", "pair", "n", "unknown", *(f"seed{k}" for k in range(n)))
        scored = state.where("unknown > 0").select(*kept).join(by_left, "left").join(by_right, "right").join(by_pair, "pair", "left")
        by_shape = [(1 - (1 - F.lit(TRUST) * F.col(f"l{k}")) * (1 - F.lit(TRUST) * F.col(f"r{k}"))).alias(f"s{k}") for k in range(n)]
        by_words = [(F.lit(TRUST) * F.coalesce(f"b{k}", F.lit(0.0))).alias(f"w{k}") for k in range(n)]
        scored = scored.select(*kept, *by_shape, *by_words).select("*", *(F.greatest(f"s{k}", f"w{k}").alias(f"p{k}") for k in range(n)))
        known = state.where("unknown = 0").select(*scored.columns)
        state = stored(scored.unionByName(known), "pii-round")
    best = F.greatest(*(F.col(f"p{k}") for k in range(n)))
    kind = F.coalesce(*(F.when(F.col(f"p{k}") == best, F.lit(k)) for k in range(n)))
    return state.where((F.col("unknown") > 0) & (best >= F.lit(CONFIDENT))).select("left", "right", kind.alias("new_kind"))


def _found(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, row_key, base, added): spans by the exact formats, and those that patterns add."""
    marked = stored(_marked(docs, doc_id, text), "pii-marked")
    instances = marked.select("row_key", F.explode("instances").alias("i")).select("row_key", "i.*")
    new = instances.where("kind IS NULL").join(_discovered(instances), ["left", "right"])
    added = stored(new.groupBy("row_key").agg(F.collect_set(F.struct(F.col("new_kind").alias("kind"), "start", "end")).alias("added")), "pii-added")
    nothing = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return marked.select("doc_id", "row_key", "base").join(added, "row_key", "left").withColumn("added", F.coalesce("added", nothing))


def written(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end), kinds as positions in ``KINDS``."""
    found = _found(docs, doc_id, text)
    return found.select(F.col("doc_id").alias(doc_id), "base", F.array_sort(F.concat("base", "added")).alias("spans"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns; every span in the text gives way to its kind in brackets, overlapping spans to the first."""
    found = _found(docs, doc_id, text)
    spans = stored(found.where((F.size("base") > 0) | (F.size("added") > 0)).select("row_key", F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("spans")).dropDuplicates(["row_key"]), "pii-spans")
    # All columns travel in one, so that their names clash with none here.
    own = docs.select(F.struct(*docs.columns).alias("d"), F.col(text).alias("whole"), row_key(doc_id, text).alias("row_key"))
    # The spans grow with the documents: merged at every size, never broadcast.
    joined = own.join(spans.hint("merge"), "row_key", "left")
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def step(state: Column, s: Column) -> Column:
        ahead = s["start"] >= state["at"]
        piece = F.concat(state["out"], F.substring("whole", state["at"] + 1, s["start"] - state["at"]), F.element_at(names, s["kind"] + 1))
        return F.struct(F.when(ahead, piece).otherwise(state["out"]).alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    walked = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
    clean = F.when(F.col("spans").isNotNull(), F.concat(walked["out"], F.substring("whole", walked["at"] + 1, F.length("whole")))).otherwise(F.col("whole"))
    return joined.select(*(clean.alias(c) if c == text else F.col("d")[c].alias(c) for c in docs.columns))
