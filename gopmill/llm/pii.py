"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base spans (e-mail, IP, card, phone) come from patterns with checks and are the seeds. The words beside a seed are its
lexical patterns; every token with a digit or an @ that no base span touches is a further instance of the patterns
beside it. Over the graph of patterns and instances scores go round: a pattern's confidence in a kind is the share of
its instances that are of that kind, an instance's score in a kind is that of its best pattern. Patterns of high
confidence and support then give their kind to the unseen identifiers beside them, if these have the shape of the kind.

Positions: a text is split by the pattern and the lengths of what lies between and of the matches are added up, by a
window over the matches of one text. The patterns never go back over what they have read, so long runs cost no more
than their length. Frequent patterns ("the") are reduced by ordinary aggregates before the shuffle.

Null texts are empty. Rows equal in id and text are found alike; null ids are kept. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gopmill.llm.common import KEY, key
from gopmill.session import written

KINDS = ("email", "ip", "card", "phone")
LOCAL, BLANK = "A-Za-z0-9._%+-", r"\x20\x09-\x0D"
# (?:\G|(?<!..)) starts a match where the last one ended or where a run begins: inside a run no start can do better
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "token": rf"(?<![^{BLANK}])[^{BLANK}0-9@]*+[0-9@][^{BLANK}]*+",
}
PART = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
ROUNDS = 3
MIN_CONFIDENCE = 0.8
MIN_SEEDS = 5
PRIOR = 1.0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(kind: Column, match: Column) -> Column:
    size = F.length(_digits(match))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", match.rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
        .when(kind == "card", size.between(14, 19) & F.call_function("luhn_check", _digits(match)))
        .when(kind == "phone", size.between(10, 15))
    )


def _shaped(kind: Column, token: Column) -> Column:
    """May this token be an identifier of the kind?"""
    size = F.length(_digits(token))
    return (
        F.when(kind == "email", token.contains("@") & (F.length(token) >= 5))
        .when(kind == "ip", token.rlike("^[0-9A-Fa-f]+([.:][0-9A-Fa-f]+){2,}$"))
        .when(kind == "card", size.between(12, 19))
        .when(kind == "phone", size.between(7, 15))
    )


def mentions(docs: DataFrame) -> DataFrame:
    """(row key, kind, start, end, match, left, right, before): matches of all kinds with the words beside them."""
    # no kind matches without a digit or an @
    texts = docs.filter(F.col("text").rlike("[0-9@]")).select(key(), "text")
    pieces = texts.select(KEY, *[F.split("text", p, -1).alias(f"p_{k}") for k, p in PATTERNS.items()],
                          *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in PATTERNS.items()])

    def rows(kind: str) -> Column:
        p, m = F.col(f"p_{kind}"), F.col(f"m_{kind}")
        zipped = F.arrays_zip(p.alias("piece"), m.alias("match"), F.slice(p, F.lit(2), F.size(p)).alias("next"))

        def row(x: Column, i: Column) -> Column:
            plain = lambda piece: F.translate(piece, "\t\n\x0b\x0c\r", "     ")
            before = F.rtrim(plain(x["piece"]))
            return F.struct(
                F.lit(kind).alias("kind"), i.alias("i"), F.length(x["piece"]).alias("gap"), x["match"].alias("match"),
                F.lower(F.substring_index(before, " ", -1)).alias("left"), F.lower(F.substring_index(before, " ", -2)).alias("before"),
                F.lower(F.substring_index(F.ltrim(plain(x["next"])), " ", 1)).alias("right"),
            )

        return F.transform(F.slice(zipped, F.lit(1), F.size(m)), row)

    found = pieces.select(KEY, F.explode(F.concat(*[rows(k) for k in PATTERNS])).alias("x")).select(KEY, "x.*").distinct()
    so_far = Window.partitionBy(KEY, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("match")).over(so_far)
    return found.withColumn("end", end.cast("bigint")).withColumn("start", F.col("end") - F.length("match"))


def lexical_patterns(found: DataFrame) -> DataFrame:
    """``found`` once per pattern beside it: the word before, the two words before, the word after."""
    sides = F.array(
        F.when(F.col("left") != "", F.concat(F.lit("< "), "left")),
        F.when(F.col("before").contains(" "), F.concat(F.lit("<< "), "before")),
        F.when(F.col("right") != "", F.concat(F.lit("> "), "right")),
    )
    return found.withColumn("pattern", F.explode(sides)).filter("pattern is not null")


def confidences(seeds: DataFrame, others: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence, seeds): scores after ``rounds`` rounds over the graph of patterns and instances."""
    columns = ["pattern", "instance", "kind"]
    known = lexical_patterns(seeds.withColumn("instance", F.col("match"))).select(*columns)
    open_ones = lexical_patterns(others.withColumn("instance", F.col("match"))).select("pattern", "instance", F.lit(None).cast("string").alias("kind"))
    edges = written(known.unionByName(open_ones).distinct())
    size = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("size"))
    support = edges.filter("kind is not null").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds"))
    # what an open instance adds to its patterns; nothing in the first round
    extra = None
    unknown = edges.filter("kind is null").select("pattern", "instance")
    for _ in range(rounds):
        mass = support.select("pattern", "kind", F.col("seeds").cast("double").alias("mass"))
        if extra is not None:
            mass = mass.unionByName(extra).groupBy("pattern", "kind").agg(F.sum("mass").alias("mass"))
        scored = mass.join(size, "pattern").select("pattern", "kind", (F.col("mass") / (F.col("size") + PRIOR)).alias("confidence"))
        believed = unknown.join(scored.filter(F.col("confidence") >= MIN_CONFIDENCE), "pattern")
        score = believed.filter(_shaped(F.col("kind"), F.col("instance"))).groupBy("instance", "kind").agg(F.max("confidence").alias("score"))
        extra = unknown.join(score, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"))
    return scored.join(support, ["pattern", "kind"])


def discovered(others: DataFrame, scored: DataFrame) -> DataFrame:
    """Spans of identifiers that a pattern of high confidence and support names; of several kinds the surest."""
    sure = scored.filter((F.col("confidence") >= MIN_CONFIDENCE) & (F.col("seeds") >= MIN_SEEDS)).select("pattern", F.col("kind").alias("named"), "confidence")
    beside = lexical_patterns(others).join(sure, "pattern").filter(_shaped(F.col("named"), F.col("match")))
    best = beside.groupBy(KEY, "start", "end").agg(F.max_by("named", F.struct("confidence", "named")).alias("kind"))
    return best.select(KEY, "kind", "start", "end")


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base spans and those the method adds, as (row key, kind, start, end)."""
    found = written(mentions(docs))
    base = written(found.filter((F.col("kind") != "token") & _valid(F.col("kind"), F.col("match"))))
    taken = base.groupBy(KEY).agg(F.collect_list(F.struct("start", "end")).alias("taken"))
    # a token without what encloses it: brackets, quotes, a full stop
    core = F.regexp_extract("match", "[A-Za-z0-9+](?:.*[A-Za-z0-9])?", 0)
    at = F.col("start") + F.instr("match", core) - 1
    tokens = found.filter("kind = 'token'").withColumn("core", core).withColumn("start", at).withColumn("match", F.col("core")).withColumn("end", F.col("start") + F.length("core"))
    clear = ~F.exists("taken", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    others = written(tokens.filter("match != ''").join(taken, KEY, "left").filter(F.col("taken").isNull() | clear).drop("taken", "core"))
    return base.select(KEY, "kind", "start", "end"), discovered(others, confidences(base, others))


def op7(docs: DataFrame) -> DataFrame:
    base, added = spans(docs)
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    every = base.withColumn("base", F.lit(True)).unionByName(added.withColumn("base", F.lit(False)))
    row = F.struct("start", order[F.col("kind")].alias("rank"), "kind", "end", "base")
    listed = every.groupBy(KEY).agg(
        F.array_sort(F.collect_list(row)).alias("all"), *[F.count_if((F.col("kind") == k) & F.col("base")).alias(f"n_{k}") for k in KINDS]
    )
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    texts = listed.select(KEY, told("all").alias("spans"), F.sha2(told(F.filter("all", lambda s: s["base"])), 256).alias("base_sha256"), *[f"n_{k}" for k in KINDS])
    return docs.select("doc_id", key()).join(texts, KEY, "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )
