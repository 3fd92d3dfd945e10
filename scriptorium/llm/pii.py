"""Personal data: patterns for the usual kinds, and identifiers found by bootstrapped contexts.

What the patterns find are seeds. A context is the two or three words and marks before an
identifier, or the one before and the one after; contexts and the distinct identifiers seen in
them are a graph, seeds and tokens that merely look like identifiers. Round by round a
context is worth the mean of what it holds (seeds count in full), a token half the mean of its
contexts. Contexts worth enough then tell identifiers that no pattern knows.

Texts are read once, in column functions alone. Patterns start only where a run of their
characters does and never step back, so a long text takes time in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.urls import LOWER, UPPER
from scriptorium.plans.store import counted, materialise, scoped, spread

KINDS = ("email", "ip", "card", "phone", "identifier")
EMAIL, IP, CARD, PHONE, TOKEN = range(5)
#: A single space or hyphen between digits is read as JOINT, and JOINT itself as OTHER.
JOINT, OTHER = "\ue000", "\ue001"
LOCAL, TOKENS, MARKS = "A-Za-z0-9._%+-", "A-Za-z0-9_.@+/:#%-", "._@+/:#%-"
PATTERNS = (
    rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    rf"(?<![0-9{JOINT}])(?:[0-9]{JOINT}?){{13,18}}[0-9](?![0-9{JOINT}])",  # a run of 14 to 19 digits
    r"\+[0-9][\x20().0-9-]+[0-9]",
    rf"(?<![{TOKENS}])(?=[{TOKENS}]{{5}})(?=[A-Za-z_.+/:#%{JOINT}-]*+(?:@|[0-9][A-Za-z_.+/:#%{JOINT}-]*+[0-9@]))[{TOKENS}]++",
)
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
WORD = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"
#: Characters before and after an identifier that its contexts are taken from.
BEFORE, AFTER = 48, 32
#: Identifiers that make a context count; what one is worth; what a context must be worth.
SUPPORT, ONE, ENOUGH, ROUNDS = 3, 1_000_000, 500_000, 3
#: Rows of contexts or tokens that are broadcast (about 100 bytes each).
SMALL = 100_000


def luhn(digits: Column) -> Column:
    """Whether a number's check digit is right."""
    def step(total: Column, i: Column) -> Column:
        x = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _folded(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _patterns(left: Column, right: Column) -> Column:
    """The contexts of an identifier: each has a word with a letter before it."""
    before, after = F.regexp_extract_all(_folded(left), F.lit(WORD), F.lit(0)), F.regexp_extract_all(_folded(right), F.lit(WORD), F.lit(0))
    n = F.size(before)
    told = lambda k: F.array_join(F.slice(before, F.greatest(n - (k - 1), F.lit(1)), F.lit(k)), " ")
    has = lambda x: x.rlike(r"\p{L}")
    last = F.get(before, n - 1)
    return F.array_compact(
        F.array(
            F.when((n >= 2) & has(told(2)), F.concat(told(2), F.lit(" _"))),
            F.when((n >= 3) & has(told(3)), F.concat(told(3), F.lit(" _"))),
            F.when((n >= 1) & has(last) & (F.size(after) >= 1), F.concat(last, F.lit(" _ "), F.get(after, F.lit(0)))),
        )
    )


def _matches(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """A row per match of a pattern, and one with a null ``hit`` per text: row, of (the carry
    columns), kind, k, hit, gap (length since the last one), left, right."""
    text = F.coalesce(F.col("text"), F.lit(""))
    joined = F.regexp_replace(F.translate(text, JOINT, OTHER), r"(?<=[0-9])[\x20-](?=[0-9])", JOINT)
    rows = spread(docs).select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(c) for c in carry]).alias("of"), text.alias("plain"), F.when(text.rlike("[0-9]"), joined).otherwise(text).alias("joined"))
    found = []
    for kind, pattern in enumerate(PATTERNS):
        source = F.col("joined") if kind in (CARD, TOKEN) else F.col("plain")
        may = F.col("plain").contains("@") if kind == EMAIL else F.col("plain").contains("+") if kind == PHONE else F.lit(True)
        hits = F.when(may, F.regexp_extract_all(source, F.lit(pattern), F.lit(0)))
        hits = F.concat(hits, F.array(F.lit(None).cast("string"))) if kind == TOKEN else hits
        found.append(F.struct(F.lit(kind).alias("kind"), hits.alias("hits"), F.when(may, F.split(source, pattern, -1)).alias("gaps")))
    kinds = rows.select("row", "of", F.explode(F.array(*found)).alias("x")).select("row", "of", "x.*")
    flat = kinds.select("row", "of", "kind", "gaps", F.posexplode("hits").alias("k", "hit"))
    gap = F.get("gaps", F.col("k"))
    return flat.select("row", "of", "kind", "k", "hit", F.length(gap).alias("gap"), F.right(gap, F.lit(BEFORE)).alias("left"), F.left(F.get("gaps", F.col("k") + 1), F.lit(AFTER)).alias("right"))


def mentions(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A written row per span: row, of, kind, start, end (code points), value and contexts: what
    the patterns find, and tokens apart from that. Every text has a row without a kind besides."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _matches(docs, carry).repartition(parts, "row")
    end = F.sum(F.col("gap") + F.length("hit")).over(Window.partitionBy("row", "kind").orderBy("k"))
    plain = F.translate("hit", JOINT, " ")
    bare = F.ltrim(plain, F.lit(MARKS))
    inner, lead = F.rtrim(bare, F.lit(MARKS)), F.length("hit") - F.length(bare)
    is_token = F.col("kind") == TOKEN
    digits = F.regexp_replace("hit", "[^0-9]", "")
    good = (
        F.when(F.col("kind") == IP, F.col("hit").rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
        .when(F.col("kind") == CARD, luhn(digits))
        .when(F.col("kind") == PHONE, F.length(digits).between(10, 15))
        .when(is_token, F.length(inner) >= 4)
        .otherwise(True)
    )
    placed = rows.withColumn("end", end).withColumn("good", good).where("good or hit is null")
    told = placed.select(
        "row", "of", F.when(F.col("hit").isNotNull(), F.col("kind")).alias("kind"),
        (F.col("end") - F.length("hit") + F.when(is_token, lead).otherwise(0)).alias("start"),
        (F.col("end") - F.when(is_token, F.length(bare) - F.length(inner)).otherwise(0)).alias("end"),
        F.when(is_token, inner).otherwise(plain).alias("value"),
        F.when(is_token, F.concat("left", F.left(F.col("hit"), lead))).otherwise(F.col("left")).alias("left"),
        F.when(is_token, F.concat(F.right(F.col("hit"), F.length(bare) - F.length(inner)), "right")).otherwise(F.col("right")).alias("right"),
    )
    order = Window.partitionBy("row").orderBy("start", "kind")
    known = F.col("kind") < TOKEN
    reached = F.max(F.when(known, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(known, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(reached, F.lit(0)) <= F.col("start")) & (ahead.isNull() | (ahead >= F.col("end")))
    kept = told.withColumn("free", free).where("kind is null or kind < 4 or free")
    return materialise(kept.select("row", "of", "kind", "start", "end", _folded(F.col("value")).alias("value"), F.when(F.col("kind").isNotNull(), _patterns(F.col("left"), F.col("right"))).alias("contexts")), "mentions")


def contexts(found: DataFrame) -> DataFrame:
    """(context, worth) after ROUNDS rounds, of contexts that are worth something. Worths are
    whole millionths, so that no sum hangs on its order."""
    edges = found.where("kind is not null").select(F.explode("contexts").alias("context"), "value", (F.col("kind") < TOKEN).alias("seed"))
    edges = materialise(edges.groupBy("context", "value").agg(F.max("seed").alias("seed")), "context-edges")
    sizes = materialise(edges.groupBy("context").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT), "context-sizes")
    live = materialise(edges.join(counted(sizes, SMALL), "context"), "context-graph")
    worths = None
    for number in range(ROUNDS):
        held = live
        if worths is not None:  # what tokens are worth by their contexts
            tokens = live.where("not seed").join(counted(worths, SMALL), "context", "left").groupBy("value").agg(F.expr("sum(coalesce(worth, 0)) div (2 * count(*))").alias("own"))
            held = live.join(counted(materialise(tokens.where("own > 0"), f"token-worths-{number}"), SMALL), "value", "left")
        own = F.when(F.col("seed"), ONE).otherwise(F.coalesce("own", F.lit(0)) if "own" in held.columns else F.lit(0))
        total = held.groupBy("context", "n").agg(F.sum(own).alias("total"))
        worths = materialise(total.where(F.col("total") >= SUPPORT * ONE).select("context", F.expr("total div (n + 1)").alias("worth")), f"context-worths-{number}")
    return worths


@scoped
def find_personal_data(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns of each row of ``docs`` with spans (start, kind, end, in code points,
    end exclusive; kind is a place in KINDS), ordered.

    Emails, addresses, cards and phones are those of the patterns, checked; tokens that
    overlap none of them are identifiers where a context of theirs is worth ENOUGH. Null
    and empty texts have no spans; repeated rows have the same ones and their identifiers
    count once; an empty table gives no rows. Other columns are ignored. Sums and minima
    are taken before rows meet, so a context or token of a third of all rows is a row a
    task; a text's spans are one row."""
    found = mentions(docs, carry)
    good = contexts(found).where(F.col("worth") >= ENOUGH).select("context")
    tokens = found.where(F.col("kind") == TOKEN).select("row", "start", "end", F.explode("contexts").alias("context"))
    new = tokens.join(counted(good, SMALL), "context", "left_semi").select("row", "start", "end").distinct()
    new = new.select("row", F.lit(None).cast(found.schema["of"].dataType).alias("of"), F.lit(TOKEN).alias("kind"), "start", "end")
    spans = found.select("row", "of", "kind", "start", "end").where("kind is null or kind < 4").unionByName(new)
    held = F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end"))))
    return spans.groupBy("row").agg(F.first("of", ignorenulls=True).alias("of"), held.alias("spans")).select("of.*", "spans")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
