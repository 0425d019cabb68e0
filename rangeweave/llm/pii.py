"""Operator 3, PII: seed entities, bootstrapped contextual patterns, DataFrame functions only.

Seeds are e-mail addresses, IPv4 addresses, payment cards that pass Luhn, phone numbers, and secrets (lower-case
hexadecimal digests of 32 to 64 digits). The words around seeds make lexical patterns: the word before, the
two words before, and the words on both sides; the neighbours of a match are words of the text, other matches
included. Patterns and the identifier-like strings ("instances": tokens with a digit or @, digits in groups) that
they surround form a bipartite graph, on which Spark scores alternately. For a kind, a pattern's positives are its
seeds; its negatives are the instances that are seeds of other kinds or lack the kind's shape; the rest is
unlabelled. Confidence starts as positives / (positives + negatives + 1); an instance's score is the best
confidence among its patterns; then unlabelled instances count by their scores. After ``rounds`` rounds the
patterns with ``support`` distinct seeds and ``confidence`` are trusted, and the unseen instances of fitting
shape, at least half of whose distinct patterns are trusted, are marked where a trusted pattern holds them.
Base spans (the first four kinds' seeds) always stay; what overlaps one goes.

Positions come from the pieces between matches: lengths of pieces and matches add up, by a window
over the matches of one text, so a text's cost is linear in its length. The expressions below are
written without nested repetition, so very long runs neither overflow nor backtrack far.

Defined results: null texts count as empty. A text repeated under one id comes out as often as it
came in; one id with different texts is judged per text; a null id is an id. Empty tables give
empty results. Only id and text are read, so other columns cannot clash. Instances have 6 characters at
least; neighbours longer than 64 characters are compared by their hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

KINDS = ("email", "ip", "card", "phone")
_L, _D = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: The base patterns of the contract, with atomic runs; \G lets a match start where the last one ended.
EXPRESSIONS = {
    "email": rf"(?:(?<![{_L}])|\G)[{_L}]++@[{_D}]++\.[{_D}]++[{_D}.]*?(?=\.\.|\.?(?![{_D}.]))",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){13,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])",
    "other": r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+",
    "groups": r"(?<![0-9A-Za-z+.,-])\(?[0-9]{2,6}\)?(?:[ -][0-9]{2,6}){1,6}(?![0-9A-Za-z.,-]?[0-9])",
}
#: Kinds in the order of their spans; the contract's four first.
ALL = (*KINDS, "secret")
#: What a text must hold for a kind's expression to be worth running.
HINTS = {"email": "@", "ip": "[0-9][.][0-9]", "card": "[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "secret": "[0-9a-f]{32}", "other": "[0-9@]", "groups": "[0-9)][ -][0-9]"}
OCTET = "(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)|0++)"
#: The shape that an unseen instance of a kind must have.
SHAPES = {
    "email": r"^[^@]+@[^@]+$",
    "ip": r"^[0-9]{1,3}([.:][0-9]{1,3}){3}$",
    "card": r"^[0-9](?:[ -]?[0-9]){12,18}$",
    "phone": r"^[(]?[0-9][ ().0-9-]{5,18}[0-9]$",
    "secret": r"^(?=.*[0-9])(?=.*[A-Za-z])[0-9A-Za-z_+/=-]{24,}$",
}


def _luhn(digits):
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.cast("int").alias("d"), (i % 2 == 1).alias("twice")))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + F.when(x["twice"], x["d"] * 2 - F.when(x["d"] > 4, 9).otherwise(0)).otherwise(x["d"])) % 10 == 0


def valid(kind, value):
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
        .when(kind == "card", F.length(digits).between(14, 19) & _luhn(digits))
        .when(kind == "phone", F.length(digits).between(10, 15))
        .when(kind == "secret", value.rlike("[a-f]") & value.rlike("[0-9]"))
        .otherwise(False)
    )


def _word(words, n: int):
    """The first (n > 0) or last words of a text piece, brackets and quotes around the match left out; long ones by their hash."""
    plain = F.translate(words, "\t\n\r\x0b\x0c", "     ")
    found = F.lower(F.substring_index(F.ltrim(plain, F.lit(" \"')]}>")) if n > 0 else F.rtrim(plain, F.lit(" \"'([{<")), " ", n))
    return F.when(F.length(found) > 64, F.hex(F.xxhash64(found))).otherwise(found)


def matches(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, th, kind, idx, start, end, value, left, two, right): each kind's matches; one row of kind null for each row of ``docs``.

    ``left`` and ``right`` are the neighbouring words and ``two`` the two words before, lower-cased.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("th"), text.alias("t"))
    # columns of their own: inside a lambda they would be made anew for every match
    hinted = {k: F.col("t").rlike(HINTS[k]) for k in EXPRESSIONS}
    pieces = {f"{k}_v": F.when(hinted[k], F.regexp_extract_all("t", F.lit(x), F.lit(0))) for k, x in EXPRESSIONS.items()}
    pieces |= {f"{k}_g": F.when(hinted[k], F.split("t", x)) for k, x in EXPRESSIONS.items()}
    rows = rows.select("id", "th", *[x.alias(k) for k, x in pieces.items()])
    fields = {"kind": "string", "idx": "int", "gap": "int", "n": "int", "value": "string", "before": "string", "after": "string"}
    empty = F.array().cast(f"array<struct<{','.join(f'{k}:{x}' for k, x in fields.items())}>>")

    def of(kind):
        gaps, values = F.col(f"{kind}_g"), F.col(f"{kind}_v")
        piece = lambda array, i: F.coalesce(F.get(array, i), F.lit(""))

        def row(v, i):
            return F.struct(
                F.lit(kind).alias("kind"),
                i.alias("idx"),
                F.length(F.get(gaps, i)).alias("gap"),
                F.length(v).alias("n"),
                v.alias("value"),
                # the match before and the one after are words too; what is left of them is needed only for short gaps
                F.concat(F.when(F.length(piece(gaps, i)) < 64, F.concat(F.right(piece(gaps, i - 1), F.lit(64)), piece(values, i - 1))).otherwise(""), piece(gaps, i)).alias("before"),
                F.concat(piece(gaps, i + 1), F.when(F.length(piece(gaps, i + 1)) < 2, piece(values, i + 1)).otherwise("")).alias("after"),
            )

        def cut(x):
            """Words instead of whole pieces."""
            names = [k for k in fields if k not in ("before", "after")]
            return F.struct(*[x[k].alias(k) for k in names], _word(x["before"], -1).alias("left"), _word(x["before"], -2).alias("two"), _word(x["after"], 1).alias("right"))

        return F.transform(F.coalesce(F.transform(values, row), empty), cut)

    mark = F.array(F.struct(*[F.lit(None).cast(x).alias(k) for k, x in (("kind", "string"), ("idx", "int"), ("gap", "int"), ("n", "int"), ("value", "string"), ("left", "string"), ("two", "string"), ("right", "string"))]))
    rows = rows.select("id", "th", F.explode(F.concat(mark, *[of(k) for k in EXPRESSIONS])).alias("m")).select("id", "th", "m.*")
    rows = written(rows, "pii-matches")
    upto = Window.partitionBy("id", "th", "kind").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    once = rows.filter("kind is not null").dropDuplicates(["id", "th", "kind", "idx"])
    once = once.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(upto).cast("long")).withColumn("start", F.col("end") - F.col("n"))
    columns = ["id", "th", "kind", "start", "end", "value", "left", "two", "right"]
    marks = rows.filter("kind is null").select("id", "th", "kind", *[F.lit(None).cast("long").alias(k) for k in ("start", "end")], "value", "left", "two", "right")
    return once.select(*columns).union(marks.select(*columns))


def _instances(found: DataFrame) -> DataFrame:
    """Candidates with their punctuation cut off: (id, th, start, end, value, left, two, right)."""
    lead = F.length(F.regexp_extract("value", r"^[\"'(\[{<,;:=]*", 0))
    core = F.regexp_extract("value", r"^[\"'(\[{<,;:=]*(.*?)[^0-9A-Za-z]*$", 1)
    return (
        found.filter("kind = 'other'")
        .withColumns({"core": core, "lead": lead})
        .select("id", "th", (F.col("start") + F.col("lead")).alias("start"), (F.col("start") + F.col("lead") + F.length("core")).alias("end"), F.col("core").alias("value"), "left", "two", "right")
        .union(found.filter("kind = 'groups'").select("id", "th", "start", "end", "value", "left", "two", "right"))
        .filter(F.length("value") >= 6)
    )


def _patterns(rows: DataFrame) -> DataFrame:
    mark = lambda kind, *words: F.concat_ws("\u0001", F.lit(kind), *words)
    return rows.withColumn("pattern", F.explode(F.array(mark("1", "left"), mark("2", "two"), mark("B", "left", "right")))).filter("left <> ''")


def _shaped(kind: str):
    return F.col("value").rlike(SHAPES[kind])


def learned(seeds: DataFrame, instances: DataFrame, rounds: int = 2, support: int = 5, confidence: float = 0.8) -> DataFrame:
    """(pattern, kind, confidence): the patterns that are trusted after ``rounds`` rounds.

    ``seeds`` are (kind, value, left, two, right), ``instances`` (value, left, two, right). All counts are of distinct values.
    """
    known = _patterns(seeds).select("pattern", "kind", "value").distinct()
    used = known.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n"))
    every = used.groupBy("pattern").agg(F.sum("n").alias("seeds"))
    used = used.filter(F.col("n") >= support)
    edges = _patterns(instances).select("pattern", "value").distinct().join(known.select("pattern", "value"), ["pattern", "value"], "left_anti")
    edges = edges.join(used.select("pattern").distinct(), "pattern", "left_semi")
    edges = written(edges.withColumns({k: _shaped(k) for k in ALL}), "pii-edges")
    others = edges.groupBy("pattern").agg(*[F.count_if(~F.col(k)).alias(f"{k}_no") for k in ALL], *[F.count_if(F.col(k)).alias(f"{k}_open") for k in ALL])
    pick = lambda end: F.coalesce(*[F.when(F.col("kind") == k, F.col(f"{k}_{end}")) for k in ALL], F.lit(0))
    base = used.join(every, "pattern").join(others, "pattern", "left")
    base = written(base.select("pattern", "kind", "n", (F.col("seeds") - F.col("n") + pick("no")).alias("against"), pick("open").alias("open")), "pii-patterns")
    scored = base.withColumn("confidence", F.col("n") / (F.col("n") + F.col("against") + 1))
    fits = F.coalesce(*[F.when(F.col("kind") == k, F.col(k)) for k in ALL])
    for _ in range(rounds):
        score = edges.join(scored, "pattern").filter(fits).groupBy("value", "kind").agg(F.max("confidence").alias("s"))
        gained = edges.select("pattern", "value").join(score, "value").groupBy("pattern", "kind").agg(F.sum("s").alias("g"))
        scored = base.join(gained, ["pattern", "kind"], "left").withColumn("confidence", (F.col("n") + F.coalesce("g", F.lit(0.0))) / (F.col("n") + F.col("against") + F.col("open") + 1)).drop("g")
        scored = written(scored, "pii-scores")
    return scored.filter(F.col("confidence") >= confidence).select("pattern", "kind", "confidence")


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rounds: int = 2, support: int = 5, confidence: float = 0.8) -> DataFrame:
    """(id, th, spans): for each row the spans (start, k, kind, end, base), sorted; offsets in code points, end exclusive."""
    found = written(matches(docs, id_column, text_column), "pii-found")
    order = F.array_position(F.array(*[F.lit(k) for k in ALL]), F.col("kind")).cast("int")
    seeds = found.filter(F.col("kind").isin(*ALL)).filter(valid(F.col("kind"), F.col("value")))
    instances = _instances(found)
    words = ("value", "left", "two", "right")
    trusted = learned(seeds.select("kind", *words), instances.select(*words), rounds, support, confidence)
    fits = F.coalesce(*[F.when(F.col("kind") == k, _shaped(k)) for k in ALL])
    trusted = written(trusted, "pii-trusted")
    # a number that stands in many places of other kinds is no identifier, whatever stands before it once
    each = _patterns(instances).select("pattern", "value").distinct().join(small(trusted), "pattern", "left")
    share = each.groupBy("value").agg(F.count_distinct("pattern").alias("all"), F.count_distinct(F.when(F.col("kind").isNotNull(), F.col("pattern"))).alias("held"))
    share = share.filter(F.col("held") * 2 >= F.col("all")).select("value")
    more = _patterns(instances).join(small(trusted), "pattern").filter(fits).join(share, "value", "left_semi")
    more = more.groupBy("id", "th", "start", "end").agg(F.max(F.struct("confidence", "kind"))["kind"].alias("kind"))
    span = lambda base: F.struct("start", order.alias("k"), "kind", "end", base.alias("base"))
    is_base = F.col("kind").isin(*KINDS)
    none = F.lit(None).cast("struct<start:bigint,k:int,kind:string,end:bigint,base:boolean>")
    spans = (
        seeds.select("id", "th", span(is_base).alias("s"))
        .union(more.select("id", "th", span(F.lit(False)).alias("s")))
        .union(found.filter("kind is null").select("id", "th", none.alias("s")))
    )
    # what overlaps a base span, or an added one that begins before it, goes: running ends to the left, next base start to the right
    text = Window.partitionBy("id", "th").orderBy(F.col("s.start").asc_nulls_first(), F.col("s.end").desc(), "s.k")
    base_end = F.max(F.when(F.col("s.base"), F.col("s.end"))).over(text.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    any_end = F.max("s.end").over(text.rowsBetween(Window.unboundedPreceding, -1))
    base_start = F.min(F.when(F.col("s.base"), F.col("s.start"))).over(text.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    clear = (F.coalesce(base_end, F.lit(0)) <= F.col("s.start")) & (F.coalesce(any_end, F.lit(0)) <= F.col("s.start")) & (F.coalesce(base_start, F.col("s.end")) >= F.col("s.end"))
    spans = spans.withColumn("clear", clear).filter(F.col("s").isNull() | F.col("s.base") | F.col("clear"))
    each = spans.groupBy("id", "th").agg(F.count_if(F.col("s").isNull()).alias("_n"), F.array_sort(F.collect_list("s")).alias("spans"))
    return each.select("id", "th", "spans", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_i")).drop("_i")


def listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; overlapping spans become one."""
    found = find(docs.select(id_column, text_column).distinct(), id_column, text_column).filter(F.size("spans") > 0)
    found = found.select(F.col("id").alias("__pii_id"), F.col("th").alias("__pii_th"), F.col("spans").alias("__pii_spans"))
    text = F.col(text_column)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):
        piece = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("<"), s["kind"], F.lit(">"))).otherwise("")
        return F.struct(F.concat(acc["out"], piece, mark).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate("__pii_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    joined = docs.join(found, F.col(id_column).eqNullSafe(F.col("__pii_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("__pii_th")), "left")
    return joined.withColumn(text_column, F.when(F.col("__pii_spans").isNotNull(), done).otherwise(text)).select(*docs.columns)
