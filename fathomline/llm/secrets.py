"""Secret scans with corpus-wide ownership frequency, in DataFrame operations alone.

Three base patterns (assignments, access key ids, long hexadecimal runs) are
found with their places; a wider pattern finds bare runs that mix letters and
digits.  The values of all of them are hashed and aggregated over the whole
corpus: by how many distinct owners and repositories is each value held?  A
value of at least ``EXAMPLE_OWNERS`` owners is a widely copied *example*; one
of a single owner is *live-looking*.  A bare run becomes a span of kind
``owned`` if its value is no example and is either live-looking by itself
(enough distinct characters) or known as the value of a base span elsewhere.
Base spans always stay; their values are only classified.

A repository is (source, lang), an owner is a source.  Copies within one
repository are counted once before owners are, so a value that a third of all
rows hold is pre-aggregated to few rows.

Edge cases: a null text counts as empty and has no spans; null owners are one
owner; repeated rows are reported each; texts without any match skip the
position work; a very long text is scanned whole by one task, whose work on its
matches is done in runs; extra columns are ignored (and kept by ``redact``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import materialize

KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
ASSIGN_LENGTH = 6
WIDE = "[A-Za-z0-9+/_-]{16,}"
#: A digit within such a run has eight of its characters on one side at least.
WIDE_HINT = "[A-Za-z0-9+/_-]{8}[0-9]|[0-9][A-Za-z0-9+/_-]{8}"
#: Distinct characters that a live-looking bare run has at least.
WIDE_VARIETY = 9
EXAMPLE_OWNERS = 3
BROADCAST_ROWS = 50_000
#: Matches whose places are summed in one run.
RUN = 256
MASK = "[REDACTED]"

SPAN = "struct<start:int,kind:int,end:int,value:string>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def _runs(items: Column) -> Column:
    """The items in runs of ``RUN``; one empty run if there are none."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(RUN)), lambda i: F.slice(items, i, F.lit(RUN)))


def _placed(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Spans of all matches: the text between matches gives their places.

    Sums run over ``RUN`` matches at a time and then over the runs, so long lists
    are not copied once a match.
    """
    between = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"), F.slice(between, F.lit(1), F.size(between) - 1).alias("gap"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    zeros = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))

    def span(start: Column, end: Column, value: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value"))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(m["gap"])
        end = start + F.length(m["whole"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span(start, end, m["value"]))).alias("out"))

    def join(acc: Column, run: Column) -> Column:
        moved = F.transform(run["out"], lambda s: span(acc["at"] + s["start"], acc["at"] + s["end"], s["value"]))
        return F.struct((acc["at"] + run["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def placed(matches: Column) -> Column:
        few = F.aggregate(matches, zero, step, lambda acc: acc["out"])
        runs = F.transform(_runs(matches), lambda run: F.aggregate(run, zero, step))
        return F.when(F.size(matches) <= RUN, few).otherwise(F.flatten(F.aggregate(runs, zeros, join, lambda acc: acc["out"])))

    return _let(pairs, placed)


def _spans(text: Column, pattern: str, kind: int, group: int = 0, hint: str | None = None) -> Column:
    none = F.array().cast(f"array<{SPAN}>")
    return F.when(text.rlike(hint or pattern), _placed(text, pattern, kind, group)).otherwise(none)


def _reached(events: Column, kind: str) -> Column:
    """Each event (a struct of ``kind`` with a field ``top``) with ``at``, the largest top before it, or 0.

    Largest tops are taken over runs first, so lists are not copied once an event.
    """
    none = F.array().cast(f"array<struct<event:{kind},at:int>>")

    def step(acc: Column, e: Column) -> Column:
        out = F.concat(acc["out"], F.array(F.struct(e.alias("event"), acc["at"].alias("at"))))
        return F.struct(F.greatest(acc["at"], e["top"]).alias("at"), out.alias("out"))

    def within(runs: Column, tops: Column) -> Column:
        before = lambda k: F.coalesce(F.array_max(F.slice(tops, F.lit(1), k)), F.lit(0))
        return F.flatten(F.transform(runs, lambda run, k: F.aggregate(run, F.struct(before(k).alias("at"), none.alias("out")), step, lambda acc: acc["out"])))

    return _let(_runs(events), lambda runs: _let(F.transform(runs, lambda run: F.array_max(run["top"])), lambda tops: within(runs, tops)))


def _apart(bare: Column, base: Column) -> Column:
    """The bare spans that touch no base span: met in one order of bare ends and base starts."""
    kind = f"struct<key:int,base:int,top:int,span:{SPAN}>"

    def event(key: Column, base: int, top: Column, span: Column) -> Column:
        return F.struct(key.alias("key"), F.lit(base).alias("base"), top.alias("top"), span.cast(SPAN).alias("span"))

    ends = F.transform(bare, lambda s: event(s["end"], 0, F.lit(0), s))
    starts = F.transform(base, lambda s: event(s["start"], 1, s["end"], F.lit(None)))
    free = F.filter(_reached(F.array_sort(F.concat(ends, starts)), kind), lambda r: (r["event"]["base"] == 0) & (r["at"] <= r["event"]["span"]["start"]))
    return F.when((F.size(bare) == 0) | (F.size(base) == 0), bare).otherwise(F.transform(free, lambda r: r["event"]["span"]))


def _pieces(text: Column, places: Column) -> Column:
    """The parts of a text at ascending places (start, end), cut from the text of each run of places."""
    cut = lambda text, a, b: F.substring(text, a + 1, b - a)

    def of_run(run: Column) -> Column:
        first = F.get(run, 0)["start"]
        whole = cut(text, first, F.get(run, F.size(run) - 1)["end"])
        return _let(whole, lambda own: F.transform(run, lambda p: cut(own, p["start"] - first, p["end"] - first)))

    return F.flatten(F.transform(_runs(places), of_run))


def _variety(value: Column) -> Column:
    return F.size(F.array_distinct(F.split(value, "")))


def detected(docs: DataFrame, owner: str = "source", inner: str = "lang") -> DataFrame:
    """A number, doc_id, holder and the base and bare spans of each row, written once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(_spans(F.col("text"), ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= ASSIGN_LENGTH)
    base = F.concat(assign, _spans(F.col("text"), ACCESS, 1), _spans(F.col("text"), HEX, 2))
    bare = F.filter(_spans(F.col("text"), WIDE, 3, 0, WIDE_HINT), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", F.xxhash64(text).alias("text_key"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(inner).cast("string"), F.lit("")).alias("inner"), text.alias("text"),
    )
    rows = rows.withColumns({"base": base, "bare": bare}).drop("text")
    return materialize(rows.withColumn("bare", _apart(F.col("bare"), F.col("base"))), "detected")


def ownership(found: DataFrame) -> DataFrame:
    """Owners and repositories of each value's hash, and whether a base span holds it."""
    held = found.select("owner", "inner", F.explode(F.concat("base", "bare")).alias("s")).select("owner", "inner", F.sha2("s.value", 256).alias("hash"), (F.col("s.kind") < 3).cast("int").alias("base"))
    repositories = held.groupBy("hash", "owner", "inner").agg(F.max("base").alias("base"))
    owners = repositories.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.max("base").alias("base"))
    return owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.max("base").alias("base"))


def classified(found: DataFrame) -> DataFrame:
    """``found`` with all ``spans`` and the numbers of live-looking and example values."""
    each = found.select("uid", F.explode(F.concat("base", "bare")).alias("s")).withColumn("hash", F.sha2("s.value", 256))
    each = each.join(ownership(found), "hash")
    example, live = F.col("owners") >= EXAMPLE_OWNERS, F.col("owners") == 1
    is_base = F.col("s.kind") < 3
    owned = ~is_base & ~example & ((F.col("base") == 1) | (live & (_variety(F.col("s.value")) >= WIDE_VARIETY)))
    place = F.struct("s.start", "s.kind", "s.end")
    sums = each.groupBy("uid").agg(
        F.array_sort(F.collect_list(F.when(is_base | owned, place))).alias("spans"),
        F.sum((is_base & live).cast("long")).alias("n_live"), F.sum((is_base & example).cast("long")).alias("n_example"), F.sum(owned.cast("long")).alias("n_owned"),
    )
    return found.join(sums, "uid", "left")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    rows = classified(detected(docs))
    places = F.array_sort(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(_joined(places).cast("binary"), 256).alias("base_sha256"), F.coalesce(_joined(F.col("spans")), F.lit("")).alias("spans"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_example", "n_owned")],
    )


def redact(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mask``; other columns stay.

    The spans of the (few) texts that have any are joined by doc_id and a hash
    of the text, broadcast only if they are few.
    """
    found = classified(detected(docs)).where(F.size("spans") > 0)
    found = materialize(found.groupBy("doc_id", "text_key").agg(F.first("spans").alias("secret_spans")), "spans")
    found = found.select(F.col("doc_id").alias("secret_doc"), F.col("text_key").alias("secret_text"), "secret_spans")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    rows = docs.join(found, docs["doc_id"].eqNullSafe(found["secret_doc"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["secret_text"]), "left")
    text = docs["text"]
    place = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    spans = F.transform("secret_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("top")))
    opened = F.filter(_reached(spans, "struct<start:int,top:int>"), lambda r: r["event"]["start"] >= r["at"])
    places = F.concat(F.transform(opened, lambda r: place(r["at"], r["event"]["start"])), F.array(place(F.array_max(spans["top"]), F.length(text))))
    clean = F.array_join(_let(places, lambda p: _pieces(text, p)), mask)
    return rows.select(*[F.when(F.col("secret_spans").isNull(), text).otherwise(clean).alias(c) if c == "text" else docs[f"`{c}`"] for c in docs.columns])
