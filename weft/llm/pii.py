r"""Personal data and information-theoretic sanitisation, with DataFrame operations only.

Base spans (email, ip, card, phone) are found in each row: the matches of a pattern and the gaps between them,
taken by the same pattern, give every match's offset by running sums in blocks, so that n matches cost n ** 1.5 small
copies at most. Patterns begin at the start of a run or at the end of the last match (``\G``) and use possessive
loops, which gives the leftmost non-overlapping matches of the plain patterns in time linear in the text and without recursion.

The method: each distinct value found is a protected entity. With document counts over the whole corpus
(N documents, n_e with the entity, n_t with the term, n_et with both, however far apart), a term discloses log(N n_et / (n_e n_t)) of the log(N / n_e) that the entity itself is worth. In
documents with the entity, every term that discloses at least ``GENERALISE`` of it is marked, however few
the documents: a value found once counts like any other. Those that disclose ``REMOVE`` or more are removed if they
do so of log(N / n_et), too, what the pair itself is worth (the same for terms in all of the entity's documents, more
for those in some of them), and replaced by their kind if not. Spans of kind ``remove`` and ``generalise`` mark every
occurrence of such a term in that document, found by joining its words with the verdicts. Documents without personal
data get no spans. Terms are runs of letters outside base spans (of these only e-mail addresses hold letters). Entities of the same documents disclose alike: they count once, so that a document with many values of
its own makes no more rows than one with a single value.

Shuffles: partial counts of terms, rows of (document, entities, term), the words and the texts of those documents that hold personal data. Counts combine before each shuffle.

Defined results: a null text is an empty one; rows that share doc_id share the terms to mark; in an empty corpus
nothing is found; other columns are not read. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table, text_hash, texts, written

REMOVE, GENERALISE = 0.9, 0.6
SHORTEST = 3  # letters of a term
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of these has none of the pattern, either.
HINTS = {"email": r"@[A-Za-z0-9]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_SPAN = "struct<a:int,b:int,m:string>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans_of(text: Column, pattern: Column, keep=None) -> Column:
    """array<struct<a, b, m>>: start, end and text of each match that ``keep`` holds for.

    An array that grows by one is copied, so offsets run over about sqrt(n) blocks, and within each."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"))
    return _let(pairs, lambda p: _let(_blocks(p), lambda blocks: _let(_starts(blocks), lambda starts: _located(blocks, starts, keep))))


def _blocks(pairs: Column) -> Column:
    side = F.ceil(F.sqrt(F.size(pairs).cast("double"))).cast("int")
    last = F.floor((F.size(pairs) - 1) / side).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(pairs, k * side + 1, side))


def _length(pair: Column) -> Column:
    return F.length(pair["gap"]) + F.coalesce(F.length(pair["m"]), F.lit(0))


def _starts(blocks: Column) -> Column:
    sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda s, pair: s + _length(pair)))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sums, zero, lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])


def _located(blocks: Column, starts: Column, keep) -> Column:
    def step(s: Column, pair: Column) -> Column:
        a = s["at"] + F.length(pair["gap"])
        span = F.struct(a.alias("a"), (a + F.length(pair["m"])).alias("b"), pair["m"].alias("m"))
        drop = pair["m"].isNull() if keep is None else pair["m"].isNull() | ~keep(pair["m"])
        return F.struct((s["at"] + _length(pair)).alias("at"), F.when(drop, s["out"]).otherwise(F.array_append(s["out"], span)).alias("out"))

    def one(block: Column, k: Column) -> Column:
        zero = F.struct(F.element_at(starts, k + 1).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
        return F.aggregate(block, zero, step, lambda s: s["out"])

    return F.flatten(F.transform(blocks, one))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def step(s: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), _octet)
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(m))).otherwise(F.lit(False))
    return n.between(8, 15)


def _checked(kind: str):
    return None if kind == "email" else lambda m: _valid(kind, m)


def _octet(x: Column) -> Column:
    return x.rlike(r"^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$")


def with_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the base spans of each kind as a column of that name."""
    out = texts(docs)
    for kind in KINDS:
        found = F.when(F.col("text").rlike(HINTS[kind]), spans_of(F.col("text"), F.lit(PATTERNS[kind]), _checked(kind))).otherwise(F.array().cast(f"array<{_SPAN}>"))
        out = out.withColumn(kind, found)
    return out.select("doc_id", "text", *KINDS)


def _value(kind: str, m: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.lower(m) if kind == "email" else m if kind == "ip" else _digits(m))


def _spans_as(kind: str, more) -> Column:
    return F.transform(kind, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), more(s, kind)))


def _terms(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, r"[^\p{L}]+"), lambda t: F.length(t) >= SHORTEST), F.lower)


def _outside() -> Column:
    """The text with a blank for each e-mail address; the other base spans hold no letters."""
    return F.regexp_replace("text", F.lit(PATTERNS["email"]), F.lit(" "))


def holding(found: DataFrame, folder: str) -> DataFrame:
    """Distinct rows of doc_id, grp (the entities of one set of documents), n_e, and a term of the document."""
    spans = F.concat(*[_spans_as(k, lambda s, k: _value(k, s["m"]).alias("entity")) for k in KINDS])
    held = written(found.select("doc_id", F.explode(F.array_distinct(spans["entity"])).alias("entity")).distinct(), f"{folder}/held")
    grps = held.groupBy("entity").agg(F.bit_xor(F.xxhash64("doc_id")).alias("grp"), F.count("*").alias("n_e"))
    of = held.join(grps, "entity").select(F.col("doc_id").alias("_id"), "grp", "n_e").distinct()
    terms = found.select("doc_id", F.explode("terms").alias("term")).distinct()
    return terms.join(of, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "grp", "n_e", "term")


def counted(docs: DataFrame, found: DataFrame) -> DataFrame:
    """term, n_t: the rows of ``docs`` that have it outside base spans."""
    every = texts(docs).select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"), F.lit(1).alias("n"))
    # Only what stands in spans alone has to be taken off again.
    less = found.select(F.explode(F.array_except(F.array_distinct(_terms(F.col("text"))), "terms")).alias("term"), F.lit(-1).alias("n"))
    more = found.select(F.explode(F.array_except("terms", F.array_distinct(_terms(F.col("text"))))).alias("term"), F.lit(1).alias("n"))
    return every.unionByName(less).unionByName(more).groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosing(docs: DataFrame, found: DataFrame, rows: DataFrame, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """grp, n_e, term, removed (or else generalised) of the pairs at or above the lower threshold."""
    n = docs.count()
    seen = rows.where(F.col("n_e") < n).groupBy("grp", "n_e", "term").agg(F.count("*").alias("n_et"))
    both = seen.join(counted(docs, found), "term")
    bits = F.log(F.lit(float(n)) * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    ratio, shrunk = (bits / F.log(F.lit(float(n)) / F.col(c)) for c in ("n_e", "n_et"))
    return both.where(ratio >= generalise).select("grp", "n_e", "term", (F.least(ratio, shrunk) >= remove).alias("removed"))


def analyse(docs: DataFrame, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """doc_id, the base spans by kind, ``remove`` and ``generalise`` (spans of terms), and text where there is any span."""
    folder = shared_dir(docs.sparkSession)
    any_span = F.size(F.concat(*KINDS)) > 0
    found = with_spans(docs).withColumn("text", F.when(any_span, F.col("text")))
    found = written(found.withColumn("terms", F.when(any_span, F.array_distinct(_terms(_outside())))), f"{folder}/found")
    held = found.where("text is not null")
    rows = written(holding(held, folder), f"{folder}/rows")
    verdicts = disclosing(docs, held, rows, remove, generalise)
    hit = rows.join(verdicts, ["grp", "n_e", "term"]).groupBy(F.col("doc_id").alias("_id"), F.col("term").alias("_term")).agg(F.max("removed").alias("removed"))
    words = spans_of(F.col("text"), F.lit(r"\p{L}+"), lambda m: F.length(m) >= SHORTEST)
    words = held.select("doc_id", text_hash().alias("t"), words.alias("words")).distinct().select("doc_id", "t", F.explode("words").alias("w"))
    marked = words.join(hit, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.lower("w.m") == F.col("_term")))
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("w"))))
    per = marked.groupBy(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).agg(pick(F.col("removed")).alias("remove"), pick(~F.col("removed")).alias("generalise"))
    # Rows without spans, which have no text here, have no part in the join: they are passed on beside it.
    out = held.withColumn("t", text_hash()).join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left")
    none = F.array().cast(f"array<{_SPAN}>")
    out = out.select("doc_id", "text", *KINDS, *[F.coalesce(c, none).alias(c) for c in ("remove", "generalise")])
    return out.unionByName(found.where("text is null").select("doc_id", "text", *KINDS, none.alias("remove"), none.alias("generalise")))


def sanitised(docs: DataFrame) -> DataFrame:
    """doc_id and text with base spans replaced by their kind, terms removed or replaced by [term]; null where nothing was found.

    Spans are taken from the left, the longest first; one that begins inside another is dropped with it. The text is cut as an array of
    code points: a piece costs its own length, not that of all before it."""
    label = {k: f"[{k}]" for k in KINDS} | {"remove": "", "generalise": "[term]"}
    ranked = F.transform(F.concat(*[_spans_as(k, lambda s, k: F.lit(label[k]).alias("by")) for k in label]), lambda s: F.struct(s["a"].alias("a"), (-s["b"]).alias("z"), s["b"].alias("b"), s["by"].alias("by")))
    spans = F.array_sort(ranked)
    rows = analyse(docs).where("text is not null").select("doc_id", F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)).alias("chars"), spans.alias("spans"))
    end = lambda i: F.coalesce(F.get("reach", i - 1), F.lit(0))
    rows = rows.withColumn("reach", _running_most(F.transform("spans", lambda s: s["b"])))
    gap = lambda a, b: F.array_join(F.slice("chars", a + 1, F.greatest(b - a, F.lit(0))), "")
    parts = F.transform("spans", lambda s, i: F.when(s["a"] >= end(i), F.concat(gap(end(i), s["a"]), s["by"])).otherwise(F.lit("")))
    last = end(F.size("spans"))
    return rows.select("doc_id", F.concat(F.array_join(parts, ""), gap(last, F.size("chars"))).alias("text"))


def _running_most(values: Column) -> Column:
    """Of each place the greatest value up to it, in blocks as in spans_of."""
    append = lambda s, x: F.struct(F.greatest(s["m"], x).alias("m"), F.array_append(s["out"], F.greatest(s["m"], x)).alias("out"))
    zero = lambda m: F.struct(m.alias("m"), F.array().cast("array<int>").alias("out"))

    def within(blocks: Column) -> Column:
        tops = F.aggregate(F.transform(blocks, F.array_max), zero(F.lit(0)), append, lambda s: s["out"])
        return _let(tops, lambda tops: F.flatten(F.transform(blocks, lambda b, k: F.aggregate(b, zero(F.coalesce(F.get(tops, k - 1), F.lit(0))), append, lambda s: s["out"]))))

    return F.when(F.size(values) > 0, _let(_blocks(values), within)).otherwise(F.array().cast("array<int>"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda k: F.transform(k, lambda s: F.concat_ws(":", F.lit(k), s["a"], s["b"]))
    told = lambda kinds: F.concat_ws(",", *map(one, kinds))
    return analyse(table(spark, sf_dir, "documents")).select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(told(KINDS).cast("binary"), 256).alias("base_sha256"), told([*KINDS, "remove", "generalise"]).alias("spans")
    )
