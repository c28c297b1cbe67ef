"""Checks that return their violations as rows, and joins that say what they did not find.

A check never stops a job: it gives (key, problem) rows, which an empty result proves absent. Keys meet in joins and
aggregates that combine on the map side; problems of one key are a handful of names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def named(rows: DataFrame, key: tuple[str, ...], problems: dict[str, Column]) -> DataFrame:
    """(key, problem): one row for each named condition that holds in a row."""
    hit = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in problems.items()]))
    return rows.select(*key, F.explode(hit).alias("problem"))


# --- pools ---------------------------------------------------------------------------------------------------


def pool_shape(candidates: DataFrame, gold: DataFrame, records: DataFrame, size: int) -> DataFrame:
    """(qid, problem) of pools: candidates (qid, idx, flagged), gold (qid, idx), records (qid, validated).

    A pool must have `size` candidates and every gold id among them. Where the gold was validated, just the gold
    candidates are flagged; where it was not, none is.
    """
    both = candidates.select("qid", "idx", "flagged", F.lit(True).alias("held")).join(gold.select("qid", "idx", F.lit(True).alias("gold")).distinct(), ["qid", "idx"], "full_outer")
    held, is_gold, flagged = (F.coalesce(c, F.lit(False)) for c in ("held", "gold", "flagged"))
    g = both.groupBy("qid").agg(
        F.count_if(held).alias("n"), F.count_if(is_gold & ~held).alias("strangers"), F.count_if(held & flagged).alias("flags"), F.count_if((held & flagged) != is_gold).alias("unlike"),
    )
    r = records.join(g, "qid", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "strangers", "flags", "unlike")})
    validated = F.coalesce("validated", F.lit(False))
    return named(r, ("qid",), {
        "empty_pool": F.col("n") == 0, "pool_size": F.col("n") != size, "gold_not_among_candidates": F.col("strangers") > 0,
        "flags_are_not_the_gold": validated & (F.col("unlike") > 0), "flagged_without_validation": ~validated & (F.col("flags") > 0),
    })


def merge_reviews(pool: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pool with the columns reviewed, reviewer and reason, and the reviews that could not be merged as (qid, idx, problem).

    pool is (qid, idx, gold, ..), reviews (qid, idx, validated, reviewer, reason). Reviews that validate nothing are passed
    over; one must name its reviewer and reason, and a candidate of its pool that is no gold. Of several for one
    candidate, the last by reviewer and reason counts.
    """
    valid = reviews.where("validated")
    bare = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    known = valid.join(pool.select("qid", "idx", "gold"), ["qid", "idx"], "left")
    problem = F.when(F.col("qid").isNull() | F.col("idx").isNull() | bare("reviewer") | bare("reason"), "missing_field").when(F.col("gold").isNull(), "unknown_document").when(F.col("gold"), "gold_cannot_be_stale")
    judged = known.withColumn("problem", problem)
    good = judged.where("problem IS NULL").groupBy("qid", "idx").agg(F.max(F.struct("reviewer", "reason")).alias("r"))
    merged = pool.join(good, ["qid", "idx"], "left").select(*[c for c in pool.columns if c != "reviewed"], F.col("r").isNotNull().alias("reviewed"), "r.reviewer", "r.reason")
    return merged, judged.where("problem IS NOT NULL").select("qid", "idx", "problem")


def alignment(records: DataFrame, key: str, texts: str, metadata: str) -> DataFrame:
    """(key, position, text, meta, status): the elements of two arrays side by side, none left out.

    metadata holds structs with index and doc_id, either of which may be null. status is LENGTH_DIFFERS where the arrays do
    not pair up, INDEX_CONFLICT, REPEATED_DOCUMENT, INDEX_CHECKED, or POSITIONAL_ONLY for want of an index.
    """
    zipped = records.select(key, F.size(texts).alias("n"), F.size(metadata).alias("m"), F.transform(metadata, lambda x: x["doc_id"]).alias("ids"), F.posexplode(F.arrays_zip(F.col(texts).alias("text"), F.col(metadata).alias("meta"))).alias("position", "e"))
    at, doc = F.col("e.meta.index"), F.col("e.meta.doc_id")
    again = F.size(F.filter("ids", lambda x: x == doc)) > 1
    status = (
        F.when(F.col("n") != F.col("m"), "LENGTH_DIFFERS").when(at.isNotNull() & (at != F.col("position")), "INDEX_CONFLICT").when(doc.isNotNull() & again, "REPEATED_DOCUMENT")
        .when(at.isNotNull(), "INDEX_CHECKED").otherwise("POSITIONAL_ONLY")
    )
    return zipped.select(key, "position", F.col("e.text").alias("text"), F.col("e.meta").alias("meta"), status.alias("status"))


# --- parents and children -------------------------------------------------------------------------------------


def child_groups(children: DataFrame, key: str, position: str, parent: str, index: str) -> DataFrame:
    """children with `slot`: the number, from 0, of the run of children that a parent's occurrence has, in the order of position.

    A run ends where the parent changes or the child index starts again at 0, so two occurrences of one parent
    side by side stay apart.
    """
    w = Window.partitionBy(key).orderBy(position)
    new = F.col(parent).eqNullSafe(F.lag(parent).over(w)) & (F.col(index) != 0)
    return children.withColumn("slot", F.sum(F.when(new, 0).otherwise(1)).over(w) - 1)


def lineage(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """(key, slot, problem): parents (key, slot, doc_id, ts, flag), children (key, slot, n, doc_id, parent_doc_id, ts, flag).

    n is a child's number in its slot, from 0; its id must be the parent's with #chunk and that number, and its parent,
    time and flag must be those of the parent in its slot. Every parent has children, every child a parent.
    """
    p = parents.select(key, "slot", F.struct("doc_id", "ts", "flag").alias("p"))
    c = children.select(key, "slot", F.struct("n", "doc_id", "parent_doc_id", "ts", "flag").alias("c"))
    both = p.join(c, [key, "slot"], "full_outer")
    whole = F.col("p").isNotNull() & F.col("c").isNotNull()
    return named(both, (key, "slot"), {
        "parent_without_children": F.col("c").isNull(), "child_without_parent": F.col("p").isNull(),
        "parent_differs": whole & ~F.col("c.parent_doc_id").eqNullSafe(F.col("p.doc_id")),
        "id_or_order_differs": whole & ~F.col("c.doc_id").eqNullSafe(F.concat(F.col("p.doc_id").cast("string"), F.lit("#chunk"), F.col("c.n").cast("string"))),
        "time_differs": whole & ~F.col("c.ts").eqNullSafe(F.col("p.ts")), "flag_differs": whole & F.col("c.flag").isNotNull() & (F.col("c.flag") != F.col("p.flag")),
    }).distinct()


# --- joins ----------------------------------------------------------------------------------------------------


def fetch(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows of the wanted keys, each once with found true, and the keys that rows has not, with found false and nulls."""
    return wanted.select(key).distinct().join(rows.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def agreement_problems(left: DataFrame, right: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """(key, problem): keys of left that right lacks, that either side repeats, or whose columns differ (name_differs)."""
    a = left.groupBy(key).agg(F.count("*").alias("x"), *[F.min(c).alias(f"a_{c}") for c in columns])
    b = right.groupBy(key).agg(F.count("*").alias("y"), *[F.min(c).alias(f"b_{c}") for c in columns])
    both = a.join(b, key, "left")
    once = (F.col("x") == 1) & (F.col("y") == 1)
    differ = {f"{c}_differs": once & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in columns}
    return named(both, (key,), {"missing": F.col("y").isNull(), "repeated_left": F.col("x") > 1, "repeated_right": F.col("y") > 1} | differ)


def bound_annotations(annotations: DataFrame, frame: DataFrame, digest: tuple[str, ...]) -> DataFrame:
    """(digest columns, qid, n_locations, membership): equal annotations once, with the number of places they stand in.

    annotations is (digest columns, qid); frame is (qid). membership is IN_FRAME for annotations bound to a question of the
    frame; all others are in quarantine, as OUT_OF_FRAME or, without a question, MISSING_ID.
    """
    once = annotations.groupBy(*digest, "qid").agg(F.count("*").alias("n_locations"))
    inside = once.join(frame.select("qid", F.lit(True).alias("inside")).distinct(), "qid", "left")
    state = F.when(F.col("qid").isNull(), "MISSING_ID").when(F.col("inside").isNull(), "OUT_OF_FRAME").otherwise("IN_FRAME")
    return inside.select(*digest, "qid", "n_locations", state.alias("membership"))


def consistency(rows: DataFrame, manual: str, judged: str, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """rows with `consistent`: whether the judge's label is one that the manual label allows; null for an unknown manual label."""
    pairs = [F.when(F.col(manual) == m, F.col(judged).isin(*labels)) for m, labels in allowed.items()]
    return rows.withColumn("consistent", F.coalesce(*pairs))


def snapshot_problems(expected: DataFrame, found: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, problem): parts of a snapshot that are missing, unexpected, or of another digest than the manifest states."""
    a, b = expected.select(key, F.col(digest).alias("a")), found.select(key, F.col(digest).alias("b"))
    both = a.withColumn("x", F.lit(1)).join(b.withColumn("y", F.lit(1)), key, "full_outer")
    return named(both, (key,), {"missing": F.col("y").isNull(), "unexpected": F.col("x").isNull(), "digest_differs": F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.col("a").eqNullSafe(F.col("b"))})


def schema_problems(df: DataFrame, expected: dict[str, str]) -> list[tuple[str, str]]:
    """(column, problem) of a table's schema against names and types; from metadata only."""
    have = dict(df.dtypes)
    return [(c, "missing" if c not in have else "type_differs") for c, t in expected.items() if have.get(c) != t] + [(c, "unexpected") for c in have if c not in expected]


# --- rows of an analysis --------------------------------------------------------------------------------------

# The states of an analysis frame and its rows.
FRAME_STATES = {"eligibility": ("ELIGIBLE", "INELIGIBLE", "UNKNOWN", "NOT_REVIEWED"), "clean": ("CORRECT", "OTHER_WRONG", "ABSTAIN", "NEEDS_REVIEW", "MISSING")}
ROW_STATES = {
    "construction": ("SUCCEEDED", "FAILED", "UNKNOWN", "NOT_ATTEMPTED"),
    "retrieval": ("YES", "NO", "UNKNOWN", "NOT_APPLICABLE"),
    "generator": ("YES", "NO", "TRUNCATED", "UNVERIFIED", "UNKNOWN", "NOT_APPLICABLE"),
    "outcome": ("POISON_ADOPTED", "CORRECT", "OTHER_WRONG", "ABSTAIN", "NEEDS_REVIEW", "MISSING"),
}
RESOLVED = ("POISON_ADOPTED", "CORRECT", "OTHER_WRONG", "ABSTAIN")
POPULATIONS = ("fixed_frame", "eligible", "clean_correct", "constructed", "retrieved", "visible", "judge_resolved")


def analysis_problems(frame: DataFrame, rows: DataFrame) -> DataFrame:
    """(question_id, problem) of frame (question_id, eligibility, clean) and rows (question_id, family, condition, states)."""
    unlike = lambda states: {f"unknown_{c}": F.col(c).isNull() | ~F.col(c).isin(*s) for c, s in states.items()}
    repeated = lambda df, key: df.groupBy(*key).count().where("count > 1").select("question_id")
    no_name = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    parts = [
        named(frame, ("question_id",), unlike(FRAME_STATES)),
        repeated(frame, ("question_id",)).withColumn("problem", F.lit("repeated_question")),
        rows.join(frame, "question_id", "left_anti").select("question_id", F.lit("question_not_in_frame").alias("problem")),
        repeated(rows, ("question_id", "family", "condition")).withColumn("problem", F.lit("repeated_row")),
        named(rows, ("question_id",), unlike(ROW_STATES) | {
            "unnamed_condition": no_name("family") | no_name("condition"),
            "resolved_without_construction": ~F.col("construction").eqNullSafe("SUCCEEDED") & F.col("outcome").isin(*RESOLVED),
        }),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def _value() -> Column:
    """1 for an adopted claim, 0 for another resolved outcome, null where the outcome does not stand."""
    stands = F.col("construction").eqNullSafe("SUCCEEDED") & F.col("outcome").isin(*RESOLVED) & ~F.coalesce("generator", F.lit("")).isin("TRUNCATED", "UNVERIFIED")
    return F.when(stands, (F.col("outcome") == "POISON_ADOPTED").cast("int"))


def _members() -> dict[str, Column]:
    """Whether a question (joined to its row, if there is one) is in each population; null where that is unknown."""
    unknown, out = F.col("eligibility").isin("UNKNOWN", "NOT_REVIEWED"), F.col("eligibility") == "INELIGIBLE"

    def inner(c: Column) -> Column:
        return F.when(~unknown, F.when(out, F.lit(False)).otherwise(c))

    def built(c: Column) -> Column:
        state = F.coalesce("construction", F.lit("UNKNOWN"))
        return inner(F.when(state == "FAILED", F.lit(False)).when(~state.isin("UNKNOWN", "NOT_ATTEMPTED"), c))

    seen = lambda c: F.when(F.col(c) == "YES", F.lit(True)).when(F.col(c).isin("NO", "NOT_APPLICABLE"), F.lit(False))
    return {
        "fixed_frame": F.lit(True),
        "eligible": inner(F.lit(True)),
        "clean_correct": inner(F.when(~F.col("clean").isin("MISSING", "NEEDS_REVIEW"), F.col("clean") == "CORRECT")),
        "constructed": built(F.lit(True)),
        "retrieved": built(seen("retrieval")),
        "visible": built(seen("generator")),
        "judge_resolved": built(F.col("outcome").isin(*RESOLVED)),
    }


def population_rates(frame: DataFrame, rows: DataFrame) -> DataFrame:
    """The rate of adopted claims by family, condition and population, one row for each.

    (family, condition, population, status, reason, adopted, members, unresolved, unknown, estimate, low, high, widest_low,
    widest_high): a rate is NOT_ESTIMABLE while any membership is unknown, UNDEFINED without members or with an unresolved
    outcome, else DEFINED. low and high are its bounds over the unresolved outcomes of known members, the widest
    ones also over questions of unknown membership. Every question of the frame counts in every family and condition,
    with a row or without, by arithmetic: those without one are the frame less those with one.
    """
    value, members = _value(), _members()
    joined = rows.join(frame, "question_id").withColumn("_v", value)
    states = F.array(*[F.struct(F.lit(p).alias("population"), m.alias("m")) for p, m in members.items()])
    # questions without a row: their membership depends on the frame alone
    alone = frame.withColumns({c: F.lit(None).cast("string") for c in ("construction", "retrieval", "generator", "outcome")})

    def counted(df: DataFrame, *key: str) -> DataFrame:
        e = df.select(*key, "_v", F.explode(states).alias("s")).select(*key, "_v", "s.population", "s.m")
        return e.groupBy(*key, "population").agg(
            F.count_if("m").alias("members"), F.count_if(F.col("m").isNull()).alias("unknown"), F.count_if(F.col("m") & (F.col("_v") == 1)).alias("adopted"), F.count_if(F.col("m") & F.col("_v").isNull()).alias("unresolved"),
        )

    key = ("family", "condition")
    have = counted(joined, *key)
    blank = joined.withColumns({c: F.lit(None).cast("string") for c in ("construction", "retrieval", "generator", "outcome")}).withColumn("_v", F.lit(None).cast("int"))
    instead = counted(blank, *key).select(*key, "population", *[F.col(c).alias(f"_{c}") for c in ("members", "unknown", "unresolved")])
    every = counted(alone.withColumn("_v", F.lit(None).cast("int"))).select("population", *[F.col(c).alias(f"e_{c}") for c in ("members", "unknown", "unresolved")])
    r = have.join(instead, [*key, "population"]).join(F.broadcast(every), "population")  # seven rows
    r = r.withColumns({c: F.col(c) + F.col(f"e_{c}") - F.col(f"_{c}") for c in ("members", "unknown", "unresolved")})
    n, k, u, x = F.col("members"), F.col("adopted"), F.col("unresolved"), F.col("unknown")
    status = F.when(x > 0, "NOT_ESTIMABLE").when((n == 0) | (u > 0), "UNDEFINED").otherwise("DEFINED")
    reason = F.when(x > 0, "UNKNOWN_POPULATION_MEMBERSHIP").when(n == 0, "ZERO_DENOMINATOR").when(u > 0, "UNRESOLVED_OUTCOMES")
    share = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    return r.select(
        *key, "population", status.alias("status"), reason.alias("reason"), "adopted", "members", "unresolved", "unknown", F.when(status == "DEFINED", share(k, n)).alias("estimate"),
        share(k, n).alias("low"), share(k + u, n).alias("high"), share(k, n + x).alias("widest_low"), share(k + u + x, n + x).alias("widest_high"),
    )


def paired_difference(frame: DataFrame, rows: DataFrame, families: tuple[str, ...], by: tuple[str, ...] = (), neutral: str = "neutral", freshness: str = "freshness") -> DataFrame:
    """(by, status, eligible, complete, unknown, estimate, low, high): freshness less neutral, all questions and families alike.

    A question counts if it is eligible, and is complete with both outcomes in each of the families. One that is not makes
    the estimate UNDEFINED, one of unknown eligibility NOT_ESTIMABLE; low and high bound it over what is missing.
    """
    held = rows.where(F.col("family").isin(*families)).withColumn("_v", _value()).groupBy("question_id", "family").agg(
        F.max(F.when(F.col("condition") == neutral, F.col("_v"))).alias("a"), F.max(F.when(F.col("condition") == freshness, F.col("_v"))).alias("b"))
    q = held.groupBy("question_id").agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("pairs"), F.count("*").alias("n"), F.sum(F.col("b") - F.col("a")).alias("d"),
        F.sum(F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(1))).alias("low"), F.sum(F.coalesce("b", F.lit(1)) - F.coalesce("a", F.lit(0))).alias("high"))
    m = len(families)
    f = frame.join(q, "question_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("pairs", "n", "low", "high")})
    eligible, unknown = F.col("eligibility") == "ELIGIBLE", F.col("eligibility").isin("UNKNOWN", "NOT_REVIEWED")
    whole = eligible & (F.col("pairs") == m)
    g = f.groupBy(*by).agg(
        F.count_if(eligible).alias("eligible"), F.count_if(whole).alias("complete"), F.count_if(unknown).alias("unknown"), F.avg(F.when(whole, F.col("d") / m)).alias("d"),
        F.avg(F.when(eligible, (F.col("low") - (m - F.col("n"))) / m)).alias("low"), F.avg(F.when(eligible, (F.col("high") + (m - F.col("n"))) / m)).alias("high"))
    status = F.when(F.col("unknown") > 0, "NOT_ESTIMABLE").when((F.col("eligible") == 0) | (F.col("complete") < F.col("eligible")), "UNDEFINED").otherwise("DEFINED")
    return g.select(*by, status.alias("status"), "eligible", "complete", "unknown", F.when(status == "DEFINED", F.round("d", 6)).alias("estimate"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def metric_tests(values: DataFrame) -> DataFrame:
    """(metric, n, is_binary, test) of values (metric, value): paired counts if all defined values are 0 or 1, else resampling."""
    g = values.groupBy("metric").agg(F.count("value").alias("n"), F.coalesce(F.bool_and(F.col("value").isin(0, 1)), F.lit(False)).alias("is_binary"))
    return g.select("metric", "n", "is_binary", F.when(F.col("is_binary"), "mcnemar").otherwise("paired_bootstrap").alias("test"))


def harm_review(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Rows whose answer a selected poison turned from right to wrong (n_selected, em_clean, em_attacked), with blank label columns."""
    harmed = rows.where((F.col("n_selected") > 0) & (F.col("em_clean") == 1) & (F.col("em_attacked") == 0))
    return harmed.select(*keep, F.lit("").alias("manual_label"), F.lit("").alias("manual_notes"))
