"""A batch of searches: sections, evidence, neighbours, times, governance, and what a question's intent adds, in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions import question as Q
from annalist.functions import text as T
from annalist.functions import vocab as V
from annalist.operators.governance import governed
from annalist.operators.lexical import bm25, top_each
from annalist.sources.store import stored

REQUEST = "qid long, query string, top_k int, expanded string, windows array<struct<centre: double, back: double, half: double>>, years array<int>, " + ", ".join(f"{n} boolean" for n in Q.INTENTS)


def requests(spark: SparkSession, asked: Sequence[tuple[int, str, int]], now: float) -> DataFrame:
    """Searches (qid, query, top_k) with what their questions ask for: as many rows as were asked."""
    rows = []
    for qid, query, top_k in asked:
        found = Q.clues(query, now)
        rows.append((qid, query, top_k, Q.expanded(query), [(c.centre, float(c.back), float(c.half)) for c in found], Q.years(found), *Q.intents(query).values()))
    return spark.createDataFrame(rows, REQUEST)


def sections(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, id, place, score): all anchors, oldest first, canon while top_k lasts, then rows by relevance that share a token with
    the question.  Only the last have a score."""
    fixed = rows.where("section <> 'ordinary'")
    counts = fixed.agg(F.count_if(F.col("section") == "anchor").alias("anchors"), F.count_if(F.col("section") == "canon").alias("canon"))
    place = F.row_number().over(W.partitionBy("section").orderBy("moment", "id"))
    room = F.greatest(F.col("top_k") - F.col("anchors"), F.lit(0))
    limits = asked.select("qid", "top_k").crossJoin(F.broadcast(counts)).withColumn("rest", room - F.least("canon", room))  # one row
    # the first of a section that any search shows
    shown = fixed.select("id", "section", place.alias("n")).join(F.broadcast(limits)).where((F.col("section") == "anchor") | (F.col("n") <= room))
    shown = shown.select("qid", "id", "section", F.when(F.col("section") == "anchor", F.col("n")).otherwise(F.col("anchors") + F.col("n")).alias("place"), F.lit(None).cast("double").alias("score"))
    ordinary = rows.where("section = 'ordinary'")
    hits = bm25(ordinary, asked.select("qid", F.col("expanded").alias("query"))).where("relevance > 0").join(ordinary.select("id", "moment"), "id")
    most = asked.agg(F.max("top_k")).first()[0] or 0  # as many as any search shows: the others drop out before they are shuffled
    ranked = top_each(hits, "qid", most, F.desc("relevance"), F.desc("moment"), "id").withColumnRenamed("rank", "n").join(F.broadcast(limits), "qid").where("n <= rest")
    return shown.unionByName(ranked.select("qid", "id", F.lit("ordinary").alias("section"), (F.col("anchors") + F.col("canon") + F.col("n")).alias("place"), F.col("relevance").alias("score")))


def neighbours(rows: DataFrame, asked: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, id, place, score) of turns near what was found that share a token with the question or with what was found; near
    a causal question's, any with tokens.  As many as top_k leaves room for, by session and place in it."""
    words = F.array_distinct(T.tokens(F.col("content")))
    seed = F.when(F.col("section") != "canon", F.struct("session_id", "position", words.alias("words")))
    ask = asked.select("qid", "top_k", "causal", F.array_distinct(T.tokens(F.col("expanded"))).alias("asks"))
    # one row per search with what it found: at most top_k rows and the anchors
    per = found.join(rows.select("id", "session_id", "position", "content"), "id").groupBy("qid").agg(F.collect_list(seed).alias("seeds"), F.collect_list("id").alias("ids")).join(F.broadcast(ask), "qid")
    per = per.withColumns({"signal": F.array_distinct(F.concat(F.flatten("seeds.words"), "asks")), "room": F.col("top_k") - F.size("seeds")})
    reach = F.when(F.col("causal"), V.CAUSAL_RADIUS).otherwise(V.NEAR_RADIUS)
    places = F.flatten(F.transform("seeds", lambda s: F.transform(F.sequence(s["position"] - reach, s["position"] + reach), lambda p: F.struct(s["session_id"].alias("session_id"), p.alias("position")))))
    around = per.select("qid", "ids", "signal", "causal", "room", F.inline(F.array_distinct(places)))
    near = around.join(rows.select("id", "session_id", "position", words.alias("words")), ["session_id", "position"]).where(~F.array_contains("ids", F.col("id")))
    hits = F.when(F.col("causal"), F.least(F.size("words"), F.lit(1))).otherwise(F.size(F.array_intersect("words", "signal")))
    n = F.row_number().over(W.partitionBy("qid").orderBy("session_id", "position", "id"))
    near = near.withColumn("hits", hits).where("hits > 0").withColumn("n", n).where("n <= room")
    return near.select("qid", "id", (F.lit(1_000_000) + F.col("n")).alias("place"), F.round(F.col("hits") * V.NEAR_SCORE, 4).alias("score"))


def timed(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """Scores by a question's times: memories that name its years first, then windows around times back from the newest entry."""
    e = entries.join(F.broadcast(asked.select("qid", "windows", "years")), "qid")
    named = F.arrays_overlap(T.years(F.col("content")), "years") & (F.size("windows") > 0)
    score = F.when(named, F.round(F.col("score") * V.YEAR_BOOST, 4)).otherwise(F.col("score"))
    newest = F.max("moment").over(W.partitionBy("qid")).cast("double")
    return e.withColumn("score", F.round(score * Q.weight(F.col("moment").cast("double"), newest, F.col("windows")), 4)).drop("windows", "years")


def summaries(rows: DataFrame) -> DataFrame:
    """Sessions' running summaries (session_id, summary, latest)."""
    points = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("position", "id", T.point(F.col("content")).alias("point")))).alias("p"), F.max("moment").alias("latest"))
    return points.select("session_id", T.rolled(F.col("p.point")).alias("summary"), "latest")


def added(rows: DataFrame, asked: DataFrame, intent: str, order: list[Column], limit: Column, score: float, place: int) -> DataFrame:
    """Rows that searches of an intent get whatever they share: (qid, entry, content, moment, score, group, place), the first
    ``limit`` by an order.  The most that any search can ask for is cut off first, without ranking the table."""
    who = asked.where(F.col(intent)).select("qid", limit.alias("limit"))
    most = who.agg(F.max("limit")).first()[0] or 0
    first = rows.orderBy(*order).limit(most)
    first = first.withColumn("place", F.row_number().over(W.orderBy(*order)))
    return first.join(F.broadcast(who)).where("place <= limit").select("qid", F.col("id").cast("string").alias("entry"), "content", "moment", F.lit(score).alias("score"), F.lit(place).alias("group"), "place")


def evidence(rows: DataFrame, asked: DataFrame, updates: DataFrame) -> DataFrame:
    """(qid, id, content, moment, score, place) of what searches found, governed: duplicates and old versions go down, and what
    was replaced (``updates``: old_id), if the question names no time."""
    found = sections(rows, asked)
    base = found.select("qid", "id", "place", "score").unionByName(neighbours(rows, asked, found))
    entries = timed(base.join(rows.select("id", "source", "content", "moment", "position"), "id"), asked)
    entries = stored(entries, "entries")
    timeless = entries.join(F.broadcast(asked.where(F.size("windows") == 0).select("qid")), "qid").select("qid", "id")  # as many as were asked
    old = timeless.join(updates.select(F.col("old_id").alias("id")), "id", "left_semi")
    after = F.row_number().over(W.partitionBy("qid").orderBy(F.col("score").isNotNull(), F.desc("score"), "place"))
    return governed(entries, old).select("qid", "id", "content", "moment", "score", after.alias("place"))


def searched(rows: DataFrame, asked: DataFrame, updates: DataFrame, contradictions: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """(qid, rank, entry, score) of a batch of searches (see requests()) over ``rows`` (id, session_id, position, source,
    content, moment, section, rule), with the versions (old_id) and contradictions (a, b) that were recorded when rows came.

    Entries with one id count once, with their best score.  Unscored ones (anchors and canon) come first.  Ties keep the
    order in which entries came in.  What the searches found and what they show (a few times top_k rows each) is written, as
    later steps read it again.  ``told`` are the sessions' summaries if they are kept.
    """
    main = evidence(rows, asked, updates).select("qid", F.col("id").cast("string").alias("entry"), "content", "moment", "score", F.lit(2).alias("group"), "place")
    cap = F.greatest(F.lit(1), F.least(F.lit(4), F.floor(F.col("top_k") / 4))).cast("int")
    told = (summaries(rows) if told is None else told).where("summary <> ''").select(F.concat(F.lit("summary_"), F.substring(F.sha2(F.col("session_id").cast("string"), 256), 1, 10)).alias("id"), F.substring("summary", 1, V.SUMMARY_SHOWN).alias("content"), F.lit(None).cast("long").alias("moment"), "latest")
    top = F.col("top_k")
    out = main.unionByName(added(told, asked, "summary", [F.desc("latest"), F.col("id")], cap, V.PREPENDED_SCORE, 0))
    newest = [F.desc("moment"), F.desc("position"), F.desc("id")]
    out = out.unionByName(added(rows.where("rule"), asked, "rule", newest, F.least(top, F.lit(V.RULES_SHOWN)), V.PREPENDED_SCORE, 1))
    rule = F.exists(F.array(*map(F.lit, V.RULE_INDICATORS)), lambda x: F.contains(F.lower("content"), x))
    out = out.join(F.broadcast(asked.select("qid", "rule_answer")), "qid").withColumn("score", F.when(F.col("rule_answer") & rule & F.col("score").isNotNull(), F.greatest("score", F.lit(V.RULE_FLOOR))).otherwise(F.col("score"))).drop("rule_answer")
    likes = added(rows, asked, "preference", [F.desc("moment"), F.desc("id")], F.lit(V.PREFERENCES_SEEN), V.PREFERENCE_SCORE, 3).where(T.domain(F.col("content")) == "preference")
    recent = added(rows, asked, "recent", [F.desc("moment"), F.desc("id")], top, V.RECENT_SCORE, 4)
    out = stored(lifted(unseen(out.unionByName(likes).unionByName(recent)), asked), "shown")
    ids = out.select("qid", "entry").distinct()
    both = contradictions.select("a", "b").unionByName(contradictions.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").cast("string").alias("entry"), F.col("b").alias("other"))
    partner = both.join(ids, "entry").select("qid", "other").distinct().join(rows.select(F.col("id").alias("other"), "content", "moment"), "other")
    out = unseen(out.unionByName(partner.select("qid", F.col("other").cast("string").alias("entry"), "content", "moment", F.lit(V.PARTNER_SCORE).alias("score"), F.lit(5).alias("group"), F.col("other").cast("int").alias("place"))))
    once = F.row_number().over(W.partitionBy("qid", "entry").orderBy(F.col("score").isNotNull(), F.desc("score"), "group", "place"))
    out = out.withColumn("n", once).where("n = 1").join(F.broadcast(asked.select("qid", "top_k", "order")), "qid")
    scored = F.col("score").isNotNull()
    told_at = F.when(F.col("order") & scored, F.coalesce("moment", F.lit(0))).otherwise(F.lit(0))
    by_score = F.when(F.col("order"), F.lit(0.0)).otherwise(F.col("score"))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(scored, told_at, F.desc(by_score), "group", "place", "entry"))
    return out.withColumn("rank", rank).where("rank <= top_k").select("qid", "rank", "entry", F.round("score", 4).alias("score"))


def unseen(out: DataFrame) -> DataFrame:
    """Entries without those of groups from 3 on that an earlier group has."""
    first = F.min("group").over(W.partitionBy("qid", "entry"))
    return out.withColumn("first", first).where((F.col("group") <= F.greatest("first", F.lit(2)))).drop("first")


def lifted(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """The newest three tenths of the scored entries of a question about recent times gain, up to 1."""
    scored = F.col("score").isNotNull()
    e = entries.join(F.broadcast(asked.select("qid", "recent")), "qid")
    n = F.row_number().over(W.partitionBy("qid", scored).orderBy(F.desc(F.coalesce("moment", F.lit(0))), "group", "place"))
    many = F.greatest(F.lit(1), F.floor(F.count("*").over(W.partitionBy("qid", scored)) * 0.3))
    lift = F.col("recent") & scored & (n <= many)
    e = e.withColumn("lift", lift)
    return e.withColumn("score", F.when(F.col("lift"), F.least(F.col("score") + V.RECENT_LIFT, F.lit(1.0))).otherwise(F.col("score"))).select(entries.columns)
