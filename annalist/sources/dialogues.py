"""Dialogue files: an object per conversation, whose sessions are keys with a number, and questions with the turns that answer them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalist.functions.rules import is_text, items, kind_of, text_at

SESSION = r"^session_([0-9]+)$"
CATEGORIES = (1, 5)
ADVERSARIAL = 5


def _strings(v: Column, path: str) -> Column:
    return F.coalesce(kind_of(v, path) == "STRING", F.lit(False))


def imported(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """JSON lines (value) to documents, questions and what is wrong.

    Documents: conversation, session (number), position, id, text (the speaker's name before it, an image's caption after it), in
    the order of the sessions' numbers.  Questions: conversation, number, question, category, gold (ids, each once, in order),
    excluded (``adversarial``, ``no_evidence``, ``unresolved_evidence``, the first that holds; else null).  Wrong: conversation and
    reason; a conversation with one gives neither documents nor questions.
    """
    raw = lines.select(F.try_parse_json("value").alias("v"))
    rows = raw.select(F.coalesce(text_at(F.col("v"), "$.sample_id"), F.lit("")).alias("conversation"), "v")
    twice = F.count("*").over(W.partitionBy("conversation"))
    rows = rows.withColumn("n", twice)
    v = F.col("v")
    qa = items(v, "$.qa")
    bad_question = F.exists(qa, lambda q: ~is_text(q, "$.question") | F.coalesce(kind_of(q, "$.category") != "BIGINT", F.lit(True)) | ~F.coalesce(F.try_variant_get(q, "$.category", "bigint").between(*CATEGORIES), F.lit(False)))
    bad_evidence = F.exists(qa, lambda q: ~F.coalesce(kind_of(q, "$.evidence").isin("ARRAY"), F.try_variant_get(q, "$.evidence", "variant").isNull()) | F.exists(items(q, "$.evidence"), lambda e: ~_strings(e, "$")))
    members = F.coalesce(F.try_variant_get(v, "$.conversation", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    sessions = F.map_filter(members, lambda k, x: k.rlike(SESSION))
    rows = rows.withColumn("sessions", sessions)
    bad_session = F.exists(F.map_values("sessions"), lambda s: F.coalesce(kind_of(s) != "ARRAY", F.lit(True)))
    bad_turn = F.exists(F.map_values("sessions"), lambda s: F.exists(items(s, "$"), lambda t: ~(_strings(t, "$.dia_id") & (text_at(t, "$.dia_id") != "") & _strings(t, "$.text") & _strings(t, "$.speaker"))))
    ids = F.flatten(F.transform(F.map_values("sessions"), lambda s: F.transform(items(s, "$"), lambda t: text_at(t, "$.dia_id"))))
    rows = rows.withColumn("ids", ids)
    reason = (
        F.when((F.col("conversation") == "") | (F.col("n") > 1), "sample_id")
        .when(F.coalesce(bad_session, F.lit(False)), "session")
        .when(F.coalesce(bad_turn, F.lit(False)), "turn")
        .when(F.size("ids") != F.size(F.array_distinct("ids")), "dia_id")
        .when((F.size("ids") == 0) | (F.size(qa) == 0), "empty")
        .when(bad_question, "question")
        .when(bad_evidence, "evidence")
    )
    rows = rows.withColumn("reason", reason)
    wrong = rows.where("reason is not null").select("conversation", "reason")
    good = rows.where("reason is null")
    turns = good.select("conversation", F.explode("sessions").alias("key", "turns")).select("conversation", F.regexp_extract("key", SESSION, 1).cast("long").alias("session"), F.posexplode(items(F.col("turns"), "$")).alias("position", "t"))
    caption = text_at(F.col("t"), "$.blip_caption")
    text = F.concat(text_at(F.col("t"), "$.speaker"), F.lit(": "), text_at(F.col("t"), "$.text"), F.when(_strings(F.col("t"), "$.blip_caption") & (caption != ""), F.concat(F.lit("\nImage caption: "), caption)).otherwise(""))
    documents = turns.select("conversation", "session", "position", text_at(F.col("t"), "$.dia_id").alias("id"), text.alias("text"))
    asked = good.select("conversation", "ids", F.posexplode(qa).alias("number", "q"))
    gold = F.array_distinct(F.transform(items(F.col("q"), "$.evidence"), lambda e: F.trim(F.try_variant_get(e, "$", "string"))))
    asked = asked.select("conversation", "number", text_at(F.col("q"), "$.question").alias("question"), F.try_variant_get(F.col("q"), "$.category", "int").alias("category"), gold.alias("gold"), "ids")
    excluded = F.when(F.col("category") == ADVERSARIAL, "adversarial").when(F.size("gold") == 0, "no_evidence").when(F.size(F.array_except("gold", "ids")) > 0, "unresolved_evidence")
    return documents, asked.withColumn("excluded", excluded).drop("ids"), wrong
