"""A stream of messages with state: idempotent requests, places in sessions, running summaries, and candidates for revision.

The state of a user holds which requests are done, each session's next place and summary, and the user's last statements.  So a
batch neither reads the store nor depends on where the batches are cut: the stream gives what one fold over all messages gives,
after a restart too.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from annalist.functions import text as T
from annalist.functions import vocab as V
from annalist.operators.governance import dealt, judged_contradictions, judged_versions, profile

#: Messages as they arrive: ``arrived`` orders them, ``message`` is the place in its request, ``moment`` the event time.
MESSAGE = "user_id string, session_id string, request_id string, message long, arrived long, id long, source string, content string, moment long"
#: What the state gives for them, by kind: turn (a message has its place), pair (an earlier statement it may revise or
#: contradict), summary (of a session that has changed).
EVENT = "kind string, user_id string, session_id string, request_id string, message long, id long, source string, content string, moment long, position long, old_id long, old_source string, old_content string, old_moment long, old_position long, summary string, n_messages long"
#: A user's statements that a new one is held against.
RECENT = 300
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def appended(summary: str, point: str) -> str:
    """A summary with one more line, once; if it grows too long its head and its tail stay."""
    if not point or point in summary.split("\n"):
        return summary
    longer = f"{summary}\n{point}" if summary else point
    if len(longer) <= V.SUMMARY_CHARS:
        return longer
    tail = V.SUMMARY_CHARS - V.SUMMARY_HEAD - 3
    return f"{longer[: V.SUMMARY_HEAD]}\n…\n{longer[-tail:]}"


class Recent:
    """The last statements of a user and an index of them by token, domain of short ones, and triple."""

    FIELDS = ("id", "source", "content", "moment", "position", "tokens", "domain", "triple")

    def __init__(self, rows: list[tuple]):
        self.rows: dict[int, tuple] = {}
        self.next = 0
        self.by_key: dict[str, set[int]] = defaultdict(set)
        for row in rows:
            self.add(row)

    def keys(self, row: tuple) -> list[str]:
        tokens, domain, triple = row[5].split("\n") if row[5] else [], row[6], row[7]
        return [f"w{t}" for t in tokens] + [f"d{domain}"] * bool(domain) + [f"t{triple}"] * bool(triple)

    def add(self, row: tuple) -> None:
        self.rows[self.next] = row
        for key in self.keys(row):
            self.by_key[key].add(self.next)
        self.next += 1
        if len(self.rows) > RECENT:
            gone = self.next - RECENT - 1
            for key in self.keys(self.rows.pop(gone)):
                self.by_key[key].discard(gone)

    def candidates(self, row: tuple) -> list[tuple]:
        """Statements that the rules may pair with a new one: of its domain or triple, or of which it has all tokens or is a
        rewriting.  All others fail every rule."""
        shared: Counter[int] = Counter()
        found: set[int] = set()
        n_new = 0
        for key in self.keys(row):
            if key[0] == "w":
                shared.update(self.by_key[key])
                n_new += 1
            else:
                found |= self.by_key[key]
        for k, n in shared.items():
            n_old = len(self.rows[k][5].split("\n"))
            if n == n_old or n >= V.STRONG_JACCARD * (n_old + n_new - n):
                found.add(k)
        return [self.rows[k] for k in sorted(found)]


class Sessions(StatefulProcessor):
    """Folds the messages of one user, in the order of their arrival."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getMapState("done", "request_id string", "yes boolean")
        self.session = handle.getMapState("session", "session_id string", "position long, summary string, n_messages long")
        self.recent = handle.getListState("recent", "id long, source string, content string, moment long, position long, tokens string, domain string, triple string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        messages = pd.concat(list(rows)).sort_values(["arrived", "request_id", "message"], kind="stable")
        recent = Recent([tuple(r) for r in self.recent.get()] if self.recent.exists() else [])
        known: dict[str, bool] = {}
        mine: dict[str, list] = {}
        out: list[dict] = []
        for m in messages.to_dict("records"):
            request, session = m["request_id"], m["session_id"]
            if request not in known:
                known[request] = self.done.containsKey((request,))
            if known[request]:
                continue
            if (request, m["message"]) in known:
                continue  # the request once more, in this batch
            known[request, m["message"]] = True
            if session not in mine:
                mine[session] = list(self.session.getValue((session,))) if self.session.containsKey((session,)) else [0, "", 0]
            position = mine[session][0]
            mine[session] = [position + int(m["n_chunks"]), appended(mine[session][1], m["point"]), mine[session][2] + 1]
            new = (int(m["id"]), m["source"], m["content"], int(m["moment"]), position, m["tokens"], m["domain"], m["triple"])
            turn = {k: m[k] for k in ("user_id", "session_id", "request_id", "message", "id", "source", "content", "moment")} | {"position": position}
            out.append(turn | {"kind": "turn"})
            for old in recent.candidates(new):
                out.append(turn | {"kind": "pair", "old_id": old[0], "old_source": old[1], "old_content": old[2], "old_moment": old[3], "old_position": old[4]})
            recent.add(new)
        for request in {r for r in known if isinstance(r, str) and not known[r]}:
            self.done.updateValue((request,), (True,))
        for session, (position, summary, n) in mine.items():
            self.session.updateValue((session,), (position, summary, n))
            out.append({"kind": "summary", "user_id": key[0], "session_id": session, "summary": summary, "position": position, "n_messages": n})
        if mine:
            self.recent.put(list(recent.rows.values()))
        names = [c.split()[0] for c in EVENT.split(", ")]
        frame = pd.DataFrame(out, columns=names)
        for c in ("message", "id", "moment", "position", "old_id", "old_moment", "old_position", "n_messages"):
            frame[c] = frame[c].astype("Int64")
        yield frame.astype({c: object for c in names if frame[c].dtype != "Int64"}).where(frame.notna(), None)

    def close(self) -> None:
        pass


def folded(messages: DataFrame) -> DataFrame:
    """A stream of MESSAGE rows to EVENT rows.  Null contents are empty."""
    c = F.coalesce("content", F.lit(""))
    p = profile(F.col("content"))
    short = F.length("content") <= V.STATEMENT_CHARS
    rows = dealt(messages, "user_id").withColumn("content", c)
    rows = rows.withColumns({"n_chunks": F.size(T.chunks(F.col("content"))), "point": T.point(F.col("content")), "tokens": F.array_join(p["tokens"], "\n"), "domain": F.coalesce(F.when(short, p["domain"]), F.lit("")), "triple": F.coalesce(p["triple"].cast("string"), F.lit(""))})
    return rows.groupBy("user_id").transformWithStateInPandas(Sessions(), outputStructType=EVENT, outputMode="Append", timeMode="None")


def paired(events: DataFrame) -> DataFrame:
    """The pairs (user_id, old, new) with the profiles of both sides.  The rules read a profile's fields many times, and a plan that
    isn't persisted here makes the field anew each time."""

    def side(prefix: str) -> Column:
        content = F.col(f"{prefix}content")
        return F.struct(*(F.col(f"{prefix}{n}").alias(n) for n in ("id", "source", "content", "moment", "position")), *(v.alias(k) for k, v in profile(content).items()))

    return events.where("kind = 'pair'").select("user_id", side("old_").alias("old"), side("").alias("new"))


def judged(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Version edges (old_id, new_id, similarity) and contradictions (a, b, signal) among the pairs."""
    later = (F.col("old.moment") < F.col("new.moment")) | ((F.col("old.moment") == F.col("new.moment")) & (F.col("old.position") < F.col("new.position")))
    return judged_versions(both.where(later)), judged_contradictions(both)


def turns_of(events: DataFrame) -> DataFrame:
    """Stored turns: a row per chunk of a message, at its place in the session."""
    c = F.col("content")
    rows = events.where("kind = 'turn'").select("user_id", "session_id", "request_id", "message", "id", "source", "moment", "position", F.when(T.is_rule(c), "rule").otherwise("dialogue").alias("material_type"), T.years(c).alias("years"), F.posexplode(T.chunks(c)).alias("chunk", "content"))
    return rows.withColumn("position", F.col("position") + F.col("chunk"))


def start(messages: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Runs the fold over what there is: turns, versions, contradictions and summaries under ``store``, a folder per batch, so
    that a batch that is run again after a failure replaces what it wrote."""

    def batch(events: DataFrame, number: int) -> None:
        events.persist()
        both = paired(events).persist()
        versions, contradictions = judged(both)
        for name, df in (("turns", turns_of(events)), ("versions", versions), ("contradictions", contradictions), ("summaries", events.where("kind = 'summary'").select("user_id", "session_id", "summary", "position", "n_messages"))):
            df.write.mode("overwrite").parquet(f"{store}/{name}/batch={number}")
        both.unpersist()
        events.unpersist()

    spark = messages.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        return folded(messages).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def read(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A table of the store; of each session's summaries the newest."""
    rows = spark.read.parquet(f"{store}/{name}")
    if name != "summaries":
        return rows.drop("batch")
    return rows.groupBy("user_id", "session_id").agg(F.max_by(F.struct("summary", "position", "n_messages"), "batch").alias("s")).select("user_id", "session_id", "s.*")
