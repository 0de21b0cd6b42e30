"""Conversations as an append-only message table: ``conversation_id, seq, role, content, timestamp``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from reelgraph.config import ChatSettings
from reelgraph.functions import text
from reelgraph.functions.text import NO_CONTEXT

Complete = Callable[[list[dict]], str]


def _latest(rows: DataFrame, n: int) -> DataFrame:
    """The last n rows of each conversation; the limit applies in each task before the shuffle."""
    w = Window.partitionBy("conversation_id").orderBy(F.desc("seq"))
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def dialogue(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("role").isin("user", "assistant"))


def recent_context(messages: DataFrame, last: int = 5) -> DataFrame:
    """A one-line summary of the last user and assistant messages of every conversation."""
    said = F.when(F.col("role") == "user", F.lit("User asked: ")).otherwise(F.lit("Assistant responded about: "))
    line = F.concat(said, F.substring("content", 1, 100), F.lit("..."))
    tail = _latest(dialogue(messages), last).select("conversation_id", F.struct("seq", line.alias("line")).alias("x"))
    joined = tail.groupBy("conversation_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), " | ").alias("context")
    )  # at most ``last`` entries
    return messages.select("conversation_id").distinct().join(joined, "conversation_id", "left").select(
        "conversation_id", F.coalesce("context", F.lit(NO_CONTEXT)).alias("context")
    )


def history(messages: DataFrame, last: int = 6) -> DataFrame:
    """The messages sent along with a new question."""
    return _latest(dialogue(messages), last)


def trim(messages: DataFrame, cap: int = 50) -> DataFrame:
    """Conversations above the cap keep their system messages and the last half cap of the others."""
    keep = -(-cap // 2)
    counts = messages.groupBy("conversation_id").agg(F.count("*").alias("_n"))
    short = counts.filter(F.col("_n") <= cap).select("conversation_id")
    long = counts.filter(F.col("_n") > cap).select("conversation_id")
    whole = messages.join(short, "conversation_id", "left_semi")
    over = messages.join(long, "conversation_id", "left_semi")
    system = over.filter(F.col("role") == "system")
    recent = _latest(over.filter(F.col("role") != "system"), keep)
    return whole.unionByName(system).unionByName(recent)


def list_conversations(messages: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Message, frame and video counts per conversation, the last updated first.

    ``frames`` lists active frames as (conversation_id, frame_id, video_id).
    """
    rows = messages.groupBy("conversation_id").agg(
        F.count("*").alias("message_count"), F.min("timestamp").alias("created"), F.max("timestamp").alias("last_updated")
    )
    if frames is not None:
        active = frames.groupBy("conversation_id").agg(
            F.count("*").alias("frame_count"), F.countDistinct("video_id").alias("video_count")
        )
        rows = rows.join(active, "conversation_id", "left").fillna(0, ["frame_count", "video_count"])
    return rows.orderBy(F.desc("last_updated"), "conversation_id")


def finished(messages: DataFrame, min_messages: int = 3) -> DataFrame:
    """Conversations long enough for a closing summary, with their length in hours."""
    return (
        messages.groupBy("conversation_id")
        .agg(F.count("*").alias("message_count"), (F.max("timestamp") - F.min("timestamp")).alias("_s"))
        .filter(F.col("message_count") >= min_messages)
        .select("conversation_id", "message_count", (F.col("_s") / 3600).alias("duration_hours"))
    )


def conversation_id(epoch_seconds: Column, number: Column) -> Column:
    return F.format_string("chat_%d_%04d", epoch_seconds.cast("long"), number.cast("long"))


def start_conversation(frames: DataFrame, conversation: str, at: float, context: str | None = None) -> DataFrame:
    """The opening system messages of a conversation about a set of frames."""
    counts = frames.agg(F.count("*").alias("n"), F.countDistinct("video_id").alias("v"))
    opening = F.format_string("Conversation about %d frames from %d videos.", F.col("n"), F.col("v"))
    lines = [opening] + ([F.lit(f"Context: {context}")] if context else [])
    return counts.select(F.posexplode(F.array(*lines)).alias("seq", "content")).select(
        F.lit(conversation).alias("conversation_id"), F.col("seq").cast("long").alias("seq"), F.lit("system").alias("role"),
        "content", F.lit(float(at)).alias("timestamp"),
    )


def target_frames(frames: DataFrame, frame_ids: list[str] | None = None, first: int = 10) -> DataFrame:
    """The frames asked about: those named, else the first ten by time."""
    if frame_ids:
        return frames.filter(F.col("frame_id").isin(*frame_ids))
    return frames.orderBy("timestamp", "frame_id").limit(first)


def frame_set(frames: DataFrame, group: str = "video_id", first: int = 10, ordered_by: str = "timestamp") -> DataFrame:
    """Per group, its first frames described in order, with the time they span.

    A group contributes at most ``first`` frames, limited in each task before the shuffle.
    """
    w = Window.partitionBy(group).orderBy(ordered_by, "frame_id")
    few = frames.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= first)
    line = text.frame_description(*[F.col(c) for c in ("frame_id", "video_id", "timestamp", "caption", "confidence")])
    packed = few.groupBy(group).agg(
        F.array_sort(F.collect_list(F.struct("place", "timestamp", line.alias("line")))).alias("x")
    )  # at most ``first`` entries
    span = F.element_at("x", -1)["timestamp"] - F.element_at("x", 1)["timestamp"]
    return packed.select(
        group, F.size("x").cast("bigint").alias("frames"), span.alias("temporal_span"),
        F.array_join(F.transform("x", lambda r: r["line"]), "\n\n").alias("prompt"),
    )


def distinct_analyses(requests: DataFrame) -> DataFrame:
    """Each (frame, prompt) once, so that a model sees no request twice."""
    return requests.dropDuplicates(["frame_id", "prompt"])


def chat_turn(
    messages: DataFrame, frames: DataFrame, conversation: str, question: str, at: float, complete: Complete,
    frame_ids: list[str] | None = None, settings: ChatSettings = ChatSettings(),
) -> DataFrame:
    """The two messages a turn appends: the question and the model's answer about the target frames.

    Reads one conversation: at most the recent history and ten frames reach the prompt.
    """
    own = messages.filter(F.col("conversation_id") == conversation)
    past = history(own, settings.history_messages).orderBy("seq").select("role", "content").collect()
    shown = target_frames(frames, frame_ids)
    described = frame_set(shown.withColumn("_g", F.lit("")), "_g", first=max(10, len(frame_ids or []))).first()
    prompt = [{"role": r["role"], "content": r["content"]} for r in past]
    if described is not None:
        prompt.insert(0, {"role": "system", "content": described["prompt"]})
    prompt.append({"role": "user", "content": question})
    answer = complete(prompt)
    last = own.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    return messages.sparkSession.createDataFrame(
        [(conversation, last + 1, "user", question, float(at)), (conversation, last + 2, "assistant", answer, float(at))],
        "conversation_id string, seq bigint, role string, content string, timestamp double",
    )


def transcript_log(audio: DataFrame) -> DataFrame:
    """``[start-end] transcript`` lines of every video, one row each, in video and time order."""
    from reelgraph.functions.clock import seconds_to_timestamp

    return audio.filter(F.coalesce("transcript", F.lit("")) != "").select(
        "video_id", "start_time",
        F.concat(
            F.lit("["), seconds_to_timestamp(F.col("start_time")), F.lit("-"), seconds_to_timestamp(F.col("end_time")),
            F.lit("] "), "transcript",
        ).alias("line"),
    ).orderBy("video_id", "start_time")


def video_content(
    chunks: DataFrame, audio: DataFrame, entities: DataFrame | None = None, entity_videos: DataFrame | None = None, video_id: str | None = None,
) -> DataFrame:
    """All that is known of every video, or of one, one row per item: its chunks, what is said in them, its entities.

    Long form, so a video that holds a third of all chunks or an entity of a third of all videos is many small rows.  Chunks without a
    description stay, with a null ``content``; transcripts that are null or empty drop out; a video names an entity once.  Entities come where
    both entity tables are given.
    """
    from reelgraph.functions.clock import seconds_to_timestamp

    def only(rows: DataFrame) -> DataFrame:
        return rows if video_id is None else rows.filter(F.col("video_id") == video_id)

    def timed(rows: DataFrame, section: str, key: str, content: str) -> DataFrame:
        start, end = F.col("start_time"), F.col("end_time")
        return only(rows).select(
            "video_id", F.lit(section).alias("section"), F.col(key).alias("item_id"), "start_time", "end_time",
            seconds_to_timestamp(start).alias("start_stamp"), seconds_to_timestamp(end).alias("end_stamp"),
            F.col(content).alias("content"), F.lit(None).cast("double").alias("confidence"),
        )

    said = audio.filter(F.coalesce("transcript", F.lit("")) != "")
    rows = timed(chunks, "chunk", "chunk_id", "unified_description").unionByName(timed(said, "transcript", "chunk_id", "transcript"))
    if entities is None or entity_videos is None:
        return rows
    named = only(entity_videos.select("entity_id", "video_id").distinct()).join(entities, "entity_id")
    line = F.concat("name", F.lit(" ("), "entity_type", F.lit(")"), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), "description")).otherwise(""))
    return rows.unionByName(
        named.select("video_id", F.lit("entity").alias("section"), F.col("entity_id").alias("item_id"), line.alias("content"), "confidence"),
        allowMissingColumns=True,
    )
