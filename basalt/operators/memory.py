"""Conversations and knowledge gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions import text as T

# Questions about the conversation itself, and words that carry no topic.
META = [
    r"\bsummari[sz]e\b.*\b(conversation|chat|discussion|what we|so far)\b",
    r"\b(recap|summary) of\b.*\b(conversation|chat|discussion)\b",
    r"\bwhat (did|have) (we|i|you)\b.*\b(discuss|talk|ask|say|said|cover)\w*\b",
    r"\bwhat (was|were) (my|our|the) (first|last|previous|earlier) (question|query|message)s?\b",
    r"\bwhat did you (say|tell|answer|recommend)\b",
    r"\bhow many questions\b.*\b(ask|asked)\b",
    r"\b(list|show)\b.*\b(questions|topics)\b.*\b(asked|discussed|so far|conversation|chat)\b",
    r"\bwhat (have|did) we (covered|done) so far\b",
    r"\bearlier (question|answer|topic)s?\b",
]
STOP = (
    "the a an and or of to in on for is are was were it its this that what which how why does do did can could should would with about we you i my our your me be as at by "
    "from have has had will there their they them please tell explain more also any some"
).split()
SUMMARY_HEAD = "Earlier in this conversation the user asked (oldest first):"
FOLLOWUPS = ["What causes issues with {}?", "Show the maintenance history for {}.", "Which documents reference {}?"]
GAP_RAISE, PREVIEW = 3, 120
MOST_TOPICS = 10_000
# End of fixed values.


def memory_tokens(text: Column) -> Column:
    """Distinct words of two characters or more without function words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9][a-z0-9_.-]{1,}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(STOP)))


def _line(text: Column) -> Column:
    return F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != ""), " ")


def topic_line(text: Column, limit: int = 110) -> Column:
    """A text on one line, cut with a sign of it."""
    line = _line(text)
    return F.concat(F.substring(line, 1, limit), F.when(F.length(line) > limit, "…").otherwise(""))


def is_meta(q: Column) -> Column:
    return F.array_join(F.split(F.lower(F.coalesce(q, F.lit(""))), r"[ \t\n]+"), " ").rlike("|".join(META))


def listing(turns: DataFrame) -> DataFrame:
    """(conv_id, title, preview, messages): preview is the last user message, cut."""
    user = F.col("role") == "user"
    out = turns.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("last"), F.min_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("first"))
    return out.select("conv_id", T.title_from(F.col("first")).alias("title"), F.substring(F.coalesce("last", F.lit("")), 1, PREVIEW).alias("preview"), "messages")


def relevant_turns(turns: DataFrame, skip_recent: int = 6, least: int = 2, top: int = 2) -> DataFrame:
    """(conv_id, turn, overlap, place): turns older than the last `skip_recent` that share words with the last user message."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = turns.withColumn("back", F.row_number().over(w)).withColumn("ts", memory_tokens(F.col("text")))
    user = F.when(F.col("role") == "user", F.col("ts"))
    asked = rows.groupBy("conv_id").agg(F.max_by(user, F.when(F.col("role") == "user", F.col("turn"))).alias("q"))
    old = rows.where(F.col("back") > skip_recent).join(asked, "conv_id").withColumn("overlap", F.size(F.array_intersect("ts", "q"))).where(F.col("overlap") >= least)
    order = Window.partitionBy("conv_id").orderBy(F.desc("overlap"), "turn")
    return old.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("conv_id", "turn", "overlap", "place")


def _numbered(turns: DataFrame, limit: int) -> DataFrame:
    """(conv_id, n, lines): the users' questions in order, numbered, one a line."""
    asked = turns.where((F.col("role") == "user") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    listed = F.array_sort(F.collect_list(F.struct("turn", topic_line(F.col("text"), limit).alias("t"))))
    return asked.groupBy("conv_id").agg(F.count("*").alias("n"), F.transform(listed, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["t"])).alias("lines"))


def older_summary(turns: DataFrame, skip_recent: int = 6, cut: int = 110) -> DataFrame:
    """(conv_id, summary): the questions before the recent turns, numbered, under a heading."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    older = turns.withColumn("back", F.row_number().over(w)).where(F.col("back") > skip_recent)
    return _numbered(older, cut).select("conv_id", F.concat(F.lit(SUMMARY_HEAD + "\n"), F.array_join("lines", "\n")).alias("summary"))


def transcript(turns: DataFrame, last: int = 40, cut: int = 700) -> DataFrame:
    """(conv_id, transcript): the last turns that are not empty, speaker and cut text, a blank line between."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = turns.withColumn("back", F.row_number().over(w)).where((F.col("back") <= last) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    said = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.substring(_line(F.col("text")), 1, cut))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("t")))), lambda x: x["t"]), "\n\n").alias("transcript"))


def curate(turns: DataFrame, skip_recent: int = 6, most: int = 10) -> DataFrame:
    """(conv_id, place, role, text): what a model should see: a summary of older questions, two recalled turns, the recent ones; the last `most`."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= skip_recent).select("conv_id", F.lit(2).alias("kind"), F.col("turn").cast("bigint").alias("at"), "role", "text")
    head = older_summary(turns, skip_recent).select("conv_id", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("at"), F.lit("assistant").alias("role"), F.col("summary").alias("text"))
    recalled = relevant_turns(turns, skip_recent).join(turns, ["conv_id", "turn"])
    said = F.concat(F.lit("[Recalled from earlier in this conversation — "), F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit(" said] "), topic_line(F.col("text"), 500))
    recalled = recalled.select("conv_id", F.lit(1).alias("kind"), F.col("place").cast("bigint").alias("at"), F.lit("assistant").alias("role"), said.alias("text"))
    rows = head.unionByName(recalled).unionByName(recent)
    order = Window.partitionBy("conv_id").orderBy("kind", "at")
    n = F.count("*").over(Window.partitionBy("conv_id"))
    return rows.withColumn("place", F.row_number().over(order)).withColumn("n", n).where(F.col("place") > F.col("n") - most).select("conv_id", "place", "role", "text")


def conversation_answer(turns: DataFrame, asks: DataFrame) -> DataFrame:
    """(conv_id, answer): the answer to a question about the conversation itself (asks: conv_id, query), from its questions alone."""
    said = turns.where((F.col("role") == "user") & (F.trim(F.coalesce("text", F.lit(""))) != "")).groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"), F.max_by("text", "turn").alias("last"))
    rows = asks.join(_numbered(turns, 160), "conv_id", "left").join(said, "conv_id", "left")
    low = F.lower("query")
    tail = F.when(F.contains(low, F.lit("first")), F.concat(F.lit("\n\nYour first question was: “"), topic_line(F.col("first"), 200), F.lit("”")))
    tail = tail.when(F.contains(low, F.lit("last")) | F.contains(low, F.lit("previous")), F.concat(F.lit("\n\nYour most recent question was: “"), topic_line(F.col("last"), 200), F.lit("”"))).otherwise("")
    listed = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("- "), x)), "\n")
    answer = F.concat(F.lit("## Conversation so far\nYou have asked "), F.col("n").cast("string"), F.lit(" question(s) in this chat:\n"), listed, tail)
    return rows.select("conv_id", F.coalesce(answer, F.lit("This conversation has no earlier questions yet — this is the first one.")).alias("answer"))


def followups(answers: DataFrame, most: int = 4) -> DataFrame:
    """(aid, pos, question): the questions that an answer (aid, text, subject) suggests at its end, four at most, else templates about its subject."""
    section = F.regexp_extract(F.coalesce("text", F.lit("")), r"(?is)#{1,4}\s*Suggested\s+Follow-?up\s+Questions\s*\n(.*)$", 1)
    bare = lambda x: F.regexp_replace(F.trim(F.regexp_replace(F.trim(x), r"^[-*•]+", "")), r"^[0-9]+[.)]\s*", "")
    words = lambda x: F.size(F.filter(F.split(x, r"[ \t]+"), lambda w: w != ""))
    given = F.slice(F.filter(F.transform(F.split(section, "\n"), bare), lambda x: F.endswith(x, F.lit("?")) | (words(x) >= 3)), 1, most)
    templates = F.when(F.col("subject").isNotNull(), F.array(*(F.replace(F.lit(t), F.lit("{}"), F.col("subject")) for t in FOLLOWUPS))).otherwise(F.array().cast("array<string>"))
    return answers.select("aid", F.posexplode(F.when(F.size(given) > 0, given).otherwise(templates)).alias("pos", "question"))


def search(turns: DataFrame, needle: str, last: int = 20) -> DataFrame:
    """(conv_id, hits): conversations whose last turns hold the needle."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= last)
    return rows.where(F.contains(F.lower("text"), F.lit(needle.lower()))).groupBy("conv_id").agg(F.count("*").alias("hits"))


def gap_key(q: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(q), "[^a-z0-9 ]", ""))


def gaps(asks: DataFrame) -> DataFrame:
    """(key, ask_count, first_asked, last_asked, priority, place) of asks (query, confidence, at).

    Three asks raise MEDIUM to HIGH; a confidence under .2 is HIGH at once, one of .5 or more LOW."""
    rows = asks.select(gap_key(F.col("query")).alias("key"), "confidence", "at").where(F.col("key") != "")
    out = rows.groupBy("key").agg(F.count("*").alias("ask_count"), F.min("at").alias("first_asked"), F.max("at").alias("last_asked"), F.min("confidence").alias("c"))
    base = F.when(F.col("c") < 0.2, "HIGH").when(F.col("c") < 0.5, "MEDIUM").otherwise("LOW")
    out = out.withColumn("priority", F.when((base == "MEDIUM") & (F.col("ask_count") >= GAP_RAISE), "HIGH").otherwise(base)).drop("c")
    rank = F.when(F.col("priority") == "HIGH", 0).when(F.col("priority") == "MEDIUM", 1).otherwise(2)
    # The places are a report over all gaps; ties by key.
    return out.withColumn("rank", rank)


def suggest_expert(questions: DataFrame, experts: DataFrame) -> DataFrame:
    """(qid, name, hits): the expert with most topics named in the question, the first of equals, none without a hit.
    questions: (qid, text); experts: (pos, name, topics comma list), a small table."""
    topics = experts.select("pos", "name", F.explode(F.transform(F.split("topics", ","), lambda t: F.lower(F.trim(t)))).alias("topic"))
    if topics.count() > MOST_TOPICS:
        raise ValueError(f"more than {MOST_TOPICS} topics: a list of experts is expected, which every task can hold")
    met = questions.select("qid", F.lower(F.coalesce("text", F.lit(""))).alias("t")).join(F.broadcast(topics), F.contains(F.col("t"), F.col("topic")))
    n = met.groupBy("qid", "pos", "name").agg(F.count("*").alias("hits"))
    order = Window.partitionBy("qid").orderBy(F.desc("hits"), "pos")
    return n.withColumn("i", F.row_number().over(order)).where("i = 1").select("qid", "name", "hits")
