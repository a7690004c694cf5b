"""Dialogues as next-turn examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.text import filled, stripped


def next_turns(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(conversation, turn, history, n_history, response): flat turns; history is all earlier non-blank turns. A row needs
    a history and a non-blank response. The result holds every prefix of a conversation, so it grows with the square of its
    turns, and a conversation is one task's work."""
    words = F.col(text)
    before = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    own = turns.where(filled(words)).withColumn("_history", F.collect_list(stripped(words)).over(before))
    return own.where(F.size("_history") > 0).select(conversation, turn, F.array_join("_history", "\n").alias("history"), F.size("_history").alias("n_history"), stripped(words).alias("response"))


def nested_turns(dialogues: DataFrame, key: str, utterances: str = "utterances") -> DataFrame:
    """The same for array<struct<speaker, text>>; history lines are 'speaker: text'."""
    lines = F.filter(F.col(utterances), lambda u: filled(u["text"]))
    d = dialogues.select(key, lines.alias("_u"))
    each = d.select(key, "_u", F.posexplode("_u").alias("pos", "u")).where("pos > 0")
    history = F.transform(F.slice("_u", 1, F.col("pos")), lambda u: F.concat(u["speaker"], F.lit(": "), stripped(u["text"])))
    return each.select(key, "pos", F.array_join(history, "\n").alias("history"), stripped(F.col("u.text")).alias("response"))


def seeded_turns(dialogues: DataFrame, key: str) -> DataFrame:
    """Messages with previous utterances and persona details before them."""
    clean = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: filled(x))
    d = dialogues.select(key, clean("previous_utterance").alias("_p"), clean("free_messages").alias("_m"), F.array_join(clean("personas"), "\n").alias("details"))
    each = d.select(key, "_p", "_m", "details", F.posexplode("_m").alias("pos", "response"))
    history = F.concat(F.col("_p"), F.slice("_m", 1, F.col("pos")))
    return each.where(F.size(history) > 0).select(key, "pos", "details", F.array_join(history, "\n").alias("history"), stripped(F.col("response")).alias("response"))


FLATTENERS = {"flat": next_turns, "nested": nested_turns, "seeded": seeded_turns}


def dialogue_prompt(history: Column, details: Column) -> Column:
    """The details of a conversation, if any, and its turns so far."""
    own = stripped(F.coalesce(details, F.lit("")))
    return F.concat(F.when(own != "", F.concat(own, F.lit("\n\n"))).otherwise(""), F.lit("Conversation:\n"), history)


def _examples(turns: DataFrame, details: Column) -> DataFrame:
    return turns.withColumn("_details", details).select(*[c for c in turns.columns if c not in ("history", "response", "n_history")], dialogue_prompt(F.col("history"), F.col("_details")).alias("_dialogue_prompt"), F.col("response").alias("_dialogue_response"))


def _lines(**named: str) -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k.replace('_', ' ')}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for k, c in named.items()])


def _taskmaster(df: DataFrame) -> DataFrame:
    """(conversation, instruction_id, utterances): the instruction goes with every turn."""
    own = df.select(F.struct("conversation", "instruction_id").alias("k"), "utterances")
    turns = nested_turns(own, "k").select("k.*", "pos", "history", "response")
    return _examples(turns, _lines(Task_instruction="instruction_id")).drop("instruction_id")


def _blended(df: DataFrame) -> DataFrame:
    """(conversation, previous_utterance, free_messages, personas, context, additional_context)."""
    own = df.select(F.struct("conversation", F.array_join("personas", " | ").alias("named"), "context", "additional_context").alias("k"), "previous_utterance", "free_messages", "personas")
    turns = seeded_turns(own, "k").select("k.*", "pos", "history", "response")
    return _examples(turns, _lines(Personas="named", Context="context", Additional_context="additional_context")).drop("named", "context", "additional_context")


def _empathetic(df: DataFrame) -> DataFrame:
    """Flat turns (conv_id, turn, utterance, context, prompt); feeling and situation are those of the turn."""
    turns = next_turns(df, "conv_id", "turn", "utterance").join(df.select("conv_id", "turn", "context", "prompt"), ["conv_id", "turn"])
    return _examples(turns, _lines(Emotion="context", Situation="prompt")).drop("context", "prompt")


#: The datasets whose rows are conversations.
ADAPTERS = {"ParlAI/blended_skill_talk": _blended, "google-research-datasets/taskmaster1": _taskmaster, "facebook/empathetic_dialogues": _empathetic}


def adapted(dataset: str, df: DataFrame) -> DataFrame:
    """The rows of a dataset; of a conversational one its examples, with _dialogue_prompt and _dialogue_response."""
    return ADAPTERS.get(dataset, lambda x: x)(df)
