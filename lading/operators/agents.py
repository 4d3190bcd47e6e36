"""Which agent a mail is from: names of a catalog looked for in its subject, then in its body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lading.functions.text import fold, similarity

# Words that say the form of a company, and letters at its end that do.
LEGAL = ("SA", "SAS", "SRL", "LTDA", "LIMITADA", "LLC", "LTD", "LIMITED", "INC", "CORP", "CORPORATION", "CO", "COMPANY", "SOCIEDAD", "ANONIMA", "ANONIMO")
LEGAL_ENDS = ("S A S", "S R L", "L T D A", "S A")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
LEAST, LEAD = 0.88, 0.06


def company_text(c: Column) -> Column:
    """Words in upper case without marks, entities decoded, without words and closing letters of company forms."""
    for entity, sign in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(sign))
    words = F.trim(F.regexp_replace(F.upper(fold(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}]+", " "))
    bare = F.regexp_replace(words, rf"(?:^| )(?:{'|'.join(LEGAL_ENDS)})$", "")
    return F.array_join(F.filter(F.split(bare, " "), lambda w: (w != "") & ~w.isin(*LEGAL)), " ")


def aliases(agents: DataFrame) -> DataFrame:
    """``agent_id, name, alias, words, glued, longest`` of ``agents(agent_id, name, aliases)``; a row per distinct name."""
    all_ = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    a = agents.select("agent_id", "name", F.explode(all_).alias("raw")).withColumn("alias", company_text(F.col("raw"))).filter("alias <> ''")
    a = a.select("agent_id", "name", "alias").distinct().withColumn("words", F.size(F.split("alias", " "))).withColumn("glued", F.replace("alias", F.lit(" "), F.lit("")))
    return a.withColumn("longest", F.max(F.length("alias")).over(Window.partitionBy("agent_id")))


def scored(texts: DataFrame, names: DataFrame, short: bool) -> DataFrame:
    """``text_id, agent_id, name, longest, score`` of agents whose name a text holds, or nearly holds.

    A name that occurs as whole words scores 1. Names of one word of up to three letters count only then, and only where
    ``short``. Others are compared with runs of about as many words. Runs and names meet in an equality join on pieces: a
    likeness of 0.88 lets ``e`` letters of a name differ, so of ``e + 1`` even pieces one occurs unchanged in the run, at
    most ``e`` places off. No pair that is alike enough is missed, and runs are made distinct before they are compared.
    """
    worded = texts.withColumn("norm", company_text(F.col("text"))).filter("norm <> ''").select("text_id", F.split("norm", " ").alias("ws"))
    most = (names.agg(F.max("words")).first()[0] or 0) + 1
    runs = worded.select("text_id", "ws", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.size("ws")))).alias("n"))
    runs = runs.select("text_id", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - F.col("n") + 1), lambda i: F.array_join(F.slice("ws", i, F.col("n")), " "))).alias("run")).distinct()
    kinds = runs.select("n", "run").distinct().withColumn("rglued", F.replace("run", F.lit(" "), F.lit("")))
    small = (F.col("words") == 1) & (F.length("alias") <= 3)
    whole = kinds.join(names, F.col("run") == F.col("alias")).filter(F.lit(short) | ~small).select("run", "agent_id", "name", "longest", F.lit(1.0).alias("score"))
    # nearly: an edit similarity of 0.88 lets floor(0.12 * longest) letters differ; a piece stays whole at a place near its own
    near_names = names.filter(~small).withColumn("e", F.floor(F.length("glued") * 0.12 / 0.88).cast("int"))
    piece = F.expr("transform(sequence(0, e), i -> struct(i as i, cast(floor(i * length(glued) / (e + 1)) as int) as at, substr(glued, cast(floor(i * length(glued) / (e + 1)) as int) + 1, cast(floor((i + 1) * length(glued) / (e + 1)) - floor(i * length(glued) / (e + 1)) as int)) as piece))")
    pieces = near_names.select("agent_id", "name", "longest", "glued", "words", "e", F.explode(piece).alias("p")).select("agent_id", "name", "longest", "glued", "words", "e", "p.at", "p.piece", F.length("p.piece").alias("size"))
    shapes = pieces.select("size", "at", "e").distinct().groupBy("size").agg(F.min(F.col("at") - F.col("e")).alias("low"), F.max(F.col("at") + F.col("e")).alias("high"))
    cut = kinds.join(F.broadcast(shapes), F.length("rglued") >= F.col("size"))
    cut = cut.select("n", "run", "rglued", "size", F.explode(F.expr("sequence(greatest(0, low), greatest(greatest(0, low), least(high, length(rglued) - size)))")).alias("start")).withColumn("piece", F.expr("substr(rglued, start + 1, size)"))
    met = cut.join(pieces, ["size", "piece"]).filter((F.abs(F.col("start") - F.col("at")) <= F.col("e")) & F.col("n").between(F.greatest(F.lit(1), F.col("words") - 1), F.col("words") + 1))
    met = met.select("run", "rglued", "agent_id", "name", "longest", "glued").distinct().withColumn("score", F.round(similarity(F.col("rglued"), F.col("glued")), 6))
    near = met.filter(F.col("score") >= LEAST).select("run", "agent_id", "name", "longest", "score")
    best = whole.union(near).groupBy("run", "agent_id", "name", "longest").agg(F.max("score").alias("score"))
    return runs.select("text_id", "run").distinct().join(best, "run").groupBy("text_id", "agent_id", "name", "longest").agg(F.max("score").alias("score"))


def winners(matches: DataFrame) -> DataFrame:
    """The best agent of each text, by score, then the longest name, then the first one; none where the next is nearer
    than ``LEAD``."""
    order = Window.partitionBy("text_id").orderBy(F.col("score").desc(), F.col("longest").desc(), "name")
    ranked = matches.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("score").over(order))
    return ranked.filter((F.col("place") == 1) & (F.col("next").isNull() | (F.round(F.col("score") - F.col("next"), 6) >= LEAD))).select("text_id", "agent_id", "name", "score")


def resolve_messages(messages: DataFrame, agents: DataFrame) -> DataFrame:
    """``message_id, agent_id, name, score, found_in`` for ``messages(message_id, subject, body)``: the subject decides, the
    body where the subject names nobody."""
    names = aliases(agents)
    one = winners(scored(messages.select(F.col("message_id").alias("text_id"), F.col("subject").alias("text")), names, True)).withColumn("found_in", F.lit("subject"))
    rest = messages.join(one.select(F.col("text_id").alias("message_id")), "message_id", "left_anti")
    two = winners(scored(rest.select(F.col("message_id").alias("text_id"), F.col("body").alias("text")), names, False)).withColumn("found_in", F.lit("body"))
    return one.union(two).withColumnRenamed("text_id", "message_id")
