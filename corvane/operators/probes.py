"""Deterministic probes: construction, one-factor rewrites, and rule oracles that answer them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Our own names, colours and objects.
NAMES = ("Ada", "Ben", "Cleo", "Dov", "Edda", "Finn", "Gus", "Hal")
COLOURS = ("amber", "blue", "coral", "denim", "ecru", "fawn", "green", "hazel")
REPLACED = {"amber": "ivory", "blue": "jade", "coral": "khaki", "denim": "lilac", "ecru": "mauve", "fawn": "navy", "green": "ochre", "hazel": "plum"}
#: Two more tasks: the line of a fact, its question, and the question in other words.
TASKS = {
    "copy": ("{who} wrote {value}.", "What did {who} write?", "Repeat the word of {who}."),
    "colour": ("The box of {who} is {value}.", "What colour is the box of {who}?", "Name the colour of {who} on the box."),
}
TRAIN_OFFSETS, DEV_OFFSETS = (1, 4), (2, 3)


def build(spark: SparkSession, offsets: tuple[int, ...], split: str) -> DataFrame:
    """Each name and its partner ``offset`` places on, with colours, asked for both: two queries per context."""
    n = len(NAMES)
    values = spark.createDataFrame([(i, NAMES[i], COLOURS[i]) for i in range(n)], "i int, name string, colour string")
    steps = spark.createDataFrame([(o,) for o in offsets], "offset int")
    own = values.crossJoin(steps).withColumn("j", F.pmod(F.col("i") + F.col("offset"), F.lit(n)))  # constants of the probe
    other = values.select(F.col("i").alias("j"), F.col("name").alias("name2"), F.col("colour").alias("colour2"))
    facts = own.join(F.broadcast(other), "j").withColumn("context", F.concat(F.col("name"), F.lit(" has the "), F.col("colour"), F.lit(" card. "), F.col("name2"), F.lit(" has the "), F.col("colour2"), F.lit(" card.")))
    asked = facts.select("i", "offset", "context", F.explode(F.array(F.struct(F.lit(1).alias("q"), F.col("name").alias("who"), F.col("colour").alias("response")), F.struct(F.lit(2).alias("q"), F.col("name2").alias("who"), F.col("colour2").alias("response")))).alias("a"))
    return asked.select(F.concat_ws("-", F.lit(split), "offset", "i", "a.q").alias("id"), F.lit("name").alias("category"), F.concat(F.lit("Which card does "), F.col("a.who"), F.lit(" have?")).alias("instruction"), "context", F.col("a.response").alias("response"))


def solve(context: Column, instruction: Column) -> Column:
    """The answer that the facts give; null if they give none or several."""
    who = F.regexp_extract(instruction, r"^(?:Which card does|Name the card of|Whose card, for|The card of) (\w+)", 1)
    names = F.regexp_extract_all(context, F.lit(r"(\w+) has the (\w+) card\."), 1)
    cards = F.regexp_extract_all(context, F.lit(r"(\w+) has the (\w+) card\."), 2)
    found = F.transform(F.filter(F.arrays_zip(names.alias("n"), cards.alias("c")), lambda x: x["n"] == who), lambda x: x["c"])
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def rephrase(instruction: Column) -> Column:
    return F.regexp_replace(instruction, r"^Which card does (\w+) have\?$", "Name the card of $1.")


def reorder(context: Column) -> Column:
    """The facts in reverse."""
    return F.array_join(F.reverse(F.split(context, r"(?<=\.) ")), " ")


def replace_values(text: Column, values: dict[str, str] | None = None) -> Column:
    """Whole words replaced; old and new values are disjoint."""
    for old, new in (values or REPLACED).items():
        text = F.regexp_replace(text, rf"\b{old}\b", new)
    return text


def conditions(probes: DataFrame) -> DataFrame:
    """The probes under four conditions that differ from the control in one factor each."""
    base = probes.withColumn("base_id", F.col("id"))
    changed = {"control": {}, "rephrase": {"instruction": rephrase(F.col("instruction"))}, "reorder": {"context": reorder(F.col("context"))}, "values": {"context": replace_values(F.col("context")), "response": replace_values(F.col("response"))}}
    out = None
    for name, columns in changed.items():
        part = base.withColumns({**columns, "condition": F.lit(name), "id": F.concat_ws("-", F.lit(name), "base_id")})
        out = part if out is None else out.unionByName(part)
    return out


def faults(probes: DataFrame) -> DataFrame:
    """``fault, item``: wrong answers, repeated probes, contexts without exactly two queries."""
    wrong = probes.where(~solve(F.col("context"), F.col("instruction")).eqNullSafe(F.col("response"))).select(F.lit("answer").alias("fault"), F.col("id").alias("item"))
    twice = probes.groupBy("context", "instruction").count().where("count > 1").select(F.lit("repeated").alias("fault"), F.col("context").alias("item"))
    odd = probes.groupBy("context").count().where("count <> 2").select(F.lit("pair").alias("fault"), F.col("context").alias("item"))
    return wrong.unionByName(twice).unionByName(odd)


def _filled(template: str, who: Column, value: Column | None = None) -> Column:
    """The template with its names in place."""
    parts = [who if x == "{who}" else value if x == "{value}" else F.lit(x) for x in re.split(r"(\{who\}|\{value\})", template) if x]
    return F.concat(*parts)


def build_task(spark: SparkSession, task: str, offsets: tuple[int, ...], split: str) -> DataFrame:
    """The probes of ``build`` as another task: one fact a line, the question by the task's template."""
    fact, question, _ = TASKS[task]
    base = build(spark, offsets, split).withColumns({"who": F.regexp_extract("instruction", r"does (\w+) have", 1), "facts": F.regexp_extract_all("context", F.lit(r"(\w+) has the \w+ card"), 1), "values": F.regexp_extract_all("context", F.lit(r"has the (\w+) card"), 1)})
    line = lambda k: _filled(fact, F.get("facts", F.lit(k)), F.get("values", F.lit(k)))
    return base.select(F.concat_ws("-", F.lit(task), "id").alias("id"), F.lit(task).alias("category"), _filled(question, F.col("who")).alias("instruction"), F.concat_ws("\n", line(0), line(1)).alias("context"), "response")


def solve_task(task: str, context: Column, instruction: Column) -> Column:
    """The value that the facts give for the name in the question, in either wording; null if they give none or several."""
    fact, *questions = (t.replace(".", r"\.").replace("?", r"\?").replace("{who}", r"(\w+)").replace("{value}", r"(\w+)") for t in TASKS[task])
    who = F.coalesce(*(F.nullif(F.regexp_extract(instruction, f"^{q}$", 1), F.lit("")) for q in questions))
    pairs = F.arrays_zip(F.regexp_extract_all(context, F.lit(fact), 1).alias("n"), F.regexp_extract_all(context, F.lit(fact), 2).alias("v"))
    found = F.transform(F.filter(pairs, lambda x: x["n"] == who), lambda x: x["v"])
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def task_conditions(probes: DataFrame, task: str) -> DataFrame:
    """A task's probes under four conditions that differ from the control in one factor each; lines are reversed."""
    _, question, other = TASKS[task]
    pattern = question.replace("?", r"\?").replace("{who}", r"(\w+)")
    lines = F.array_join(F.reverse(F.split("context", "\n")), "\n")
    changed = {"control": {}, "rephrase": {"instruction": F.regexp_replace("instruction", f"^{pattern}$", other.replace("{who}", "$1"))}, "reorder": {"context": lines}, "values": {"context": replace_values(F.col("context")), "response": replace_values(F.col("response"))}}
    out = None
    for name, columns in changed.items():
        part = probes.withColumn("base_id", F.col("id")).withColumns({**columns, "condition": F.lit(name), "id": F.concat_ws("-", F.lit(name), "id")})
        out = part if out is None else out.unionByName(part)
    return out
