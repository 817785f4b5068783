"""Prompt assembly; the wording is our own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_SOURCES, ANSWER_CHARS = 10, 6000
SYSTEM = {
    "support": "Answer from the given context and cite it by number. Say so if it does not hold the answer.",
    "code": "Write complete, secure code from the given context and cite it by number.",
    "review": "Review the given code for faults and name the place and the remedy of each.",
    "audit": "Audit the given code for security faults, worst first, and cite the context by number.",
}


def domain_sentence(names: Column) -> Column:
    return F.concat(F.lit("The questions concern "), F.array_join(names, ", "), F.lit("."))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(mode: Column, question: Column, context: Column, sources: Column) -> Column:
    system = F.lit(SYSTEM["support"])
    for name, text in SYSTEM.items():
        system = F.when(mode == name, F.lit(text)).otherwise(system)
    cited = F.array_join(F.slice(sources, 1, MOST_SOURCES), "\n")
    user = F.concat_ws("\n\n", F.concat(F.lit("Context:\n"), context), F.concat(F.lit("Sources:\n"), cited), F.concat(F.lit("Question: "), question))
    return F.array(message("system", system), message("user", user))


def repair_messages(question: Column, answer: Column, findings: Column) -> Column:
    user = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Question: "), question),
        F.concat(F.lit("Answer:\n"), F.substring(answer, 1, ANSWER_CHARS)),
        F.concat(F.lit("Remove these faults:\n"), findings),
    )
    return F.array(message("system", F.lit(SYSTEM["code"])), message("user", user))


def context_window(model: Column, default: int = 8192) -> Column:
    """Tokens of context by the size that a model's name states."""
    m = F.lower(model)
    limits = ((("32b", "70b"), 2048), (("14b",), 3072), (("7b", "8b"), 4096))
    out = None
    for names, limit in limits:
        fits = F.lit(False)
        for n in names:
            fits = fits | m.contains(n)
        out = (F.when if out is None else out.when)(fits, F.lit(min(default, limit)))
    return out.otherwise(F.lit(default))


def batch_size(free_mb: Column, base: Column) -> Column:
    """Rows to a batch by free memory."""
    part = lambda least, share: F.greatest(F.lit(least), F.floor(base / share).cast("int"))
    return F.when(free_mb < 2000, part(25, 8)).when(free_mb < 4000, part(50, 4)).when(free_mb < 8000, part(100, 2)).otherwise(base)
