"""Raw sources to (text, category): one function per source shape, DataFrame in, DataFrame out.

Rows that can't be read are dropped and never fail a job: a null where a string is needed, a missing list, a score that
isn't there. A null inside a template shows as the word None; a column that is missing leaves no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuswright.functions import text as X
from corpuswright.schemas import CODE_LANGUAGES, OTHER, SAMPLE

MIN_SCORE = 0.75


def needs(*columns: str):
    """Makes an adapter give no rows if one of its columns is missing."""

    def wrap(adapter: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(adapter)
        def checked(raw: DataFrame, *args, **options) -> DataFrame:
            if set(columns) <= set(raw.columns):
                return adapter(raw, *args, **options)
            return raw.sparkSession.createDataFrame([], SAMPLE)

        return checked

    return wrap


def _out(raw: DataFrame, text: Column, category: Column, keep: Iterable[str]) -> DataFrame:
    return raw.select(*keep, text.alias("text"), category.alias("category"))


def allow_list(languages: str | Iterable[str] | None) -> list[str] | None:
    """Lower-cased names from a comma-separated string or several strings; None allows all."""
    if languages is None:
        return None
    return sorted({x.strip().lower() for x in (languages.split(",") if isinstance(languages, str) else languages)})


def bucket(language: Column, known: Iterable[str] = CODE_LANGUAGES) -> Column:
    """The language if it is known, by exact spelling, else OTHER."""
    return F.when(language.isin(list(known)), language).otherwise(F.lit(OTHER))


@needs("files")
def code_files(raw: DataFrame, languages: str | Iterable[str] | None = None, known: Iterable[str] = CODE_LANGUAGES, keep: Iterable[str] = ()) -> DataFrame:
    """files (language, content) one by one. With an allow-list, a file without a language ends its repository's list."""
    allowed, files = allow_list(languages), F.col("files")
    if allowed is not None:
        bad = F.array_position(F.transform(files, lambda f: f["language"].isNull()), True)
        files = F.when(bad > 0, F.slice(files, F.lit(1), (bad - 1).cast("int"))).otherwise(files)
        files = F.filter(files, lambda f: F.lower(f["language"]).isin(allowed))
    one = raw.select(*keep, F.posexplode(files).alias("pos", "file"))
    return one.select(*keep, "pos", F.col("file.content").alias("text"), bucket(F.col("file.language"), known).alias("category"))


@needs("ChatML")
def reasoning(raw: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Chat markup as it is."""
    return _out(raw, F.col("ChatML"), F.lit("reasoning"), keep)


@needs("text")
def code_instruction(raw: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Text as it is."""
    return _out(raw, F.col("text"), F.lit("instruction_code"), keep)


@needs("problem", "generated_solution")
def math(raw: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Problem and solution under their headings."""
    return _out(raw, F.concat(F.lit("Problem: "), X.shown(F.col("problem")), F.lit("\nSolution: "), X.shown(F.col("generated_solution"))), F.lit("math"), keep)


@needs("instruction", "response")
def distilled_chat(raw: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """A conversation as a struct, as JSON or as a Python literal, and the answer as its last turn.

    Rows go without a usable message or with a blank answer; columns of other types leave no rows.
    """
    kinds = {f.name: f.dataType for f in raw.schema.fields}
    given, answer = kinds["instruction"], F.col("response")
    if not isinstance(kinds["response"], T.StringType):
        return raw.sparkSession.createDataFrame([], SAMPLE)
    if isinstance(given, T.StructType) and "messages" in given.names:
        messages = X.struct_messages(F.col("instruction.messages"), given["messages"].dataType)
    elif isinstance(given, T.StringType):
        messages = X.tolerant_messages(F.col("instruction"))
    else:
        return raw.sparkSession.createDataFrame([], SAMPLE)
    rows = raw.where(F.length(X.strip(answer)) > 0).select(*keep, "response", messages.alias("_m"))
    last = F.struct(F.lit("assistant").alias("role"), answer.alias("content"))
    return _out(rows.where(F.size("_m") > 0), X.chatml(F.concat("_m", F.array(last))), F.lit("instruction"), keep)


@needs("language_score", "text")
def web(raw: DataFrame, least: float = MIN_SCORE, keep: Iterable[str] = ()) -> DataFrame:
    """Text with a language score of `least` or more (not-a-number passes)."""
    return _out(raw.where(F.col("language_score") >= least), F.col("text"), F.lit("web"), keep)


def _exchange(raw: DataFrame, user: str, assistant: str, language: str, keep: Iterable[str]) -> DataFrame:
    text = X.chatml_of(("user", F.col(user)), ("assistant", F.col(assistant)))
    return _out(raw, text, F.concat(X.shown(F.col(language)), F.lit("_instruction_code")), keep)


@needs("query", "answer", "lang")
def code_feedback(raw: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """A question and its answer as chat."""
    return _exchange(raw, "query", "answer", "lang", keep)


@needs("conversations")
def conversations(raw: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """A whole conversation as chat."""
    return _out(raw.where(F.col("conversations").isNotNull()), X.chatml(F.col("conversations")), F.lit("instruction_code_alpaca"), keep)


@needs("problem", "output", "language")
def code_generation(raw: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """A task and its program as chat."""
    return _exchange(raw, "problem", "output", "language", keep)


@needs("prompt", "response", "programming_language")
def tiny_codes(raw: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """A prompt and its program as chat."""
    return _exchange(raw, "prompt", "response", "programming_language", keep)


@needs("code", "is_vulnerable", "language")
def code_security(raw: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Code to fix, and the fixed code or the word that there is nothing to fix."""
    language = X.shown(F.col("language"))
    ask = F.concat(F.lit("Fix the following "), language, F.lit(" code:\n"), X.shown(F.col("code")), F.lit("\n"))
    fixed = F.concat(F.lit("Fixed code:\n"), X.shown(F.col("code_fixed"))) if "code_fixed" in raw.columns else F.lit(None).cast("string")
    fine = F.concat(F.lit("The following "), language, F.lit(" code is not vulnerable"))
    rows = raw.withColumn("_answer", F.when(F.coalesce(F.col("is_vulnerable").cast("boolean"), F.lit(False)), fixed).otherwise(fine)).where(F.col("_answer").isNotNull())
    return _out(rows, X.chatml_of(("user", ask), ("assistant", F.col("_answer"))), F.concat(language, F.lit("_instruction_code")), keep)


#: Every source by name; a mix is any choice of them.
ADAPTERS: dict[str, Callable[..., DataFrame]] = {
    "code_files": code_files, "reasoning": reasoning, "code_instruction": code_instruction, "math": math, "distilled_chat": distilled_chat, "web": web,
    "code_feedback": code_feedback, "conversations": conversations, "code_generation": code_generation, "tiny_codes": tiny_codes, "code_security": code_security,
}


def mix(raws: dict[str, DataFrame], **options: dict) -> list[DataFrame]:
    """The adapted sources in the order given; options by source name go to its adapter."""
    return [ADAPTERS[name](raw, **options.get(name, {})) for name, raw in raws.items()]
