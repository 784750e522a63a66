"""Model input: budget truncation over an experiment grid, prompts and chat messages."""

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from braidset.functions.labels import parse_labels
from braidset.functions.tokens import encoder_count, encoder_cuts, token_count, truncate_equally
from braidset.schemas import CONTEXT_WINDOWS, SHOTS


def as_list(df: DataFrame, col: str) -> Column:
    """A list column as it is, or parsed from its text form."""
    c = F.col(col)
    return c if dict(df.dtypes)[col].startswith("array") else parse_labels(c)


def input_text(message: Column, diff: Column, include_message) -> Column:
    """The text shown to the model (fixed format)."""
    flag = include_message if isinstance(include_message, Column) else F.lit(include_message)
    with_message = F.concat(F.lit("- given commit message:\n "), message, F.lit("\n Diff: "), diff)
    return F.when(flag, with_message).otherwise(F.concat(F.lit("- given commit diff: \n "), diff))


def add_truncated(df: DataFrame, context, include_message) -> DataFrame:
    """Add ``truncated_commit`` and ``token_length``.

    The message is never cut: it takes its tokens off the budget the diffs share,
    and the finished text may be longer than ``context``.
    """
    context = context if isinstance(context, Column) else F.lit(context)
    flag = include_message if isinstance(include_message, Column) else F.lit(include_message)
    message = F.coalesce("commit_message", F.lit(""))
    left = F.greatest(context - token_count(message), F.lit(0))
    cut = truncate_equally(as_list(df, "diff"), F.when(flag, left).otherwise(context))
    return df.withColumn("truncated_commit", input_text(message, cut, flag)).withColumn(
        "token_length", token_count(F.col("truncated_commit"))
    )


def with_settings(
    df: DataFrame,
    contexts: Sequence[int] = CONTEXT_WINDOWS,
    with_message: Sequence[bool] = (True, False),
) -> DataFrame:
    """Every case under every (context, message) setting, row by row, without a join."""
    grid = F.array(
        *[
            F.struct(F.lit(c).alias("context_len"), F.lit(m).alias("with_message"))
            for m in with_message
            for c in contexts
        ]
    )
    return df.withColumn("_s", F.explode(grid)).select("*", "_s.*").drop("_s")


def truncated_grid(
    df, contexts=CONTEXT_WINDOWS, with_message=(True, False), factory: Callable | None = None
) -> DataFrame:
    """The cases cut for every setting; ``factory`` makes a tokenizer, without it a token is four characters."""
    if factory is None:
        spread = with_settings(df, contexts, with_message)
        return add_truncated(spread, F.col("context_len"), F.col("with_message"))
    settings = [(c, m) for m in with_message for c in contexts]
    message = F.coalesce("commit_message", F.lit(""))
    # The cuts of all settings come from one pass over the texts, and no text is shuffled.
    cuts = encoder_cuts(message, as_list(df, "diff"), settings, factory)
    setting = F.array(*[F.struct(F.lit(c).alias("context_len"), F.lit(m).alias("with_message")) for c, m in settings])
    rows = df.withColumn("_s", F.explode(F.arrays_zip(setting.alias("s"), cuts.alias("cut"))))
    rows = rows.select(*df.columns, "_s.s.*", F.col("_s.cut").alias("_cut"))
    rows = rows.withColumn("truncated_commit", input_text(message, F.col("_cut"), F.col("with_message"))).drop("_cut")
    return rows.withColumn("token_length", encoder_count(F.col("truncated_commit"), factory))


def add_truncated_by_encoder(df: DataFrame, context: int, include_message: bool, factory: Callable) -> DataFrame:
    """``add_truncated`` with a real tokenizer."""
    cut = truncated_grid(df, [context], [include_message], factory)
    added = ("context_len", "with_message")
    return cut.drop(*[c for c in added if c not in df.columns])


def experiment_grid(
    df, contexts=CONTEXT_WINDOWS, shots=SHOTS, with_message=(True, False), factory: Callable | None = None
) -> DataFrame:
    """The truncated cases under every shot; truncation runs once, before the shots."""
    shot = F.explode(F.array(*map(F.lit, shots)))
    return truncated_grid(df, contexts, with_message, factory).withColumn("shot", shot)


@dataclass(frozen=True)
class Prompts:
    """Instruction text and worked examples as (message, body) pairs, both the user's."""

    system: str
    examples: Sequence[tuple[str, str]]

    def text(self, shot: str, include_message: bool) -> str:
        """Zero, one or two examples after the instructions; any other shot means two."""
        n = {"Zero-shot": 0, "One-shot": 1}.get(shot, 2)
        if n == 0:
            return self.system
        shown = [
            f"<commit_message>{m}</commit_message>\n{b}" if include_message else b
            for m, b in self.examples[:n]
        ]
        return "\n".join([f"{self.system}\n\n# Examples", *shown])

    def diff_only(self) -> str:
        return "\n\n".join([self.system, "# Examples", *[b for _, b in self.examples]])


def with_prompt(df: DataFrame, prompts: Prompts, shot="shot", include_message="with_message"):
    """Add ``system_prompt`` by looking the setting up in literals."""
    def pick(flag: bool) -> Column:
        return (
            F.when(F.col(shot) == "Zero-shot", F.lit(prompts.text("Zero-shot", flag)))
            .when(F.col(shot) == "One-shot", F.lit(prompts.text("One-shot", flag)))
            .otherwise(F.lit(prompts.text("Two-shot", flag)))
        )

    chosen = F.when(F.col(include_message), pick(True)).otherwise(pick(False))
    return df.withColumn("system_prompt", chosen)


def prompt_stats(df: DataFrame, col: str = "system_prompt") -> DataFrame:
    return df.withColumns(
        {
            "examples_count": F.regexp_count(F.col(col), F.lit("<commit_diff")),
            "has_message": F.contains(F.col(col), F.lit("<commit_message>")),
        }
    )


def chat_messages(df: DataFrame, system: str) -> DataFrame:
    """Add ``messages``: system, user and assistant turns of a training sample."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    diff = F.col("diff")
    if dict(df.dtypes)["diff"].startswith("array"):
        diff = F.to_json(diff)
    user = input_text(F.coalesce("commit_message", F.lit("")), diff, True)
    answer = F.to_json(F.struct(as_list(df, "types").alias("types")))
    return df.withColumn(
        "messages",
        F.array(turn("system", F.lit(system)), turn("user", user), turn("assistant", answer)),
    )


def render_chat(
    df: DataFrame,
    before: str = "<|im_start|>{role}<|im_sep|>",
    after: str = "<|im_end|>",
    between: str = "",
) -> DataFrame:
    """Add ``text``: the messages in one string. The marks are the tokenizer's, so they are arguments."""
    head, tail = before.split("{role}")
    one = lambda m: F.concat(F.lit(head), m["role"], F.lit(tail), m["content"], F.lit(after))
    return df.withColumn("text", F.array_join(F.transform("messages", one), between))


def reasoning_prompt(df: DataFrame, request: str) -> DataFrame:
    """Add ``reasoning_prompt``: message, types, diff and the user's ``request``. Types that do not parse are used as they are."""
    types = F.coalesce(
        F.array_join(F.from_json("types", "array<string>"), ", "), F.col("types")
    )
    text = F.concat(
        F.lit("Commit Message: "), F.coalesce("commit_message", F.lit("")),
        F.lit("\n\nAssigned Types: "), F.coalesce(types, F.lit("")),
        F.lit("\n\nGit Diff:\n"), F.coalesce("diff", F.lit("")),
        F.lit("\n\n" + request),
    )
    return df.withColumn("reasoning_prompt", text)


def replace_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Drop ``name`` when it is there and add it anew at the end."""
    return df.drop(name).withColumn(name, value)
