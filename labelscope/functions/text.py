"""Whitespace, prompt and JSON text expressions."""

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: whitespace classes ---------------------------------------
# Code points removed by the replay side: Unicode White_Space plus U+001C-U+001F.
REPLAY_SPACE = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Code points removed by the encoder: Unicode White_Space.
ENCODER_SPACE = r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# --- end of fixed values ----------------------------------------------------


def _strip_end(text: Column, space: str) -> Column:
    # Most texts end in no space and skip the regex; the lookbehind makes every
    # run of spaces tried once, from its start.
    stripped = F.regexp_replace(text, rf"(?<![{space}])[{space}]++\z", "")
    return F.when(F.right(text, F.lit(1)).rlike(f"[{space}]"), stripped).otherwise(text)


def right_strip(text: Column) -> Column:
    return _strip_end(text, REPLAY_SPACE)


def encoder_strip(text: Column) -> Column:
    return _strip_end(text, ENCODER_SPACE)


def left_strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{REPLAY_SPACE}]++", "")


def strip(text: Column) -> Column:
    return left_strip(right_strip(text))


@dataclass(frozen=True)
class PromptTemplate:
    """Instruction/response layout; ``preamble`` is the deployment's system line."""

    preamble: str = "You are a helpful assistant."
    instruction_header: str = "### Instruction:"
    response_header: str = "### Response:"
    end_of_turn: str = "<|EOT|>"

    def prompt(self, instruction: Column) -> Column:
        head = f"\n{self.preamble}\n{self.instruction_header}\n"
        tail = f"\n{self.response_header}\n"
        return left_strip(F.concat(F.lit(head), strip(instruction), F.lit(tail)))

    def target(self, output: Column) -> Column:
        return F.concat(output, F.lit("\n" + self.end_of_turn))


def render_prompt(instruction: Column, template: PromptTemplate = PromptTemplate()) -> Column:
    return template.prompt(instruction)


def render_target(output: Column, template: PromptTemplate = PromptTemplate()) -> Column:
    return template.target(output)
